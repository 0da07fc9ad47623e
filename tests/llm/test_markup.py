import re
import time

import pytest
from pyspark.sql import functions as F

from lexloom.llm.markup import TRIGGER, clean, clean_column, clean_markup

PLAIN = [
    "n < 32, m > 13.", "R&D 217 & 4.", "C:\\actas\\1919.", "(*) 354.", "a | b | 376.", "-- 95 --", "n == 253?", "'204' \"88\" ''.", "$ 52 + $ 58.", "100 % ^ 34.",
    "291 <= 86 => 86.", "[sic] (350).", "11 * 173 * 2.", "{133} ~ 75.", "#235, #54.", "T = b1 x p", "a) el plazo\nb) la fianza", "snake_case_name", "[4473] (2/b)", "5 > 3", "75·*·290·*·2.", "a.74*26*2.b", "(*) 6.\ny (*) 7.", "'1' \"2\" ''.\n'3' \"4\" ''.", "a ~ b\nc ~ d",
]
MARKED = {
    "<b>Ley</b>": "Ley", "<H2 class=\"tit\">Artículo 2</H2>": "## Artículo 2", "inspecci&oacute;n": "inspección", "&lt;p&gt;Ley": "Ley", "<!-- 3 -->Ley": "Ley", "a</font> b": "a b", "m<sup>2</sup>": "m^{2}",
    "<ul>\n<li>uno</li>\n<li>dos</li>\n</ul>": "- uno\n\n- dos", "<pre><code>x = 1</code></pre>": "```\nx = 1\n```", "&#237;": "í", "uno<br/>dos": "uno\ndos",
    "# **Título**": "# Título", "Título\n=====": "# Título", "* * *\nLey": "Ley", "> cita": "cita", "- [ ] tarea": "- tarea", "[texto](https://a.example/1) b": "texto b", "![fig](f.png)": "fig", "nota[^3] b": "nota[3] b",
    "el `plan` anual": "el `plan` anual", "~~no~~ sí": "no sí", "*canon* b": "canon b", "\\*": "*", "__dos__": "dos", "```\ncode *x*\n```": "```\ncode *x*\n```", "**abierto": "abierto", "| a | b |\n|---|:--|\n| 1 | 2 |": "a | b\n1 | 2",
    "== Título ==": "## Título", "[[Norma 3|texto]] b": "texto b", "[[texto]]": "texto", "{{nota|5}} b": "[5] b", "'''negrita''' b": "negrita b", "[[Categoría:leyes]]\nb": "b", "<nowiki>*x*</nowiki>": "*x*", "__NOTOC__\nb": "b", "[https://w.example/1 texto] b": "texto b",
    "a ~~no\nsí~~ b": "a no\nsí b", "[uno\nb)](https://a.example/3) c": "uno\nb) c", "![a.\nb](fig4.png)": "a.\nb", "[a [375] b](https://a.example/1) c": "a [375] b c", "**a\nb** c": "a\nb c", "''a\nb'' c": "a\nb c", "`a\nb` c": "`a\nb` c",
    "\\section{Título}": "## Título", "\\subsection*{A}\\label{s1}\nb": "### A\nb", "caf\\'{e}": "café", "a\\~nos": "años", "\\textbf{x} b": "x b", "$x_{5}$": "$x_{5}$", "\\S~7 b": "§ 7 b", "{\\bf Título}": "## Título", "x\\footnote{4} b": "x [4] b",
    "\\begin{itemize}\n\\item uno\n\\end{itemize}": "- uno", "\\[ R = b \\]": "$R = b$", "fiscaliza\\c{c}ão": "fiscalização", "munic\\'{\\i}pio": "município", "\\begin{verbatim}\na_b\n\\end{verbatim}": "```\na_b\n```",
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_stay(text):
    assert clean(text) == (text, [])


@pytest.mark.parametrize("text", MARKED)
def test_markup_goes_and_structure_stays(text):
    got, kinds = clean(text)
    assert got == MARKED[text] and kinds


def test_limits(spark):
    assert clean(None) == (None, []) and clean("") == ("", [])
    long = "palabra " * 100_000 + "<b>x</b>"
    assert clean(long)[1] == ["html"]
    rows = [("a", "<b>x</b>", 1), ("a", "<b>x</b>", 1), ("b", None, 2), ("c", "", 3), ("d", "n < 3", 4)]
    df = spark.createDataFrame(rows, "id string, t string, marcas int")
    got = [(r.id, r.texto_limpio, list(r.marcas)) for r in clean_markup(df, "t").collect()]
    assert got == [("a", "x", ["html"]), ("a", "x", ["html"]), ("b", None, []), ("c", "", []), ("d", "n < 3", [])]


def test_trigger_lets_no_markup_by(spark):
    texts = [(t,) for t in MARKED]
    assert spark.createDataFrame(texts, "t string").where(f"not t rlike r'{TRIGGER.replace(chr(39), chr(92) + 'x27')}'").collect() == []


def test_trigger_lets_every_kind_of_markup_through(spark):
    texts = ["see [text][1] here", "one &frac12; and m&sup2;", "list\n     - deep item", "list\n\t\t\t\t+ deep item", "      == Título ==", "x\n\t\t\t\t| a | b |"]
    assert all(clean(t)[1] for t in texts)
    got = spark.createDataFrame([(t,) for t in texts], "t string").where(F.size(clean_column("t")["marcas"]) > 0)
    assert sorted(r.t for r in got.collect()) == sorted(texts)


UNCLOSED = {
    "Ley 1.\n<!-- nota\nArtículo 1. Uno.\nArtículo 2. Dos.": "Ley 1.\n nota\nArtículo 1. Uno.\nArtículo 2. Dos.",
    "Inicio <script>Artículo 1 <b>uno</b>": "Inicio\nArtículo 1 uno", "a\n```\n**b** c\nd": "a\nb c\nd", "a <pre>\n**b** c": "a \nb c".replace(" \n", "\n\n"), "\\begin{verbatim}\n\\textbf{b} c": "b c", "<h2>Título\nLey": "Título\nLey",
}
NESTED = {
    "[[a|[[b|c]]]] {{x|{{y|z}}}}": "c [z]", "\\textbf{a \\emph{b {\\it c} \\texttt{d}} e} f": "a b c d e f", "\\textbf{a {b} c} d": "a {b} c d", "\\textbf{" * 30 + "x" + "}" * 30: "x", "**a _b ~~c~~ d_ e** f": "a b c d e f", "[[A|" * 20 + "x" + "]]" * 20: "x",
}


@pytest.mark.parametrize("text", UNCLOSED | NESTED)
def test_unclosed_markup_costs_its_sign_and_nested_markup_goes_whole(text):
    assert clean(text)[0] == (UNCLOSED | NESTED)[text]


def test_no_word_is_lost_behind_an_opener():
    words = " ".join(f"palabra{k}" for k in range(300))
    for opener in ("<!--", "<script>", "<pre>", "<style>", "```\n", "~~~\n", "<nowiki>", "\\begin{verbatim}", "<code>", "<h1>", "\\[", "\\(", "$$", "[[", "{{", "**", "_", "''", "\\textbf{", "{\\bf ", "`"):
        assert re.findall(r"palabra\d+", clean(f"antes\n{opener}{words}")[0]) == words.split(), opener


@pytest.mark.parametrize("unit", ["<", "<!--", "<script>", "<h1>", "<sup>", "&lt;b", "\\", "\\textbf{", "\\section[", "\\[", "$_", "$$ a", "[[a", "{{a", "[[a ]]", "[a", "](", "[http://a ", "''a ", "''a b'c ", "== a", "# #", "*a ", "_a ", "_a", "__A", "a_", "~~a ", "`a ", "```\n", "- ", "| a", "<b a="])
def test_time_grows_with_the_length(unit):
    began = time.process_time()
    clean((unit * 200_000)[:200_000])
    clean(("x " + unit) * (200_000 // (len(unit) + 2)))
    assert time.process_time() - began < 8  # by the square it would be minutes
