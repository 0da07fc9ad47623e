"""Problem 4: clean text from HTML, Markdown, wiki and LaTeX markup.

``clean`` rewrites one text by rules per kind of markup and tells which kinds it met.
Headings come out as ``# title`` (level by number of signs), list items as ``- item``, code
in fences or back ticks, formulas between dollar signs; other markup is removed and its
words are kept. Signs that only mean themselves (a lone ``<``, ``a | b``, ``$ 5``, paths
with back slashes, ``a)`` lists) stay as they are. A text without markup is returned
unchanged. The result is a fixed point for the kept structure: it is read as Markdown.

Markup that is never closed costs its own sign (or line), no text behind it. Openers meet their closers in
one scan each, nested groups are taken off by a stack, so the time grows with the length of the text.
Links and groups within more than ``DEEPEST`` others lose their signs but keep all their words.

Defined results: null gives null and no kinds; '' gives ''.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Element names of HTML and of wiki extensions.
TAGS = (
    "a abbr address article aside b big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em"
    " figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark math meta nav"
    " noscript nowiki ol p pre q ref references s samp script section small span strike strong style sub summary sup table tbody td tfoot"
    " th thead time title tr tt u ul var wbr gallery syntaxhighlight source poem"
)
# LaTeX commands that occur in running text.
COMMANDS = (
    "part chapter section subsection subsubsection paragraph subparagraph textbf textit texttt textsc textrm textsf emph underline footnote"
    " label ref pageref cite url href item begin end par noindent bf it tt sc rm sf em large Large small footnotesize normalsize centering"
    " S P ss ae AE oe OE o O aa AA l L i j c r H k v u b d t dots ldots textdegree newline newpage clearpage hline hspace vspace title author"
    " date maketitle tableofcontents frac sqrt cdot leq geq times sum int left right alpha beta gamma delta"
)
INLINE_TAGS = "a|abbr|b|big|cite|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|time|tt|u|var|ref|wbr|code|nowiki"
_TAG = "(?:" + "|".join(sorted(TAGS.split(), key=len, reverse=True)) + ")"
_ATTR = r"(?:\s[^<>]*)?"
_COMMAND = "(?:" + "|".join(sorted(COMMANDS.split(), key=len, reverse=True)) + ")"
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "r": "\u030a", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "S": "§", "P": "¶", "dots": "...", "ldots": "...", "textdegree": "°"}
LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6, "title": 1}
MATH_COMMANDS = {"frac", "sqrt", "cdot", "leq", "geq", "times", "sum", "int", "left", "right", "alpha", "beta", "gamma", "delta"}

#: Java pattern: whatever holds markup matches it (it also lets many plain texts through).
TRIGGER = (
    r"(?m)<(?:[A-Za-z/!])|&(?:#|[A-Za-z][A-Za-z0-9]{1,30};)|[\\*`~$]|__|_\S|''|\[\[|\]\]|\{\{|\}\}|\{\||\|\}|\]\(|\]\[|\[\^|\[https?:|^[ \t]*(?:#|=|>|[-+|]|\d{1,9}[.)][ \t])|[-=_]{3,}"
)


def _accent(m: re.Match) -> str:
    mark, letter = m.group(1), m.group(2) or m.group(3) or m.group(4) or ""
    letter = letter.strip("{}").removeprefix("\\")
    return unicodedata.normalize("NFC", letter + ACCENTS[mark]) if letter else ""


class Cleaner:
    """One text on its way; ``kinds`` collects what was met."""

    def __init__(self, text: str) -> None:
        self.text, self.kinds, self.kept = text, set(), []
        self.mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)
        self.mark2 = next(c for c in map(chr, range(0xF8FE, 0xE000, -1)) if c not in text)

    def sub(self, kind: str, pattern: re.Pattern, to: str | Callable) -> None:
        self.text, n = pattern.subn(to, self.text)
        if n:
            self.kinds.add(kind)

    def pairs(self, kind: str, opener: re.Pattern, closer: Callable[[str], re.Pattern], to: Callable[[re.Match, str], str | None]) -> None:
        """What stands between an opener and the next closer is rewritten; ``to`` may refuse with None.

        The closer follows from the opener's first group. Where no closer is left for a group, none is sought again.
        """
        text, out, at, none = self.text, [], 0, set()
        m = opener.search(text)
        while m:
            name = (m.group(1) or "").lower() if opener.groups else ""
            end = None if name in none else closer(name).search(text, m.end())
            new = to(m, text[m.end() : end.start()]) if end else None
            if end is None:
                none.add(name)
            if new is None:
                m = opener.search(text, m.end())
                continue
            out += [text[at : m.start()], new]
            at = end.end()
            self.kinds.add(kind)
            m = opener.search(text, at)
        if at:
            self.text = "".join(out) + text[at:]

    def keep(self, text: str) -> str:
        """A place holder for text that no later rule may touch."""
        self.kept.append(text)
        return f"{self.mark}{len(self.kept) - 1}{self.mark2}"

    def restore(self) -> None:
        place = re.compile(f"{self.mark}(\\d+){self.mark2}")
        while place.search(self.text):
            self.text = place.sub(lambda m: self.kept[int(m.group(1))], self.text)


def _heading(c: Cleaner, level: int, title: str) -> str:
    """A heading line whose signs no later rule reads as Markdown of the source."""
    return "\n" + c.keep("#" * level + " ") + " ".join(title.split()) + "\n"


def _re(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags | re.MULTILINE)


_NL = r"\n(?![ \t]*\n)"  # inline markup may run over a line end, not over an empty line
_LABEL = rf"(?:[^\[\]\n]|\[[^\[\]\n]*\]|{_NL})"

DEEPEST = 64


def _closing(pattern: str) -> Callable[[str], re.Pattern]:
    """The closers of an opener, one pattern for each name."""
    return lru_cache(64)(lambda name: _re(pattern.replace("NAME", re.escape(name)), re.IGNORECASE))


_FENCE = _re(r"^[ ]{0,3}(```+|~~~+)([^\n`]*)$\n?")
_PRE = _re(r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?", re.IGNORECASE)
_PRE_END = _closing(r"(?:</code>\s{0,80})?</pre\s*>")
_CODE = _re(r"<(code|tt|kbd|samp|syntaxhighlight|source)\b[^<>]*>", re.IGNORECASE)
_TAG_END = _closing(r"</NAME\s*>")
_VERBATIM, _VERBATIM_END = _re(r"\\begin\{verbatim\}"), _closing(r"\\end\{verbatim\}")
_NOWIKI = _re(r"<(nowiki)>", re.IGNORECASE)
_TICK = _re(rf"(?<!`)(`{{1,2}})(?!`)((?:[^`\n]|{_NL})+)\1(?!`)")
_DROPPED = _re(r"<(script|style)\b[^<>]*>", re.IGNORECASE)
_COMMENT, _COMMENT_END = _re(r"<!--"), _closing(r"-->")
_COMMENT_OPEN = _re(r"<!DOCTYPE[^<>]*>|<!--", re.IGNORECASE)
_H, _H_END = _re(r"<h([1-6])\b[^<>]*>", re.IGNORECASE), _closing(r"</hNAME\s*>")
_LI = _re(r"\s*<li\b[^<>]*>\s*", re.IGNORECASE)
_BREAK = _re(r"<(?:br|hr)\b[^<>]*/?>[ \t]*\n?", re.IGNORECASE)
_CELL = _re(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", re.IGNORECASE)
_SUP, _SUP_END = _re(r"<su([pb])\b[^<>]*>", re.IGNORECASE), _closing(r"</suNAME\s*>")
_REF = _re(r"<(ref)\b[^<>/]*>", re.IGNORECASE)
_INLINE = _re(rf"<(?=[A-Za-z/])/?(?:{INLINE_TAGS}){_ATTR}/?>", re.IGNORECASE)
_BLOCK = _re(rf"<(?=[A-Za-z/])/?{_TAG}{_ATTR}/?>", re.IGNORECASE)
_CUT = _re(rf"<(?=[A-Za-z/])(?:/?{_TAG}|{_TAG}\s+[\w-]+=[^<>]*)\Z", re.IGNORECASE)
_ENTITY = _re(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ESCAPED = re.compile(rf"&lt;(/?{_TAG}\b(?:(?!&[lg]t;).)*?)&gt;", re.IGNORECASE | re.DOTALL)

_MATH = (
    (_re(r"\\begin\{((?:equation|align|displaymath|math|eqnarray|gather)\*?)\}"), _closing(r"\\end\{NAME\}")),
    (_re(r"\\\["), _closing(r"\\\]")),
    (_re(r"\\\("), _closing(r"\\\)")),
)
_MATH_BLOCK = _re(r"\$\$(?=\s*[^\s$])([^$]+)\$\$")
_FORMULA = re.compile(r"[\\_^{=]")
_ACCENT_SIGN = _re(r"\\(['`^\"~=.])(?:\{(\\?[A-Za-z])\}|(\\[ij](?![A-Za-z]))(?:\{\})?|([A-Za-z]))")
_ACCENT_WORD = _re(r"\\([crvuHk])(?:\{(\\?[A-Za-z])\}|[ ](\\[ij])(?![A-Za-z])|[ ]([A-Za-z])(?![A-Za-z]))")
_SECTION = _re(r"[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]\n]{0,200}\])?\{([^{}\n]*)\}(?:[ \t]*\\label\{[^{}\n]*\})?[ \t]*\n?")
_OLD_HEADING = _re(r"^[ \t]*\{\\(?:bf|large|Large|sc)[ ]+([^{}\n]*)\}[ \t]*$")
_GROUPS = _re(
    r"\\href\{[^{}\n]*\}\{|\\(?:textbf|textit|texttt|textsc|textrm|textsf|emph|underline|url)\{|(\\footnote(?:mark)?(?:\[[^\]\n]{0,200}\])?\{)"
    r"|\{\\(?:bf|it|tt|sc|rm|sf|em|large|Large|small|footnotesize)\b[ ]?|\\[{}]|[{}]"
)
_DROP = _re(r"\\(?:label|ref|pageref|cite)\{[^{}\n]*\}|\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]{0,200}\])?[ \t]*\n?|\\(?:h|v)space\*?\{[^{}\n]*\}")
_ITEM = _re(r"^[ \t]*\\item\b[ \t]*(?:\[[^\]\n]{0,200}\])?")
_LETTER = _re(r"\\(ss|ae|AE|oe|OE|o|O|aa|AA|l|L|S|P|dots|ldots|textdegree)(?:\{\}|(?![A-Za-z\\]))(?:~|[ ](?=\d))?")
_SWITCH = _re(r"\\(?:par|noindent|bf|it|tt|sc|rm|sf|em|large|Large|small|footnotesize|normalsize|centering|newline|newpage|clearpage|hline|maketitle|tableofcontents)(?![A-Za-z\\])[ \t]?")
_UNCLOSED = _re(rf"\\(?:{_COMMAND})\*?(?=[{{\[])(?:\[[^\]\n]{0,200}\])?\{{?|\{{\\(?:bf|it|tt|sc|rm|sf|em)\b[ ]?")
_LINE_END = _re(r"\\\\(?:\[[^\]\n]{0,200}\])?[ \t]*$")
_TIE = _re(r"(?<=[\w.§])~(?=\w)")

_WIKI_H = _re(r"^[ \t]*(={1,6})([^=\n]+)(={1,6})[ \t]*$")
_WIKI_DROP = _re(r"\[\[(?:Categoría|Categoria|Catégorie|Kategorie|Kategori|Categorie|Category|Категория|File|Archivo|Fichier|Datei|Bestand|Fil|Image|Imagen)\s*:[^\[\]\n]*\]\][ \t]*\n?", re.IGNORECASE)
_WIKI_URL = _re(r"\[https?://[^\s\[\]]+(?:[ \t]+([^\]\n]{0,500}))?\]")
_WIKI_SIGNS = _re(r"\[\[|\]\]|\{\{|\}\}|\n[ \t]*\n")
_WIKI_OPEN = _re(r"\[\[(?=\w)|(?<=\w)\]\]|\{\{(?=\w)|(?<=\w)\}\}")
_WIKI_WORD = _re(r"^[ \t]*__[A-Z]{3,}__[ \t]*\n?")
_WIKI_BOLD = _re(rf"('{{5}}|'{{3}}|(?<!')'{{2}}(?!'))(?=[\w«(\[])((?:[^'\n]|{_NL})*(?:'(?:[^'\n]|{_NL})+)*?[^\s'])\1(?!')")
_WIKI_BOLD_OPEN = _re(r"'{3}(?=\w)|(?<=\w)'{3}|(?<![\w'])''(?=\w)")
_WIKI_TABLE = _re(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n|]*|\|\+[^\n]*)$\n?")
_WIKI_ROW = _re(r"^[ \t]*[|!](?![-}|+])[ \t]*([^\n]*?\|\|[^\n]*)$")
_WIKI_CELL = _re(r"^[ \t]*[|!](?![-}|+])[ \t]*([^\n|]*)$")

_ESCAPE = _re(r"\\([*_#`\[\]{}()<>+!|~-])")
_ATX = _re(r"^[ ]{0,3}(#{1,6})[ \t]+([^\n]*)$")
_SETEXT = _re(r"^(?![ \t]*(?:[-*+>#|]|\d+[.)])[ \t])([^\n]+)\n[ ]{0,3}(?:(=){3,}|(-){3,})[ \t]*$")
_RULE = _re(r"^[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|={5,})$\n?")
_QUOTE = _re(r"^[ ]{0,3}>+[ \t]+(?=\S)")
_TASK = _re(r"^([ \t]*)[-*+][ \t]+\[[ xX]\][ \t]+")
_BULLET = _re(r"^([ \t]*)[-*+][ \t]+(?=[^\s*+-])")
_IMAGE = _re(rf"!\[({_LABEL}*?)\]\([^()\n]*\)")
_LINK = _re(rf"\[({_LABEL}+?)\]\((?:https?://|mailto:|/|#|\w[\w.-]*\.\w+)[^()\n]*\)")
_LINK_END = _re(r"\]\((?:https?://[^()\s]*|[\w-]+\.(?:png|jpe?g|gif|svg))\)")
_LINK_REF = _re(r"\[([^\[\]\n]+)\]\[\w*\]")
_FOOT = _re(r"\[\^(\w+)\]")
_STRONG = _re(rf"(?<!\d)(\*{{1,3}})(?=[^\s*·])((?:[^*\n]|{_NL})*?[^\s*·])\1(?!\*)")
_UNDER = _re(rf"(?<!\w)(_{{1,3}})(?=[^\s_])((?:[^_\n]|{_NL}|(?<=\w)_(?=\w))*?[^\s_])\1(?!\w)")
_STRIKE = _re(rf"~~(?=[^\s~])((?:[^~\n]|{_NL})+?)~~")
_STRIKE_OPEN = _re(r"(?<![~\w])~~(?=\w)|(?<=\w)~~(?![~\w])")
_STRONG_OPEN = _re(r"\*\*(?=\w)|(?<=\w)\*\*|(?<![\w*(])\*(?=\w)|(?<=\w)\*(?![\w*)]|\s*\d)")
_MD_TABLE = _re(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?")
_MD_ROW = _re(r"^[ \t]*\|([^\n]*)\|[ \t]*$")
_TABLE_PART = _re(r"^[ \t]*\|[ \t]*[^\n|]+(?:\|[^\n|]*)+\|[ \t]*$")


def _html(c: Cleaner) -> None:
    if "&" in c.text:
        c.sub("html", _ESCAPED, lambda m: "<" + m.group(1) + ">")
    if "<" in c.text:
        c.pairs("html", _DROPPED, _TAG_END, lambda m, inner: "")
        c.pairs("html", _COMMENT, _COMMENT_END, lambda m, inner: "")
        c.sub("html", _COMMENT_OPEN, "")
        c.pairs("html", _H, _H_END, lambda m, inner: _heading(c, int(m.group(1)), re.sub(r"<[^<>]*>", " ", inner)))
        c.pairs("html", _SUP, _SUP_END, lambda m, inner: None if "\n" in inner or len(inner) > 200 else ("^" if m.group(1).lower() == "p" else "_") + c.keep("{" + inner + "}"))
        c.pairs("wiki", _REF, _TAG_END, lambda m, inner: f" [{inner.strip()}]" if inner.strip() else "")
        c.sub("html", _LI, lambda m: "\n" + c.keep("- "))
        c.sub("html", _BREAK, "\n")
        c.sub("html", _CELL, " | ")
        c.sub("html", _INLINE, "")
        c.sub("html", _BLOCK, "\n")
        c.sub("html", _CUT, "")
    if "&" in c.text:
        c.sub("html", _ENTITY, lambda m: c.keep(s) if (s := html.unescape(m.group())) in "<>&*_\\$`" else s.replace("\xa0", " "))


def _dollars(c: Cleaner) -> None:
    """Formulas between two single dollar signs of one line: what stands between has a sign of formulas."""
    text, out, at = c.text, [], 0
    signs = [m.start() for m in re.finditer(r"\$", text)]
    i = 0
    while i + 1 < len(signs):
        a, b = signs[i], signs[i + 1]
        inner = text[a + 1 : b]
        opens = a == 0 or not (text[a - 1] in "\\$" or text[a - 1].isalnum() or text[a - 1] == "_")
        after = text[b + 1 : b + 2]
        if opens and inner and "\n" not in inner and inner[-1] != "\\" and not (after == "$" or after.isalnum() or after == "_") and _FORMULA.search(inner):
            out += [text[at:a], c.keep("$" + inner.strip() + "$")]
            at, i = b + 1, i + 2
        else:
            i += 1
    if at:
        c.text = "".join(out) + text[at:]
        c.kinds.add("latex")


def _groups(c: Cleaner) -> None:
    """Takes off commands around groups, however nested; groups of no command and unclosed ones stay."""
    text, drop, stack = c.text, [], []
    for m in _GROUPS.finditer(text):
        sign = m.group()
        if sign == "}":
            if stack:
                opener = stack.pop()
                if opener.group() != "{":
                    note = bool(opener.group(1))
                    drop += [(opener.start(), opener.end(), " [" if note else ""), (m.start(), m.end(), "]" if note else "")]
        elif sign not in ("\\{", "\\}"):
            stack.append(m)
    if drop:
        c.kinds.add("latex")
        out, at = [], 0
        for begin, end, new in sorted(drop):
            out += [text[at:begin], new]
            at = end
        c.text = "".join(out) + text[at:]


def _latex(c: Cleaner) -> None:
    formula = lambda inner: c.keep("$" + " ".join(inner.split()) + "$") if inner.strip() else None
    for opener, closer in _MATH if "\\" in c.text else ():
        c.pairs("latex", opener, closer, lambda m, inner: formula(inner))
    if "$$" in c.text:
        c.sub("latex", _MATH_BLOCK, lambda m: formula(m.group(1)))
    if "$" in c.text:
        _dollars(c)
    if "\\" not in c.text:
        return
    c.sub("latex", _ACCENT_SIGN, _accent)
    c.sub("latex", _ACCENT_WORD, _accent)
    c.sub("latex", _SECTION, lambda m: _heading(c, LEVELS[m.group(1)], m.group(2)))
    c.sub("latex", _OLD_HEADING, lambda m: _heading(c, 2, m.group(1)))
    _groups(c)
    c.sub("latex", _DROP, "")
    c.sub("latex", _ITEM, lambda m: c.keep("- "))
    c.sub("latex", _LETTER, lambda m: LETTERS[m.group(1)] + (" " if m.group(1) in "SP" else ""))
    c.sub("latex", _SWITCH, "")
    c.sub("latex", _UNCLOSED, "")
    c.sub("latex", _LINE_END, "")
    if "latex" in c.kinds:
        c.sub("latex", _TIE, " ")


def _note(c: Cleaner, inner: str) -> str:
    """What stays of a note between double braces: a fraction, else its last part."""
    name, *args = inner.split("|")
    if name.strip().lower() == "frac" and len(args) == 2:
        return c.keep(rf"$\frac{{{args[0]}}}{{{args[1]}}}$")
    last = args[-1] if args else ""
    return f"[{last}]" if last and not (last[0] == "[" and last[-1] == "]") else last


def _brackets(c: Cleaner) -> None:
    """Links and notes in double brackets and braces, from the inside out; none runs over an empty line."""
    text, at, changed = c.text, 0, False
    stack: list[tuple[str, list[str]]] = [("", [])]

    def flush() -> None:
        while len(stack) > 1:
            sign, parts = stack.pop()
            stack[-1][1].extend([sign, *parts])

    for m in _WIKI_SIGNS.finditer(text):
        sign = m.group()
        stack[-1][1].append(text[at : m.start()])
        at = m.end()
        if sign in ("[[", "{{"):
            if len(stack) <= DEEPEST:
                stack.append((sign, []))
            else:
                changed = True
        elif sign in ("]]", "}}"):
            opener = "[[" if sign == "]]" else "{{"
            if stack[-1][0] != opener:
                stack[-1][1].append(sign)
                continue
            inner = "".join(stack.pop()[1])
            if opener == "{{" and "\n" in inner:
                stack[-1][1].append(opener + inner + sign)
                continue
            changed = True
            stack[-1][1].append(inner.partition("|")[2] or inner.partition("|")[0] if opener == "[[" else _note(c, inner))
        else:
            flush()
            stack[-1][1].append(sign)
    flush()
    if changed:
        c.kinds.add("wiki")
        c.text = "".join(stack[0][1]) + text[at:]


def _wiki_heading(c: Cleaner, m: re.Match) -> str:
    return _heading(c, len(m.group(1)), m.group(2)) if m.group(1) == m.group(3) and m.group(2).strip() else m.group()


def _wiki(c: Cleaner) -> None:
    if "=" in c.text:
        before = c.text
        c.text = _WIKI_H.sub(lambda m: _wiki_heading(c, m), c.text)
        if c.text != before:
            c.kinds.add("wiki")
    if "[" in c.text:
        c.sub("wiki", _WIKI_DROP, "")
    if "[[" in c.text or "{{" in c.text:
        _brackets(c)
    if "[http" in c.text:
        c.sub("wiki", _WIKI_URL, lambda m: m.group(1) or "")
    if "[[" in c.text or "]]" in c.text or "{{" in c.text or "}}" in c.text:
        c.sub("wiki", _WIKI_OPEN, "")
    if "__" in c.text:
        c.sub("wiki", _WIKI_WORD, "")
    if "''" in c.text:
        for _ in range(3):  # runs of five, three and two signs
            c.sub("wiki", _WIKI_BOLD, r"\2")
        c.sub("wiki", _WIKI_BOLD_OPEN, "")
    if "{|" in c.text or "|}" in c.text or "|-" in c.text:
        before = c.text
        c.sub("wiki", _WIKI_TABLE, "")
        if c.text != before:
            c.sub("wiki", _WIKI_ROW, lambda m: m.group(1).replace("||", "|"))
            c.sub("wiki", _WIKI_CELL, r"\1")


def _markdown(c: Cleaner) -> None:
    if "(*)" in c.text:  # a note sign of its own
        c.text = c.text.replace("(*)", c.keep("(*)"))
    if "\\" in c.text:
        c.sub("markdown", _ESCAPE, lambda m: c.keep(m.group(1)))
    c.sub("markdown", _ATX, lambda m: f"{m.group(1)} {m.group(2).rstrip(' \t').rstrip('#').rstrip(' \t')}")
    c.sub("markdown", _SETEXT, lambda m: ("# " if m.group(2) else "## ") + m.group(1).strip())
    c.sub("markdown", _RULE, "")
    before = c.text
    c.sub("markdown", _MD_TABLE, "")
    c.sub("markdown", _MD_ROW, lambda m: m.group(1).strip(" \t")) if c.text != before or _TABLE_PART.search(c.text) else None
    c.sub("markdown", _QUOTE, "")
    c.sub("markdown", _TASK, r"\1- ")
    c.sub("markdown", _BULLET, r"\1- ")
    if "[" in c.text:
        c.sub("markdown", _IMAGE, r"\1")
        c.sub("markdown", _LINK, r"\1")
        c.sub("markdown", _LINK_REF, r"\1")
        c.sub("markdown", _LINK_END, "")
        c.sub("markdown", _FOOT, r"[\1]")
    for _ in range(6):  # signs come in runs of up to three, of two kinds
        before = c.text
        if "*" in c.text:
            c.sub("markdown", _STRONG, r"\2")
        if "_" in c.text:
            c.sub("markdown", _UNDER, r"\2")
        if c.text == before:
            break
    if "~~" in c.text:
        c.sub("markdown", _STRIKE, r"\1")
        c.sub("markdown", _STRIKE_OPEN, "")
    if "*" in c.text:
        c.sub("markdown", _STRONG_OPEN, "")


def _fences(c: Cleaner) -> None:
    """Blocks of code between fence lines; of a fence that is never closed only its line goes."""
    lines = list(_FENCE.finditer(c.text))
    out, at, i = [], 0, 0
    open_for_good: dict[str, int] = {}  # per sign: fences of at least this length have no closer any more
    while i < len(lines):
        fence = lines[i].group(1)
        end = None
        if len(fence) < open_for_good.get(fence[0], 1 << 60):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].group(1).startswith(fence) and not lines[k].group(2).strip(" \t`~")), None)
            if end is None:
                open_for_good[fence[0]] = len(fence)
        out.append(c.text[at : lines[i].start()])
        if end is None:
            at, i = lines[i].end(), i + 1
        else:
            out.append(c.keep("```\n" + c.text[lines[i].end() : lines[end].start()].rstrip("\n") + "\n```") + ("\n" if lines[end].group().endswith("\n") else ""))
            at, i = lines[end].end(), end + 1
    if lines:
        c.kinds.add("markdown")
        c.text = "".join(out) + c.text[at:]


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """The clean text and the kinds of markup met, sorted (none: the text is returned as it is)."""
    if not text:
        return text, []
    c = Cleaner(text.replace("\r\n", "\n").replace("\r", "\n"))
    if "```" in text or "~~~" in text:
        _fences(c)
    if "<" in text:
        c.pairs("wiki", _NOWIKI, _TAG_END, lambda m, inner: c.keep(inner))
        c.pairs("html", _PRE, _PRE_END, lambda m, inner: c.keep("```\n" + html.unescape(inner).strip("\n") + "\n```"))
        c.pairs("html", _CODE, _TAG_END, lambda m, inner: c.keep("`" + html.unescape(inner) + "`"))
    if "\\begin{verbatim}" in text:
        c.pairs("latex", _VERBATIM, _VERBATIM_END, lambda m, inner: c.keep("```\n" + inner.strip("\n") + "\n```"))
    if "`" in text:
        c.sub("markdown", _TICK, lambda m: c.keep("`" + m.group(2) + "`"))
    _html(c)
    _latex(c)
    _wiki(c)
    _markdown(c)
    if not c.kinds:
        return text, []
    c.restore()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", c.text, flags=re.MULTILINE)).strip("\n"), sorted(c.kinds)


RESULT = StructType([StructField("texto_limpio", StringType()), StructField("marcas", ArrayType(StringType(), False))])


@F.pandas_udf(RESULT)
def clean_udf(texts: pd.Series) -> pd.DataFrame:
    done = [clean(t) for t in texts]
    return pd.DataFrame({"texto_limpio": pd.Series([t for t, _ in done], dtype=object), "marcas": pd.Series([k for _, k in done], dtype=object)})


def clean_column(text: str):
    """Column struct(texto_limpio, marcas). Rows without any trigger sign never reach Python."""
    col = F.col(text)
    return clean_udf(F.when(col.rlike(TRIGGER), col))


def clean_markup(df: DataFrame, text: str) -> DataFrame:
    """``df`` with columns texto_limpio and marcas (null text: null and empty). Clashing columns are replaced."""
    named = df.withColumn("__c", clean_column(text))
    return named.withColumns({
        "texto_limpio": F.coalesce(F.col("__c.texto_limpio"), F.col(text)),
        "marcas": F.coalesce(F.col("__c.marcas"), F.array().cast("array<string>")),
    }).drop("__c")
