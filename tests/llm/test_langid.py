import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import langid

SAY = {
    "es": "el consejo rector podrá suspender la concesión vigente en los términos señalados por la norma y las obras menores",
    "pt": "o conselho diretivo poderá suspender a licença em vigor nas condições indicadas pela norma e as obras menores não",
    "it": "il consiglio direttivo può sospendere la concessione vigente nei termini indicati dalla norma e le opere minori degli",
    "fr": "le conseil de direction peut suspendre la concession en vigueur dans les conditions indiquées par le texte et les travaux",
    "de": "der leitende Rat kann die gültige Erlaubnis unter den genannten Bedingungen aussetzen und die kleineren Arbeiten nicht",
    "nl": "de raad van bestuur kan de geldende vergunning onder de genoemde voorwaarden schorsen en de kleinere werken niet",
    "sv": "det ledande rådet får upphäva det giltiga beviset på angivna villkor enligt denna ordning och de mindre arbetena",
    "en": "the governing board may suspend the licence in force on the terms stated by this act and the minor works shall not",
    "bg": "управителният съвет може да спре действащото разрешение при посочените условия и дребните работи не се изпълняват",
}


def sentence(rng, lang):
    words = SAY[lang].split()
    return " ".join(rng.sample(words, k=len(words))).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    texts, labels = [], []
    for k in range(450):
        lang = langid.LANGS[k % 9]
        texts.append(" ".join(sentence(rng, lang) for _ in range(3)))
        labels.append(lang if k % 20 else "es")  # some labels are wrong
    return langid.train(texts, labels, epochs=4)


def test_held_out_accuracy(model):
    rng = random.Random(7)
    right = total = 0
    for k in range(270):
        lang = langid.LANGS[k % 9]
        (seg,) = langid.segment_texts([" ".join(sentence(rng, lang) for _ in range(2))], model)
        total += 1
        right += len(seg) == 1 and seg[0][2] == lang and 0 <= seg[0][3] <= 1
    assert right / total > 0.97 and model.accuracy > 0.9


def test_mixed_texts_are_cut_where_the_language_changes(model):
    rng = random.Random(8)
    a, b = " ".join(sentence(rng, "es") for _ in range(3)) + " ", " ".join(sentence(rng, "de") for _ in range(3))
    (seg,) = langid.segment_texts([a + b], model)
    assert [s[2] for s in seg] == ["es", "de"] and seg[0][1] == len(a) and (seg[0][0], seg[-1][1]) == (0, len(a + b))


def test_empty_null_symbols_long(model):
    got = langid.segment_texts([None, "", "123 -- 456", "el " * 100_000], model)
    assert got[0] is None and got[1] == [] and got[2][0][2] == langid.REJECTED and got[2][0][3] == 0.0 and got[3][-1][1] == 300_000
    assert langid.segment_texts([], model) == [] and langid.segment_texts([None], model) == [None]


def test_unbroken_texts_are_cut_where_the_language_changes(model):
    rng = random.Random(10)
    for joint in ("", "\xb7"):
        a, b = (joint.join(" ".join(sentence(rng, lang) for _ in range(12)).split(" ")) for lang in ("es", "de"))
        (seg,) = langid.segment_texts([a + joint + b], model)
        assert [s[2] for s in seg] == ["es", "de"] and abs(seg[0][1] - len(a)) <= 1 and (seg[0][0], seg[-1][1]) == (0, len(a + joint + b))
    a, b = ("".join(" ".join(sentence(rng, lang) for _ in range(40)).replace(".", "").lower().split()) for lang in ("fr", "sv"))
    (seg,) = langid.segment_texts([a + b], model)
    assert [s[2] for s in seg] == ["fr", "sv"] and abs(seg[0][1] - len(a)) <= 400


def test_long_runs_of_letters_are_scored_whole(model):
    start, rest = "".join(sentence(random.Random(12), "es")[:-1].lower().split())[:60], "".join(" ".join(sentence(random.Random(k), "de") for k in range(4)).replace(".", "").lower().split())
    (seg,) = langid.segment_texts([start + rest], model)
    assert [s[2] for s in seg] == ["de"]
    for n in (61, 64, 65, 116, 117, 300):
        w = "".join(chr(0x4E00 + i) for i in range(n))
        assert {w[i : i + 5] for i in range(n - 4)} == {p[i : i + 5] for p in langid.pieces([w]) for i in range(len(p) - 4)} and max(map(len, langid.pieces([w]))) <= 60


def test_table(spark, model):
    rng = random.Random(9)
    quote = sentence(rng, "es") + " " + sentence(rng, "es") + " «de raad» " + sentence(rng, "es")
    mixed = sentence(rng, "fr") + " " + sentence(rng, "fr") + "\n" + sentence(rng, "en") + " " + sentence(rng, "en")
    rows = [(1, quote, "x"), (2, mixed, "x"), (3, None, "x"), (4, "", "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "id bigint, t string, langs string")
    got = {r.id: r for r in langid.with_segments(df, "t", model, 120).collect()}
    assert got[1].langs == ["es"] and sorted(got[2].langs) == ["en", "fr"] and got[3].langs is None and got[4].langs == [langid.REJECTED]
    assert got[1].main_lang == "es" and got[1].main_confidence > 0.5 and got[4].main_confidence == 0.0


def test_written_forms_of_labels(spark):
    forms = {"es": "es", "ES": "es", "SPA": "es", "pt-BR": "pt", "fr_BE": "fr", "BUL": "bg", " nld ": "nl", "Deutsch": "de", "xx": None, "und": None, "??": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in forms], "l string")
    assert [r[0] for r in df.select(langid.label_language(F.col("l"))).collect()] == list(forms.values())


def test_fit_without_labels(spark):
    df = spark.createDataFrame([(None, "es"), ("x", None)], "t string, l string")
    model = langid.fit(df, "t", "l")
    assert langid.segment_texts(["hola a todos"], model)[0][0][2] == langid.REJECTED
