import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import canon


def test_forms_that_look_alike_become_one():
    same = ["Ley 12 de aguas", "Ｌｅｙ １２ de aguas", "Ley\u00a012\u2009de\u3000aguas", "L\u200bey 12 de a\u00adguas", "Lеу 12 dе аguаs", "Lеy 12 de aguas\ufeff"]
    assert {canon.canonical(s) for s in same} == {"Ley 12 de aguas"}
    assert canon.canonical("ﬁn Ⅳ oﬃcio") == "fin IV officio"
    assert canon.canonical("cafe\u0301") == canon.canonical("café") == "café"
    assert canon.canonical("а\u0301guа") == "água"  # Cyrillic base, combining accent
    assert canon.canonical("a\u200d\u0301") == "á"
    assert canon.canonical("a\u2011b\uff0dc\u2010d") == "a-b-c-d"


def test_what_differs_to_a_reader_stays_different():
    texts = ["Ley", "ley", "Léy", "Le y", "Le  y", "Ley\n", "Ley\r\n", "Ley.", "L3y", "Le\u2013y", "Le-y", "г", "r", "x²", "x2"]
    assert len({canon.canonical(t) for t in texts}) == len(texts)


def test_empty_null_ascii_and_very_long():
    assert canon.canonical(None) is None and canon.canonical("") == "" and canon.canonical("abc") == "abc"
    assert canon.canonical("é\u200b" * 200_000) == "é" * 200_000


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        canon.check_conflicts({"а": "a", "ɑ": "a"}, "x")
    with pytest.raises(ValueError):
        canon.check_conflicts({"а": "A"}, "x")


def test_the_finished_mapping_is_checked():
    for bad in ({"a": "b"}, {"а": "ｂ", "ｂ": "b"}, {"а": "x", "б": "x"}):
        with pytest.raises(ValueError):
            canon.check_mapping(bad)
    canon.check_mapping(canon.transducer().single)


def test_styles_and_further_scripts():
    assert canon.canonical("𝐀𝒓𝗍. 𝟙 ℎ") == "Art. 1 h" and canon.canonical("օ Ꭺ") == "o A"
    assert canon.canonical("𝐀\u0301𝐀\u0301") == "ÁÁ" and canon.canonical("a\u0323\u0302") == canon.canonical("ậ") == canon.canonical("â\u0323")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aбЕеé\u0301\u0308\u200b\u00a0ﬁＡ１Ⅳ\u212b-\u2011\n \u0306ий"), max_size=20))
def test_one_pass_is_enough(text):
    once = canon.canonical(text)
    assert canon.canonical(once) == once
    assert unicodedata.normalize("NFC", once) == once
    assert canon.canonical(unicodedata.normalize("NFD", text)) == canon.canonical(unicodedata.normalize("NFC", text))


def test_pairs(spark):
    rows = [("a", "Ley 1"), ("a", "Ley 1"), ("b", "Lеy 1"), ("c", "Ley\u00a01"), ("d", "Ley 1"), ("e", None), (None, "Ley 1"), ("f", "otra"), ("g", "otra"), ("h", "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id string, t string, form int, k string")
    got = {tuple(r) for r in canon.look_alikes(df, "id", "t").collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a and b and a < b and x and y and x != y and canon.canonical(x) == canon.canonical(y)}
    assert got == want and ("a", "d") not in got
    assert canon.look_alikes(df.limit(0), "id", "t").count() == 0
    forms = canon.with_form(df, "t", "form").where("id = 'b'").first()
    assert forms.form == "Ley 1"


def test_without_case_either_order_is_one():
    assert len({canon.folded(t) for t in ("ВОДНИТЕ", "водните", "BOДHИTE", "Водните")}) == 1
    assert canon.folded("Вezirk") == "bezirk" and canon.folded("") == ""
