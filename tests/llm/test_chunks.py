import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.chunks import split, split_texts


def check(text, most, again):
    pieces = split(text, most, again)
    assert all(e - b <= most for b, e, _ in pieces)
    fresh = [text[b + (again if k and b + again <= e else 0) : e] for k, (b, e, _) in enumerate(pieces)]
    ends = [0] + [e for _, e, _ in pieces]
    assert "".join(text[a:b] for a, b in zip(ends, ends[1:])) == text
    for (_, e, _), (b, _, _) in zip(pieces, pieces[1:]):
        assert b == max(0, e - again)
    return pieces, fresh


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\u0301é", max_size=600), st.integers(20, 90), st.integers(0, 15))
def test_round_trip(text, most, again):
    check(text, most, again)


def law(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeimnorstu") for _ in range(rng.randrange(2, 9)))
    return "".join(f"Artículo {k}. {word()}\n" + " ".join(" ".join(word() for _ in range(12)) + "." for _ in range(rng.randrange(2, 8))) + "\n" for k in range(n))


def test_cuts_at_articles():
    pieces, _ = check(law(), 4000, 200)
    assert len(pieces) > 3 and all(kind in ("article", "end") for _, _, kind in pieces)


def test_an_edit_alters_neighbours_only():
    text = law(2, 120)
    changed = text[:3000] + " palabra nueva" + text[3000:]
    cuts = lambda t: {t[b:e] for b, e, _ in split(t, 4000, 200)}
    assert len(cuts(text) - cuts(changed)) <= 3 and len(cuts(text)) > 10


def test_limits():
    assert split("", 10, 2) == [(0, 0, "end")] and split("x" * 10, 10, 2) == [(0, 10, "end")]
    assert len(check("x" * 100_000, 4000, 200)[0]) >= 26
    with pytest.raises(ValueError):
        split("abc", 5, 5)


def test_table(spark):
    rows = [("a", "x" * 50), ("a", "x" * 50), ("b", None), ("c", ""), (None, "y" * 5), ("d", "k" * 20)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id string, t string, piece int")
    got = split_texts(df, "id", "t", 20, 5).collect()
    assert sorted({r.key or "" for r in got}) == ["", "a", "c", "d"] and len([r for r in got if r.key == "a"]) == len(split("x" * 50, 20, 5))
    assert all(len(r.content) == r.end - r.begin for r in got)
    assert {r.key for r in split_texts(df, "id", "t", 20, 5, long_only=True).collect()} == {"a"}
    assert split_texts(df.limit(0), "id", "t", 20, 5).count() == 0
