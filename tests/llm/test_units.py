import random

import pytest

from lexloom.llm import units


def brute(rows, unit, least):
    seen, out = {}, set()
    for k, t in sorted({r for r in rows if None not in r}):
        for b, e in units.units(t, unit):
            form = units.normalised(t[b:e])
            if len(form) >= least:
                seen.setdefault(form, []).append((k, b, e))
    for places in seen.values():
        first = min(places)
        out |= {(k, b, e, first[0], first[1], (k, b) == first[:2]) for k, b, e in places if len(places) > 1}
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_units_equal_brute_force_and_offsets_give_the_text(spark, unit):
    rng = random.Random(6)
    line = lambda: "".join(rng.choice("abcdef \t") for _ in range(rng.choice([5, 45, 60])))
    stock = [line() for _ in range(6)]
    rows = [(k, "\n".join(rng.choice([rng.choice(stock), "  " + rng.choice(stock) + " ", line(), ""]) for _ in range(rng.randrange(0, 14)))) for k in range(40)]
    rows += [(50, None), (None, stock[1]), (51, ""), (3, rows[3][1]), (52, "x" * 300_000), (53, "\n" * 500)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id bigint, t string, begin int")
    assert {tuple(r) for r in units.shared_units(df, "id", "t", unit, 40).collect()} == brute(rows, unit, 40)
    texts, done = dict(r for r in rows if r[0] is not None and r[1] is not None), units.without_repeats(df, "id", "t", unit, 40).collect()
    assert sorted(r.key for r in done) == sorted(texts)
    for r in done:
        assert r.own_text == "".join(texts[r.key][k["begin"] : k["end"]] for k in r.kept) and r.removed_chars == len(texts[r.key]) - len(r.own_text)
    kept = {units.normalised(r.own_text[b:e]) for r in done for b, e in units.units(r.own_text, unit)}
    assert {f for t in texts.values() for b, e in units.units(t, unit) if len(f := units.normalised(t[b:e])) >= 40} <= kept  # nothing is lost everywhere
    assert units.shared_units(df.limit(0), "id", "t", unit).count() == 0 and units.without_repeats(df.limit(0), "id", "t", unit).count() == 0
