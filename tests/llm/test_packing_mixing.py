import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import mixing, packing, tokens


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 40), max_size=25))
def test_patterns_hold_every_item_once(sizes):
    patterns = packing.pack_histogram(sizes, 60)
    placed = Counter()
    for p, n in patterns:
        assert sum(p) <= 60 and n > 0
        for s in p:
            placed[s] += n
    assert placed == Counter({s: n for s, n in sizes.items() if s})


def test_little_is_wasted():
    rng = random.Random(1)
    sizes = Counter(min(1024, int(rng.lognormvariate(5.2, 0.8)) + 1) for _ in range(20_000))
    patterns = packing.pack_histogram(sizes, 1024)
    total = sum(s * n for s, n in sizes.items())
    assert total / (1024 * sum(n for _, n in patterns)) > 0.98


def test_pack_table(spark):
    rng = random.Random(2)
    rows = [(k, 7 if k % 3 == 0 else rng.randrange(0, 130)) for k in range(900)] + [(1000, None), (1001, 0), (1002, 305)]
    df = spark.createDataFrame([(k, n, "x") for k, n in rows], "id bigint, n bigint, salt string")
    got = packing.pack(df, "id", "n", 100).collect()
    load, parts = Counter(), defaultdict(list)
    for r in got:
        load[r.container] += r["size"]
        parts[r.id].append((r.part, r.first_token, r["size"]))
    assert max(load.values()) <= 100
    assert {k: sum(p[2] for p in v) for k, v in parts.items()} == {k: n for k, n in rows if n is not None}
    assert all(len(v) == 1 for k, v in parts.items() if dict(rows)[k] <= 100) and len(parts[1002]) == 4
    report = packing.report(packing.pack(df, "id", "n", 100), 100).first()
    assert report.unused_share < 0.02 and report.items == len(got)
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(k, "big", rng.randrange(50, 500)) for k in range(3000)] + [(5000 + k, "small", rng.randrange(50, 500)) for k in range(30)] + [(6000, "tiny", 100), (6001, None, 5), (6002, "big", None), (6003, "other", 9000), (6004, "big", 0)]
    df = spark.createDataFrame(rows, "id bigint, source string, n bigint")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.15, 4), ("tiny", 0.04, 3), ("gone", 0.01, 2), ("big", 0.8, 1)], "source string, target_share double, max_repeats int")
    total = sum(n or 0 for _, _, n in rows)
    chosen, shares = mixing.mix(df, "id", "source", "n", targets, 0.1)
    got, rep = chosen.collect(), {r.source: r for r in shares.collect()}
    assert set(rep) == {"big", "small", "tiny", "gone"} and len({r.id for r in got}) == len(got)
    most = {"big": 1, "small": 4, "tiny": 3}
    assert all(1 <= r.copies <= most[r.source] for r in got)
    assert abs(rep["big"].reached_tokens - 0.08 * total) <= 500
    small = sum(n for _, s, n in rows if s == "small")
    assert abs(rep["small"].reached_tokens - min(0.015 * total, 4 * small)) <= 500
    assert rep["tiny"].reached_tokens == 300 and rep["gone"].reached_tokens == 0
    assert rep["small"].most_copies - min(r.copies for r in got if r.source == "small") <= 1
    again = mixing.mix(df, "id", "source", "n", targets, 0.1)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    empty = mixing.mix(df.limit(0), "id", "source", "n", targets, 0.1)[1].collect()
    assert len(empty) == 4 and all(r.reached_tokens == 0 for r in empty)


def test_inclusion_follows_size(spark):
    df = spark.range(20_000).select(F.col("id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 400).otherwise(100).cast("bigint").alias("n"))
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = Counter(r["size"] for r in mixing.mix(df, "id", "source", "n", targets, 0.2)[0].collect())
    assert 1.8 < got[400] / got[100] < 2.2  # with the power 0.5: in proportion to the root of the size


def test_odds_are_scaled_for_what_certain_records_leave(spark):
    # Two records of 40,000 would go beyond 1: they are certain, and the small ones fill the rest.
    df = spark.createDataFrame([(k, "s", 40_000 if k < 2 else 100) for k in range(2000)], "id bigint, source string, n bigint")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    total = 2 * 40_000 + 1998 * 100
    planned = mixing.plan(df, "source", "n", targets, 0.5, 1.0).first()
    assert abs(planned.scale * 100 * 1998 * 100 - (total / 2 - 80_000)) < 1 and planned.scale * 40_000 > 1
    got = mixing.mix(df, "id", "source", "n", targets, 0.5, power=1.0)[0].collect()
    assert {0, 1} <= {r.id for r in got} and abs(sum(r["size"] for r in got) - total / 2) <= 100


def test_token_counts(spark):
    texts = ["", "Ley de aguas 12/2001.", None, "ñ" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.token_count(F.col("t"))).collect()]
    assert got[0] == 0 and got[2] is None and got[1] == tokens.count(texts[1]) > 3 and got[3] == tokens.count(texts[3])
