import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import rolling, spans


def common(a, b, n):
    return len(a) >= n and any(a[i : i + n] in b for i in range(len(a) - n + 1))


def made(n_docs=30, seed=2):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefg ñ\n") for _ in range(k))
    passages = [text(n) for n in (199, 200, 201, 230, 400, 120, 650)]
    rows = []
    for k in range(n_docs):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            parts += [p, text(rng.randrange(0, 200))]
        rows.append((k, "".join(parts)))
    return rows


def brute(rows, n):
    rows = {(k, t) for k, t in rows if k is not None and t is not None}
    return {(a, b) for (a, x), (b, y) in itertools.product(rows, rows) if a < b and common(x, y, n)}


def test_winnowing_keeps_its_promise():
    rng = np.random.default_rng(0)
    for k in range(300):
        h = rng.integers(0, 20 if k % 2 else 1 << 60, rng.integers(1, 200)).astype(np.uint64)
        w = int(rng.integers(1, 40))
        chosen = set(rolling.winnow(h, w).tolist())
        for i in range(max(1, len(h) - w + 1)):
            assert chosen & set((np.flatnonzero(h[i : i + w] == h[i : i + w].min()) + i).tolist())


def test_windows_hash_by_content():
    h = rolling.window_hashes(rolling.codes("xxabcabcabcyy"), 3)
    assert h[2] == h[5] == h[8] and len(set(h.tolist())) == 7
    assert len(rolling.window_hashes(rolling.codes("ab"), 3)) == 0


def test_pairs_equal_brute_force(spark):
    rows = made() + [(50, None), (None, "x"), (51, ""), (52, "🜨🜍" * 150), (53, "y" + "🜨🜍" * 120), (54, "a" * 500), (55, "b" + "a" * 250 + "c"), (3, made()[3][1])]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id bigint, text string, h int")
    assert {tuple(r) for r in spans.found_pairs(df, "doc_id", "text", 200).collect()} == brute(rows, 200)
    assert spans.found_pairs(df.limit(0), "doc_id", "text", 200).count() == 0


def test_shared_part(spark):
    p = "".join(random.Random(9).choice("abcdefghij ") for _ in range(300))
    rows = [(1, "AAA " + p), (2, p + " BBB"), (3, "nothing"), (4, None), (5, "CC" + p[:250] + "DD")]
    got = {r.key: r for r in spans.shared_part(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 200).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert (got[1].shared_chars, got[2].shared_chars, got[5].shared_chars, got[3].shared_chars) == (300, 300, 250, 0)
    assert (got[1].removed_chars, got[2].removed_chars) == (0, 300)
    found = {r.key: r for r in spans.shared_spans(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 200).collect()}
    assert (found[1].begin, found[1].end, found[1].kept) == (4, 304, True) and (found[5].begin, found[5].end, found[5].first_key) == (2, 252, 1)


def test_hot_passage(spark):
    p = "".join(random.Random(4).choice("abcdefghij ") for _ in range(210))
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.concat(F.col("id").cast("string"), F.lit(" " + p))).otherwise(F.col("id").cast("string")).alias("t"))
    assert spans.found_pairs(df, "id", "t", 200).count() == 100 * 99 // 2


def shared_by_brute_force(rows, n):
    """Per record: how many points are in spans of n that other records hold, and how many of those an earlier one holds."""
    first = {}
    for k, t in rows:
        for i in range(len(t) - n + 1):
            lo, hi = first.get(t[i : i + n], (k, k))
            first[t[i : i + n]] = (min(lo, k), max(hi, k))
    out = {}
    for k, t in rows:
        least = {}
        for i in range(len(t) - n + 1):
            lo, hi = first[t[i : i + n]]
            if lo != hi:
                least |= {p: min(lo, least.get(p, lo)) for p in range(i, i + n)}
        out[k] = (len(least), sum(f != k for f in least.values()))
    return out


@pytest.mark.parametrize("n", [spans.CLASSES - 1, spans.CLASSES, spans.CLASSES + 1])
def test_stock_phrase_in_few_and_in_many_surroundings(spark, n):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase, longer = text(150), text(60)
    rows = [(k, text(120) + phrase + text(120)) for k in range(n - 20)] + [(100 + k, text(40) + longer + phrase + text(40)) for k in range(20)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert {tuple(r) for r in spans.found_pairs(df, "id", "t", 200).collect()} == brute(rows, 200)
    assert {r.key: (r.shared_chars, r.removed_chars) for r in spans.shared_part(df, "id", "t", 200).collect()} == shared_by_brute_force(rows, 200)


def test_every_place_of_a_repeated_passage_counts(spark):
    p = "".join(random.Random(5).choice("abcdefghij ") for _ in range(250))
    rows = [(1, "x" + p + "yy" + p + "z"), (2, p), (3, "a" * 500), (4, "b" + "a" * 300)]
    got = {r.key: (r.shared_chars, r.removed_chars) for r in spans.shared_part(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 200).collect()}
    assert got == {1: (500, 0), 2: (250, 250), 3: (500, 0), 4: (300, 300)} == shared_by_brute_force(rows, 200)


def test_first_occurrences_next_to_copies_are_kept(spark):
    rng = random.Random(21)
    p, q, r = ("".join(rng.choice("abcdefghij ") for _ in range(260)) for _ in range(3))
    rows = [(1, p), (2, p + q), (3, q), (4, r), (5, q + p + r)]
    got = {}
    for x in spans.shared_spans(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 200).orderBy("key", "begin").collect():
        got.setdefault(x.key, []).append((x.begin, x.end, x.first_key, x.kept))
    assert got[1] == [(0, 260, 1, True)] and got[2] == [(0, 260, 1, False), (260, 520, 2, True)] and got[3] == [(0, 260, 2, False)]
    assert got[5] == [(0, 260, 2, False), (260, 520, 1, False), (520, 780, 4, False)]
    part = {x.key: x for x in spans.shared_part(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", 200).collect()}
    assert [part[k].removed_chars for k in (1, 2, 3, 4, 5)] == [0, 260, 260, 0, 780] and (part[2].spans, part[2].shared_chars) == (1, 520)
