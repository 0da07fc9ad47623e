import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import neardup
from lexloom.llm.canon import canonical


def tokens(text, kind):
    if kind == "chars":
        return {text[i : i + 4] for i in range(len(text) - 3)}
    words = re.findall(r"\w+", text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, kind, t):
    rows = sorted({(i, canonical(x).lower()) for i, x in rows if i is not None and x is not None})
    out = set()
    for (i, x), (j, y) in itertools.combinations(rows, 2):
        a, b = tokens(x, kind), tokens(y, kind)
        if i != j and (x == y or (a | b and len(a & b) / len(a | b) >= t)):
            out.add((min(i, j), max(i, j)))
    return out


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + rng.choice("abcxyz") + text[k + 1 :], text[:k] + rng.choice("abcxyz") + text[k:], text[:k] + text[k + 1 :]])
    return text


@pytest.fixture(scope="module")
def titles():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["pra", "cho", "lu", "ti", "ver", "mo", "sae"]) for _ in range(3))
    base = [f"Decreto {rng.randrange(999)}/20{rng.randrange(10, 30)}, sobre {' '.join(word() for _ in range(rng.randrange(1, 9)))}" for _ in range(60)]
    out = list(enumerate(base)) + [(100 + k, edited(rng, rng.choice(base), rng.randrange(0, 8))) for k in range(120)]
    return [(f"id{i:03}", t) for i, t in out] + [("n1", None), (None, base[0]), ("e1", ""), ("e2", ""), ("s1", "abc"), ("s2", "abc"), ("s3", "abcd"), ("id000", base[0])]


def test_titles_equal_brute_force(spark, titles):
    df = spark.createDataFrame([(i, t, 1) for i, t in titles], "id string, t string, doc int")
    assert {tuple(r) for r in neardup.found_pairs(df, "id", "t", "chars", 0.7).collect()} == brute(titles, "chars", 0.7)


def test_texts_equal_brute_force_and_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))] for _ in range(30)]
    rows = [(f"t{k:02}", " ".join(b)) for k, b in enumerate(base)]
    for k in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
        rows.append((f"v{k:02}", " ".join(words)))
    df = spark.createDataFrame(rows, "id string, t string")
    want = brute(rows, "words", 0.8)
    assert {tuple(r) for r in neardup.found_pairs(df, "id", "t", "words", 0.8).collect()} == want
    got = {r.id: r for r in neardup.groups(df, "id", "t", "words", 0.8).collect()}
    assert len(got) == len(rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[find(a)] = find(b)
    assert {(a, b) for a in got for b in got if got[a].grupo == got[b].grupo} == {(a, b) for a in got for b in got if find(a) == find(b)}


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([], "id string, t string")
    assert neardup.found_pairs(df, "id", "t", "words", 0.8).count() == 0
    long = "palabra " * 50_000
    df = spark.createDataFrame([("a", long), ("b", long + "fin"), ("c", "x" * 300_000)], "id string, t string")
    assert {tuple(r) for r in neardup.found_pairs(df, "id", "t", "words", 0.7).collect()} == brute([("a", long), ("b", long + "fin"), ("c", "x")], "words", 0.7)


def test_hot_group_of_copies(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"), F.when(F.col("id") % 3 == 0, F.lit("uno dos tres cuatro cinco seis")).otherwise(F.concat(F.lit("texto "), F.repeat(F.concat("id", F.lit(" ")), 8))).alias("t"))
    rows = neardup.groups(df, "id", "t", "words", 0.8).collect()
    assert len(rows) == 3000 and sorted(r.copies for r in rows)[-1] == 999


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    rarity = neardup.rarity_class(rng.integers(0, 5000, 1 << 16))
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 32, 80).astype(np.uint32))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 32, rng.integers(0, 9)).astype(np.uint32)]))
        apart = np.bitwise_count(neardup.parity_sketch(a) ^ neardup.parity_sketch(b)).sum()
        assert apart <= len(np.setxor1d(a, b))
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.7:
            x, y = ([h.tobytes() for h in neardup.heads(s, rarity, 0.7)] for s in (a, b))
            assert neardup.share_heads(len(a), len(b), x, y, 0.7)


def test_reordered_inserted_and_repeated_words_of_titles(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    rows = []
    for k in range(150):
        words = [word() for _ in range(7)]
        mixed = words[:]
        rng.shuffle(mixed)
        rows += [(f"a{k:03}", " ".join(words)), (f"b{k:03}", " ".join(mixed)), (f"c{k:03}", " ".join(words + [words[0]])), (f"d{k:03}", " ".join(words)[:30] + "x" + " ".join(words)[30:] + " y")]
    df = spark.createDataFrame(rows, "id string, t string")
    assert {tuple(r) for r in neardup.found_pairs(df, "id", "t", "chars", 0.7).collect()} == brute(rows, "chars", 0.7)


@pytest.mark.parametrize("block", [8192, 7, 40])
def test_hot_tokens_met_in_blocks_lose_no_pair(monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 32, 60).astype(np.uint32))
    sets = [np.unique(np.append(base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 32, 3).astype(np.uint32))) for _ in range(120)]
    total = np.bincount(np.concatenate(sets) >> np.uint32(16), minlength=1 << 16)
    docs = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, len(sets))]
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "tokens"])
    rows = sorted((r for out in neardup._index(neardup.rarity_class(total), "words", 0.8, 4)(iter([batch])) for r in zip(*(out.column(i).to_pylist() for i in range(7)))), key=lambda r: r[0])
    index = pa.RecordBatch.from_pylist([dict(zip("abcdefg", r)) for r in rows])
    got = {p for out in neardup._candidates(0.8)(iter([index])) for p in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    want = {(min(x, y), max(x, y)) for (x, a), (y, b) in itertools.combinations(zip(docs, sets), 2) if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8}
    assert len(want) > 100 and want <= got


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (200, 150)], "a bigint, b bigint")
    got = {r.node: r.root for r in neardup.components(edges, "a", "b").collect()}
    assert all(got[k] == 0 for k in range(61)) and got[101] == 100 and got[200] == 150 and 102 not in got
