"""Problem 3: groups of records that differ by small edits, by multiple-global-order filtering.

Two sets of tokens with a similarity (shared / all) of ``threshold`` or more share a token among
the first ``n - ceil(threshold * n) + 1`` tokens of each, under *every* global order of tokens. Here:

* order 1, rarest first (frequency from a table of counts over all records, ties by hash), generates
  candidates: records meet at the tokens of their prefix, in buckets of tokens whose number follows the
  size of the index; of two records the smaller meets by its shorter prefix, and size and position filters
  (for runs of characters also a parity sketch) act on each meeting pair;
* orders 2 and 3 put one half of all tokens (chosen by hash) first, rarest first within each half, so
  they look at rare tokens of either half: a candidate must share a token of the pair's own prefixes under
  both, which is tested on the prefixes alone, before any whole set is fetched;
* verification counts the shared tokens of the whole sets of the pairs that are left.

The tokens compared are the tokens indexed, for both kinds, so no link is lost. Nothing is sampled or capped.
Copies with one form are reduced to one representative first. A token that many records hold is met in
blocks: each pair of blocks of about ``BLOCK`` records is a unit of work of its own, wherever it is placed.

Defined results: null ids and null texts are in no pair; '' and texts with less than a whole run of
words (characters) equal only their copies; repeated rows count once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.canon import folded
from lexloom.llm.rolling import codes, mix
from lexloom.session import cut

COUNT_BITS = (16, 22)  # the table of counts has a counter for every 16 tokens, within these bounds (at most 4 MB)
SKETCH_BITS = 256  # parity sketch of runs of characters
BUCKETS_LEAST, BUCKET_TOKENS = 8, 1_000_000  # buckets of the index: their number follows the number of tokens
BLOCK = 8192  # records of one token that are met in one unit of work
BROADCAST_ROWS = 400_000  # candidates are broadcast up to this many pairs (16 bytes each)
_MUL = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_HALF = np.uint32(0x85EBCA6B)
_TIES = np.uint32(0x9E3779B1)
_words = re.compile(r"\w+").findall


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 500_000:
            self.clear()
        return value


def _runs(values: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all runs of ``k`` values within each record, and the record of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = values[:n] * _MUL[0]
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) + values[i : i + n] * _MUL[i % 5] + np.uint64(i)
    inside = owner[:n] == owner[k - 1 :]
    return (mix(h[inside]) >> np.uint64(32)).astype(np.uint32), owner[:n][inside]


def _sets(tokens: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct tokens of each record, sorted."""
    both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | tokens)
    ends = np.searchsorted(both >> np.uint64(32), np.arange(1, n, dtype=np.uint64))
    return np.split((both & np.uint64(0xFFFFFFFF)).astype(np.uint32), ends)


def token_sets(forms: list[str], kind: str) -> list[np.ndarray]:
    """The tokens of each lower-cased form: hashes of its runs of five words or four characters."""
    if kind == "words":
        memo, words, sizes = token_sets.memo, [], []
        for f in forms:
            own = _words(f)
            words += own
            sizes.append(len(own))
        values = np.array([memo[w] for w in words], dtype=np.uint64)
        return _sets(*_runs(values, np.array(sizes), 5), len(forms))
    sizes = np.array([len(f) for f in forms])
    return _sets(*_runs(codes("".join(forms)).astype(np.uint64), sizes, 4), len(forms))


token_sets.memo = _WordHash()


def doc_number(form: str) -> int:
    """A 64-bit number that stands for a form."""
    return int.from_bytes(hashlib.md5(form.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """Ids and lower-cased forms, 2,000 records at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            yield batch.column(0).to_pylist(), [folded(t) for t in batch.column(1).to_pylist()]


_FIRST = ["id", "doc", "tokens", "block", "counts"]


def _first_pass(kind: str, bits: int):
    """Rows (id, doc, tokens) for the records, and per task the counts of its tokens in blocks of 4,096 counters."""
    shift = np.uint32(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(1 << bits, np.int32), [], 0
        seen: set[int] = set()  # the tokens of copies of one form are counted and written once in a task
        for ids, forms in _forms(batches):
            docs = [doc_number(f) for f in forms]
            fresh = [d not in seen and not seen.add(d) for d in docs]
            sets = iter(token_sets([f for f, new in zip(forms, fresh) if new], kind)) if any(fresh) else iter(())
            sets = [next(sets) if new else None for new in fresh]
            waiting.append(np.concatenate([np.empty(0, np.uint32), *(x for x in sets if x is not None)]))
            held += len(waiting[-1])
            if held > 1 << 21:
                total += np.bincount(np.concatenate(waiting) >> shift, minlength=1 << bits).astype(np.int32)
                waiting, held = [], 0
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(docs, pa.int64()), pa.array([x if x is None else x.tobytes() for x in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_FIRST)
        if waiting:
            total += np.bincount(np.concatenate(waiting) >> shift, minlength=1 << bits).astype(np.int32)
        blocks = np.unique(np.flatnonzero(total) >> 12)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), t) for t in (pa.string(), pa.int64(), pa.binary())] + [pa.array(blocks, pa.int32()), pa.array([total[b << 12 : (b + 1) << 12].tobytes() for b in blocks], pa.binary())], names=_FIRST)

    return run


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"))


def count_bits(tokens: int) -> int:
    return min(max(int(tokens).bit_length() - 4, COUNT_BITS[0]), COUNT_BITS[1])


def first_pass(rows: DataFrame, kind: str) -> tuple[DataFrame, np.ndarray, int]:
    """(sets, rarity, tokens): (id, doc, tokens) of every record, written once (tokens null where a copy in the
    same task has them); how often the tokens of each
    counter occur over all records (``rarity_class``, one byte each); and the number of all tokens.
    """
    letters = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    bits = count_bits(letters // 7 if kind == "words" else letters)
    done = cut(rows.mapInArrow(_first_pass(kind, bits), "id string, doc bigint, tokens binary, block int, counts binary"))
    rarity, tokens = np.zeros(1 << bits, np.uint8), 0
    summed = done.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary, tokens bigint")
    for row in summed.collect():  # 1,024 rows of 4 kB at most, whatever the input
        rarity[row.block << 12 : (row.block + 1) << 12] = np.frombuffer(row.counts, np.uint8)
        tokens += row.tokens
    return done.where("block is null").select("id", "doc", "tokens"), rarity, tokens


def rarity_class(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of an eighth of a power of two: 0 for 0, at most 255."""
    return np.where(counts > 0, np.minimum(np.floor(8 * np.log2(np.maximum(counts, 1))) + 1, 255), 0).astype(np.uint8)


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << 12, np.int64)
    for counts in table.column("counts").to_pylist():
        total += np.frombuffer(counts, np.int32)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([rarity_class(total).tobytes()], pa.binary()), "tokens": pa.array([int(total.sum())], pa.int64())})


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def index_prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many first tokens suffice for the smaller of two records."""
    return n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1


def least_shared(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """How many tokens two records of these sizes must share."""
    return np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-6).astype(np.int64)


def parity_sketch(tokens: np.ndarray, bits: int = 256) -> np.ndarray:
    """``bits`` bits: whether an even or odd number of tokens falls on each.

    Two sketches differ in no more bits than the sets differ in tokens, so a pair whose sketches differ in
    too many bits cannot be similar: nothing is lost by this filter.
    """
    odd = np.bincount(tokens & np.uint32(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def blocks_of(rarity: np.ndarray) -> np.ndarray:
    """In how many blocks the records of tokens of these classes are met: from the greatest count of the class."""
    return np.ceil(np.exp2(rarity.astype(np.float64) / 8) / BLOCK).astype(np.int64)


_ANY = 2  # side of a posting that may meet every other


def _postings(first: np.ndarray, rarity: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, place, side) of one record's prefix; a hot token once per pair of blocks that the record's block is in."""
    n = blocks_of(rarity)
    places = np.minimum(np.arange(len(first)), 0x3FFF)
    if (n == 1).all():
        return first, places, np.full(len(first), _ANY)
    at = np.repeat(np.arange(len(first)), n)
    other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    own = (doc % n)[at]
    low, high = np.minimum(own, other), np.maximum(own, other)
    unit = (low * 0x9E3779B1 + high * 0x85EBCA6B + (n[at] > 1) * 0x27D4EB2F).astype(np.uint64).astype(np.uint32)
    return first[at] ^ unit, places[at], np.where(low == high, _ANY, (own == high).astype(np.int64))


def _index(rarity: np.ndarray, kind: str, threshold: float, buckets: int):
    """Per batch of records and bucket of tokens one row of packed arrays: the records' prefixes under order 1."""
    shift = np.uint32(33 - len(rarity).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of one form within a task come out once
        for batch in batches:
            docs, sizes, sketches, toks, places, owners = [], [], [], [], [], []
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc in seen:
                    continue
                seen.add(doc)
                own = np.frombuffer(whole, np.uint32)
                if p := prefix_length(len(own), threshold):
                    rare = rarity[own >> shift]
                    order = np.lexsort((own * _TIES, rare))[:p]
                    tok, place, side = _postings(own[order], rare[order], doc)
                    toks.append(tok)
                    places.append((place | side << 14).astype(np.uint16))
                    owners.append(np.full(len(tok), len(docs)))
                    docs.append(doc)
                    sizes.append(len(own))
                    if kind == "chars":
                        sketches.append(parity_sketch(own, SKETCH_BITS))
            if not docs:
                continue
            tok, place, owner = np.concatenate(toks), np.concatenate(places), np.concatenate(owners)
            bucket = (tok * np.uint32(0xC2B2AE35) >> np.uint32(8)) % np.uint32(buckets)
            order = np.lexsort((owner, bucket))
            tok, place, owner, bucket = tok[order], place[order], owner[order], bucket[order]
            docs, sizes = np.array(docs, np.int64), np.array(sizes, np.int32)
            sketch = np.stack(sketches) if sketches else None
            edges = np.flatnonzero(np.diff(bucket)) + 1
            cols: list[list] = [[] for _ in range(7)]
            for lo, hi in zip(np.append(0, edges), np.append(edges, len(bucket))):
                own, n = np.unique(owner[lo:hi], return_counts=True)
                packed = sketch[own].tobytes() if sketch is not None else None
                for col, value in zip(cols, (int(bucket[lo]), docs[own].tobytes(), sizes[own].tobytes(), packed, n.astype(np.int32).tobytes(), tok[lo:hi].tobytes(), place[lo:hi].tobytes())):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "docs", "sizes", "sketches", "n", "tok", "place"])

    return run


PAIR_BLOCK = 1 << 20


def _meet(rows: list[tuple], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of records of one bucket that pass the prefix, size, position and parity filters of order 1."""
    docs = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
    sizes = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows]).astype(np.int64)
    sketch = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]).reshape(len(docs), -1) if rows[0][2] is not None else None
    n = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
    tok = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows])
    place = np.concatenate([np.frombuffer(r[5], np.uint16) for r in rows]).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), n)
    _, first = np.unique(docs, return_index=True)  # copies met in several tasks
    single = np.zeros(len(docs), bool)
    single[first] = True
    keep = single[owner]
    tok, place, owner = tok[keep], place[keep], owner[keep]
    key = tok.astype(np.uint64) << np.uint64(32) | sizes[owner].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, owner, side, place = key[order], owner[order], place[order] >> 14, place[order] & 0x3FFF
    size = sizes[owner]
    # Each posting meets those after it in its token's run, up to the greatest size that can be similar.
    last = np.searchsorted(key, (key & np.uint64(0xFFFFFFFF00000000)) | np.floor(size / threshold + 1e-6).astype(np.uint64), side="right")
    meets = np.where(place < index_prefix(size, threshold), last - np.arange(len(key)) - 1, 0)
    starters = np.flatnonzero(meets)
    through = np.cumsum(meets[starters])
    at, found, held = 0, [], 0

    def out() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_a", "doc_b"])

    while at < len(starters):
        done = through[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(through, done + PAIR_BLOCK, side="right")))
        own, k = starters[at:to], meets[starters[at:to]]
        i = np.repeat(own, k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        at = to
        left = np.minimum(size[i] - place[i], size[j] - place[j])
        ok = left * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-6
        i, j = i[ok], j[ok]
        ok = (side[i] == _ANY) | (side[j] == _ANY) | (side[i] != side[j])
        a, b = owner[i[ok]], owner[j[ok]]
        if sketch is not None:
            apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1)
            ok = apart * (1 + threshold) <= (1 - threshold) * (sizes[a] + sizes[b]) + 1e-6
            a, b = a[ok], b[ok]
        x, y = docs[a], docs[b]
        if len(x):
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            held += len(x)
            if held > PAIR_BLOCK:
                yield out()
                found, held = [], 0
    if found:
        yield out()


def _candidates(threshold: float):
    """Rows come sorted by bucket; each bucket is met once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if b != bucket and rows:
                    yield from _meet(rows, threshold)
                    rows = []
                bucket = b
                rows.append(row)
        if rows:
            yield from _meet(rows, threshold)

    return run


def heads(tokens: np.ndarray, rarity: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of one set under orders 2 and 3: the one or the other half of all tokens first, rarest first within it."""
    rare = rarity[tokens >> np.uint32(33 - len(rarity).bit_length())]
    half = tokens * _HALF >> np.uint32(31)
    p, ties = prefix_length(len(tokens), threshold), tokens * _TIES
    return tokens[np.lexsort((ties, rare, half))[:p]], tokens[np.lexsort((ties, rare, 1 - half.astype(np.int8)))[:p]]


def _heads(rarity: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
            own = [heads(x, rarity, threshold) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), *(pa.array([h[k].tobytes() for h in own], pa.binary()) for k in (0, 1))], names=["doc", "n", "head2", "head3"])

    return run


def share_heads(na: int, nb: int, a: tuple[bytes, bytes], b: tuple[bytes, bytes], threshold: float) -> bool:
    """Whether two records share a token of their prefixes, cut to what this pair needs, under orders 2 and 3."""
    must = int(least_shared(np.int64(na), np.int64(nb), threshold))
    return all(not set(np.frombuffer(x, np.uint32)[: na - must + 1].tolist()).isdisjoint(np.frombuffer(y, np.uint32)[: nb - must + 1].tolist()) for x, y in zip(a, b))


def _intersect(threshold: float):
    """Candidates that meet under orders 2 and 3 as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [share_heads(na, nb, (a2, a3), (b2, b3), threshold) for na, a2, a3, nb, b2, b3 in zip(*(batch.column(i).to_pylist() for i in range(2, 8)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_a", "doc_b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b, out_s = [], [], []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(ta, np.uint32), np.frombuffer(tb, np.uint32)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                similarity = shared / max(1, len(x) + len(y) - shared)
                if similarity >= threshold - 1e-9:
                    out_a.append(a)
                    out_b.append(b)
                    out_s.append(similarity)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_s, pa.float64())], names=["doc_a", "doc_b", "similarity"])

    return run


def candidates(sets: DataFrame, rarity: np.ndarray, tokens: int, kind: str, threshold: float) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs that pass the filters of order 1."""
    buckets = int(max(BUCKETS_LEAST, tokens // BUCKET_TOKENS))
    index = sets.where("tokens is not null").select("doc", "tokens").mapInArrow(_index(rarity, kind, threshold, buckets), "bucket int, docs binary, sizes binary, sketches binary, n binary, tok binary, place binary")
    return index.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates(threshold), "doc_a bigint, doc_b bigint").distinct()


def links(sets: DataFrame, rarity: np.ndarray, tokens: int, kind: str, threshold: float) -> DataFrame:
    """(doc_a, doc_b, similarity), doc_a < doc_b: links between different forms."""
    pairs = cut(candidates(sets, rarity, tokens, kind, threshold))
    docs = pairs.select(F.col("doc_a").alias("doc")).union(pairs.select("doc_b")).distinct()
    if pairs.count() <= BROADCAST_ROWS:  # checked: at most twice as many records
        docs = F.broadcast(docs)
    sets = cut(sets.where("tokens is not null").select("doc", "tokens").join(docs, "doc", "left_semi").dropDuplicates(["doc"]))
    side = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns])
    tested = sets.mapInArrow(_heads(rarity, threshold), "doc bigint, n int, head2 binary, head3 binary")
    met = pairs.join(side(tested, "a"), "doc_a").join(side(tested, "b"), "doc_b").select("doc_a", "doc_b", *[f"{c}_{x}" for x in "ab" for c in ("n", "head2", "head3")])
    met = met.mapInArrow(_intersect(threshold), "doc_a bigint, doc_b bigint")
    both = met.join(side(sets, "a"), "doc_a").join(side(sets, "b"), "doc_b").select("doc_a", "doc_b", "tokens_a", "tokens_b")
    return both.mapInArrow(_verify(threshold), "doc_a bigint, doc_b bigint, similarity double")


def found_pairs(df: DataFrame, key: str, text: str, kind: str, threshold: float) -> DataFrame:
    """(id_a, id_b): all pairs of ids whose texts are similar, copies of one form included."""
    rows = texts_of(df, key, text)
    sets, rarity, tokens = first_pass(rows, kind)
    members = sets.select("id", "doc").distinct()
    a, b = members.alias("a"), members.alias("b")
    copies = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    linked = (
        links(sets, rarity, tokens, kind, threshold)
        .join(members.select(F.col("doc").alias("doc_a"), F.col("id").alias("i")), "doc_a")
        .join(members.select(F.col("doc").alias("doc_b"), F.col("id").alias("j")), "doc_b")
        .where("i <> j")
        .select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    )
    return copies.union(linked).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each connected part, by alternating large and small stars.

    Every round is written to the shared folder; the number of rounds grows with the logarithm of
    the longest chain. Nodes without an edge are not in the result.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:  # the stars shrink every round until nothing changes
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            break
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(df: DataFrame, key: str, text: str, kind: str, threshold: float) -> DataFrame:
    """One row per id: group (the least id in it), links to other forms, copies of its own form."""
    rows = texts_of(df, key, text)
    sets, rarity, tokens = first_pass(rows, kind)
    members = sets.select("id", "doc").distinct()
    found = cut(links(sets, rarity, tokens, kind, threshold).select("doc_a", "doc_b"))
    ends = found.select(F.col("doc_a").alias("doc")).union(found.select("doc_b"))
    degree = ends.groupBy("doc").agg(F.count("*").alias("links"))
    parts = components(found, "doc_a", "doc_b").withColumnRenamed("node", "doc")
    copies = members.groupBy("doc").agg((F.count("*") - 1).alias("copies"), F.min("id").alias("first_id"))
    heads = parts.join(copies, "doc").groupBy("root").agg(F.min("first_id").alias("least_id"))
    parts = parts.join(heads, "root").select("doc", "least_id")
    facts = copies.join(degree, "doc", "left").join(parts, "doc", "left").select("doc", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least_id", "first_id").alias("grupo"))
    return members.join(facts, "doc").select("id", "grupo", "links", "copies")
