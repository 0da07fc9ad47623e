"""Problem 9: long spans that appear verbatim in more than one record.

Hashing whole lines or paragraphs cannot see a span that begins or ends inside a line, so the unit
here is a window of ``UNIT`` code points chosen by content: of each ``min_chars - UNIT + 1``
consecutive windows the one of least hash. Any common span of ``min_chars`` code points therefore
holds a whole unit chosen on both sides. Digests of units are grouped globally; the units that two
records share are compared with what surrounds them (exactly, code point by code point), which
gives the shared spans with their offsets in the original text. Of every stretch of text the occurrence
in the record ranked first (least key) is kept, the others are marked for removal.

Defined results: null keys and null texts share nothing; texts shorter than ``min_chars`` share
nothing; repeated rows of one key count once, spans repeated within one record only do not count. A shared
passage that one record holds several times counts at each of its places.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.rolling import codes, window_hashes, winnow
from lexloom.session import cut

UNIT = 100
CLASSES = 64  # up to so many different surroundings of a unit are compared in pairs, beyond them by digest
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def units(texts: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the chosen windows of all texts, in one go per 64 K code points."""
    unit = min(UNIT, min_chars)
    outs, at = [], 0
    while at < len(texts):
        size, first = 0, at
        while at < len(texts) and (size == 0 or size + len(texts[at]) <= 1 << 16):
            size += len(texts[at])
            at += 1
        part = texts[first:at]
        sizes = np.array([len(t) for t in part])
        h = window_hashes(codes("".join(part)), unit)
        if not len(h):
            continue
        owner = np.repeat(np.arange(len(part)), sizes)
        crossing = owner[: len(h)] != owner[unit - 1 :]
        h[crossing] = _MOST
        p = winnow(h, min_chars - unit + 1)
        p = p[~crossing[p]]
        begins = np.append(0, np.cumsum(sizes)[:-1])
        outs.append((owner[p] + first, p - begins[owner[p]], h[p]))
    if not outs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate([o[i] for o in outs]) for i in range(3))


def _digests(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            owner, _, h = units(batch.column(1).to_pylist(), min_chars)
            both = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1) if len(h) else np.empty((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[1].view(np.int64)), pa.array(keys[both[0].astype(np.int64)])], names=["h", "key"])

    return run


def _surroundings(min_chars: int):
    reach = min_chars - min(UNIT, min_chars)
    unit = min(UNIT, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, shared = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            owner, place, h = units(texts, min_chars)
            wanted = [set(s) for s in shared]
            places: dict[tuple, list[int]] = {}  # equal surroundings of one text are written once, with all their places
            for o, p, x in zip(owner.tolist(), place.tolist(), h.view(np.int64).tolist()):
                if x in wanted[o]:
                    begin = max(0, p - reach)
                    places.setdefault((x, o, p - begin, texts[o][begin : p + unit + reach]), []).append(p)
            cols = list(zip(*((x, keys[o], at, pre, around) for (x, o, pre, around), at in places.items()))) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string()))], names=["h", "key", "places", "pre", "around"])

    return run


def common_reach(a: str, la: int, b: str, lb: int) -> tuple[int, int]:
    """How far two surroundings agree to the left of and from the unit's first point on."""
    left = 0
    for x, y in zip(reversed(a[:la]), reversed(b[:lb])):
        if x != y:
            break
        left += 1
    right = 0
    for x, y in zip(a[la:], b[lb:]):
        if x != y:
            break
        right += 1
    return left, right


def _compare(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for h, ca, cb, a, la, b, lb in zip(*(batch.column(i).to_pylist() for i in range(7))):
                left, right = common_reach(a, la, b, lb)
                if left + right >= min_chars:
                    for o, v in zip(out, (h, ca, cb, left, right)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "ca", "cb", "left", "right"])

    return run


def shared_units(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(h, key, places, pre, around, class): the units met in two or more records, with what surrounds them.

    ``class`` numbers equal surroundings (a 64-bit digest of text and place in it).
    """
    rows = df.where(F.col(key).isNotNull() & (F.length(text) >= min_chars)).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"))
    digests = rows.mapInArrow(_digests(min_chars), "h bigint, key bigint").repartition("h")
    several = digests.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h")
    shared = digests.join(several, "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("hs"))  # bounded by the text's length
    found = rows.join(shared, "key").mapInArrow(_surroundings(min_chars), "h bigint, key bigint, places array<int>, pre int, around string")
    return cut(found.withColumn("class", F.xxhash64("around", "pre")).distinct())


def _by_number(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, many): the units (h) with up to ``CLASSES`` different surroundings, and those with more."""
    several = found.groupBy("h").agg(F.count_distinct("class").alias("k"))
    return several.where(F.col("k") <= CLASSES).select("h"), several.where(F.col("k") > CLASSES).select("h")


def class_windows(classes: DataFrame, min_chars: int) -> DataFrame:
    """(h, class, left, window): the digests of all windows of ``min_chars`` points that hold the unit, ``left`` of them before it."""
    low = F.greatest(F.lit(0), F.lit(min_chars) - (F.length("around") - F.col("pre")))
    high = F.least(F.col("pre"), F.lit(min_chars - min(UNIT, min_chars)))
    windows = classes.where((F.length("around") >= min_chars) & (low <= high)).select("h", "class", "around", "pre", F.explode(F.sequence(low, high)).alias("left"))
    return windows.select("h", "class", "left", F.md5(F.concat(F.col("left").cast("string"), F.lit(":"), F.expr(f"substr(around, pre - left + 1, {min_chars})"))).alias("window"))


def class_links(found: DataFrame, min_chars: int) -> DataFrame:
    """(h, ca, cb, left, right): surroundings (equal or not) of one unit that agree over ``min_chars`` points."""
    classes = found.groupBy("h", "class").agg(F.first("around").alias("around"), F.first("pre").alias("pre"), F.count("*").alias("n"))
    same = classes.where((F.length("around") >= min_chars) & (F.col("n") > 1)).select(
        "h", F.col("class").alias("ca"), F.col("class").alias("cb"), F.col("pre").alias("left"), (F.length("around") - F.col("pre")).alias("right")
    )
    # Units with few surroundings: all pairs of those. A unit that stands in many different surroundings (a
    # stock phrase): only surroundings with an equal window of ``min_chars`` points around the unit meet.
    few, many = _by_number(found)
    light = classes.join(few, "h", "left_semi")
    windows = class_windows(classes.join(many, "h", "left_semi"), min_chars)
    wa, wb = windows.alias("a"), windows.alias("b")
    met = wa.join(wb, (F.col("a.h") == F.col("b.h")) & (F.col("a.window") == F.col("b.window")) & (F.col("a.class") < F.col("b.class"))).select("a.h", F.col("a.class").alias("ca"), F.col("b.class").alias("cb")).distinct()
    a, b = light.alias("a"), light.alias("b")
    met = met.union(a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.class") < F.col("b.class"))).select("a.h", F.col("a.class").alias("ca"), F.col("b.class").alias("cb")))
    side = lambda c, x, n: classes.select("h", F.col("class").alias(c), F.col("around").alias(x), F.col("pre").alias(n))
    different = (
        met.join(side("ca", "xa", "la"), ["h", "ca"]).join(side("cb", "xb", "lb"), ["h", "cb"]).select("h", "ca", "cb", "xa", "la", "xb", "lb").mapInArrow(_compare(min_chars), "h bigint, ca bigint, cb bigint, left int, right int")
    )
    return same.union(different)


def found_pairs(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records with a common span of ``min_chars`` code points or more."""
    found = shared_units(df, key, text, min_chars)
    linked = class_links(found, min_chars)
    holders = found.select("h", "class", "key").distinct()
    return (
        linked.join(holders.select("h", F.col("class").alias("ca"), F.col("key").alias("i")), ["h", "ca"])
        .join(holders.select("h", F.col("class").alias("cb"), F.col("key").alias("j")), ["h", "cb"])
        .where("i <> j")
        .select(F.least("i", "j").alias("key_a"), F.greatest("i", "j").alias("key_b"))
        .distinct()
    )


def parts(begins: list[int], ends: list[int], firsts: list[int]) -> list[tuple[int, int, int, int]]:
    """(span, begin, end, first_key): the pieces of one text cut where their least key changes.

    ``span`` numbers the stretches of pieces that touch or overlap.
    """
    order = sorted(range(len(begins)), key=begins.__getitem__)
    out, active, at, span = [], [], 0, 0
    points = sorted({*begins, *ends})
    for begin, end in zip(points, points[1:]):
        while at < len(order) and begins[order[at]] <= begin:
            heapq.heappush(active, (firsts[order[at]], ends[order[at]]))
            at += 1
        while active and active[0][1] <= begin:
            heapq.heappop(active)
        if not active:
            continue
        first = active[0][0]
        if out and out[-1][2] == begin:
            if out[-1][3] == first:
                out[-1] = (span, out[-1][1], end, first)
                continue
        else:
            span += 1
        out.append((span, begin, end, first))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, *part) for key, *pieces in zip(*(batch.column(i).to_pylist() for i in range(4))) for part in parts(*pieces)]
        cols = list(zip(*rows)) or [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["key", "span", "begin", "end", "first_key"])


def shared_spans(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(key, span, begin, end, first_key, kept): the shared spans of each record, in its original offsets.

    Spans that touch or overlap have one number ``span``; they are cut where the least key that holds the
    text changes. ``first_key`` is that key for the whole row, ``kept`` tells whether this record is that
    one; the other occurrences are to be removed.
    """
    found = shared_units(df, key, text, min_chars)
    few, many = _by_number(found)
    linked = class_links(found.join(few, "h", "left_semi"), min_chars)
    both = linked.select("h", F.col("ca").alias("class"), F.col("cb").alias("other"), "left", "right").union(
        linked.where("ca <> cb").select("h", F.col("cb").alias("class"), F.col("ca").alias("other"), "left", "right")
    )
    first = found.groupBy("h", F.col("class").alias("other")).agg(F.min("key").alias("first_other"))
    reach = both.join(first, ["h", "other"]).groupBy("h", "class", "left", "right").agg(F.min("first_other").alias("first_other"))
    # Units in many surroundings: no pairs of those, but per window the least key that holds it.
    hot = found.join(many, "h", "left_semi")
    windows = class_windows(hot.groupBy("h", "class").agg(F.first("around").alias("around"), F.first("pre").alias("pre")), min_chars)
    ends = hot.groupBy("h", "class").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    least = windows.join(ends, ["h", "class"]).groupBy("h", "window").agg(F.min("lo").alias("first_other"), F.max("hi").alias("last")).where("first_other <> last").drop("last")
    reach = reach.unionByName(windows.join(least, ["h", "window"]).select("h", "class", "left", (F.lit(min_chars) - F.col("left")).alias("right"), "first_other"))
    pieces = found.join(reach, ["h", "class"]).withColumn("place", F.explode("places")).select(
        "key", (F.col("place") - F.col("left")).alias("begin"), (F.col("place") + F.col("right")).alias("end"), F.least("key", "first_other").alias("first_key")
    )
    gathered = pieces.groupBy("key").agg(F.collect_set(F.struct("begin", "end", "first_key")).alias("p"))  # bounded by the length of one text
    divided = gathered.select("key", "p.begin", "p.end", "p.first_key").mapInArrow(_parts, "key bigint, span int, begin int, end int, first_key bigint")
    return divided.withColumn("kept", F.col("key") == F.col("first_key"))


def shared_part(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(key, n_chars, spans, shared_chars, removed_chars, share) for every record, those without shared spans too."""
    spans = shared_spans(df, key, text, min_chars).groupBy("key").agg(
        F.max("span").alias("spans"), F.sum(F.col("end") - F.col("begin")).alias("shared_chars"), F.sum(F.when(~F.col("kept"), F.col("end") - F.col("begin")).otherwise(0)).alias("removed_chars")
    )
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.length(text).alias("n_chars")).dropDuplicates(["key"])
    done = rows.join(spans, "key", "left").fillna(0, ["spans", "shared_chars", "removed_chars"])
    return done.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
