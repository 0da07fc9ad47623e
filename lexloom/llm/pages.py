"""Problem 4, the method named: differencing of pages with near URLs.

Pages are paired by URL path within each host, their lines aligned by a longest common subsequence, and
shared lines deleted. Each page is paired with the one before it in path order within its host, the first
with the second. The order is a range sort over host and path; where a host runs on into the next range, the
last and first pages of the two meet, so no host sits in one task.

This takes off what a site repeats on every page. It can neither tell markup from text nor keep
repeated headings, which is why the query p4_found uses ``markup`` instead (see the README).

Defined results: rows with null key, text or URL, or without a host, and pages alone on their host keep
all their lines; '' has none.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut


def common_lines(a: list[str], b: list[str]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists of lines; works from their matches (Hunt and Szymanski)."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        where[line].append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    tails: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(link)
            else:
                ends[k] = j
                tails[k] = link
    out, link = [], tails[-1] if tails else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, mates, others = (batch.column(i).to_pylist() for i in range(4))
        shared, kept, total = [], [], []
        for text, other in zip(texts, others):
            lines = text.splitlines() if text else []
            same = set(common_lines(lines, other.splitlines())) if other else set()
            shared.append(len(same))
            total.append(len(lines))
            kept.append("\n".join(x for k, x in enumerate(lines) if k not in same))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(mates, pa.string()), pa.array(total, pa.int64()), pa.array(shared, pa.int64()), pa.array(kept, pa.string())], names=["key", "mate", "lines", "shared", "own_text"])


def page_differences(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(key, mate, lines, shared, own_text) for every row with a key and a text."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.try_parse_url(F.col(url), F.lit("HOST")).alias("host"), F.try_parse_url(F.col(url), F.lit("PATH")).alias("path"))
    rows = cut(rows.distinct().withColumn("page", F.md5(F.to_json(F.struct("key", "host", "path", F.md5("text").alias("t"))))))
    placed = F.col("host").isNotNull() & F.col("path").isNotNull()
    # Only keys and paths are sorted; written once, so that every use meets the same ranges.
    order = ["path", "key", "page"]
    ranged = cut(rows.where(placed).select("host", *order).repartitionByRange("host", *order).withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part", "host").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    host = Window.partitionBy("host").orderBy("part")  # bounded by the number of ranges
    ends = ends.select("part", "host", F.lag("last.page").over(host).alias("earlier"), F.lead("first.page").over(host).alias("later"))
    w = Window.partitionBy("part", "host").orderBy(*order)  # bounded by the size of one range
    near = ranged.select("part", "host", "page", F.lag("page").over(w).alias("before"), F.lead("page").over(w).alias("after")).join(ends, ["part", "host"])
    mates = near.select("page", F.coalesce("before", "earlier", "after", "later").alias("mate"))
    others = rows.select(F.col("page").alias("mate"), F.col("key").alias("mate_key"), F.col("text").alias("mate_text"))
    paired = rows.select("page", "key", "text").join(mates, "page", "left").join(others, "mate", "left")
    return paired.select("key", "text", "mate_key", "mate_text").mapInArrow(_difference, "key string, mate string, lines bigint, shared bigint, own_text string")
