"""Problem 9, the method named: line or paragraph hashing.

Units (lines, or paragraphs between empty lines) are normalised (runs of blanks become one, outer
blanks go), their digests grouped globally, the earliest ranked occurrence (least key, then first place) is
kept and the rest removed; what is kept retains its offsets in the original text.

Whole units are all it sees: a passage that begins or ends inside a line is found by ``spans`` only.

Defined results: null keys and null texts have no units; units of less than ``least`` code points once normalised
take no part and stay; a unit repeated within one record is removed after its first place; repeated rows of one
key count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

LEAST = 40  # code points of a unit that may count as shared
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_ENDS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r\f\v]*\n\s*")}


def units(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """(begin, end) of each unit, without what parts them."""
    out, at = [], 0
    for m in _ENDS[unit].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def normalised(unit: str) -> str:
    return _BLANKS.sub(" ", unit).strip(" ")


def _digests(unit: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b, e in units(text, unit):
                    if e - b >= least and len(form := normalised(text[b:e])) >= least:
                        rows.append((hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest(), key, b, e))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int32(), pa.int32()))], names=["digest", "key", "begin", "end"])

    return run


def shared_units(df: DataFrame, key: str, text: str, unit: str = "line", least: int = LEAST) -> DataFrame:
    """(key, begin, end, first_key, first_begin, kept): every unit that occurs more than once, and its earliest occurrence.

    Digests are combined before they are shuffled, so a line held by a third of all records is one row of each task.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"))
    found = cut(rows.mapInArrow(_digests(unit, least), "digest binary, key bigint, begin int, end int").distinct())
    first = found.groupBy("digest").agg(F.min(F.struct("key", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = found.join(first, "digest")
    return met.select("key", "begin", "end", F.col("first.key").alias("first_key"), F.col("first.begin").alias("first_begin"), ((F.col("key") == F.col("first.key")) & (F.col("begin") == F.col("first.begin"))).alias("kept"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        keys, texts, gone, stays = batch.column(0).to_pylist(), [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            at, kept = 0, []
            for b, e in sorted((s["begin"], s["end"]) for s in spans or ()):
                if b > at:
                    kept.append({"begin": at, "end": b})
                at = e + (text[e : e + 1] == "\n")  # the line end goes with its line
            if at < len(text):
                kept.append({"begin": at, "end": len(text)})
            texts.append("".join(text[k["begin"] : k["end"]] for k in kept))
            stays.append(kept)
            gone.append(len(text) - len(texts[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(gone, pa.int32()), pa.array(stays, pa.list_(kinds))], names=["key", "own_text", "removed_chars", "kept"])


def without_repeats(df: DataFrame, key: str, text: str, unit: str = "line", least: int = LEAST) -> DataFrame:
    """(key, own_text, removed_chars, kept): each text without the units kept elsewhere; ``kept`` are the ranges of the
    original text that ``own_text`` is put together from. Null texts are left out.
    """
    gone = shared_units(df, key, text, unit, least).where("not kept").groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # bounded by the length of a text
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t")).dropDuplicates(["key"])
    # Both sides lie by key: the texts are shuffled once.
    return rows.join(gone, "key", "left").select("key", "t", "spans").mapInArrow(_cut_out, "key bigint, own_text string, removed_chars int, kept array<struct<begin:int,end:int>>")
