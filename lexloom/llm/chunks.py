"""Problem 5: splitting long texts by content-defined landmarks snapped to natural boundaries.

A rolling hash over ``WINDOW`` code points marks landmarks that depend on the content around them
only. From the end of the piece before, the first landmark beyond the least size is taken and moved
to the nearest natural boundary within the least and the greatest size: an article's beginning where
there is one, else a paragraph, else a sentence, else white space (or the dot that stands for it), else a stop
between letters; without any, the cut is at the
landmark itself (at the greatest size if there is none), never before a combining sign. An edit
alters the pieces near it only: later cuts meet the same landmarks and boundaries again.

Each piece after the first begins with the last ``overlap`` code points of the one before; no piece
is longer than ``max_chars``. The pieces without their overlaps give back the text exactly.

Defined results: null text gives no piece; '' and texts within the limit give one piece.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.rolling import codes, window_hashes

WINDOW = 48
_ARTICLE = re.compile(r"^[^\w\n]{0,12}(?:<[^<>\n]*>|\\[a-z]+\*?\{|\{\\[a-z]+ )*[^\w\n]{0,6}(?:art(?:[ií]culo|igo|icolo|icle|ikel)|член|art\.|§)\s*\d", re.IGNORECASE | re.MULTILINE)
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)+")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”)\]]*[\s·]+")
_SPACE = re.compile(r"[\s·]+")
_JOINT = re.compile(r"[.;:!?](?=[^\W\d])")  # texts whose spaces were lost
BOUNDARIES = ("article", "paragraph", "sentence", "space", "joint")


def _marks(text: str) -> list[list[int]]:
    """Sorted cut places of each class of boundary."""
    return [[m.start() for m in _ARTICLE.finditer(text)], *([m.end() for m in p.finditer(text)] for p in (_PARAGRAPH, _SENTENCE, _SPACE, _JOINT))]


def _nearest(places: list[int], at: int, low: int, high: int) -> int | None:
    i = bisect.bisect_left(places, at)
    near = [p for p in places[max(0, i - 1) : i + 1] if low <= p <= high]
    return min(near, key=lambda p: (abs(p - at), p)) if near else None


def split(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (begin, end, kind of the boundary at the end); begin includes the overlap."""
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be less than the limit")
    n = len(text)
    if n <= max_chars:
        return [(0, n, "end")]
    fresh = max_chars - overlap
    least = max(1, fresh // 4)
    h = window_hashes(codes(text), WINDOW)
    landmarks = (np.flatnonzero(h % np.uint64(max(2, least)) == 0) + WINDOW).tolist()
    marks = _marks(text)
    out, at = [], 0
    while True:
        high = at + (max_chars if at == 0 else fresh)
        begin = max(0, at - overlap)
        if high >= n:
            out.append((begin, n, "end"))
            return out
        low = at + least
        i = bisect.bisect_left(landmarks, low)
        mark = landmarks[i] if i < len(landmarks) and landmarks[i] <= high else high
        for kind, places in zip(BOUNDARIES, marks):
            if (to := _nearest(places, mark, low, high)) is not None:
                break
        else:
            kind, to = "none", mark
            while to > low and unicodedata.combining(text[to]):
                to -= 1
        out.append((begin, to, kind))
        at = to


def _split_batches(max_chars: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = split(text, max_chars, overlap)
                begins, ends, kinds = zip(*pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(pieces), pa.string()), pa.array(range(len(pieces)), pa.int32()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), pa.array([text[b:e] for b, e, _ in pieces], pa.string())],
                    names=["key", "piece", "begin", "end", "boundary", "content"],
                )

    return run


def split_texts(df: DataFrame, key: str, text: str, max_chars: int, overlap: int, long_only: bool = False) -> DataFrame:
    """(key, piece, begin, end, boundary, content). Only texts over the limit go through Python.

    Repeated rows count once. ``long_only`` leaves out texts of one piece.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("t"))
    long = rows.where(F.length("t") > max_chars).distinct()
    cut_up = long.mapInArrow(_split_batches(max_chars, overlap), "key string, piece int, begin int, end int, boundary string, content string")
    if long_only:
        return cut_up
    short = rows.where(F.length("t") <= max_chars).distinct()
    return cut_up.union(short.select("key", F.lit(0).alias("piece"), F.lit(0).alias("begin"), F.length("t").alias("end"), F.lit("end").alias("boundary"), F.col("t").alias("content")))
