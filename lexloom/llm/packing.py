"""Problem 7: filling containers of fixed capacity, shortest-pack-first over the histogram of sizes.

The histogram of sizes (at most ``capacity`` rows) comes to the driver. Sizes are placed longest
first; each lot goes to the least filled packs it fits in, splitting the pattern counts, or opens
new packs. The patterns, with counts, are then joined back to the items by their rank within
their size: ranks are global (salted, so that a size held by a third of all items is ranked in
parallel) and each takes its place in one container by binary search in the pattern table.

An item is cut only if it is larger than the capacity: into full containers and a rest.

Defined results: null texts take no part; an item of size 0 goes to container 0; an empty table
gives no rows; equal rows are separate items.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut

RANKED = 200_000  # items of one size are ranked in windows of about so many
MOST_SALTS = 1024


def pack_histogram(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes, longest first) and how many containers have each.

    Work is in lots, so its cost grows with distinct sizes and patterns, not with items.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []  # max-heap of rooms in use

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not by_room[room]:
            heapq.heappush(rooms, -room)
        by_room[room].append((pattern, n))

    for size in sorted((s for s in sizes if s > 0), reverse=True):
        left = sizes[size]
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < size:
                each = max(1, capacity // size)
                # New packs hold one item each for now: later, shorter sizes share the room with its like.
                full, rest = (divmod(left, each) if size * 2 <= capacity else (left, 0))
                if full:
                    put((size,) * (each if size * 2 <= capacity else 1), full)
                if rest:
                    put((size,) * rest, 1)
                left = 0
                break
            room = -rooms[0]
            pattern, n = by_room[room].pop()
            if not by_room[room]:
                heapq.heappop(rooms)
            fit = room // size  # how many of this size the emptiest pack takes
            packs = min(n, max(1, left // fit) if left >= fit else 1)
            take = min(fit, left)
            if packs < n:
                put(pattern, n - packs)
            put(pattern + (size,) * take, packs)
            left -= take * packs
    return [(p, n) for found in by_room.values() for p, n in found]


class Places:
    """For each size: from which rank on items go to which containers."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: Counter[int] = Counter()
        container = 0
        for pattern, n in patterns:
            for size, m in Counter(pattern).items():
                rows[size].append((taken[size], container, m))
                taken[size] += n * m
            container += n
        self.containers = container
        self.rows = {size: tuple(np.array(c, np.int64) for c in zip(*r)) for size, r in rows.items()}

    def of(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            if size == 0:
                continue
            own = sizes == size
            starts, base, m = self.rows[int(size)]
            i = np.searchsorted(starts, ranks[own], side="right") - 1
            out[own] = base[i] + (ranks[own] - starts[i]) // m[i]
        return out


def items(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, size, first_token): items within the capacity; larger ones cut into full parts and a rest."""
    n_parts = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(capacity))).cast("int")
    rows = sized.where(F.col(size).isNotNull()).select(F.col(key), F.col(size).cast("bigint").alias("__n"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    return rows.select(key, "part", F.least(F.lit(capacity), F.col("__n") - F.col("part") * capacity).alias("size"), (F.col("part") * F.lit(capacity).cast("bigint")).alias("first_token"))


def pack(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(container, key, part, first_token, size) for every item. ``sized`` has each record's size."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    parts = cut(items(sized, key, size, capacity))
    # The commonest size settles how many windows each size is ranked in, so a window does not grow with the input.
    commonest = parts.groupBy("size").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = min(MOST_SALTS, max(16, -(-commonest // RANKED)))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    # At most (capacity + 1) x salts rows, whatever the input.
    lots = counted.collect()
    histogram: Counter[int] = Counter()
    offsets = np.zeros((capacity + 1, salts), np.int64)
    for row in sorted(lots, key=lambda r: (r["size"], r.salt)):
        offsets[row["size"], row.salt] = histogram[row["size"]]
        histogram[row["size"]] += row.n
    places = Places(pack_histogram(dict(histogram), capacity))

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, salts, ranks in batches:
            size = sizes.to_numpy()
            yield pd.Series(places.of(size, offsets[size, salts.to_numpy()] + ranks.to_numpy() - 1))

    w = Window.partitionBy("size", "salt").orderBy(key, "part")
    ranked = salted.withColumn("rank", F.row_number().over(w))
    return ranked.select(container("size", "salt", "rank").alias("container"), key, "part", "first_token", "size")


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, and the share of the room left unused."""
    filled = packed.groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("items"))
    total = filled.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.max("tokens").alias("fullest"))
    return total.withColumn("unused_share", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * F.lit(capacity))))
