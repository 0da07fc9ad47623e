"""Problem 1: processing only what is new or changed since the last successful run.

Log-based change capture. The log has partitions (``partition``) and an offset that orders the
deliveries of a partition (``offset``). A run first writes its plan, the range of offsets it will take
per partition, ahead of any work; a run that fails leaves its plan behind, and the next run
replays it before going on. A partition's committed offset moves only with a successful run, so
nothing is skipped; the sink is written per batch (overwriting what a failed attempt left) and read
without repeats of one key and offset, so nothing comes twice.

A key is new or changed if its state, the tracked columns of the row with the greatest version, is
not the one of the last committed run. Null is a value, equal to null. Rows with a null key,
partition or offset are left out; a null version is the least version; of rows that tie in version
the greatest tracked values are taken.

* ``plan_history`` and ``replay_history`` do this for a whole history of runs at once: the ranges of
  all committed plans are met with the log in one join, states are pre-aggregated per key and run
  before any window (a key with a tenth of all deliveries leaves one row per run), and no window holds
  more rows than there are runs.
* ``ChangeCapture`` keeps plans, commits, states and the sink in a folder and runs one batch at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Log:
    """Names of the columns of a change log."""

    partition: str
    key: str
    offsets: tuple[str, ...]  # compared in this order; unique within a partition
    version: str
    tracked: tuple[str, ...]


def plan_history(runs: DataFrame, partition: str, run_id: str, at: str, status: str, ok: str = "ok") -> DataFrame:
    """The plan of every run: (run_id, partition, from, to, committed, replays).

    ``from`` (excluded; null: the log's beginning) is the offset of the last successful run of the
    partition, ``to`` (included) the run's own; ``replays`` counts the failed plans it takes over.
    Repeated rows of a run count once; runs with null start or partition have no plan.
    """
    once = runs.where(F.col(partition).isNotNull() & F.col(at).isNotNull()).select(F.col(run_id).alias("run_id"), F.col(partition).alias("part"), F.col(at).alias("to"), (F.col(status) == ok).alias("committed")).distinct()
    once = once.withColumn("committed", F.coalesce("committed", F.lit(False)))
    before = Window.partitionBy("part").orderBy("to", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    planned = once.withColumn("from", F.max(F.when(F.col("committed"), F.col("to"))).over(before)).withColumn("__done", F.coalesce(F.sum(F.col("committed").cast("int")).over(before), F.lit(0)))
    place = Window.partitionBy("part", "__done").orderBy("to", "run_id")
    return planned.withColumn("replays", F.row_number().over(place) - 1).drop("__done")


def replay_history(log: DataFrame, plans: DataFrame, names: Log) -> DataFrame:
    """(run_id, key, offset): the work list of every committed run. The offset is the last one taken for the key."""
    rows = log.where(F.col(names.partition).isNotNull() & F.col(names.key).isNotNull() & F.col(names.offsets[0]).isNotNull()).select(
        F.col(names.partition).alias("part"), F.col(names.key).alias("key"), F.col(names.offsets[0]).alias("offset"), F.struct(names.version, *names.tracked).alias("state")
    )
    begin = rows.agg(F.min("offset").alias("first"))  # one row
    # Ranges and rows meet by partition and day, so a row is compared with the few runs of its day.
    ranges = plans.where("committed").crossJoin(F.broadcast(begin)).where("first <= to")
    ranges = ranges.withColumn("day", F.explode(F.sequence(F.to_date(F.coalesce("from", "first")), F.to_date("to")))).select("run_id", "part", "from", "to", "day")
    taken = rows.withColumn("day", F.to_date("offset")).join(ranges, ["part", "day"]).where((F.col("from").isNull() | (F.col("offset") > F.col("from"))) & (F.col("offset") <= F.col("to")))
    per_run = taken.groupBy("part", "key", "run_id", "to").agg(F.max("state").alias("state"), F.max("offset").alias("offset"))
    order = Window.partitionBy("part", "key").orderBy("to", "run_id")
    known = per_run.withColumn("state", F.max("state").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    value = F.struct(*[F.col(f"state.{c}") for c in names.tracked])
    known = known.withColumn("now", value).withColumn("was", F.lag("now").over(order)).withColumn("nth", F.row_number().over(order))
    return known.where((F.col("nth") == 1) | ~F.col("now").eqNullSafe(F.col("was"))).select("run_id", "key", "offset")


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _after(a: list, b: list) -> bool:
    """Whether offset ``a`` is beyond ``b``; one of fewer values is beyond all that begin with it."""
    for x, y in zip(a, b):
        if x != y:
            return x > y
    return len(a) < len(b)


class ChangeCapture:
    """Incremental runs over a growing log, with all state in ``root`` (any file system Spark can write).

    root/plans/N.json    the plan of batch N (the range of offsets per partition), written before its work
    root/batches/batch=N the states the batch leaves; rows with ``changed`` are its work list
    root/commits/N.json  the committed offsets of all partitions, written last; without it batch N does not count

    Offsets are unique within a partition and never go back: of deliveries of one instant a second column
    (a sequence number) tells which came later, so one that lands after a run is taken by the next. A plan or
    commit is a whole file, renamed into place; that two runs cannot take one batch holds where a rename
    onto an existing file fails (HDFS and object stores with conditional writes).
    """

    def __init__(self, spark: SparkSession, root: str, names: Log, compact_every: int = 20) -> None:
        self.spark, self.root, self.names, self.compact_every = spark, root.rstrip("/"), names, compact_every
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _last(self, kind: str) -> int:
        """The number of the last file of a kind, -1 if there is none. Contents are not read."""
        if not self._fs.exists(self._path(kind)):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(kind))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit()), default=-1)

    def _read(self, kind: str, batch: int) -> dict:
        stream = self._fs.open(self._path(kind, f"{batch}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, kind: str, batch: int, value: dict) -> None:
        """A whole file or none: written aside, then renamed."""
        aside, final = self._path(kind, f".{uuid.uuid4().hex}"), self._path(kind, f"{batch}.json")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise RuntimeError(f"{kind} {batch} exists already: another run took this batch")

    def committed(self) -> dict[str, list]:
        """The committed offset of each partition."""
        last = self._last("commits")
        return self._read("commits", last)["offsets"] if last >= 0 else {}

    def plan(self, log: DataFrame, until: dict[str, list] | None = None) -> tuple[int, dict]:
        """The plan left by a failed run, else a new one. Its size is the number of partitions.

        A new plan goes from the committed offsets to the last ones in the log, or to those of ``until``
        (an offset of fewer values than the log has columns includes all that begin with it).
        """
        batch = self._last("commits") + 1
        if self._last("plans") >= batch:
            return batch, self._read("plans", batch)
        last = self.committed()
        ends = self._ends(log, last) if until is None else until
        ranges = {p: [last.get(p), end] for p, end in ends.items() if p not in last or _after(end, last[p])}
        value = {"ranges": ranges}
        if ranges:
            self._write("plans", batch, value)
        return batch, value

    def _ends(self, log: DataFrame, last: dict[str, list]) -> dict[str, list]:
        """The greatest offset of each partition; the scan begins at the least committed one if all partitions have one."""
        end = F.max(F.struct(*[F.col(c) for c in self.names.offsets]))
        shown = [F.date_format(f"end.{c}", "yyyy-MM-dd HH:mm:ss.SSSSSS") if t.startswith("timestamp") else F.col(f"end.{c}") for c, t in self._offset_types(log)]
        rows = log.where(self._present())
        if last:
            first, kind = self._offset_types(log)[0]
            low = F.lit(min(x[0] for x in last.values())).cast(kind)
            rows = rows.where((F.col(first) >= low) | ~F.col(self.names.partition).isin(list(last)))
        return {r[0]: list(r[1]) for r in rows.groupBy(F.col(self.names.partition).cast("string")).agg(end.alias("end")).select(F.col(self.names.partition), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(shown)])).collect()}

    def _present(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (self.names.partition, self.names.key, *self.names.offsets)])

    def _offset_types(self, log: DataFrame) -> list[tuple[str, str]]:
        types = dict(log.dtypes)
        return [(c, types[c]) for c in self.names.offsets]

    def _beyond(self, types: list[tuple[str, str]], value: list, over: bool) -> str:
        """Offsets greater than ``value``, or those up to it: on the stored columns with literals, so that the scan gets them."""
        more, equal = (">", ">=") if over else ("<", "<=")
        cols = [(f"`{c}`", v if isinstance(v, int) else f"CAST({_quoted(v)} AS {t})") for (c, t), v in zip(types, value)]
        strict = None
        for c, v in reversed(cols):
            if strict is None:
                strict = f"{c} {more if over else equal} {v}"
            else:
                strict = f"({c} {more} {v} OR ({c} = {v} AND {strict}))"
        return f"{strict} AND {cols[0][0]} {equal} {cols[0][1]}"

    def _between(self, log: DataFrame, ranges: dict[str, list]) -> DataFrame:
        """The rows of the log within the ranges: one condition of literals per partition."""
        types, n = self._offset_types(log), self.names
        own = [" AND ".join([f"`{n.partition}` = {_quoted(p)}", self._beyond(types, high, False), *([self._beyond(types, low, True)] if low is not None else [])]) for p, (low, high) in ranges.items()]
        there = " AND ".join(f"`{c}` IS NOT NULL" for c in (n.partition, n.key, *n.offsets))
        return log.where(f"{there} AND ({' OR '.join(f'({x})' for x in own)})")

    def _rows(self, log: DataFrame) -> DataFrame:
        n = self.names
        return log.selectExpr(f"CAST(`{n.partition}` AS string) AS part", f"`{n.key}` AS key", f"struct({', '.join(f'`{c}`' for c in n.offsets)}) AS offset", f"struct({', '.join(f'`{c}`' for c in (n.version, *n.tracked))}) AS state")

    def _states(self, now: DataFrame) -> DataFrame | None:
        """The states left by the committed batches since the last one that holds all."""
        last = self._last("commits")
        if last < 0:
            return None
        base = self._read("commits", last)["base"]
        return self.spark.read.schema(now.select("part", "key", "state").schema).parquet(*[f"{self.root}/batches/batch={b}" for b in range(base, last + 1)])

    def run(self, log: DataFrame, until: dict[str, list] | None = None, failing: frozenset[str] | set[str] = frozenset(), stop: Callable[[str], None] = lambda stage: None) -> int | None:
        """One batch; its number, or None if there is nothing new.

        Partitions in ``failing`` are planned but not committed: a later batch takes their ranges again, with
        what has come since. ``stop`` is called between the stages (tests raise in it).
        """
        batch, plan = self.plan(log, until)
        if not plan["ranges"]:
            return None
        stop("planned")
        ranges = {p: r for p, r in plan["ranges"].items() if p not in failing}
        done = {p: high for p, (_, high) in ranges.items()}
        now = self._rows(self._between(log, ranges) if ranges else log.limit(0)).groupBy("part", "key").agg(F.expr("max(state) AS state"), F.expr("max(offset) AS offset"))
        compact = batch > 0 and batch % self.compact_every == 0
        old = self._states(now)
        if old is None:
            merged = now.selectExpr("*", "state AS latest", "TRUE AS changed")
        else:
            met = old if compact else old.join(now.select("part", "key"), ["part", "key"], "left_semi")
            before = met.groupBy("part", "key").agg(F.expr("max(state) AS was"))
            same = " AND ".join(f"latest.`{x}` <=> was.`{x}`" for x in self.names.tracked)
            merged = now.join(before, ["part", "key"], "full" if compact else "left").selectExpr("*", "CASE WHEN state IS NULL OR was > state THEN was ELSE state END AS latest")
            merged = merged.selectExpr("*", f"offset IS NOT NULL AND (was IS NULL OR NOT ({same})) AS changed")
        merged = merged.selectExpr("part", "key", "latest AS state", "offset", "changed")
        merged.write.mode("overwrite").parquet(f"{self.root}/batches/batch={batch}")
        stop("written")
        base = batch if compact or old is None else self._read("commits", batch - 1)["base"]
        self._write("commits", batch, {"offsets": self.committed() | done, "base": base})
        return batch

    def plans(self) -> list[tuple[int, str, list | None, list]]:
        """(batch, partition, from, to) of all plans written so far."""
        return [(b, p, *r) for b in range(self._last("plans") + 1) for p, r in self._read("plans", b)["ranges"].items()]

    def changes(self) -> DataFrame | None:
        """(batch, part, key, offset, tracked columns): the work of committed batches, without repeats of a key and offset."""
        last = self._last("commits")
        if last < 0:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/batches").parquet(*[f"{self.root}/batches/batch={b}" for b in range(last + 1)])
        rows = rows.where("changed").select("batch", "part", "key", "offset", *[F.col(f"state.{x}").alias(x) for x in self.names.tracked])
        return rows.dropDuplicates(["part", "key", "offset"])


def replay_runs(log: DataFrame, plans: DataFrame, names: Log, root: str) -> DataFrame:
    """(run_id, key): the work list of every successful run of a history, by driving a ``ChangeCapture`` through it.

    Batch k holds the k-th run of each partition, all planned ahead. Runs that did not succeed are not
    committed, so that the next run of their partition takes their range again. There are as many batches as one
    partition has runs, each reads its own ranges of the log only. ``plans`` is the (small) table of
    ``plan_history``, whose ``to`` bounds the first offset column.
    """
    rounds: dict[int, dict[str, tuple]] = {}
    nth: dict[str, int] = {}
    for r in plans.orderBy("to", "run_id").select("part", "run_id", F.date_format("to", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("to"), "committed").collect():
        nth[r.part] = nth.get(r.part, -1) + 1
        rounds.setdefault(nth[r.part], {})[r.part] = (r.run_id, r.to, r.committed)
    capture, ids = ChangeCapture(log.sparkSession, root, names), []
    for k in sorted(rounds):
        own = rounds[k]
        batch = capture.run(log, until={p: [to] for p, (_, to, _) in own.items()}, failing={p for p, (*_, ok) in own.items() if not ok})
        ids += [(batch, p, run_id) for p, (run_id, _, ok) in own.items() if ok and batch is not None]
    made = log.sparkSession.createDataFrame(ids, "batch int, part string, run_id long")
    sink = capture.changes()
    if sink is None:
        return log.limit(0).select(F.lit(0).cast("long").alias("run_id"), F.col(names.key).alias("key"))
    return sink.join(F.broadcast(made), ["batch", "part"]).select("run_id", "key")  # one row per run
