"""Queries of problem 1 over index_feed and index_runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.changes import Log, plan_history, replay_history, replay_runs
from lexloom.session import table, work_folder

FEED = Log("pais_idx", "_ruta", ("arrived_at", "feed_seq"), "_mtime", ("ultima_actualizacion", "_bytes"))


def plans(spark: SparkSession, d: str) -> DataFrame:
    return plan_history(table(spark, d, "index_runs"), "pais_idx", "run_id", "started_at", "status")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The work list of every successful run, each run driven through the change capture."""
    return replay_runs(table(spark, d, "index_feed"), plans(spark, d), FEED, work_folder(spark, "capture")).select("run_id", F.col("key").alias("_ruta"))


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    """The same work lists from the whole history at once, in one join: the check of ``p1_found``."""
    return replay_history(table(spark, d, "index_feed"), plans(spark, d), FEED).select("run_id", F.col("key").alias("_ruta"))


def p1_plans(spark: SparkSession, d: str) -> DataFrame:
    """The write-ahead plan of every run."""
    return plans(spark, d).select("run_id", F.col("part").alias("pais_idx"), F.col("from").alias("from_offset"), F.col("to").alias("to_offset"), "committed", F.col("replays").cast("bigint").alias("replays"))


def p1_work_size(spark: SparkSession, d: str) -> DataFrame:
    """Per committed run: how many paths it must process."""
    found = p1_history(spark, d).groupBy("run_id").agg(F.count("*").alias("rutas"))
    return plans(spark, d).where("committed").select("run_id", F.col("part").alias("pais_idx")).join(found, "run_id", "left").fillna(0, ["rutas"])


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p1_plans, p1_work_size)}

_STATES = """
WITH ok AS (SELECT DISTINCT run_id, pais_idx, started_at FROM index_runs WHERE status = 'ok' AND pais_idx IS NOT NULL AND started_at IS NOT NULL),
seq AS (SELECT *, lag(run_id) OVER (PARTITION BY pais_idx ORDER BY started_at, run_id) AS prev FROM ok),
state AS (
  SELECT o.run_id, f._ruta, max({'m': f._mtime, 'u': f.ultima_actualizacion, 'b': f._bytes}) AS s
  FROM ok o JOIN (SELECT DISTINCT pais_idx, _ruta, arrived_at, coalesce(_mtime, -1e300) AS _mtime, ultima_actualizacion, _bytes FROM index_feed) f
    ON f.pais_idx = o.pais_idx AND f.arrived_at <= o.started_at
  GROUP BY o.run_id, f._ruta),
found AS (
  SELECT c.run_id, c._ruta FROM state c JOIN seq r ON r.run_id = c.run_id
  LEFT JOIN state p ON p.run_id = r.prev AND p._ruta = c._ruta
  WHERE p.run_id IS NULL OR p.s.u IS DISTINCT FROM c.s.u OR p.s.b IS DISTINCT FROM c.s.b)
"""

ORACLES = {
    "p1_found": _STATES + "SELECT run_id, _ruta FROM found",
    "p1_history": _STATES + "SELECT run_id, _ruta FROM found",
    "p1_work_size": _STATES + "SELECT o.run_id, o.pais_idx, count(f._ruta) AS rutas FROM ok o LEFT JOIN found f USING (run_id) GROUP BY 1, 2",
    "p1_plans": """
WITH r AS (SELECT DISTINCT run_id, pais_idx, started_at, status = 'ok' AS ok FROM index_runs WHERE pais_idx IS NOT NULL AND started_at IS NOT NULL),
p AS (SELECT *, max(CASE WHEN ok THEN started_at END) OVER w AS f, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w, 0) AS done
      FROM r WINDOW w AS (PARTITION BY pais_idx ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_id, pais_idx, f AS from_offset, started_at AS to_offset, coalesce(ok, FALSE) AS committed,
       row_number() OVER (PARTITION BY pais_idx, done ORDER BY started_at, run_id) - 1 AS replays FROM p""",
}
