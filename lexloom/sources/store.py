"""The index as a stored table: versions of Parquet and a pointer that readers follow.

A version holds the entries once each, with their normal forms for searching and their values as served
(made safe under one set of rules). It is written whole, then the pointer is moved onto it by a rename, so a reader
meets the version before or the new one, never a half of one. The pointer names the rules; an index
of other rules is stale.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.functions import rules as R

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def publish(rows: DataFrame, root: str, keep: int = 2) -> str:
    """Writes a version and points to it; the ``keep`` latest versions stay for readers that are on their way."""
    spark, root = rows.sparkSession, root.rstrip("/")
    fs, base, jvm = _fs(spark, root)
    path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((root, *p)))
    before = current(spark, root)
    number = before["number"] + 1 if before else 0
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{root}/{version}")
    aside = path(f".{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps({"version": version, "number": number, "rules": R.fingerprint(R.METADATA)}).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(base.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, path(POINTER), over)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(base) if s.getPath().getName().startswith("v"))
    for old in versions[: -max(1, keep)]:
        if old != version:
            fs.delete(path(old), True)
    return version


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: version, number, rules; None if nothing is published."""
    fs, _, jvm = _fs(spark, root)
    where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def open_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, or None if there is none."""
    now = current(spark, root)
    return None if now is None else spark.read.parquet(f"{root.rstrip('/')}/{now['version']}")
