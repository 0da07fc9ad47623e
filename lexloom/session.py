"""Session helpers: table reading, the shared work folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files leave at least half of them idle (one small file is one task); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (local tests) is a folder of this machine used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "lexloom-shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    while _made:
        try:
            _remove(*_made.pop())
        except Exception:  # the session has ended: its folder is left to the cluster
            return


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that reuse reads files, not lineage.

    Written as parquet (columnar, compressed): smaller than a row checkpoint, and it
    survives the loss of any executor. Removed when the driver's Python ends, or by ``drop_cut``.
    """
    spark = df.sparkSession
    path = work_folder(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
