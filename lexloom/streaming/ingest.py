"""Files as they arrive: each micro-batch goes through the same scan and entry build as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexloom.functions.scan import scan_body
from lexloom.functions.text import decode
from lexloom.operators.index import build_entries
from lexloom.sources.corpus import is_document

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """(rel, text, length, mtime) of Markdown files as they appear under ``root``."""
    files = spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"\A\w+:/*", "/"), "\\A" + root.rstrip("/").replace(".", "\\.") + "/", "")
    return files.select(rel.alias("rel"), F.coalesce(decode(F.col("content")), F.lit("")).alias("text"), "length", (F.unix_micros("modificationTime") / 1e6).alias("mtime")).where(is_document(F.col("rel")))


def ingest(stream: DataFrame, country: str, target: str, checkpoint: str) -> DataStreamWriter:
    """Appends entries with their findings to ``target``; the checkpoint makes each file count once.

    Row-wise work only, so there is no state and no shuffle; ids are resolved when the index is built.
    """
    entries = scan_body(build_entries(stream, country), "_text", "hallazgos", detail=False).drop("_text")
    return entries.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
