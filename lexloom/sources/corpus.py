"""A corpus of Markdown files as a DataFrame, and the guards around paths and repositories."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import decode

# File stems that are never documents.
SKIPPED = ("readme", "license", "licence", "contributing", "code_of_conduct", "changelog", "authors")
#: Signs that no stored path may hold.
FORBIDDEN = r"[\x00-\x1f\x7f\x85\u2028\u2029]"


def is_document(path: Column) -> Column:
    """Whether a relative path is a document: not under ``.git``, its stem not on the skip list."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.md\z", ""))
    return path.endswith(".md") & ~F.array_contains(F.split(path, "/"), ".git") & ~stem.isin(*SKIPPED)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(rel, content, length, mtime) of every document under ``root``, read on the executors.

    Spark's own listing passes over names that begin with ``_`` or ``.``; ``read_listed`` keeps them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    prefix = files.sparkSession._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    rel = F.expr(f"substr(parse_url(path, 'PATH'), {len(prefix) + 1})") if root.startswith("file:") else F.regexp_replace(F.regexp_replace("path", r"\A\w+:(//[^/]*)?", ""), "\\A" + re.escape(prefix), "")
    return files.select(rel.alias("rel"), "content", "length", F.unix_micros("modificationTime").alias("__us")).select("rel", "content", "length", (F.col("__us") / 1e6).alias("mtime")).where(is_document(F.col("rel")))


_STATS = "rel string, length bigint, mtime double, error string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, length, mtime, error) of every document under a folder all executors mount, by stat alone.

    Names with ``_`` and ``.`` are included. The driver lists the top of the folder only; executors walk what is
    below. Links that lead out of the corpus and whatever is no regular file are no documents; a
    document that cannot be looked at has ``error`` set and no size.
    """
    base = os.path.realpath(root)
    tops = spark.createDataFrame([(n,) for n in sorted(os.listdir(base))], "top string")

    def walk(batches):
        import pandas as pd

        def stat(rel: str) -> tuple | None:
            try:
                found = os.stat(resolve(base, rel))
            except ValueError:
                return None
            except OSError as e:
                return rel, None, None, type(e).__name__
            return rel, found.st_size, found.st_mtime, None

        for batch in batches:
            for top in batch["top"]:
                whole = os.path.join(base, top)
                below = os.walk(whole) if os.path.isdir(whole) and not os.path.islink(whole) else [(base, [], [top])]
                for folder, _, names in below:
                    rels = [os.path.relpath(os.path.join(folder, n), base).replace(os.sep, "/") for n in names if n.endswith(".md")]
                    yield pd.DataFrame([r for r in map(stat, rels) if r], columns=["rel", "length", "mtime", "error"]).astype({"length": "Int64", "mtime": "float64"})

    spread = tops.repartition(max(1, min(tops.count(), 4 * spark.sparkContext.defaultParallelism)), "top")
    return spread.mapInPandas(walk, _STATS).where(is_document(F.col("rel")))


def load_files(listed: DataFrame, root: str) -> DataFrame:
    """``listed`` (any columns with ``rel``) with ``text`` and ``error``: contents are read on the executors, guarded.

    A file that cannot be read costs that file: null text, ``error`` set.
    """
    base = os.path.realpath(root)

    def load(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for rel in batch["rel"]:
                try:
                    with open(resolve(base, rel), "rb") as f:
                        rows.append((rel, f.read(), None))
                except (OSError, ValueError) as e:
                    rows.append((rel, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["rel", "content", "error"])

    rels = listed.select("rel").repartition("rel")
    found = rels.mapInPandas(load, "rel string, content binary, error string").select("rel", decode(F.col("content")).alias("text"), "error")
    return listed.drop("text", "error").join(found, "rel")


def read_listed(spark: SparkSession, root: str) -> DataFrame:
    """(rel, text, length, mtime, error) of every document, names with ``_`` and ``.`` included."""
    return load_files(list_files(spark, root), root)


def text_of(content: str = "content") -> Column:
    """The decoded text of a file; null if it could not be read."""
    return decode(F.col(content))


def path_allowed(path: Column) -> Column:
    """The textual half of the path guard: not empty, no forbidden signs, relative, and never above its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")), lambda acc, p: F.struct(
        (acc["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"),
        F.least(acc["least"], acc["d"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce((path != "") & ~path.rlike(FORBIDDEN) & ~path.startswith("/") & (depth["least"] >= 0) & (depth["d"] > 0), F.lit(False))


def resolve(root: str, rel: str) -> Path:
    """The whole path guard for one file, links included. Raises ValueError; a missing file is accepted."""
    if not rel or re.search(FORBIDDEN, rel) or PurePosixPath(rel).is_absolute():
        raise ValueError("path not allowed")
    base = Path(root).resolve()
    found = (base / rel).resolve()
    if not found.is_relative_to(base) or found == base or (found.exists() and not found.is_file()):
        raise ValueError("path not allowed")
    return found


def head_commit(root: str) -> str:
    """The commit at HEAD if ``root`` is the root of a repository, else ''. Never raises."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=5, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD") if Path(git("rev-parse", "--show-toplevel")).resolve() == Path(root).resolve() else ""
    except (OSError, subprocess.SubprocessError):
        return ""
