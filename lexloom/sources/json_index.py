"""Indices as JSON files: {_meta, documentos: {id: entry}}. One bad value, entry or file costs only itself."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRINGS = (
    "titulo", "identificador", "pais", "rango", "fecha_publicacion", "ultima_actualizacion", "estado", "fuente",
    "jurisdiccion", "departamento", "fecha_derogacion", "derogado_por", "_archivo", "_ruta",
)
_MAP = "map<string,string>"


def _object(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)\A\s*\{"), F.from_json(c, _MAP))


def integer_or_zero(token: Column) -> Column:
    """A size from its raw JSON token: an integer as it is, anything else 0."""
    return F.coalesce(F.when(token.rlike(r"\A-?\d+\z"), F.try_to_number(token, F.lit("S999999999999999999")).cast("bigint")), F.lit(0).cast("bigint"))


def read_indices(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries, meta) of all index_*.json of a folder, in the order of their paths.

    Of a repeated id the last value counts at the first place. Two files of one country: the later
    entries replace the earlier at the earlier place.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "index_*.json").load(folder)
    raw = files.select(F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("stem"), F.try_to_binary(F.lit("")).alias("__x"), F.make_valid_utf8(F.col("content").cast("string")).alias("value")).drop("__x")
    root = raw.withColumn("root", _object(F.col("value"))).where("root is not null")
    root = root.withColumn("docs", _object(F.try_element_at("root", F.lit("documentos")))).where("docs is not null")
    root = root.withColumn("meta", F.coalesce(_object(F.try_element_at("root", F.lit("_meta"))), F.create_map().cast(_MAP)))
    named = lambda k: F.nullif(F.try_element_at("meta", F.lit(k)), F.lit(""))
    root = root.withColumn("pais_idx", F.coalesce(named("pais_predeterminado"), named("pais"), F.regexp_replace("stem", r"\Aindex_", "")))
    order = Window.partitionBy("pais_idx")
    placed = root.withColumn("first_stem", F.min("stem").over(order)).withColumn("last_stem", F.max("stem").over(order)).where("stem = last_stem")
    ranks = placed.select("pais_idx", F.dense_rank().over(Window.orderBy("first_stem")).alias("__r"))  # one row per country
    placed = placed.join(F.broadcast(ranks), "pais_idx").withColumn("corpus_ord", F.col("__r") - 1)
    entries = placed.select("pais_idx", "corpus_ord", F.posexplode("docs").alias("pos", "id", "entry"))
    entries = entries.groupBy("pais_idx", "corpus_ord", "id").agg(F.min("pos").cast("bigint").alias("ord"), F.max_by("entry", "pos").alias("entry"))
    entries = entries.withColumn("e", _object(F.col("entry"))).where("e is not null")
    text = lambda k: F.try_element_at("e", F.lit(k))
    columns = [text(k).alias(k) for k in STRINGS]
    out = entries.select("id", "corpus_ord", "ord", "pais_idx", *columns, integer_or_zero(text("_bytes")).alias("_bytes"), text("_mtime").try_cast("double").alias("_mtime"))
    meta = placed.select("pais_idx", "corpus_ord", "stem", named("directorio_base").alias("directorio_base"), named("git_commit").alias("git_commit"), F.get_json_object(F.try_element_at("meta", F.lit("seguridad")), "$.patrones").alias("patrones"))
    return out, meta


def write_atomic(path: str, value: dict) -> None:
    """The whole file or none: written beside its place, then moved over it."""
    handle, aside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2)
        os.replace(aside, path)
    except BaseException:
        os.unlink(aside)
        raise


def export_index(entries: DataFrame, meta: dict, path: str) -> int:
    """One corpus as a JSON file for exchange, streamed row by row in order; returns how many entries."""
    fields = [c for c in entries.columns if c not in ("id", "corpus_ord", "ord", "pais_idx")]
    handle, aside = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    n = 0
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write('{"_meta": ' + json.dumps(meta, ensure_ascii=False) + ', "documentos": {')
        for row in entries.orderBy("ord").toLocalIterator():
            value = {k: row[k] for k in fields if row[k] is not None}
            out.write((", " if n else "") + json.dumps(row["id"], ensure_ascii=False) + ": " + json.dumps(value, ensure_ascii=False))
            n += 1
        out.write("}}")
    os.replace(aside, path)
    return n
