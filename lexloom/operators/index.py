"""Building and refreshing the index of a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions.scan import scan_body, scan_metadata
from lexloom.functions.text import field, front_fields
from lexloom.session import cut

MOST = 8000  # code points kept of a metadata value
# Keys of the front matter, first non-empty one wins.
KEYS = {
    "titulo": ("titulo", "title"), "identificador": ("identificador", "identifier"), "pais": ("pais", "country"), "rango": ("rango", "rank"),
    "fecha_publicacion": ("fecha_publicacion", "publication_date"), "ultima_actualizacion": ("ultima_actualizacion", "last_updated"),
    "estado": ("estado", "status"), "fuente": ("fuente", "source"), "jurisdiccion": ("jurisdiccion", "jurisdiction"),
    "departamento": ("departamento", "department"), "fecha_derogacion": ("fecha_derogacion", "repeal_date"), "derogado_por": ("derogado_por", "repealed_by"),
}
OPTIONAL = ("jurisdiccion", "departamento", "fecha_derogacion", "derogado_por")
SERVED = tuple(KEYS)


def build_entries(files: DataFrame, default_country: str, text: str = "text", rel: str = "rel") -> DataFrame:
    """Entries from files with columns rel, text, length, mtime: raw id, fields, and which fields were cut.

    Optional fields are null when absent, the others ''. An id of digits gets the country before it.
    """
    f = files.withColumn("_f", front_fields(F.col(text))).withColumn("_archivo", F.regexp_extract(rel, r"([^/]*)\z", 1))
    found = {k: field(F.col("_f"), *names) for k, names in KEYS.items()}
    found["identificador"] = F.coalesce(found["identificador"], F.regexp_replace("_archivo", r"\.[^.]*\z", ""))
    found["pais"] = F.coalesce(found["pais"], F.lit(default_country))
    found = {k: v if k in OPTIONAL else F.coalesce(v, F.lit("")) for k, v in found.items()}
    f = f.withColumns({f"_v_{k}": v for k, v in found.items()})
    digits = F.col("_v_identificador").rlike(r"\A\d+\z") & (F.col("_v_pais") != "")
    f = f.withColumn("_v_identificador", F.when(digits, F.concat("_v_pais", F.lit("_"), "_v_identificador")).otherwise(F.col("_v_identificador")))
    long = F.filter(F.array(*[F.when(F.length(f"_v_{k}") > MOST, F.lit(k)) for k in KEYS]), lambda x: x.isNotNull())
    values = [F.substring(f"_v_{k}", 1, MOST).alias(k) for k in KEYS]
    return f.select(F.col("_v_identificador").alias("raw_id"), *values, "_archivo", F.col(rel).alias("_ruta"), F.col("length").alias("_bytes"), F.col("mtime").alias("_mtime"), long.alias("truncados"), F.col(text).alias("_text"))


def new_files(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Files on disk that no entry points to."""
    return disk.join(index.select(F.col("_ruta").alias("rel")).distinct(), "rel", "left_anti")


def modified_files(disk: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Files whose size differs from the entry's or that are newer than it; all known files if ``force``."""
    known = index.select(F.col("_ruta").alias("rel"), F.col("_bytes").alias("_was"), F.col("_mtime").alias("_then")).dropDuplicates(["rel"])
    newer = F.coalesce((F.col("_then") != 0) & (F.col("mtime") > F.col("_then")), F.lit(False))
    return disk.join(known, "rel").where(F.lit(force) | ~F.col("length").eqNullSafe(F.col("_was")) | newer).drop("_was", "_then")


def orphans(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Entries whose file is gone."""
    return index.join(disk.select(F.col("rel").alias("_ruta")).distinct(), "_ruta", "left_anti")


def derived_id(raw: Column, rel: Column) -> Column:
    return F.concat(raw, F.lit("__"), F.regexp_replace(F.regexp_replace(rel, r"\.md\z", ""), "/", "_"))


def resolve_ids(entries: DataFrame, raw: str = "raw_id", rel: str = "_ruta", priority: str | None = None) -> DataFrame:
    """Adds ``id`` and ``collided``: of several files with one id the first in path order keeps it.

    ``priority`` (0 first) puts owners that stay in the index before others. Derived ids that would meet
    another id get a number. The window holds the files of one raw id; null ids are kept null.
    """
    order = [F.col(priority)] if priority else []
    w = Window.partitionBy(raw).orderBy(*order, F.split(F.col(rel), "/"))
    ranked = entries.withColumn("_n", F.row_number().over(w))
    ranked = ranked.withColumn("collided", (F.col("_n") > 1) & F.col(raw).isNotNull())
    ranked = ranked.withColumn("id", F.when(F.col("collided"), derived_id(F.col(raw), F.col(rel))).otherwise(F.col(raw)))
    again = Window.partitionBy("id").orderBy("collided", F.split(F.col(rel), "/"))
    ranked = ranked.withColumn("_m", F.row_number().over(again))
    return ranked.withColumn("id", F.when((F.col("_m") > 1) & F.col("id").isNotNull(), F.concat("id", F.lit("__"), F.col("_m").cast("string"))).otherwise(F.col("id"))).drop("_n", "_m")


def merge_audit(previous: DataFrame, fresh: DataFrame, disk: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Audit rows (kind, file, labels): earlier ones whose file is there and was not scanned again, and the new ones."""
    kept = previous.join(disk.select(F.col("rel").alias("file")).distinct(), "file", "left_semi").join(rescanned.select(F.col("rel").alias("file")).distinct(), "file", "left_anti")
    return kept.select("kind", "file", "labels").unionByName(fresh.select("kind", "file", "labels")).withColumn("labels", F.array_sort(F.array_distinct("labels")))


@dataclass
class Refresh:
    """What one indexing run found."""

    entries: DataFrame
    audit: DataFrame
    new: int
    modified: int
    orphaned: int
    changed: bool
    failed: int = 0  # files that could not be looked at or read; their entries stay as they are
    read: int = 0  # files whose contents were read
    letters: int = 0  # code points read


def refresh(disk: DataFrame, index: DataFrame, audit: DataFrame, country: str, *, load: Callable[[DataFrame], DataFrame] | None = None, force: bool = False, remove_orphans: bool = False, force_unsafe: bool = False) -> Refresh:
    """One incremental run: ``disk`` has rel, length, mtime; ``index`` the entries so far; ``audit`` the rows so far.

    What is on disk is compared by its sizes and times alone; ``load`` adds the texts of the new and modified
    files (without it ``disk`` has them). Files with an ``error`` or without a text are counted and skipped: an
    entry that is there stays as it is. What was read is counted on its way by an observation.

    Hostile bodies are quarantined (or recorded as forced), warnings and metadata findings recorded. Kept
    entries keep their order; new ones come after them in path order.
    """
    disk = disk if "error" in disk.columns else disk.withColumn("error", F.lit(None).cast("string"))
    if load is not None:
        disk = cut(disk)  # one listing for all comparisons; texts are not in it
    sound = disk.where("error IS NULL")
    listed = new_files(sound, index).withColumn("_pass", F.lit(1)).unionByName(modified_files(sound, index, force).withColumn("_pass", F.lit(2)))
    seen = Observation()
    loaded = cut((listed if load is None else load(listed)).observe(seen, F.count("*").alias("read"), F.count_if(F.col("text").isNull()).alias("failed"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("letters")))
    pending = loaded.where("text IS NOT NULL").drop("error")
    gone = orphans(disk, index)
    counts = {r[0]: r[1] for r in pending.groupBy("_pass").count().collect()}
    n_new, n_modified, n_gone = counts.get(1, 0), counts.get(2, 0), gone.count()
    facts = {"failed": disk.where("error IS NOT NULL").count() + seen.get["failed"], "read": seen.get["read"], "letters": seen.get["letters"]}
    if not (n_new or n_modified or n_gone):
        return Refresh(index, audit, 0, 0, 0, False, **facts)
    passes = pending.select(F.col("rel").alias("_ruta"), "_pass")
    built = scan_body(build_entries(pending, country), "_text", "_body", detail=False)
    built = cut(scan_metadata(built, list(SERVED), "_meta").drop("_text").join(passes, "_ruta"))
    severity = F.create_map(*[F.lit(x) for r in R.RULES for x in (r.label, r.severity)])
    blocks = F.filter("_body", lambda x: F.element_at(severity, x) == R.BLOCK)
    warns = F.filter("_body", lambda x: F.element_at(severity, x) == R.WARN)
    hostile = F.size(blocks) > 0
    accepted = built if force_unsafe else built.where(~hostile)
    # Owners: entries that stay. A modified file's own entry stays its owner; a moved file's old entry does not.
    kept = index.join(pending.select(F.col("rel").alias("_ruta")), "_ruta", "left_anti").join(gone.select("_ruta"), "_ruta", "left_anti")
    owners = kept.select(F.col("id").alias("raw_id"), "_ruta", F.lit(0).alias("_priority"))
    own_before = index.select(F.col("id").alias("raw_id"), "_ruta", F.lit(True).alias("_own"))
    claims = accepted.join(own_before, ["raw_id", "_ruta"], "left").select("raw_id", "_ruta", F.when(F.col("_own"), 0).otherwise(F.col("_pass")).alias("_priority"))
    # Only owners of an id that a pending file claims, or could be given, take part.
    asked = claims.select("raw_id").union(claims.select(derived_id(F.col("raw_id"), F.col("_ruta")))).distinct()
    ids = resolve_ids(owners.join(asked, "raw_id", "left_semi").unionByName(claims), priority="_priority").select("id", "collided", "_ruta")
    top = index.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_top"))
    known = index.select("_ruta", "ord").dropDuplicates(["_ruta"])
    fresh = accepted.join(ids, "_ruta").join(known, "_ruta", "left")
    # New entries come last, in path order: a range sort numbers them in order (with gaps), not in one task.
    late = cut(fresh.where("ord is null").select("_ruta").orderBy(F.split("_ruta", "/")).select("_ruta", (F.monotonically_increasing_id() + 1).alias("_late")))
    fresh = fresh.join(late, "_ruta", "left").crossJoin(F.broadcast(top)).withColumn("ord", F.coalesce("ord", F.col("_top") + F.col("_late")))
    columns = ["id", "ord", *SERVED, "_archivo", "_ruta", "_bytes", "_mtime"]
    staying = kept if remove_orphans else kept.unionByName(gone.join(fresh.select("id"), "id", "left_anti"))
    entries = staying.select(*columns).unionByName(fresh.select(*columns))
    kinds = {
        "forzados" if force_unsafe else "cuarentena": (hostile, blocks), "avisos": (F.size(warns) > 0, warns),
        "metadatos": (F.size("_meta") > 0, F.col("_meta")), "truncados": (F.size("truncados") > 0, F.col("truncados")),
    }
    rows = None
    for kind, (there, labels) in kinds.items():
        part = (built if kind in ("forzados", "cuarentena", "avisos") or force_unsafe else accepted).where(there).select(F.lit(kind).alias("kind"), F.col("_ruta").alias("file"), labels.alias("labels"))
        rows = part if rows is None else rows.unionByName(part)
    clash = fresh.where("collided").select(F.lit("duplicados").alias("kind"), F.col("_ruta").alias("file"), F.array("raw_id").alias("labels"))
    merged = merge_audit(audit, rows.unionByName(clash), disk, pending)
    return Refresh(cut(entries), cut(merged), n_new, n_modified, n_gone, True, **facts)


def staleness(meta: DataFrame, fingerprint: str) -> DataFrame:
    """(pais_idx, rules, commit): whether an index was scanned under other rules, and how its commit compares.

    ``meta`` has pais_idx, directorio_base, is_repo, git_commit, patrones, head. The two facts are independent.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    commit = (
        F.when(empty("directorio_base"), "SIN RUTA").when(~F.coalesce("is_repo", F.lit(False)), "SIN REPO").when(empty("head"), "SIN GIT")
        .when(empty("git_commit"), "SIN LOCK").when(F.col("git_commit") == F.col("head"), "OK").otherwise("DESACTUAL")
    )
    rules = F.when(F.coalesce(F.col("patrones"), F.lit("")) != fingerprint, "REGLAS").otherwise("OK")
    return meta.select("pais_idx", rules.alias("rules"), commit.alias("commit"), (rules.eqNullSafe("REGLAS") | commit.isin("SIN LOCK", "DESACTUAL")).alias("stale"))
