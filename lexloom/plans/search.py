"""The six parameterised queries over index tables, as DataFrames.

``index`` has the columns of an entry with pais_idx, corpus_ord, ord; where it also holds stored
normal forms (titulo_norm, rango_norm, estado_norm, jurisdiccion_norm) or stored values as served
(titulo_served and so on) those are used, and a search is a scan without any Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.articles import MAX_CONTENT, NOT_FOUND, article
from lexloom.functions.scan import encodings, sanitize_metadata, wrap_untrusted
from lexloom.functions.text import fold, strip

DEFAULT_LIMIT, MAX_LIMIT, SUGGESTIONS = 20, 100, 10
# Names of countries; others are shown by their code in capitals.
COUNTRIES = {
    "es": "Spain", "se": "Sweden", "fr": "France", "lv": "Latvia", "at": "Austria", "de": "Germany", "kr": "South Korea", "it": "Italy",
    "pt": "Portugal", "nl": "Netherlands", "be": "Belgium", "fi": "Finland", "dk": "Denmark", "no": "Norway", "pl": "Poland", "mock": "Mock (testing)",
}
# How much of each field a summary shows.
SUMMARY = {"id": 200, "pais": 50, "titulo": 500, "rango": 100, "estado": 50, "fecha_publicacion": 50, "ultima_actualizacion": 50, "fuente": 500}
NORMED = ("titulo", "rango", "estado", "jurisdiccion")


def with_norms(index: DataFrame) -> DataFrame:
    """The stored normal forms, computed with the row, so they never go stale."""
    return index.withColumns({f"{c}_norm": fold(F.coalesce(F.col(c), F.lit(""))) for c in NORMED})


def stored(index: DataFrame) -> DataFrame:
    """What a published index holds: each entry once, its normal forms, its values as served, in index order."""
    once = with_norms(index.distinct())
    served = {f"{c}_served": sanitize_metadata(F.coalesce(F.col("pais_idx" if c == "pais" else c), F.lit("")), n) for c, n in SUMMARY.items()}
    return once.withColumns(served).repartitionByRange("corpus_ord", "ord").sortWithinPartitions("corpus_ord", "ord")


def _norm(index: DataFrame, c: str) -> Column:
    return F.col(f"{c}_norm") if f"{c}_norm" in index.columns else fold(F.coalesce(F.col(c), F.lit("")))


def size_of(c: str = "_bytes") -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("bigint"))


def summary(rows: DataFrame) -> DataFrame:
    """The served columns of an entry, each made safe and cut; the country is the index's own."""
    if all(f"{c}_served" in rows.columns for c in SUMMARY):
        return rows.select(*[F.col(f"{c}_served").alias(c) for c in SUMMARY], size_of().alias("bytes"))
    source = rows.withColumn("pais", F.col("pais_idx"))
    return source.select(*[sanitize_metadata(F.coalesce(F.col(c), F.lit("")), n).alias(c) for c, n in SUMMARY.items()], size_of().alias("bytes"))


def select_laws(index: DataFrame, text: str = "", country: str = "", rank: str = "", status: str = "", year: str = "", jurisdiction: str = "", since: str = "", until: str = "") -> DataFrame:
    """The rows that meet all criteria; an empty one is no criterion. Dates are compared as text, rows without date pass since and until."""
    date = F.coalesce(F.col("fecha_publicacion"), F.lit(""))
    asked = lambda v: fold(F.lit(v.strip()))
    rows = index
    if country:
        rows = rows.where(F.col("pais_idx") == country)
    if year.strip():
        rows = rows.where(date.startswith(year.strip()))
    if since.strip():
        rows = rows.where((date == "") | (date >= since.strip()))
    if until.strip():
        rows = rows.where((date == "") | (date <= until.strip()))
    for c, v in (("estado", status), ("rango", rank), ("jurisdiccion", jurisdiction), ("titulo", text)):
        if v.strip():
            rows = rows.where(F.contains(_norm(index, c), asked(v)))
    return rows


def search(index: DataFrame, *, limit: int = DEFAULT_LIMIT, offset: int = 0, **criteria: str) -> DataFrame:
    """One page of the laws found, in index order. Sanitised after the limit, so on at most MAX_LIMIT rows."""
    page = select_laws(index, **criteria).orderBy("corpus_ord", "ord").offset(max(0, offset)).limit(min(max(1, limit), MAX_LIMIT))
    return summary(page)


def countries(index: DataFrame) -> DataFrame:
    """(codigo, nombre, total_documentos, total_megabytes, orden) of each index, in the order of loading."""
    names = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    per = index.groupBy("pais_idx").agg(F.count("*").alias("total_documentos"), F.bround(F.sum(size_of()) / F.lit(1048576.0), 1).alias("total_megabytes"), F.min("corpus_ord").alias("orden"))
    return per.select(F.col("pais_idx").alias("codigo"), F.coalesce(F.try_element_at(names, F.col("pais_idx")), F.upper("pais_idx")).alias("nombre"), "total_documentos", "total_megabytes", "orden").orderBy("orden")


def _counted(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Counts per value; ties come in the order of first appearance."""
    first = F.min(F.struct("corpus_ord", "ord"))
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("total"), first.alias("_first")).orderBy(F.desc("total"), "_first").drop("_first")


def _known(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("desconocido"))


def ranks(index: DataFrame, country: str = "") -> DataFrame:
    rows = index.where(F.col("pais_idx") == country) if country else index
    return _counted(rows, _known("rango"), "rango").withColumn("rango", sanitize_metadata(F.col("rango"), 100))


def statuses(index: DataFrame) -> DataFrame:
    return _counted(index, _known("estado"), "estado").withColumn("estado", sanitize_metadata(F.col("estado"), 50))


def top_ranks(index: DataFrame, n: int = 10) -> DataFrame:
    return ranks(index).limit(n)


def top_years(index: DataFrame, n: int = 10) -> DataFrame:
    return _counted(index.where(F.length("fecha_publicacion") >= 4), F.substring("fecha_publicacion", 1, 4), "anno").limit(n)


def totals(index: DataFrame) -> DataFrame:
    """One row: documents, megabytes, and the countries in order."""
    return index.agg(F.count("*").alias("total_documentos"), F.coalesce(F.bround(F.sum(size_of()) / F.lit(1048576.0), 1), F.lit(0.0)).alias("total_megabytes"), F.array_join(F.array_sort(F.collect_set("pais_idx")), ",").alias("paises"))


def wanted_id(text: str) -> str:
    return text.strip().upper().replace(".MD", "")


def resolve(index: DataFrame, law: str, country: str = "") -> DataFrame:
    """(pais_idx, id): the law meant, at most one row.

    Per country an exact id, else the only id that contains the text; the first such country counts. Ids
    are compared in capitals.
    """
    q = F.lit(wanted_id(law))
    rows = (index.where(F.col("pais_idx") == country) if country else index).withColumn("_up", F.upper("id"))
    part = F.contains(F.col("_up"), q)
    per = rows.groupBy("pais_idx").agg(
        F.min("corpus_ord").alias("corpus_ord"), F.max(F.when(F.col("_up") == q, F.col("id"))).alias("exact"), F.count_if(part).alias("n"), F.min_by(F.when(part, F.col("id")), F.when(part, F.col("ord"))).alias("one")
    )
    met = per.where(F.col("exact").isNotNull() | (F.col("n") == 1)).orderBy("corpus_ord").limit(1)
    return met.select("pais_idx", F.coalesce("exact", "one").alias("id"))


def suggestions(index: DataFrame, law: str, country: str = "") -> DataFrame:
    """The first ids that contain the text, made safe: what an ambiguous request is answered with."""
    rows = index.where(F.col("pais_idx") == country) if country else index
    return rows.where(F.contains(F.upper("id"), F.lit(wanted_id(law)))).orderBy("corpus_ord", "ord").limit(SUGGESTIONS).select(sanitize_metadata(F.col("id"), 200).alias("id"))


def law_texts(rows: DataFrame, text: str = "texto", most: int = MAX_CONTENT, country: str = "pais_idx", source: str = "fuente") -> DataFrame:
    """Served texts: cut to ``most`` code points with flags, wrapped; what looks encoded is listed."""
    most = max(0, most)
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.length(whole)
    return rows.withColumn("_whole", whole).withColumns({
        "texto_truncado": n > most, "chars_totales": F.when(n > most, n), "chars_devueltos": F.when(n > most, F.lit(most)),
        "encodings": F.array_join(encodings(F.substring(whole, 1, most)), ","),
        text: wrap_untrusted(F.substring(whole, 1, most), F.col(source), F.col(country)),
    }).drop("_whole")


def law_articles(rows: DataFrame, number: str, text: str = "texto", country: str = "pais_idx", source: str = "fuente", context: int = MAX_CONTENT, wrap: bool = True) -> DataFrame:
    """(id, pais, titulo, articulo_buscado, texto, posicion_caracter, error) for every row; not found is a partial result."""
    found = rows.withColumn("_a", article(F.coalesce(F.col(text), F.lit("")), number, context))
    shown = F.when(F.col("_a").isNotNull(), wrap_untrusted(F.col("_a.texto"), F.col(source), F.col(country)) if wrap else F.col("_a.texto"))
    return found.select(
        sanitize_metadata(F.col("id"), 200).alias("id"), F.col(country).alias("pais"), sanitize_metadata(F.col("titulo")).alias("titulo"), strip(F.lit(number)).alias("articulo_buscado"),
        shown.alias("texto"), F.col("_a.posicion").alias("posicion_caracter"), F.when(F.col("_a").isNull(), F.lit(NOT_FOUND)).alias("error"),
    )
