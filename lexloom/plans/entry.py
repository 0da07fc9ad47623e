"""Queries over the reference's operators, adapted to the given tables, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import rules as R
from lexloom.functions import scan, text
from lexloom.operators import index as I
from lexloom.plans import search as S
from lexloom.session import spread, table, work_folder
from lexloom.sources import store
from lexloom.sources.corpus import path_allowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- the tables as the engine sees them


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The index: repeated rows count once."""
    return table(spark, d, "index_entries").distinct()


_published: dict[tuple[str, str], str] = {}


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """The index as published for searching: built once for a session and folder, read from then on."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _published or store.current(spark, _published[key]) is None:  # not yet, or the shared folder was emptied
        root = work_folder(spark, "index")
        store.publish(S.stored(table(spark, d, "index_entries")), root)
        _published[key] = root
    return store.open_index(spark, _published[key])


def laws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ley_completa").withColumnRenamed("pais", "pais_idx").distinct()


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


IDX = "(SELECT DISTINCT * FROM index_entries)"
LAWS = "(SELECT DISTINCT * FROM ley_completa)"
INVISIBLE = "'[\\x{200b}-\\x{200f}\\x{2060}\\x{feff}\\x{ad}]'"
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), '{text.ACCENTED}', '{text.FOLDED}')"


def seen_sql(x: str) -> str:
    return f"regexp_replace({x}, {INVISIBLE}, '', 'g')"


def clean_sql(x: str, n: int) -> str:
    return f"substr({seen_sql(f"regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")}, 1, {n})"


SUMMARY_SQL = ", ".join(f"{clean_sql('pais_idx' if c == 'pais' else c, n)} AS {c}" for c, n in S.SUMMARY.items()) + ", coalesce(_bytes, 0) AS bytes"


def page_sql(where: str, limit: int = 20, offset: int = 0) -> str:
    return f"SELECT {SUMMARY_SQL} FROM (SELECT * FROM {IDX} WHERE {where} ORDER BY corpus_ord, ord LIMIT {limit} OFFSET {offset})"


def has_sql(c: str, q: str) -> str:
    return f"contains({fold_sql(f"coalesce({c}, '')")}, {fold_sql(quoted(q))})"


# ---- search


@query(page_sql(has_sql("titulo", "decreto")))
def search_title(spark, d):
    return S.search(indexed(spark, d), text="decreto")


@query(page_sql(has_sql("titulo", "LICENÇA em vigor")))
def search_title_folded(spark, d):
    return S.search(indexed(spark, d), text="LICENÇA em vigor")


@query(page_sql(f"pais_idx = 'es' AND starts_with(coalesce(fecha_publicacion, ''), '20') AND {has_sql('estado', 'in_force')} AND {has_sql('rango', 'ley')} AND {has_sql('titulo', 'sobre')}"))
def search_filters_all(spark, d):
    return S.search(indexed(spark, d), text="sobre", country="es", year="20", status="In_Force", rank="LEY")


@query(page_sql("starts_with(coalesce(fecha_publicacion, ''), '2001')", 100))
def search_year_prefix(spark, d):
    return S.search(indexed(spark, d), year=" 2001 ", limit=100)


@query(page_sql("(coalesce(fecha_publicacion, '') = '' OR fecha_publicacion >= '1999-06') AND (coalesce(fecha_publicacion, '') = '' OR fecha_publicacion <= '2003')", 100))
def search_date_range(spark, d):
    return S.search(indexed(spark, d), since="1999-06", until="2003", limit=100)


@query(page_sql(has_sql("estado", "repealed"), 50))
def search_status_substring(spark, d):
    return S.search(indexed(spark, d), status="repealed", limit=50)


@query(page_sql(has_sql("jurisdiccion", "a") + " AND pais_idx = 'ch'", 50))
def search_jurisdiction(spark, d):
    return S.search(indexed(spark, d), jurisdiction="a", country="ch", limit=50)


@query(page_sql("pais_idx = 'de'", 10, 15))
def search_page_offset(spark, d):
    return S.search(indexed(spark, d), country="de", limit=10, offset=15)


@query(page_sql("TRUE", 100))
def search_limit_clamp(spark, d):
    return S.search(indexed(spark, d), limit=100_000, offset=-5)


@query(f"SELECT id, {', '.join(f"{fold_sql(f"coalesce({c}, '')")} AS {c}_norm" for c in S.NORMED)} FROM {IDX}")
def index_norms(spark, d):
    """The stored normal forms of every entry."""
    return indexed(spark, d).select("id", *[f"{c}_norm" for c in S.NORMED])


# ---- counts

_NAMES = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in S.COUNTRIES.items())
_MB = "round_even(sum(coalesce(_bytes, 0)) / 1048576.0::DOUBLE, 1)"


@query(f"SELECT pais_idx AS codigo, coalesce(any_value(n.name), upper(pais_idx)) AS nombre, count(*) AS total_documentos, {_MB} AS total_megabytes, min(corpus_ord) AS orden FROM {IDX} LEFT JOIN (VALUES {_NAMES}) n(code, name) ON code = pais_idx GROUP BY pais_idx")
def country_list(spark, d):
    return S.countries(entries(spark, d))


def counts_sql(key: str, name: str, where: str = "TRUE", limit: str = "") -> str:
    return f"SELECT {name}, total FROM (SELECT {key} AS {name}, count(*) AS total, min(corpus_ord * 1000000000::BIGINT + ord) AS o FROM {IDX} WHERE {where} GROUP BY 1 ORDER BY total DESC, o {limit})"


@query(counts_sql("coalesce(nullif(rango, ''), 'desconocido')", "rango"))
def rank_counts(spark, d):
    return S.ranks(entries(spark, d))


@query(counts_sql("coalesce(nullif(estado, ''), 'desconocido')", "estado"))
def stats_status(spark, d):
    return S.statuses(entries(spark, d))


@query(counts_sql("coalesce(nullif(rango, ''), 'desconocido')", "rango", limit="LIMIT 10"))
def stats_top_ranks(spark, d):
    return S.top_ranks(entries(spark, d))


@query(counts_sql("substr(fecha_publicacion, 1, 4)", "anno", "length(fecha_publicacion) >= 4", "LIMIT 10"))
def stats_top_years(spark, d):
    return S.top_years(entries(spark, d))


@query(f"SELECT count(*) AS total_documentos, coalesce({_MB}, 0) AS total_megabytes, array_to_string(list_sort(list(DISTINCT pais_idx)), ',') AS paises FROM {IDX}")
def stats_totals(spark, d):
    return S.totals(entries(spark, d))


# ---- looking up a law


def resolve_sql(q: str, country: str = "") -> str:
    where = f"WHERE pais_idx = {quoted(country)}" if country else ""
    return f"""
SELECT pais_idx, coalesce(exact, one) AS id FROM (
  SELECT pais_idx, min(corpus_ord) AS o, max(CASE WHEN upper(id) = {quoted(q)} THEN id END) AS exact,
         count(*) FILTER (contains(upper(id), {quoted(q)})) AS n, min(id) FILTER (contains(upper(id), {quoted(q)})) AS one
  FROM {IDX} {where} GROUP BY pais_idx)
WHERE exact IS NOT NULL OR n = 1 ORDER BY o LIMIT 1"""


@query(resolve_sql("CL-DEC-2001-00000327"))
def resolve_id_exact(spark, d):
    return S.resolve(entries(spark, d), " cl-dec-2001-00000327.md")


@query(resolve_sql("00000327"))
def resolve_id_partial(spark, d):
    return S.resolve(entries(spark, d), "00000327")


@query(f"SELECT pais_idx AS pais, count(*) FILTER (contains(upper(id), '-LEY-')) AS matches, (SELECT id FROM ({resolve_sql('-LEY-', 'es')})) AS id FROM {IDX} WHERE pais_idx = 'es' GROUP BY 1 UNION ALL SELECT 'cl', count(*), (SELECT id FROM ({resolve_sql('DEC-2001-00000327', 'cl')})) FROM {IDX} WHERE pais_idx = 'cl' AND contains(upper(id), 'DEC-2001-00000327')")
def resolve_id_ambiguous(spark, d):
    """Several laws of the one country searched: no id; one law: its id."""

    def asked(law: str, country: str) -> DataFrame:
        matches = entries(spark, d).where((F.col("pais_idx") == country) & F.contains(F.upper("id"), F.lit(law))).agg(F.lit(country).alias("pais"), F.count("*").alias("matches"))
        return matches.join(S.resolve(entries(spark, d), law, country).select("id"), F.lit(True), "left")

    return asked("-LEY-", "es").union(asked("DEC-2001-00000327", "cl"))


@query(f"SELECT {clean_sql('id', 200)} AS id FROM (SELECT id FROM {IDX} WHERE pais_idx = 'es' AND contains(upper(id), '-LEY-') ORDER BY corpus_ord, ord LIMIT 10)")
def resolve_suggestions(spark, d):
    return S.suggestions(entries(spark, d), "-ley-", "es")


# ---- texts of laws

_ATTR = "substr(regexp_replace(coalesce({}, ''), '[\\x00-\\x1f\\x7f\"''<>&]', '', 'g'), 1, 200)"
_CLOSING = f"(?i)</{SPACE}*untrusted_content{SPACE}*>|<{SPACE}*/?{SPACE}*untrusted_content\\b"


def wrap_sql(x: str) -> str:
    return f"'<untrusted_content source=\"' || {_ATTR.format('fuente')} || '\" country=\"' || {_ATTR.format('pais')} || '\">' || chr(10) || {quoted(scan.NOTE)} || chr(10) || '---' || chr(10) || regexp_replace({x}, '{_CLOSING}', '[filtered-tag]', 'g') || chr(10) || '</untrusted_content>'"


_T = "coalesce(texto, '')"


@query(f"SELECT id, length({_T}) > 1500 AS texto_truncado, CASE WHEN length({_T}) > 1500 THEN length({_T})::INT END AS chars_totales, CASE WHEN length({_T}) > 1500 THEN 1500 END AS chars_devueltos, {wrap_sql(f'substr({_T}, 1, 1500)')} AS texto FROM {LAWS}")
def law_truncated(spark, d):
    return S.law_texts(laws(spark, d), most=1500).select("id", "texto_truncado", "chars_totales", "chars_devueltos", "texto")


@query(f"SELECT id, FALSE AS texto_truncado, {wrap_sql(_T)} AS texto FROM {LAWS}")
def law_wrapped(spark, d):
    return S.law_texts(laws(spark, d)).select("id", "texto_truncado", "texto")


@query(f"SELECT {', '.join(f'{clean_sql(c, n)} AS {c}' for c, n in S.SUMMARY.items())}, coalesce(bytes, 0) AS bytes FROM (SELECT DISTINCT id, pais, titulo, rango, estado, fecha_publicacion, ultima_actualizacion, fuente, bytes FROM ley_completa)")
def law_metadata_only(spark, d):
    return S.summary(laws(spark, d).withColumnRenamed("bytes", "_bytes").select("id", "pais_idx", *[c for c in S.SUMMARY if c not in ("id", "pais")], "_bytes").distinct())


def article_sql(number: str) -> str:
    from lexloom.functions.articles import FORMS, NEXT, NOT_FOUND

    def re2(p: str) -> str:
        return p.replace("\\s", SPACE).replace("\\d", "\\p{Nd}")

    forms = [re2(f.replace("T\\b", number + "\\b") if "Art" in f or "art" in f else f.replace("T", number)) for f in FORMS]
    strip = lambda x: f"regexp_replace({x}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"
    hit = [f"regexp_matches({_T}, '(?im){f}')" for f in forms]
    frag = [strip(f"regexp_extract({_T}, '(?im)((?:{f})(?s:.*?))(?:{re2(NEXT)}|\\z)', 1)") for f in forms]
    pos = [f"length(regexp_extract({_T}, '(?im)\\A((?s:.*?))(?:{f})', 1))::INT" for f in forms]
    case = lambda xs: "CASE " + " ".join(f"WHEN {h} THEN {x}" for h, x in zip(hit, xs)) + " END"
    return f"SELECT id, pais, {clean_sql('titulo', 500)} AS titulo, '{number}' AS articulo_buscado, {case(frag)} AS texto, {case(pos)} AS posicion_caracter, {case(['NULL'] * len(hit))[:-4]} ELSE '{NOT_FOUND}' END AS error FROM {LAWS}"


def _articles(spark, d, number):
    return S.law_articles(laws(spark, d), number, wrap=False)


@query(article_sql("3"))
def article_extract(spark, d):
    return _articles(spark, d, "3")


@query(article_sql("12"))
def article_extract_late(spark, d):
    return _articles(spark, d, "12")


@query(article_sql("9999"))
def article_missing(spark, d):
    return _articles(spark, d, "9999")


# ---- scanning. The given texts hold no injected instructions, so every document gets one of the rules'
# own samples or a harmless line in front, the same on both sides.

PLAIN = ("Reglamento de evaluación (art. 5).", "La actriz dijo: usuarios y sistemas.", "Ley de protección de datos.")
BLOBS = ("data: " + "QUJD" * 20 + "==", r"bytes \x41\x42\x43\x44\x45 end", "iVBOR" * 15 + "= and " + "Zm9v" * 30 + "=")
LINES = tuple(r.sample for r in R.RULES) + PLAIN


def overlaid(spark: SparkSession, d: str, lines: tuple[str, ...] = LINES) -> DataFrame:
    picked = F.element_at(F.array(*[F.lit(x) for x in lines]), (F.col("doc_id") % len(lines) + 1).cast("int"))
    return spread(table(spark, d, "documents")).select("doc_id", "source", picked.alias("line"), F.concat(picked, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("t"))


def overlaid_sql(lines: tuple[str, ...] = LINES) -> str:
    picked = f"([{', '.join(quoted(x) for x in lines)}])[(doc_id % {len(lines)} + 1)::INT]"
    return f"(SELECT doc_id, source, {picked} AS line, {picked} || chr(10) || coalesce(text, '') AS t FROM documents)"


def labels_sql(x: str, surface: str) -> str:
    out = []
    for r in R.of_surface(surface):
        gates = " OR ".join(f"contains(lower({x}), {quoted(g)})" for g in r.gates)
        out.append(f"CASE WHEN ({gates}) AND regexp_matches({x}, {quoted(f'(?{r.flags})' + r.pattern)}) THEN {quoted(r.label)} END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


_SCANNED = f"(SELECT doc_id, {labels_sql('s', R.BODY)} AS ls FROM (SELECT doc_id, {seen_sql('t')} AS s FROM {overlaid_sql()}))"
_SEVERITY = f"(VALUES {', '.join(f'({quoted(r.label)}, {quoted(r.severity)})' for r in R.RULES)}) v(label, severity)"


def _scanned(spark, d):
    return scan.scan_body(overlaid(spark, d), "t", detail=False)


@query(f"SELECT doc_id, array_to_string(ls, ',') AS labels FROM {_SCANNED}")
def scan_body(spark, d):
    return _scanned(spark, d).select("doc_id", F.array_join("findings", ",").alias("labels"))


@query()
def scan_findings(spark, d):
    """Label, severity, place and surroundings of every finding (the places are those of the NFKC form)."""
    return scan.scan_body(overlaid(spark, d), "t").select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.label", "f.severity", "f.pos", "f.snippet")


def _severities() -> Column:
    return F.create_map(*[F.lit(x) for r in R.RULES for x in (r.label, r.severity)])


@query(f"SELECT label, severity, count(*) AS documents FROM (SELECT unnest(ls) AS label FROM {_SCANNED}) JOIN {_SEVERITY} USING (label) GROUP BY 1, 2")
def scan_summary_by_label(spark, d):
    rows = _scanned(spark, d).select(F.explode("findings").alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("documents")).select("label", F.element_at(_severities(), F.col("label")).alias("severity"), "documents")


def _worst() -> Column:
    kind = lambda s: F.exists("findings", lambda x: F.element_at(_severities(), x) == s)
    return F.when(kind(R.BLOCK), "cuarentena").when(kind(R.WARN), "aviso").otherwise("limpio")


_WARNS = "(" + ", ".join(quoted(r.label) for r in R.RULES if r.severity == R.WARN) + ")"
_DECIDED = f"(SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: x NOT IN {_WARNS})) > 0 THEN 'cuarentena' WHEN len(ls) > 0 THEN 'aviso' ELSE 'limpio' END AS decision FROM {_SCANNED})"


@query(f"SELECT doc_id, decision FROM {_DECIDED}")
def quarantine_split(spark, d):
    return _scanned(spark, d).select("doc_id", _worst().alias("decision"))


@query(f"SELECT doc_id FROM {_DECIDED} WHERE decision = 'aviso'")
def warn_only(spark, d):
    return _scanned(spark, d).where(_worst() == "aviso").select("doc_id")


@query(f"SELECT decision, count(*) AS documents FROM {_DECIDED} GROUP BY 1")
def audit_counts(spark, d):
    return _scanned(spark, d).groupBy(_worst().alias("decision")).agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id, array_to_string(list_concat(list_transform({labels_sql('s', R.METADATA)}, lambda x: 'line: ' || x), list_transform({labels_sql('o', R.METADATA)}, lambda x: 'source: ' || x)), ',') AS labels FROM (SELECT doc_id, {seen_sql('line')} AS s, coalesce(source, '') AS o FROM {overlaid_sql()})")
def scan_metadata(spark, d):
    return scan.scan_metadata(overlaid(spark, d), ["line", "source"]).select("doc_id", F.array_join("findings", ",").alias("labels"))


@query(f"SELECT id, array_to_string(list_transform({labels_sql('s', R.METADATA)}, lambda x: 'titulo: ' || x), ',') AS labels FROM (SELECT id, {seen_sql("coalesce(titulo, '')")} AS s FROM {IDX})")
def scan_titles(spark, d):
    """The titles of the index as they are."""
    return scan.scan_metadata(entries(spark, d), ["titulo"]).select("id", F.array_join("findings", ",").alias("labels"))


_FUSED = "|".join(f"(?{r.flags}:{r.pattern})" for r in R.of_surface(R.METADATA))


@query(f"SELECT doc_id, regexp_replace(line, {quoted(_FUSED)}, '[filtered]', 'g') AS line FROM {overlaid_sql()}")
def filter_metadata(spark, d):
    return overlaid(spark, d).select("doc_id", scan.filter_value(F.col("line")).alias("line"))


@query(f"SELECT id, {clean_sql('titulo', 60)} AS titulo FROM {IDX}")
def sanitize_titles(spark, d):
    return entries(spark, d).select("id", scan.sanitize_metadata(F.coalesce("titulo", F.lit("")), 60).alias("titulo"))


@query(f"SELECT doc_id, {_ATTR.format('line')} AS attr FROM {overlaid_sql()}")
def sanitize_attr(spark, d):
    return overlaid(spark, d).select("doc_id", scan.sanitize_attribute(F.col("line")).alias("attr"))


@query(f"SELECT doc_id, regexp_replace(t, '{_CLOSING}', '[filtered-tag]', 'g') AS t FROM {overlaid_sql()}")
def neutralize_delimiter(spark, d):
    return overlaid(spark, d).select("doc_id", scan.neutralize(F.col("t")).alias("t"))


@query(f"SELECT doc_id, {seen_sql('text')} AS text FROM documents")
def strip_invisible(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_invisible(F.col("text")).alias("text"))


@query()
def nfkc_form(spark, d):
    """What the scanner sees of every law."""
    return laws(spark, d).select("id", text.normalised(F.col("texto")).alias("forma"))


@query(
    f"SELECT doc_id, array_to_string(list_concat({', '.join(f'list_transform(regexp_extract_all(t, {quoted(p)})[1:3], lambda x: {quoted(k)})' for k, p in scan.ENCODINGS)}), ',') AS encodings FROM {overlaid_sql(BLOBS + PLAIN)}"
)
def encoding_findings(spark, d):
    return overlaid(spark, d, BLOBS + PLAIN).select("doc_id", F.array_join(scan.encodings(F.col("t")), ",").alias("encodings"))


# ---- files with front matter, made of the laws

_LINE = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " ")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Every law as a file: aliases of keys, quotes, a colon in a value, a comment line without colon."""
    head = F.concat(F.lit('---\ntitulo: "'), _LINE("titulo"), F.lit('"\nidentifier: '), F.col("id"), F.lit("\ncountry: "), F.col("pais_idx"), F.lit("\nnota\nrango:\nrank: '"), _LINE("rango"), F.lit("'\nstatus:  "), _LINE("estado"), F.lit("\nsource: "), _LINE("fuente"), F.lit("\n---\n\n"))
    return laws(spark, d).select(F.concat("pais_idx", F.lit("/"), "id", F.lit(".md")).alias("rel"), F.concat(head, F.coalesce("texto", F.lit(""))).alias("text"), F.coalesce("bytes", F.lit(0)).alias("length"), F.lit(0.0).alias("mtime"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


def _line_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[\\r\\n]+', ' ', 'g')"


@query(f"SELECT pais || '/' || id || '.md' AS rel, regexp_replace(coalesce(texto, ''), '\\A{SPACE}+', '') AS body FROM {LAWS}")
def frontmatter_split(spark, d):
    return files(spark, d).select("rel", text.body(F.col("text")).alias("body"))


@query(f"""SELECT pais || '/' || id || '.md' AS rel, u.k AS k, u.v AS v FROM (SELECT *, unnest([
 {{'k': 'titulo', 'v': {_line_sql('titulo')}}}, {{'k': 'identifier', 'v': id}}, {{'k': 'country', 'v': pais}}, {{'k': 'rango', 'v': ''}},
 {{'k': 'rank', 'v': {_line_sql('rango')}}}, {{'k': 'status', 'v': {_strip_sql(_line_sql('estado'))}}}, {{'k': 'source', 'v': {_strip_sql(_line_sql('fuente'))}}}]) AS u FROM {LAWS})""")
def frontmatter_parse(spark, d):
    return files(spark, d).select("rel", F.explode(text.front_fields(F.col("text"))).alias("f")).select("rel", "f.k", "f.v")


@query(f"SELECT id AS raw_id, {_line_sql('titulo')} AS titulo, id AS identificador, pais, {_line_sql('rango')} AS rango, {_strip_sql(_line_sql('estado'))} AS estado, {_strip_sql(_line_sql('fuente'))} AS fuente, '' AS fecha_publicacion, NULL AS jurisdiccion, id || '.md' AS _archivo, pais || '/' || id || '.md' AS _ruta, coalesce(bytes, 0) AS _bytes, '' AS truncados FROM {LAWS}")
def build_entries(spark, d):
    built = I.build_entries(files(spark, d), "xx")
    return built.select("raw_id", "titulo", "identificador", "pais", "rango", "estado", "fuente", "fecha_publicacion", "jurisdiccion", "_archivo", "_ruta", "_bytes", F.array_join("truncados", ",").alias("truncados"))


@query(f"SELECT id AS raw_id, least(length(coalesce(texto, '')), 8000)::INT AS kept, length(coalesce(texto, '')) > 8000 AS cut FROM (SELECT id, regexp_replace(coalesce(texto, ''), '[^A-Za-z]+', '', 'g') AS texto FROM {LAWS})")
def metadata_length(spark, d):
    """A whole text as title: cut to the most a metadata value may have, and recorded."""
    titled = laws(spark, d).select(F.concat("id", F.lit(".md")).alias("rel"), F.concat(F.lit("---\nidentificador: "), "id", F.lit("\ntitulo: "), F.regexp_replace(F.coalesce("texto", F.lit("")), "[^A-Za-z]+", ""), F.lit("\n---\n")).alias("text"), F.lit(0).cast("bigint").alias("length"), F.lit(0.0).alias("mtime"))
    return I.build_entries(titled, "").select("raw_id", F.length("titulo").alias("kept"), F.array_contains("truncados", "titulo").alias("cut"))


# ---- keys, differences, audit

_CLAIMS = "(SELECT doc_id, ley_id AS raw_id, coalesce(source, 'sin') || '/' || doc_id || '.md' AS rel FROM documents WHERE ley_id IS NOT NULL)"


@query(f"SELECT rel AS _ruta, n > 1 AS collided, CASE WHEN n = 1 THEN raw_id ELSE raw_id || '__' || replace(substr(rel, 1, length(rel) - 3), '/', '_') END AS id FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY string_split(rel, '/')) AS n FROM {_CLAIMS})")
def id_collisions(spark, d):
    """Documents that claim the id of one law: the first in path order has it."""
    claims = table(spark, d, "documents").where("ley_id IS NOT NULL").select(F.col("ley_id").alias("raw_id"), F.concat(F.coalesce("source", F.lit("sin")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("_ruta"))
    return I.resolve_ids(claims).select("_ruta", "collided", "id")


def disk(spark: SparkSession, d: str) -> DataFrame:
    """The files as last delivered."""
    last = F.max(F.struct("arrived_at", "feed_seq", "_bytes", "_mtime"))
    return table(spark, d, "index_feed").groupBy(F.col("_ruta").alias("rel")).agg(last.alias("s")).select("rel", F.col("s._bytes").alias("length"), F.col("s._mtime").alias("mtime"))


_DISK = "(SELECT _ruta AS rel, _bytes AS length, _mtime AS mtime FROM (SELECT *, row_number() OVER (PARTITION BY _ruta ORDER BY arrived_at DESC, feed_seq DESC) AS n FROM index_feed) WHERE n = 1)"


@query(f"SELECT rel FROM {_DISK} WHERE rel NOT IN (SELECT _ruta FROM index_entries WHERE _ruta IS NOT NULL AND _bytes IS NOT NULL)")
def diff_new(spark, d):
    """An entry without a size was never finished: its file counts as new."""
    return I.new_files(disk(spark, d), entries(spark, d).where("_bytes IS NOT NULL")).select("rel")


@query(f"SELECT rel, length FROM {_DISK} JOIN {IDX} e ON e._ruta = rel WHERE length IS DISTINCT FROM e._bytes OR coalesce(e._mtime <> 0 AND mtime > e._mtime, FALSE)")
def diff_modified(spark, d):
    return I.modified_files(disk(spark, d), entries(spark, d)).select("rel", "length")


@query(f"SELECT id, _ruta FROM {IDX} WHERE _ruta NOT IN (SELECT rel FROM {_DISK} WHERE length IS NOT NULL)")
def diff_orphans(spark, d):
    """A last delivery without a size means that the file is gone."""
    return I.orphans(disk(spark, d).where("length IS NOT NULL"), entries(spark, d)).select("id", "_ruta")


@query(f"""SELECT 'metadatos' AS kind, _ruta AS file, 'titulo: viejo' AS labels FROM {IDX}
 WHERE _ruta IN (SELECT rel FROM {_DISK}) AND _ruta NOT IN (SELECT rel FROM {_DISK} JOIN {IDX} e ON e._ruta = rel WHERE length IS DISTINCT FROM e._bytes OR coalesce(e._mtime <> 0 AND mtime > e._mtime, FALSE))
 UNION ALL SELECT 'avisos', rel, 'a,b' FROM {_DISK} JOIN {IDX} e ON e._ruta = rel WHERE length IS DISTINCT FROM e._bytes OR coalesce(e._mtime <> 0 AND mtime > e._mtime, FALSE)""")
def audit_merge(spark, d):
    index, now = entries(spark, d), disk(spark, d)
    changed = I.modified_files(now, index)
    before = index.select(F.lit("metadatos").alias("kind"), F.col("_ruta").alias("file"), F.array(F.lit("titulo: viejo")).alias("labels"))
    fresh = changed.select(F.lit("avisos").alias("kind"), F.col("rel").alias("file"), F.array(F.lit("b"), F.lit("a"), F.lit("b")).alias("labels"))
    return I.merge_audit(before, fresh, now, changed).select("kind", "file", F.array_join("labels", ",").alias("labels"))


_RUNS = "(SELECT DISTINCT * FROM index_runs)"


@query(f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY pais_idx ORDER BY started_at DESC, run_id DESC) AS n FROM {_RUNS} WHERE status = 'ok'),
 head AS (SELECT pais_idx, git_commit AS head FROM (SELECT *, row_number() OVER (PARTITION BY pais_idx ORDER BY started_at DESC, run_id DESC) AS n FROM {_RUNS}) WHERE n = 1)
 SELECT pais_idx, CASE WHEN coalesce(patrones, '') <> '{R.fingerprint()}' THEN 'REGLAS' ELSE 'OK' END AS rules,
  CASE WHEN coalesce(directorio_base, '') = '' THEN 'SIN RUTA' WHEN coalesce(head, '') = '' THEN 'SIN GIT' WHEN coalesce(git_commit, '') = '' THEN 'SIN LOCK' WHEN git_commit = head THEN 'OK' ELSE 'DESACTUAL' END AS commit,
  coalesce(patrones, '') <> '{R.fingerprint()}' OR (coalesce(directorio_base, '') <> '' AND coalesce(head, '') <> '' AND coalesce(git_commit, '') IS DISTINCT FROM head) AS stale
 FROM last JOIN head USING (pais_idx) WHERE n = 1""")
def staleness_report(spark, d):
    """Each corpus at its last successful run against the commit of its last run of any kind."""
    runs = table(spark, d, "index_runs").distinct()
    state = F.struct("started_at", "run_id", "directorio_base", "git_commit", "patrones")
    ok = runs.where("status = 'ok'").groupBy("pais_idx").agg(F.max(state).alias("s"))
    head = runs.groupBy("pais_idx").agg(F.max(state).alias("h"))
    meta = ok.join(head, "pais_idx").select("pais_idx", "s.directorio_base", "s.git_commit", "s.patrones", F.col("h.git_commit").alias("head"), F.lit(True).alias("is_repo"))
    return I.staleness(meta, R.fingerprint())


_SIGNS = "'[\\x00-\\x1f\\x7f\\x{{85}}\\x{{2028}}\\x{{2029}}]'"
_WAYS = {"same": "{}", "inside": "x/../{}", "above": "../../{}", "absolute": "/{}", "broken": "{}\n"}


@query(f"SELECT id, _ruta, NOT regexp_matches(_ruta, {_SIGNS.format()}) AS same, NOT regexp_matches(_ruta, {_SIGNS.format()}) AS inside, FALSE AS above, FALSE AS absolute, FALSE AS broken FROM {IDX} WHERE _ruta IS NOT NULL")
def path_guard(spark, d):
    """Every stored path, as it is, by a detour inside, led out of the corpus, absolute, and with a line end."""
    rows = entries(spark, d).where("_ruta IS NOT NULL")
    return rows.select("id", "_ruta", *[path_allowed(F.format_string(way.replace("{}", "%s"), "_ruta")).alias(name) for name, way in _WAYS.items()])


# Fixed value: the published fingerprint of the ruleset for texts.
PUBLISHED = "03446b5a64e4"


@query(f"SELECT '{R.BODY}' AS surface, TRUE AS published, TRUE AS other_order, FALSE AS other_pattern")
def ruleset_fingerprint(spark, d):
    """The rules give the published fingerprint, in any order, and not with a pattern changed."""
    changed = (R.Rule(**(R.RULES[0].__dict__ | {"pattern": "y"})), *R.RULES[1:])
    now = [R.fingerprint(R.BODY, rules) == PUBLISHED for rules in (R.RULES, R.RULES[::-1], changed)]
    return spark.createDataFrame([(R.BODY, *now)], "surface string, published boolean, other_order boolean, other_pattern boolean")


_BROKEN = R.Rule("x.broken", R.WARN, ("sample",), r"zzz\d", "A sample the rule does not find.")


@query(" UNION ALL ".join(f"SELECT {quoted(r.label)} AS label, {quoted(s)} AS surface, {str(r is not _BROKEN).upper()} AS ok" for r in (*R.RULES, _BROKEN) for s in r.surfaces))
def self_test(spark, d):
    """Every rule finds its own sample; one that does not is told."""
    return scan.self_test(spark, (*R.RULES, _BROKEN))
