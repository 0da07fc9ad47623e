"""SQL for DuckDB for the queries of the problems tagged llm, where SQL can say it."""

from __future__ import annotations

from lexloom.llm.canon import INVISIBLE, SMALL, transducer
from lexloom.llm.units import LEAST


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(x: str) -> str:
    """The one form of problem 2: invisible signs go, signs are mapped, marks composed, signs mapped again."""
    single = transducer().single
    one = {c: t for c, t in single.items() if len(t) == 1}
    several = {c: t for c, t in single.items() if len(t) > 1}
    mapped = f"translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for c, t in several.items():
        if "\u0600" > c or c > "\u1fff":  # the joined signs of running text
            mapped = f"replace({mapped}, {_quoted(c)}, {_quoted(t)})" if c in "ﬀﬁﬂﬃﬄﬅﬆǄǅǆǇǈǉǊǋǌĲĳ…Ⅱ" or 0x2160 <= ord(c) < 0x2180 else mapped
    seen = f"regexp_replace({mapped}, '[{''.join(f'\\x{{{ord(c):x}}}' if c != '-' else '-' for c in INVISIBLE)}]', '', 'g')"
    return f"translate(nfc_normalize({seen}), {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"


def fold_sql(x: str) -> str:
    return f"translate(lower({x}), {_quoted(''.join(SMALL))}, {_quoted(''.join(SMALL.values()))})"


_PARAM = "(SELECT param_value FROM job_params WHERE param_name = '{}')"
_VALUES = (
    "SELECT DISTINCT 'titulo' AS campo, id, titulo AS valor FROM documento_resumen UNION SELECT DISTINCT 'texto', id, texto FROM ley_completa"
)
_FORMS = f"SELECT campo, id, valor, CASE WHEN regexp_matches(valor, '[^\\x00-\\x7f]') THEN {form_sql('valor')} ELSE valor END AS forma FROM ({_VALUES})"


def _similar_sql(name: str, source: str, runs: str) -> str:
    """Pairs of ids by shared runs over all runs: every pair of different forms, counted by their shared runs."""
    return f"""
{name}_forms AS (SELECT id, forma, dense_rank() OVER (ORDER BY forma) AS f FROM (SELECT DISTINCT id, {fold_sql(f"CASE WHEN regexp_matches(v, '[^\\x00-\\x7f]') THEN {form_sql('v')} ELSE v END")} AS forma FROM ({source}) WHERE id IS NOT NULL AND v IS NOT NULL)),
{name}_runs AS (SELECT DISTINCT f, unnest({runs}) AS run FROM (SELECT DISTINCT f, forma FROM {name}_forms)),
{name}_n AS (SELECT f, count(*) AS n FROM {name}_runs GROUP BY f),
{name}_links AS (SELECT a.f AS fa, b.f AS fb FROM {name}_runs a JOIN {name}_runs b ON a.run = b.run AND a.f < b.f JOIN {name}_n na ON na.f = a.f JOIN {name}_n nb ON nb.f = b.f
  GROUP BY a.f, b.f, na.n, nb.n HAVING count(*) >= {_PARAM.format('near_dup_threshold')} * (na.n + nb.n - count(*)) - 1e-9),
{name}_found AS (SELECT a.id AS x, b.id AS y FROM {name}_forms a JOIN {name}_forms b ON a.f = b.f AND a.id < b.id UNION SELECT a.id, b.id FROM {name}_links JOIN {name}_forms a ON a.f = fa JOIN {name}_forms b ON b.f = fb WHERE a.id <> b.id)"""


_WORDS = "regexp_extract_all(forma, '[\\p{L}\\p{N}_\\p{Mn}\\p{Mc}]+')"
_SIMILAR = f"""
WITH RECURSIVE {_similar_sql('t', "SELECT id, titulo AS v FROM index_entries", "list_transform(range(1, length(forma) - 2), lambda i: substr(forma, i, 4))")},
{_similar_sql('w', "SELECT id, texto AS v FROM ley_completa", f"list_transform(range(1, len({_WORDS}) - 3), lambda i: array_to_string({_WORDS}[i:i + 4], ' '))").replace(_WORDS, "words").replace("FROM (SELECT DISTINCT f, forma FROM w_forms)", f"FROM (SELECT DISTINCT f, {_WORDS} AS words FROM w_forms)")}"""
_NEAR = f"""{_SIMILAR}
SELECT DISTINCT 'titulo' AS campo, least(x, y) AS id_a, greatest(x, y) AS id_b FROM t_found UNION SELECT DISTINCT 'texto', least(x, y), greatest(x, y) FROM w_found"""



def _groups_sql(name: str) -> str:
    return f""",
{name}_reach AS (SELECT DISTINCT f, f AS r FROM {name}_forms UNION SELECT x.f, l.b FROM {name}_reach x JOIN (SELECT fa AS a, fb AS b FROM {name}_links UNION ALL SELECT fb, fa FROM {name}_links) l ON l.a = x.r),
{name}_group AS (SELECT x.f, min(m.id) AS grupo FROM {name}_reach x JOIN {name}_forms m ON m.f = x.r GROUP BY x.f),
{name}_degree AS (SELECT f, count(*) AS links FROM (SELECT fa AS f FROM {name}_links UNION ALL SELECT fb FROM {name}_links) GROUP BY f),
{name}_copies AS (SELECT f, count(*) - 1 AS copies FROM {name}_forms GROUP BY f)"""


def _grouped_sql(name: str, campo: str) -> str:
    return f"SELECT '{campo}' AS campo, id, grupo, coalesce(links, 0) AS links, copies FROM {name}_forms JOIN {name}_group USING (f) JOIN {name}_copies USING (f) LEFT JOIN {name}_degree USING (f)"


# Windows of the least length of a span, by their hash; one is shared if two documents hold it.
_WINDOWS = """
WITH t AS (SELECT DISTINCT doc_id, text, n FROM documents, (SELECT param_value::BIGINT AS n FROM job_params WHERE param_name = 'span_min_chars') WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, unnest(list_transform(range(1, length(text) - n + 2), lambda i: {'i': i, 'h': hash(substr(text, i, n))})) AS w FROM t),
s AS (SELECT w.h AS h, min(doc_id) AS first_doc FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, n, w.i AS i, w.h AS h, first_doc FROM w JOIN s ON s.h = w.h)"""

_UNITS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1)::INT AS begin FROM l),
n AS (SELECT doc_id, begin, (begin + length(line))::INT AS "end", trim(regexp_replace(line, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ') AS form FROM o),
f AS (SELECT *, count(*) OVER (PARTITION BY form) AS k, first_value(doc_id) OVER q AS first_doc_id, first_value(begin) OVER q AS first_begin FROM n WHERE length(form) >= {LEAST} WINDOW q AS (PARTITION BY form ORDER BY doc_id, begin))"""

ORACLES: dict[str, str] = {
    "p2_forms": f"SELECT campo, id, valor, forma, valor IS DISTINCT FROM forma AS changed FROM ({_FORMS})",
    "p2_found": f"""
WITH v AS ({_FORMS}), k AS (SELECT campo, forma FROM v WHERE valor IS NOT NULL GROUP BY ALL HAVING count(DISTINCT valor) > 1), r AS (SELECT v.* FROM v JOIN k USING (campo, forma))
SELECT DISTINCT a.campo, a.id AS id_a, b.id AS id_b FROM r a JOIN r b ON a.campo = b.campo AND a.forma = b.forma AND a.id < b.id AND a.valor <> b.valor""",
    "p3_found": _NEAR,
    "p3_groups": f"{_SIMILAR}{_groups_sql('t')}{_groups_sql('w')} {_grouped_sql('t', 'titulo')} UNION ALL {_grouped_sql('w', 'texto')}",
    "p5_found": f"SELECT DISTINCT id FROM ley_completa WHERE length(texto) > {_PARAM.format('split_max_chars')}",
    "p5_whole": "SELECT id, md5(texto) AS digest, TRUE AS fits FROM (SELECT DISTINCT id, texto FROM ley_completa WHERE texto IS NOT NULL)",
    "p7_whole": "SELECT doc_id, TRUE AS whole FROM documents WHERE text IS NOT NULL",
    "p8_whole": "SELECT DISTINCT source, TRUE AS once, TRUE AS within, TRUE AS filled FROM mix_targets WHERE source IS NOT NULL",
    "p9_found": _WINDOWS + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p9_shared": _WINDOWS
    + """,
p AS (SELECT doc_id, p, min(first_doc) AS first_doc FROM (SELECT doc_id, first_doc, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) = p - 1 THEN 0 ELSE 1 END AS fresh FROM p),
c AS (SELECT doc_id, sum(fresh)::INT AS spans, count(*) AS shared_chars, count(*) FILTER (first_doc <> doc_id) AS removed_chars FROM g GROUP BY 1)
SELECT d.doc_id, length(text)::INT AS n_chars, coalesce(spans, 0) AS spans, coalesce(shared_chars, 0) AS shared_chars, coalesce(removed_chars, 0) AS removed_chars,
 CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0)::DOUBLE / length(text) ELSE 0.0::DOUBLE END AS share FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
    "p9_removed": _UNITS
    + """,
g AS (SELECT doc_id, begin FROM f WHERE k > 1 AND NOT (doc_id = first_doc_id AND begin = first_begin)),
r AS (SELECT n.doc_id, n.begin, n."end", lead(n.begin) OVER p AS after, g.begin IS NOT NULL AS gone, sum(CASE WHEN g.begin IS NULL THEN 0 ELSE 1 END) OVER p AS island FROM n LEFT JOIN g USING (doc_id, begin) WINDOW p AS (PARTITION BY n.doc_id ORDER BY n.begin)),
i AS (SELECT doc_id, island, min(begin) AS b, max(coalesce(after, "end")) AS e FROM r WHERE NOT gone GROUP BY 1, 2),
k AS (SELECT i.doc_id, string_agg(substr(text, b + 1, e - b), '' ORDER BY b) AS own, string_agg(b || '-' || e, ',' ORDER BY b) AS kept FROM i JOIN documents USING (doc_id) WHERE b < e GROUP BY 1)
SELECT d.doc_id, coalesce(own, '') AS own_text, (length(text) - length(coalesce(own, '')))::INT AS removed_chars, coalesce(kept, '') AS kept FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id WHERE text IS NOT NULL""",
    "p9_units": _UNITS + """ SELECT doc_id, begin, "end", first_doc_id, first_begin, doc_id = first_doc_id AND begin = first_begin AS kept FROM f WHERE k > 1""",
}
