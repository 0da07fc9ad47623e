"""The queries of the problems tagged llm, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import canon, chunks, langid, markup, mixing, neardup, oracles, packing, pages, spans, tokens, units
from lexloom.session import cut, spread, table


def spread_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores if it is one file."""
    return spread(table(spark, d, name))


def param(spark: SparkSession, d: str, name: str) -> float:
    """One value of job_params (a table of fixed size)."""
    row = table(spark, d, "job_params").where(F.col("param_name") == name).select("param_value").first()
    if row is None or row[0] is None:
        raise ValueError(f"job_params has no {name}")
    return row[0]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    titles = canon.look_alikes(spread_table(spark, d, "documento_resumen"), "id", "titulo")
    texts = canon.look_alikes(spread_table(spark, d, "ley_completa"), "id", "texto")
    return titles.select(F.lit("titulo").alias("campo"), "id_a", "id_b").union(texts.select(F.lit("texto").alias("campo"), "id_a", "id_b"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Per title and per text of a law: its one form and whether the stored one differs."""
    titles = spread_table(spark, d, "documento_resumen").select(F.lit("titulo").alias("campo"), "id", F.col("titulo").alias("valor"))
    texts = spread_table(spark, d, "ley_completa").select(F.lit("texto").alias("campo"), "id", F.col("texto").alias("valor"))
    rows = canon.with_form(titles.union(texts).distinct(), "valor")
    return rows.select("campo", "id", "valor", "forma", (~F.col("valor").eqNullSafe(F.col("forma"))).alias("changed"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = param(spark, d, "near_dup_threshold")
    titles = neardup.found_pairs(spread_table(spark, d, "index_entries"), "id", "titulo", "chars", t)
    texts = neardup.found_pairs(spread_table(spark, d, "ley_completa"), "id", "texto", "words", t)
    return titles.select(F.lit("titulo").alias("campo"), "id_a", "id_b").union(texts.select(F.lit("texto").alias("campo"), "id_a", "id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per title of an entry and per law: its group (numbered within ``campo``), its links to other forms and the copies of its own form."""
    t = param(spark, d, "near_dup_threshold")
    titles = neardup.groups(spread_table(spark, d, "index_entries"), "id", "titulo", "chars", t)
    texts = neardup.groups(spread_table(spark, d, "ley_completa"), "id", "texto", "words", t)
    return titles.select(F.lit("titulo").alias("campo"), "*").union(texts.select(F.lit("texto").alias("campo"), "*"))


def _marked_up(spark: SparkSession, d: str) -> DataFrame:
    """(surface, item, texto): the texts of laws and articles as stored."""
    laws = spread_table(spark, d, "ley_completa").select(F.lit("ley_completa").alias("surface"), F.col("id").alias("item"), "texto")
    articles = spread_table(spark, d, "articulo_resultado").select(F.lit("articulo_resultado").alias("surface"), F.concat("id", F.lit("#"), "articulo_buscado").alias("item"), "texto")
    return laws.union(articles)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked_up(spark, d).where(F.size(markup.clean_column("texto")["marcas"]) > 0).select("surface", "item").distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every law and article and the kinds of markup it had."""
    return markup.clean_markup(_marked_up(spark, d), "texto").select("surface", "item", "texto_limpio", F.array_join("marcas", ",").alias("marcas"))


def p4_page_difference(spark: SparkSession, d: str) -> DataFrame:
    """The method named: what is left of each law without the lines it shares with the page of the nearest URL."""
    return pages.page_differences(spread_table(spark, d, "ley_completa"), "id", "fuente", "texto").withColumnRenamed("key", "id")


def _pieces(spark: SparkSession, d: str, long_only: bool) -> DataFrame:
    most, again = int(param(spark, d, "split_max_chars")), int(param(spark, d, "split_overlap_chars"))
    return chunks.split_texts(spread_table(spark, d, "ley_completa"), "id", "texto", most, again, long_only)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True).where("piece = 1").select(F.col("key").alias("id")).distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every law."""
    return _pieces(spark, d, False).withColumnRenamed("key", "id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all documents in tokens, counted once."""
    return cut(spread_table(spark, d, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("tokens")))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The contents of each container."""
    return packing.pack(_sized(spark, d), "doc_id", "tokens", int(param(spark, d, "pack_capacity_tokens")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_packed(spark, d), int(param(spark, d, "pack_capacity_tokens")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets"), param(spark, d, "mix_total_share"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts with their copies."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each source."""
    return _mix(spark, d)[1]


def _segmented(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, langid.Model]:
    documents, laws = spread_table(spark, d, "documents"), spread_table(spark, d, "ley_completa")
    return documents, laws, langid.fit(documents, "text", "lang")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    documents, laws, model = _segmented(spark, d)
    least = int(param(spark, d, "segment_min_chars"))
    docs = langid.with_segments(documents.where("text is not null").select(F.col("doc_id").cast("string").alias("item"), "text", "lang"), "text", model, least)
    own = langid.label_language(F.col("lang"))
    docs = docs.where(own.isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", own)).select(F.lit("documents").alias("surface"), "item", F.explode("langs").alias("lang"))
    hints = table(spark, d, "index_entries").select("id", F.lower(F.trim("pais")).alias("pais")).distinct()
    spoken = table(spark, d, "pais_langs").groupBy("pais").agg(F.collect_set("lang").alias("spoken"))  # 20 rows
    texts = langid.with_segments(laws.where("texto is not null").select("id", "texto").distinct(), "texto", model, least).select("id", "langs")
    hinted = texts.join(hints, "id", "left").join(F.broadcast(spoken), "pais", "left")
    wrong = F.col("spoken").isNull() | (F.size("langs") > 1) | ~F.arrays_overlap("langs", F.coalesce("spoken", F.array()))
    laws_found = hinted.where(wrong).select(F.lit("ley_completa").alias("surface"), F.col("id").alias("item"), F.explode("langs").alias("lang"))
    return docs.union(laws_found).where(F.col("lang") != langid.REJECTED).distinct()


def _spoken(documents: DataFrame, laws: DataFrame) -> DataFrame:
    """(surface, item, text): every document, and every law once."""
    docs = documents.select(F.lit("documents").alias("surface"), F.col("doc_id").cast("string").alias("item"), "text")
    return docs.union(laws.select(F.lit("ley_completa").alias("surface"), F.col("id").alias("item"), F.col("texto").alias("text")).distinct())


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document and law with language and confidence."""
    documents, laws, model = _segmented(spark, d)
    rows = _spoken(documents, laws).select("surface", "item", F.explode(langid.segments_udf(model)(F.col("text"))).alias("s"))
    return rows.select("surface", "item", "s.begin", "s.end", "s.lang", "s.confidence")


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document and law with its confidence, and all languages present in it."""
    documents, laws, model = _segmented(spark, d)
    rows = langid.with_segments(_spoken(documents, laws), "text", model, int(param(spark, d, "segment_min_chars")))
    return rows.select("surface", "item", "main_lang", "main_confidence", F.array_join("langs", ",").alias("langs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spans.found_pairs(spread_table(spark, d, "documents"), "doc_id", "text", int(param(spark, d, "span_min_chars")))
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """Per document: how much of it is found elsewhere, and how much would go with the first occurrence kept."""
    return spans.shared_part(spread_table(spark, d, "documents"), "doc_id", "text", int(param(spark, d, "span_min_chars"))).withColumnRenamed("key", "doc_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage that other documents hold too, with its offsets, the first document that holds it and whether it is kept."""
    documents = spread_table(spark, d, "documents")
    found = spans.shared_spans(documents, "doc_id", "text", int(param(spark, d, "span_min_chars"))).withColumnRenamed("key", "doc_id")
    passage = F.substring(F.col("text"), F.col("begin") + 1, F.col("end") - F.col("begin")).alias("passage")
    once = documents.select("doc_id", "text").dropDuplicates(["doc_id"])  # lies by doc_id: the join shuffles no text again
    return once.join(found, "doc_id").select("doc_id", "span", "begin", "end", F.col("first_key").alias("first_doc_id"), "kept", passage)


def p9_units(spark: SparkSession, d: str) -> DataFrame:
    """The method named: every line that recurs, with its place, its earliest occurrence and whether it is that one."""
    found = units.shared_units(spread_table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "begin", "end", F.col("first_key").alias("first_doc_id"), F.col("first_begin"), "kept")


def p9_removed(spark: SparkSession, d: str) -> DataFrame:
    """The method named: every document without the lines that are kept elsewhere, and the ranges of the original that are left."""
    done = units.without_repeats(spread_table(spark, d, "documents"), "doc_id", "text")
    ranges = F.array_join(F.transform("kept", lambda k: F.concat(k["begin"].cast("string"), F.lit("-"), k["end"].cast("string"))), ",")
    return done.select(F.col("key").alias("doc_id"), "own_text", "removed_chars", ranges.alias("kept"))


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Check of ``p5_pieces``: what the pieces of each law give without their overlaps, and whether all are within the limit."""
    most = int(param(spark, d, "split_max_chars"))
    pieces = _pieces(spark, d, False)
    before = Window.partitionBy("key", "version").orderBy("piece")
    pieces = pieces.withColumn("version", F.lit(0)).withColumn("after", F.coalesce(F.lag("end").over(before), F.lit(0)))
    own = F.expr("substr(content, after - begin + 1)")
    whole = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", own.alias("own")))).alias("p"), F.max(F.length("content")).alias("longest"))  # the pieces of one text
    return whole.select(F.col("key").alias("id"), F.md5(F.array_join("p.own", "")).alias("digest"), (F.col("longest") <= most).alias("fits"))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Check of ``p7_packed``: every document once and whole, no container over its capacity."""
    most = int(param(spark, d, "pack_capacity_tokens"))
    packed = cut(p7_packed(spark, d))
    over = packed.groupBy("container").agg(F.sum("size").alias("n")).where(F.col("n") > most).select("container")
    parts = packed.join(over.withColumn("over", F.lit(True)), "container", "left")
    facts = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("part").alias("last"), F.sum("size").alias("size"), F.max("size").alias("longest"), F.max(F.col("first_token") + F.col("size")).alias("end"), F.max("over").alias("over"))
    return facts.select("doc_id", ((F.col("n") == F.col("last") + 1) & (F.col("size") == F.col("end")) & (F.col("longest") <= most) & F.col("over").isNull()).alias("whole"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Check of ``p8_mix``: each source's chosen documents are its own, once each and within its repeats; a share below its target is one that the repeats bound."""
    chosen, shares = _mix(spark, d)
    own = chosen.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("k"), F.max("copies").alias("most"))
    met = shares.join(own, "source", "left")
    near = F.abs(F.col("reached_tokens") - F.col("target_tokens")) <= 0.02 * F.col("target_tokens") + 1024
    bound = F.col("reached_tokens") == F.col("max_repeats") * F.col("available_tokens")
    return met.select("source", (F.coalesce("n", F.lit(0)) == F.coalesce("k", F.lit(0))).alias("once"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within"), (near | bound).alias("filled"))


QUERIES = {f.__name__: f for f in (p2_found, p2_forms, p3_found, p3_groups, p4_found, p4_clean, p4_page_difference, p5_found, p5_pieces, p7_packed, p7_report, p8_mix, p8_shares, p6_found, p6_segments, p6_languages, p9_found, p9_shared, p9_passages, p9_units, p9_removed, p5_whole, p7_whole, p8_whole)}
ORACLES: dict[str, str] = oracles.ORACLES
