import pytest

from lexloom.llm import queries

D = "/root/testdata/sf0.001"


def keys(df, *cols):
    return {tuple(r) for r in df.select(*cols).distinct().collect()}


@pytest.mark.parametrize("name", ["p2_forms", "p3_groups"])
def test_titles_and_texts_are_both_given(spark, name):
    titles = "documento_resumen" if name == "p2_forms" else "index_entries"
    want = {("titulo", r.id) for r in queries.table(spark, D, titles).where("titulo is not null").collect()} | {("texto", r.id) for r in queries.table(spark, D, "ley_completa").where("texto is not null").collect()}
    assert want <= keys(queries.QUERIES[name](spark, D), "campo", "id")


def test_clean_text_of_laws_and_articles(spark):
    got = queries.p4_clean(spark, D).cache()
    assert keys(queries.p4_found(spark, D), "surface", "item") == keys(got.where("marcas <> ''"), "surface", "item")
    assert got.count() == sum(queries.table(spark, D, t).count() for t in ("ley_completa", "articulo_resultado"))


def test_a_language_for_each_text_and_segment(spark):
    want = {("documents", str(r.doc_id)) for r in queries.table(spark, D, "documents").where("text <> ''").collect()} | {("ley_completa", r.id) for r in queries.table(spark, D, "ley_completa").where("texto <> ''").collect()}
    assert want == keys(queries.p6_segments(spark, D), "surface", "item")
    got = queries.p6_languages(spark, D).cache()
    assert want <= keys(got.where("main_lang is not null and main_confidence is not null"), "surface", "item") and got.count() == got.select("surface", "item").distinct().count()


def test_passages_stand_in_their_first_document(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, D, "documents").collect()}
    got = queries.p9_passages(spark, D).collect()
    assert got and {x for p in queries.p9_found(spark, D).collect() for x in p} == {r.doc_id for r in got}
    for r in got:
        assert r.passage == texts[r.doc_id][r.begin : r.end] and r.passage in texts[r.first_doc_id] and r.kept == (r.doc_id == r.first_doc_id)
