"""Audit, strip and routing of documents on small tables."""

import pytest
from pyspark.sql import functions as F

from redactlake.functions import media as M
from redactlake.operators import documents as D
from redactlake.operators import verify as V


def test_strip_info_empties_strings_and_drops_dates(spark):
    info = spark.createDataFrame([(1, "t", "a", "2024", "x")], "doc int, Title string, Author string, ModDate string, Other string")
    assert D.strip_info(info).collect() == [(1, "", "", "x")]


def test_strip_all_leaves_nothing_to_find(spark):
    objects = spark.createDataFrame(
        [(1, 1, "dict", "Catalog", None, ["AcroForm", "Metadata", "Pages"]), (1, 2, "stream", "Metadata", None, []), (1, 3, "dict", "Page", None, ["Annots", "Contents"]), (1, 4, "dict", "Annot", "Link", []), (1, 5, "stream", None, None, ["Metadata"]), (2, 1, "dict", "Other", None, [])],
        "doc int, obj int, kind string, type string, subtype string, keys array<string>",
    )
    edges = spark.createDataFrame([(1, 1, 2, "Metadata"), (1, 1, 3, "Pages"), (1, 3, 4, "Annots"), (1, 3, 5, "Contents"), (1, 5, 2, "Metadata"), (1, 4, 5, "AP")], "doc int, src int, dst int, key string")
    info = spark.createDataFrame([(1, "t")], "doc int, Title string")
    roots = spark.createDataFrame([(1, 1)], "doc int, obj int")
    assert sorted(r.id for r in D.count_findings(D.object_counts(objects)).collect()) == ["links", "xmp"]
    left, refs, strings = D.strip_all(objects, edges, info, roots, lambda df: df.persist())
    assert {(r.doc, r.obj): list(r["keys"]) for r in left.collect()} == {(1, 1): ["Pages"], (1, 3): ["Contents"], (1, 5): [], (2, 1): []}
    assert sorted((r.src, r.dst) for r in refs.collect()) == [(1, 3), (3, 5)] and strings.collect() == [(1, "")]
    assert D.count_findings(D.object_counts(left)).count() == 0
    gone = D.unreachable(objects, D.strip_edges(objects, edges), roots, lambda df: df.persist())
    assert sorted(map(tuple, gone.collect())) == [(1, 2), (1, 4)]


def test_redaction_plan(spark):
    pages = spark.range(1, 303).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("doc"), F.col("id").cast("int").alias("page"))
    rects = pages.where("doc = 1 or (doc in (2, 4) and page = 7)").withColumn("rect_id", F.col("page"))
    locked = spark.createDataFrame([(4,)], "doc int")
    rows = D.redaction_plan(pages, rects, locked).groupBy("doc", "route", "error").count().collect()
    assert {(r.doc, r.route, r["count"]) for r in rows} == {(1, None, 302), (2, "raster", 1), (2, "copy", 301), (3, "copy", 302), (4, None, 302)}
    assert {r.error is None for r in rows if r.doc in (2, 3)} == {True} and {r.error for r in rows if r.doc == 4} == {"encrypted"}
    assert D.redaction_plan(pages, rects).where("doc = 4 and error is null").count() == 302
    assert D.without_rect(rects, 7).where("rect_id = 7").count() == 0 and D.without_rect(rects, None).count() == rects.count()


def test_audit_lists_documents_of_either_side(spark):
    objects = spark.createDataFrame([(1, 1, "dict", "Metadata", None, []), (1, 2, "dict", "Annot", "Link", [])], "doc int, obj int, kind string, type string, subtype string, keys array<string>")
    pages = spark.createDataFrame([(2, 0, "x"), (3, 0, " ")], "doc int, page int, text string")
    got = {r.doc: ([f.id for f in r.findings], r.has_text) for r in D.audit(D.object_counts(objects), pages).collect()}
    assert got == {1: (["xmp", "links"], False), 2: ([], True), 3: ([], False)}


def test_strict_format(spark):
    files = spark.createDataFrame([(1, bytearray(b"\xff\xd8\xff\xe0")), (2, bytearray(b"%PDF"))], "id int, content binary")
    assert files.where("id = 1").select(M.require_format(F.col("content")).alias("f")).first()["f"] == "jpeg"
    with pytest.raises(Exception, match="unsupported file"):
        files.select(M.require_format(F.col("content"))).collect()


def test_terms_without_a_word(spark):
    pages = spark.createDataFrame([(1, 0, "costs $$ 5"), (1, 1, "a$$b"), (None, 2, "(-)")], "doc int, page int, text string")
    terms = spark.createDataFrame([("$$",), ("(-)",), ("5",)], "term string")
    got = {(r.doc, r.term, tuple(r.pages)) for r in V.surviving_pages(pages, terms).collect()}
    assert got == {(1, "$$", (0,)), (1, "5", (0,)), (None, "(-)", (2,))}


def test_a_strip_sends_no_table_to_the_driver(spark):
    objects = spark.createDataFrame([(1, 1, "dict", "Catalog", None, ["Metadata"]), (1, 2, "dict", "Page", None, [])], "doc long, obj long, kind string, type string, subtype string, keys array<string>").checkpoint()
    edges = spark.createDataFrame([(1, 1, 2, "Pages"), (1, 1, 3, "Metadata")], "doc long, src long, dst long, key string").checkpoint()
    info = spark.createDataFrame([(1, "t")], "doc long, Title string")
    kept, left, _ = D.strip_all(objects, edges, info, objects.where("type = 'Catalog'").select("doc", "obj"))
    for df in (kept, left, D.object_counts(objects)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.src, r.dst) for r in left.collect()] == [(1, 2)]
