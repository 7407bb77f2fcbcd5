"""Queries on pages of PDF files: the page tree, runs of text, what a page alone holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.operators import documents as D
from redactlake.operators import pages as P
from redactlake.operators import verify as V
from redactlake.operators.rounds import saver, unsent
from redactlake.plans.registry import query, table
from redactlake.sources import pdf


def _files(spark, sf_dir):
    """A PDF for each part, of three pages whose tree is nested, of different rotation, boxes and contents.

    4 and 6 are listed by an inner node, before 5, which the root lists; 5 has contents in two streams, 6 none.
    """
    key, name = F.col("p_partkey"), F.col("p_name")
    pieces = (
        "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]/Count 3/MediaBox[0 0 ", key % 400 + 200, " 700]/Rotate ", key % 4 * 90,
        "/Resources<</Font<</F1 7 0 R/F2 8 0 R>>>>>>endobj\n3 0 obj<</Type/Pages/Parent 2 0 R/Kids[4 0 R 6 0 R", F.when(key % 5 == 0, " 3 0 R").otherwise(""), "]/CropBox[10 20 150 650]>>endobj\n",
        "4 0 obj<</Type/Page/Parent 3 0 R/Contents 9 0 R>>endobj\n5 0 obj<</Type/Page/Parent 2 0 R/Rotate 0/Contents[10 0 R 11 0 R]>>endobj\n6 0 obj<</Type/Page/Parent 3 0 R", F.when(key % 3 == 0, "/MediaBox[0 0 100 50]").otherwise(""), ">>endobj\n",
        "7 0 obj<</Type/Font/Subtype/Type1/FirstChar 32/Widths[", F.array_join(F.transform(F.sequence(F.lit(32), F.lit(126)), lambda c: (c * 7 % 400 + 200).cast("string")), " "), "]>>endobj\n",
        "8 0 obj<</Type/Font/Subtype/Type0/ToUnicode 12 0 R/DescendantFonts[13 0 R]>>endobj\n13 0 obj<</Type/Font/Subtype/CIDFontType2/DW 600/W[2[250]]>>endobj\n",
        "12 0 obj<</Length 80>>stream\n1 beginbfrange <0001><001A><0061> endbfrange 1 beginbfchar <0040><00480049> endbfchar\nendstream endobj\n",
        "9 0 obj<</Length 0>>stream\nBT /F1 10 Tf 12 TL 20 600 Td (", name, ") Tj T* (", F.col("p_brand"), ") Tj [(", F.col("p_type"), ")-250(x)] TJ ET\nendstream endobj\n",
        "10 0 obj<</Length 0>>stream\nq 2 0 0 3 5 7 cm BT /F2 8 Tf 1 0 0 1 ", key % 50, " 100 Tm <000100020040> Tj\nendstream endobj\n11 0 obj<</Length 0>>stream\nET Q BT /F1 20 Tf 50 Tz 9 Ts 0 1 -1 0 60 70 Tm (up) Tj ET\nendstream endobj\ntrailer<</Root 1 0 R>>",
    )
    content = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in pieces)).cast("binary")
    files = table(spark, sf_dir, "part").select(key.alias("file_id"), content.alias("content"))
    return files.repartition(spark.sparkContext.defaultParallelism)  # the table is small, what it is made into isn't


def _tree(spark, rows):
    nodes = rows.where("node is not null").select("doc", "obj", "type", "node")
    roots = rows.where("root is not null").select("doc", F.col("root").alias("obj"))
    return P.page_tree(nodes, roots, saver(spark))


_SEEN = """SELECT p_partkey AS doc, 1 AS page, 4 AS obj, 140.0 AS a, 630.0 AS b, p_partkey % 4 * 90 AS rotate FROM part UNION ALL
    SELECT p_partkey, 2, 6, CASE WHEN p_partkey % 3 = 0 THEN 90.0 ELSE 140.0 END, CASE WHEN p_partkey % 3 = 0 THEN 30.0 ELSE 630.0 END, p_partkey % 4 * 90 FROM part UNION ALL
    SELECT p_partkey, 3, 5, p_partkey % 400 + 200, 700, 0 FROM part"""


@query("q_pdf_pages", f"SELECT doc, page, obj::BIGINT AS obj, rotate::INTEGER AS rotate, (CASE WHEN rotate IN (90, 270) THEN b ELSE a END)::DOUBLE AS width, (CASE WHEN rotate IN (90, 270) THEN a ELSE b END)::DOUBLE AS height FROM ({_SEEN})")
def pdf_pages(spark, sf_dir):
    """Pages of PDF files in order, with their size as seen, from boxes and rotations that parents hand down."""
    tree = _tree(spark, saver(spark)(pdf.pdf_objects(spark, _files(spark, sf_dir))))
    seen = tree.withColumn("view", P.view_box(F.col("media"), F.col("crop"))).withColumn("rotate", P.turn(F.col("rotate")))
    width, height = P.page_size(F.col("view"), F.col("rotate"))
    return seen.select("doc", "page", F.shiftright("obj", 16).alias("obj"), "rotate", width.alias("width"), height.alias("height"))


_WIDE = "list_sum(list_transform(string_split({0}, ''), lambda c: ascii(c) * 7 % 400 + 200))"
_NUMBERED = f"""SELECT p_partkey AS doc, {_WIDE.format("p_brand")} / 100.0 AS first, * FROM part"""


@query(
    "q_pdf_runs",
    f"""WITH n AS ({_NUMBERED}), r AS (
    SELECT doc, 1 AS page, 1 AS k, p_name AS str, 20.0 AS x, 600.0 AS y, {_WIDE.format("p_name")} / 100.0 AS width, 10.0 AS height, true AS has_eol, 0 AS start FROM n UNION ALL
    SELECT doc, 1, 2, p_brand, 20.0, 588.0, first, 10.0, false, length(p_name) + 1 FROM n UNION ALL
    SELECT doc, 1, 3, p_type || ' x', 20.0 + first, 588.0, {_WIDE.format("p_type || 'x'")} / 100.0 + 2.5, 10.0, false, length(p_name) + length(p_brand) + 1 FROM n UNION ALL
    SELECT doc, 3, 1, 'abHI', 2 * (doc % 50) + 5.0, 307.0, (600 + 250 + 600) / 1000.0 * 8 * 2, 24.0, true, 0 FROM n UNION ALL
    SELECT doc, 3, 2, 'up', 60.0 - 9, 70.0, {_WIDE.format("'up'")} / 1000.0 * 20 / 2, 20.0, false, 5 FROM n)
    SELECT doc, page, k::BIGINT AS k, str, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y, round(width, 6)::DOUBLE AS width, height::DOUBLE AS height, has_eol, start::BIGINT AS start FROM r""",
)
def pdf_runs(spark, sf_dir):
    """Runs of text of PDF pages: what they say, where they begin, and where they stand in the text that is searched."""
    from pyspark.sql import Window

    files = _files(spark, sf_dir)
    rows = saver(spark)(pdf.pdf_text(files))
    runs = P.page_runs(_tree(spark, rows), rows.where("op is not null"), rows.where("described is not null").select("doc", "obj", F.col("described").alias("font")))
    placed = V.haystack_offsets(runs)
    k = F.row_number().over(Window.partitionBy("doc", "page").orderBy("seq")).cast("bigint")
    rounded = lambda c, name: F.round(c, 6).alias(name)
    return placed.select("doc", "page", k.alias("k"), "str", rounded(F.col("matrix")[4], "x"), rounded(F.col("matrix")[5], "y"), rounded(F.col("width"), "width"), "height", "has_eol", F.col("start").cast("bigint").alias("start"))


@query(
    "q_pdf_run_boxes",
    """SELECT p_partkey AS doc, round(51.0 / w - 20.0 / w, 6)::DOUBLE AS x, round((700 - 70 - u) / 700.0, 6)::DOUBLE AS y, round((20.0 + 20 * 0.28) / w, 6)::DOUBLE AS w, round(u / 700.0, 6)::DOUBLE AS h, true AS vertical
    FROM (SELECT p_partkey, (p_partkey % 400 + 200)::DOUBLE AS w, (ascii('u') * 7 % 400 + ascii('p') * 7 % 400 + 400) / 100.0 AS u FROM part)""",
)
def pdf_run_boxes(spark, sf_dir):
    """The boxes, on the page as it is seen, of runs that stand upright: descent below and height above their baseline."""
    files = _files(spark, sf_dir)
    rows = saver(spark)(pdf.pdf_text(files))
    tree = saver(spark)(_tree(spark, rows))
    runs = P.page_runs(tree, rows.where("op is not null"), rows.where("described is not null").select("doc", "obj", F.col("described").alias("font"))).where("str = 'up'")
    seen = tree.select("doc", "page", P.view_box(F.col("media"), F.col("crop")).alias("view"), P.turn(F.col("rotate")).alias("turned"))
    joined = runs.join(unsent(seen), ["doc", "page"])
    width, height = P.page_size(F.col("view"), F.col("turned"))
    matrix, port = [F.col("matrix")[i] for i in range(6)], P.viewport(F.col("view"), F.col("turned"))
    box = G.run_box(matrix, port, width, height, (F.lit(0.0), F.col("width")), (-F.col("height") * G.BOX_DESCENT, F.col("height")))
    return joined.select("doc", *(F.round(c, 6).alias(n) for c, n in zip((box.x, box.y, box.w, box.h), "xywh", strict=True)), G.is_vertical(matrix[0], matrix[1], port).alias("vertical"))


_REFS = """SELECT p_partkey // 60 AS doc, p_partkey AS src, (p_partkey // 60) * 60 + (p_partkey * 7 + 3 + k) % 60 AS dst, CASE p_size % 3 WHEN 0 THEN 'Parent' WHEN 1 THEN 'Resources' ELSE 'XObject' END AS key
    FROM part, (VALUES (0), (11), (17)) v(k) WHERE (p_partkey * 13 + k) % 4 <> 0"""
_PAGE = "p_partkey % 6 = 0"


@query(
    "q_page_objects",
    f"""WITH RECURSIVE e AS ({_REFS}), p AS (SELECT p_partkey // 60 AS doc, p_partkey AS obj, p_partkey % 60 // 6 + 1 AS page, p_size % 2 = 0 AS raster FROM part WHERE {_PAGE}),
    f AS (SELECT doc, src, dst FROM e WHERE NOT (key = 'Parent' AND src % 6 = 0) UNION SELECT e.doc, p.obj, e.dst FROM p JOIN e ON e.doc = p.doc AND e.src = p.doc * 60 + 1 WHERE e.key = 'Resources' AND p.page > 5),
    r(doc, page, obj) AS (SELECT doc, page, obj FROM p UNION SELECT r.doc, r.page, f.dst FROM r JOIN f ON f.doc = r.doc AND f.src = r.obj)
    SELECT r.doc, r.obj, count(*) FILTER (WHERE NOT raster) AS copied, count(*) FILTER (WHERE raster) AS raster, bool_and(raster) AS dropped
    FROM r JOIN p ON p.doc = r.doc AND p.page = r.page WHERE r.doc % 7 <> 3 GROUP BY r.doc, r.obj""",
)
def page_objects(spark, sf_dir):
    """What copied pages take along and only rasterised ones had; every seventh document is encrypted and refused; pages from the sixth on inherit resources."""
    key = F.col("p_partkey")
    doc = F.floor(key / 60).cast("bigint").alias("doc")
    part = table(spark, sf_dir, "part")
    objects = part.select(doc, key.alias("obj"), F.when(key % 6 == 0, "Page").otherwise("Other").alias("type"))
    name = F.element_at(F.array(*map(F.lit, ("Parent", "Resources", "XObject"))), F.col("p_size") % 3 + 1)
    edges = part.select(doc, key.alias("src"), F.explode(F.array(*map(F.lit, (0, 11, 17)))).alias("k"), name.alias("key")).where((F.col("src") * 13 + F.col("k")) % 4 != 0)
    edges = edges.select("doc", "src", (F.col("doc") * 60 + (F.col("src") * 7 + 3 + F.col("k")) % 60).alias("dst"), "key")
    page = (F.floor(key % 60 / 6) + 1).cast("int")
    tree = part.where(key % 6 == 0).select(doc, key.alias("obj"), page.alias("page"), F.when(page > 5, F.floor(key / 60).cast("bigint") * 60 + 1).otherwise(key).alias("holder"), "p_size")
    rects = tree.where("p_size % 2 = 0").select("doc", "page")
    plan = D.redaction_plan(tree, rects, tree.where("doc % 7 = 3").select("doc"))
    return D.page_split(D.page_objects(tree, objects, edges), plan)
