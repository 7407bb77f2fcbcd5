"""Queries on document structure: information strings, counted objects, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.operators import documents as D
from redactlake.operators import export as E
from redactlake.operators.rounds import saver, shared_folder, unsent
from redactlake.plans.registry import query, table
from redactlake.sources import pdf


@query(
    "q_info_findings",
    """WITH i AS (SELECT s_suppkey AS doc, s_name AS t, CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE 'Author ' || s_nationkey END AS a FROM supplier)
    SELECT doc, 'meta-Title' AS id, 'Information entry Title' AS title, t AS detail FROM i UNION ALL
    SELECT doc, 'meta-Author', 'Information entry Author', a FROM i WHERE trim(a) <> '' UNION ALL
    SELECT doc, 'date-Created', 'Date Created', strftime(TIMESTAMP '2024-01-01' + to_seconds(doc * 3600), '%Y-%m-%dT%H:%M:%S.000Z') FROM i WHERE doc % 5 <> 0""",
)
def info_findings(spark, sf_dir):
    key = F.col("s_suppkey")
    author = F.when(key % 3 == 0, "  ").otherwise(F.concat(F.lit("Author "), F.col("s_nationkey").cast("string")))
    created = F.when(key % 5 != 0, F.timestamp_seconds(F.lit(1704067200) + key * 3600))
    info = table(spark, sf_dir, "supplier").select(key.alias("doc"), F.col("s_name").alias("Title"), author.alias("Author"), created.alias("Created"))
    return D.info_findings(info).select("doc", "id", "title", "detail")


_TAGS = (("<script", "javascript"), ("<!--", "annots"), ("<meta", "xmp"), ("<a ", "links"))
_N = "len(regexp_extract_all(html, '{0}'))"


@query(
    "q_finding_counts",
    f"""SELECT doc, id, n FROM (SELECT page_id AS doc, unnest([{{'id': 'xmp', 'n': {_N.format("<meta")}}}, {{'id': 'annots', 'n': {_N.format("<!--")}}}, {{'id': 'links', 'n': {_N.format("<a ")}}}, {{'id': 'javascript', 'n': {_N.format("<script")}}}, {{'id': 'ocg', 'n': {_N.format("<style")}}}], recursive := true) FROM pages) WHERE n > 0""",
)
def finding_counts(spark, sf_dir):
    return D.count_findings(D.object_counts(_tag_objects(spark, sf_dir))).select("doc", "id", "n")


def _tag_objects(spark, sf_dir):
    """Tags of web pages as typed objects of a document."""
    found = F.regexp_extract_all("html", F.lit(r"(<script|<!--|<meta|<a |<style)"), F.lit(1))
    tags = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(found).alias("obj", "tag"))
    kind = F.when(F.col("tag").isin("<!--", "<a "), "Annot").when(F.col("tag") == "<meta", "Metadata").when(F.col("tag") == "<style", "OCG")
    return tags.select("doc", "obj", F.lit("dict").alias("kind"), kind.alias("type"), F.when(F.col("tag") == "<a ", "Link").alias("subtype"), F.when(F.col("tag") == "<script", F.array(F.lit("JS"))).otherwise(F.array().cast("array<string>")).alias("keys"))


_HAS = "CASE WHEN contains(html, '{0}') THEN '{1}' END"


@query("q_audit", f"SELECT page_id AS doc, concat_ws(',', {', '.join(_HAS.format(t, i) for t, i in (('<meta', 'xmp'), ('<!--', 'annots'), ('<a ', 'links'), ('<script', 'javascript'), ('<style', 'ocg')))}) AS findings, length(regexp_replace(html, '<[^>]*>|[[:space:]]', '', 'g')) > 0 AS has_text FROM pages")
def audit(spark, sf_dir):
    """Structure findings of web pages, and whether text is left without their tags."""
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.lit(0).alias("page"), F.regexp_replace("html", r"<[^>]*>", "").alias("text"))
    found = D.audit(D.object_counts(_tag_objects(spark, sf_dir)), texts)
    return found.select("doc", F.array_join(F.transform("findings", lambda f: f["id"]), ",").alias("findings"), "has_text")


_ALL_KEYS = ("Metadata", "AcroForm", "OpenAction", "AA", "AF", "PieceInfo", "Annots", "JavaScript", "EmbeddedFiles", "Kids", "Contents")
_STRIP_SQL = " OR ".join(f"(type = '{kind}' AND key IN ({', '.join(map(repr, keys))}))" for kind, keys in (("Catalog", ("Metadata", "AcroForm", "OpenAction", "AA", "AF", "PieceInfo")), ("Page", ("Annots", "Metadata", "AA", "PieceInfo")), ("Names", ("JavaScript", "EmbeddedFiles"))))


@query(
    "q_strip_keys",
    f"""SELECT src, key, type FROM (SELECT p_partkey AS src, unnest({list(_ALL_KEYS)}) AS key, {list(("Catalog", "Page", "Names", "Other"))}[p_partkey % 4 + 1] AS type, p_partkey % 3 = 0 AS stream FROM part) WHERE NOT ({_STRIP_SQL} OR (stream AND key = 'Metadata'))""",
)
def strip_keys(spark, sf_dir):
    """Every key that a strip knows, and two that it doesn't, under each type of object."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("Catalog", "Page", "Names", "Other"))), (key % 4 + 1).cast("int"))
    part = table(spark, sf_dir, "part")
    objects = part.select(F.lit(1).alias("doc"), key.alias("obj"), F.when(key % 3 == 0, "stream").otherwise("dict").alias("kind"), kind.alias("type"))
    edges = part.select(F.lit(1).alias("doc"), key.alias("src"), F.lit(0).alias("dst"), F.explode(F.array(*map(F.lit, _ALL_KEYS))).alias("key"))
    left = D.strip_edges(objects, edges)
    return left.join(objects.select(F.col("obj").alias("src"), "type"), "src").select("src", "key", "type")


@query("q_inline_annotations", "SELECT o_custkey AS doc, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS annots, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS links FROM orders GROUP BY o_custkey")
def inline_annotations(spark, sf_dir):
    """Annotations found as objects and again in pages count once."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("obj"), F.when(F.col("o_orderstatus") == "F", "Link").alias("subtype"))
    objects = rows.select("doc", "obj", F.lit("dict").alias("kind"), F.when(F.col("obj") % 2 == 0, "Annot").otherwise("Other").alias("type"), "subtype", F.array().cast("array<string>").alias("keys"))
    return D.object_counts(objects, rows).select("doc", "annots", "links")


_EDGES = "SELECT p_partkey // 50 AS doc, p_partkey AS src, (p_partkey // 50) * 50 + (p_partkey * 7 + 3 + k) % 50 AS dst, CASE p_size % 4 WHEN 0 THEN 'Metadata' WHEN 1 THEN 'Annots' WHEN 2 THEN 'Kids' ELSE 'AA' END AS key FROM part, (VALUES (0), (11)) v(k) WHERE p_partkey % 3 <> 2"
_TYPE = "CASE p_partkey % 50 WHEN 0 THEN 'Catalog' WHEN 1 THEN 'Names' ELSE CASE p_partkey % 5 WHEN 0 THEN 'Page' ELSE 'Other' END END"


def _graph(spark, sf_dir):
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    doc = F.floor(key / 50).cast("bigint")
    kind = F.when(key % 50 == 0, "Catalog").when(key % 50 == 1, "Names").when(key % 5 == 0, "Page").otherwise("Other")
    objects = part.select(doc.alias("doc"), key.alias("obj"), F.when(key % 4 == 0, "stream").otherwise("dict").alias("kind"), kind.alias("type"))
    name = F.element_at(F.array(*map(F.lit, ("Metadata", "Annots", "Kids", "AA"))), F.col("p_size") % 4 + 1)
    edges = part.where(key % 3 != 2).select(doc.alias("doc"), key.alias("src"), F.explode(F.array(F.lit(0), F.lit(11))).alias("k"), name.alias("key"))
    edges = edges.select("doc", "src", (F.col("doc") * 50 + (F.col("src") * 7 + 3 + F.col("k")) % 50).alias("dst"), "key")
    return objects, edges, objects.where(F.col("type") == "Catalog").select("doc", "obj")


@query("q_strip_edges", f"SELECT e.doc, e.src, e.dst, e.key FROM ({_EDGES}) e JOIN (SELECT p_partkey, {_TYPE} AS type FROM part) o ON o.p_partkey = e.src WHERE NOT ((type = 'Catalog' AND key IN ('Metadata', 'AA')) OR (type = 'Page' AND key IN ('Annots', 'Metadata', 'AA')) OR (e.src % 4 = 0 AND key = 'Metadata'))")
def strip_edges(spark, sf_dir):
    objects, edges, _ = _graph(spark, sf_dir)
    return D.strip_edges(objects, edges)


@query(
    "q_gc_reachable",
    f"""WITH RECURSIVE e AS ({_EDGES}), r(doc, obj) AS (SELECT p_partkey // 50, p_partkey FROM part WHERE p_partkey % 50 = 0 UNION SELECT e.doc, e.dst FROM r JOIN e ON e.doc = r.doc AND e.src = r.obj)
    SELECT p_partkey // 50 AS doc, count(*) AS kept, sum(p_partkey)::BIGINT AS keys FROM part JOIN r ON r.obj = p_partkey GROUP BY 1""",
)
def gc_reachable(spark, sf_dir):
    objects, edges, roots = _graph(spark, sf_dir)
    kept = D.collect_garbage(objects, edges, roots, saver(spark))
    return kept.groupBy("doc").agg(F.count("*").alias("kept"), F.sum("obj").alias("keys"))


@query(
    "q_strip_all",
    f"""WITH RECURSIVE a AS ({_EDGES}), e AS (SELECT a.* FROM a JOIN (SELECT p_partkey, {_TYPE} AS type FROM part) o ON o.p_partkey = a.src WHERE NOT ((type = 'Catalog' AND key IN ('Metadata', 'AA')) OR (type = 'Page' AND key IN ('Annots', 'Metadata', 'AA')) OR (a.src % 4 = 0 AND key = 'Metadata'))),
    r(doc, obj) AS (SELECT p_partkey // 50, p_partkey FROM part WHERE p_partkey % 50 = 0 UNION SELECT e.doc, e.dst FROM r JOIN e ON e.doc = r.doc AND e.src = r.obj),
    k AS (SELECT p_partkey // 50 AS doc, p_partkey AS obj FROM part JOIN r ON r.obj = p_partkey)
    SELECT k.doc, count(*) AS objects, sum(obj)::BIGINT AS keys, (SELECT count(*) FROM e WHERE e.doc = k.doc AND e.src IN (SELECT obj FROM k))::BIGINT AS edges FROM k GROUP BY k.doc""",
)
def strip_all(spark, sf_dir):
    objects, edges, roots = _graph(spark, sf_dir)
    info = roots.select("doc", F.lit("t").alias("Title"))
    kept, left, _ = D.strip_all(objects, edges, info, roots, saver(spark))
    counts = left.groupBy("doc").agg(F.count("*").alias("edges"))
    return kept.groupBy("doc").agg(F.count("*").alias("objects"), F.sum("obj").alias("keys")).join(counts, "doc", "left").select("doc", "objects", "keys", F.coalesce("edges", F.lit(0)).alias("edges"))


def _pdf_files(spark, sf_dir):
    """A small PDF for each part: two pages, an annotation, XMP; every second has it in its catalog, every third a link in its page, every seventh is encrypted."""
    key = F.col("p_partkey")
    pieces = (
        "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R", F.when(key % 2 == 0, "/Metadata 3 0 R").otherwise(""),
        ">>endobj\n2 0 obj<</Type/Pages/Kids[4 0 R 5 0 R]>>endobj\n3 0 obj<</Type/Metadata/Length 5>>stream\nhello\nendstream endobj\n4 0 obj<</Type/Page/Parent 2 0 R/Annots[6 0 R",
        F.when(key % 3 == 0, "<</Subtype/Link>>").otherwise(""), "]>>endobj\n5 0 obj<</Type/Page/Parent 2 0 R>>endobj\n6 0 obj<</Type/Annot/Subtype/Text>>endobj\n7 0 obj<</Title(",
        F.col("p_name"), ")/CreationDate(D:20240102030405+01'00')>>endobj\ntrailer<</Root 1 0 R/Info 7 0 R", F.when(key % 7 == 0, "/Encrypt 8 0 R").otherwise(""), ">>",
    )
    content = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces)).cast("binary")
    files = table(spark, sf_dir, "part").select(key.alias("file_id"), content.alias("content"))
    return files.repartition(spark.sparkContext.defaultParallelism)  # the table is small, what it is made into isn't


@query(
    "q_pdf_objects",
    """SELECT p_partkey AS doc, p_partkey % 7 = 0 AS encrypted, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 7 <> 0 THEN 7 ELSE 0 END AS objects,
    CASE WHEN p_partkey % 7 <> 0 THEN 6 + (p_partkey + 1) % 2 ELSE 0 END AS edges, CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS xmp, CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS annots,
    CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 3 = 0)::BIGINT END AS links FROM part""",
)
def pdf_objects(spark, sf_dir):
    """Objects, references and findings of PDF files."""
    rows = saver(spark)(pdf.pdf_objects(spark, _pdf_files(spark, sf_dir)))
    parts = pdf.structure(rows)
    sizes = rows.groupBy("doc").agg(F.bool_or("encrypted").alias("encrypted"), F.count("obj").alias("objects"), F.sum(F.coalesce(F.size("refs"), F.lit(0))).alias("edges"))
    counts = D.object_counts(parts.objects, parts.annotations)
    out = sizes.join(unsent(parts.info.select("doc", F.col("Title").alias("title"))), "doc", "left").join(unsent(counts), "doc", "left")
    return out.select("doc", "encrypted", "title", "objects", F.greatest("edges", F.lit(0)).cast("bigint").alias("edges"), "xmp", "annots", "links")


@query("q_pdf_clean", "SELECT p_partkey AS doc, CASE WHEN p_partkey % 7 <> 0 THEN '1 2 4 5 7' ELSE '' END AS objects, CASE WHEN p_partkey % 7 = 0 THEN 'encrypted' END AS error, CASE WHEN p_partkey % 7 <> 0 THEN '' END AS title FROM part")
def pdf_clean(spark, sf_dir):
    """PDF files written without hidden data, and read again: which objects are left."""
    cleaned = saver(spark)(pdf.clean_files(_pdf_files(spark, sf_dir)))
    rows = pdf.pdf_objects(spark, cleaned.where("error is null"))
    left = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.shiftright("obj", 16))).alias("o"), F.max(F.element_at("strings", F.lit("Title"))).alias("title"))
    return cleaned.select(F.col("file_id").alias("doc"), "error").join(unsent(left), "doc", "left").select("doc", F.coalesce(F.array_join(F.col("o").cast("array<string>"), " "), F.lit("")).alias("objects"), "error", "title")


@query("q_uses_dct", "SELECT p_partkey, p_partkey % 4 IN (1, 2) AS dct FROM part")
def uses_dct(spark, sf_dir):
    filters = F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in (("FlateDecode",), ("DCTDecode",), ("FlateDecode", "DCTDecode")))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", D.uses_dct(F.when(F.col("p_partkey") % 4 < 3, filters)).alias("dct"))


_SIZES = "SELECT p_type AS category, p_partkey AS file, p_retailprice * p_size AS size FROM part"


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("file"), (F.col("p_retailprice") * F.col("p_size")).alias("size"))


@query("q_size_rollup", f"SELECT coalesce(category, '(all)') AS category, count(*) AS files, round(sum(size), 2) AS total FROM ({_SIZES}) GROUP BY ROLLUP (category)")
def size_rollup(spark, sf_dir):
    return _sizes(spark, sf_dir).rollup("category").agg(F.count("*").alias("files"), F.round(F.sum("size"), 2).alias("total")).select(F.coalesce("category", F.lit("(all)")).alias("category"), "files", "total")


@query("q_top10_per_group", f"SELECT category, file, size, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, file) AS r FROM ({_SIZES})) WHERE r <= 10")
def top10_per_group(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("size"), "file"))
    return _sizes(spark, sf_dir).withColumn("place", place).where("place <= 10").select("category", "file", "size", F.col("place").cast("bigint").alias("place"))


_BUDGET = "(VALUES ('ECONOMY', 100.0::DOUBLE), ('STANDARD', 1e12::DOUBLE)) b(category, most)"


@query("q_size_budget", f"SELECT s.category, CASE WHEN b.most IS NULL THEN 'no budget' WHEN total > most THEN 'over' ELSE 'ok' END AS verdict FROM (SELECT category, sum(size) AS total FROM ({_SIZES}) GROUP BY category) s LEFT JOIN {_BUDGET} ON s.category = b.category")
def size_budget(spark, sf_dir):
    """A category without a budget is a failure too."""
    budget = spark.createDataFrame([("ECONOMY", 100.0), ("STANDARD", 1e12)], "category string, most double")
    totals = _sizes(spark, sf_dir).groupBy("category").agg(F.sum("size").alias("total"))
    verdict = F.when(F.col("most").isNull(), "no budget").when(F.col("total") > F.col("most"), "over").otherwise("ok")
    return totals.join(F.broadcast(budget), "category", "left").select("category", verdict.alias("verdict"))  # two rows


@query(
    "q_strip_document",
    """SELECT p_partkey AS doc, 5::BIGINT AS objects, 5::BIGINT AS edges, '' AS title, false AS dated, 1 + (p_partkey + 1) % 2 AS cut FROM part WHERE p_partkey % 7 <> 0""",
)
def strip_document(spark, sf_dir):
    """PDF files through the whole strip on tables: objects and references that are left, the information that isn't, and how many references went."""
    parts = pdf.structure(saver(spark)(pdf.pdf_objects(spark, _pdf_files(spark, sf_dir))))
    kept, edges, info = D.strip_all(parts.objects, parts.edges, parts.info, parts.roots)
    before = parts.edges.groupBy("doc").agg(F.count("*").alias("all"))
    left = edges.groupBy("doc").agg(F.count("*").alias("edges"))
    dated = F.lit(any(c in info.columns for c in D.DATE_KEYS)).alias("dated")
    out = kept.groupBy("doc").agg(F.count("*").alias("objects")).join(unsent(left), "doc").join(unsent(before), "doc").join(unsent(info.select("doc", F.col("Title").alias("title"))), "doc")
    return out.select("doc", "objects", "edges", "title", dated, (F.col("all") - F.col("edges")).alias("cut"))


@query(
    "q_export",
    """SELECT p_partkey AS doc, p_partkey % 2 AS batch, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 10 = 3 THEN 'refused' ELSE 'published' END AS status,
    CASE WHEN p_partkey % 10 = 3 THEN '1 pages to render' WHEN p_partkey % 7 = 0 THEN 'encrypted' END AS reason, CASE WHEN NOT (p_partkey % 7 = 0 OR p_partkey % 10 = 3) THEN '1 2 4 5 7' END AS objects FROM part""",
)
def export(spark, sf_dir):
    """PDF files exported in two batches, one of them played twice: what became of each, and the objects of those published."""
    folder = shared_folder(spark, "export")
    files = _pdf_files(spark, sf_dir)
    plan = files.where("file_id % 10 = 3").select(F.col("file_id").alias("doc"), F.lit(1).alias("page"), F.lit("raster").alias("route"), F.lit(None).cast("string").alias("error"))
    for batch in (0, 1, 0):
        E.publish(files.where(F.col("file_id") % 2 == batch), folder, batch, plan)
    rows = pdf.pdf_objects(spark, E.published(spark, folder).repartition(spark.sparkContext.defaultParallelism))
    held = rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.shiftright("obj", 16))).cast("array<string>"), " ").alias("objects"))
    return E.manifest(spark, folder).select(F.col("file_id").alias("doc"), "batch", "status", "reason").join(unsent(held), "doc", "left")
