"""Audit and strip of document structure: information strings, typed objects, references.

objects(doc, obj, kind, type, subtype, keys, ...) are a document's indirect objects, edges(doc, src, dst, key)
the references between them, each with the key it stands under.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions import text as T
from redactlake.functions.geometry import MAX_RASTER_PAGES
from redactlake.operators.rounds import unsent
from redactlake.operators.verify import has_text_layer

INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Producer", "Creator")
DATE_KEYS = ("Created", "Modified")
#: id, severity, category and title of findings that count objects, in order; all are emitted only above zero.
COUNTED = (
    ("xmp", "medium", "xmp", "XMP packets"),
    ("annots", "high", "annotation", "Annotations other than links"),
    ("links", "medium", "annotation", "Link annotations"),
    ("attachments", "high", "attachment", "Attached files"),
    ("javascript", "high", "javascript", "Scripts"),
    ("exif", "high", "metadata", "Images that carry EXIF"),
    ("pieceinfo", "medium", "structure", "Private data of applications"),
    ("ocg", "medium", "structure", "Layers"),
)
ENCRYPTED = ("encrypted", "high", "structure", "Encryption dictionary present; contents not audited")


def info_findings(info: DataFrame) -> DataFrame:
    """(doc, id, severity, category, title, detail) of info(doc, Title, ..., Created, Modified): strings that aren't blank, dates in UTC."""
    pairs = [F.struct(F.lit(f"meta-{k}").alias("id"), F.lit(f"Information entry {k}").alias("title"), F.when(~T.is_blank(F.col(k)), F.col(k)).alias("detail")) for k in INFO_KEYS if k in info.columns]
    pairs += [F.struct(F.lit(f"date-{k}").alias("id"), F.lit(f"Date {k}").alias("title"), F.date_format(F.col(k), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("detail")) for k in DATE_KEYS if k in info.columns]
    rows = info.select("doc", F.explode(F.array(*pairs)).alias("p")).where("p.detail is not null")
    return rows.select("doc", "p.id", F.lit("medium").alias("severity"), F.lit("metadata").alias("category"), "p.title", "p.detail")


def object_counts(objects: DataFrame, inline_annotations: DataFrame | None = None) -> DataFrame:
    """(doc, xmp, annots, links, attachments, javascript, exif, pieceinfo, ocg) in one pass over the objects.

    Annotation, embedded file, metadata and layer exclude each other; scripts and pictures with EXIF are
    counted besides. Annotations that pages list, inline_annotations(doc, obj, subtype), count once with
    those found as objects.
    """
    of = F.col("type")
    annotations = objects.where(of == "Annot").select("doc", "obj", "subtype")
    if inline_annotations is not None:
        annotations = annotations.unionByName(inline_annotations).dropDuplicates(["doc", "obj"])
    per_doc = annotations.groupBy("doc").agg(F.count_if(F.coalesce(F.col("subtype") == "Link", F.lit(False))).alias("links"), F.count("*").alias("all"))
    has = lambda key: F.array_contains("keys", key)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    root = F.coalesce(of.isin("Catalog", "Page"), F.lit(False))
    rest = objects.groupBy("doc").agg(
        count(of == "Metadata").alias("xmp"),
        count(of == "EmbeddedFile").alias("attachments"),
        count((F.col("subtype") == "JavaScript") | has("JS")).alias("javascript"),
        count(F.col("kind") == "exif-image").alias("exif"),
        F.bool_or(root & has("PieceInfo")).cast("bigint").alias("pieceinfo"),
        (count(of.isin("OCG", "OCMD")) + count((of == "Catalog") & has("OCProperties"))).alias("ocg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = rest.join(unsent(per_doc), "doc", "left")
    return joined.select("doc", "xmp", zero(F.col("all") - F.col("links")).alias("annots"), zero(F.col("links")).alias("links"), "attachments", "javascript", "exif", zero(F.col("pieceinfo")).alias("pieceinfo"), "ocg")


def count_findings(counts: DataFrame, encrypted: Column | None = None) -> DataFrame:
    """(doc, ord, id, severity, category, title, n) for counts above zero; an encrypted document has one finding and no other."""
    made = F.filter(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(c).alias("category"), F.lit(t).alias("title"), F.col(i).cast("bigint").alias("n")) for i, s, c, t in COUNTED)), lambda x: x["n"] > 0)
    if encrypted is not None:
        one = F.array(F.struct(*(F.lit(v).alias(n) for n, v in zip(("id", "severity", "category", "title"), ENCRYPTED, strict=True)), F.lit(1).cast("bigint").alias("n")))
        made = F.when(encrypted, one).otherwise(made)
    return counts.select("doc", F.posexplode(made).alias("ord", "f")).select("doc", "ord", "f.*")


def audit(counts: DataFrame, pages: DataFrame, encrypted: Column | None = None) -> DataFrame:
    """(doc, findings, has_text): a document's structure findings in order, and whether it has a text layer.

    counts is what object_counts() gives, pages(doc, page, text) the text of pages; a document of either is listed.
    """
    found = count_findings(counts, encrypted).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "severity", "n"))).alias("findings"))  # at most one of each kind
    docs = counts.select("doc").unionByName(pages.select("doc")).distinct()
    joined = docs.join(unsent(found), "doc", "left").join(unsent(has_text_layer(pages)), "doc", "left")
    empty = F.array().cast("array<struct<ord:int,id:string,severity:string,n:bigint>>")
    return joined.select("doc", F.coalesce("findings", empty).alias("findings"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def uses_dct(filters: Column) -> Column:
    return F.coalesce(F.array_contains(filters, "DCTDecode"), F.lit(False))


def has_exif_segment(content: Column) -> Column:
    """An EXIF segment begins within the first 64 KiB. Bytes are read as Latin-1, one character each."""
    window = F.decode(F.substring(content, 1, 65536 + 9), "ISO-8859-1")
    return F.rlike(window, F.lit("(?s)\\xFF\\xE1..Exif\\x00\\x00"))


# Keys that a strip removes, by where they stand.
STRIPPED_KEYS = {
    "Catalog": ("Metadata", "AcroForm", "OpenAction", "AA", "AF", "PieceInfo", "Names/JavaScript", "Names/EmbeddedFiles"),
    "Page": ("Annots", "Metadata", "AA", "PieceInfo"),
    "Names": ("JavaScript", "EmbeddedFiles"),
}
STRIPPED_INFO = ("CreationDate", "ModDate", "Trapped")


def strip_edges(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """edges without those under keys that a strip removes: by the type of the object they stand in; Metadata in any stream."""
    gone = F.lit(False)
    for kind, keys in STRIPPED_KEYS.items():
        gone = gone | ((F.col("_type") == kind) & F.col("key").isin(*keys))
    gone = gone | (F.col("_kind").isin("stream", "exif-image") & (F.col("key") == "Metadata"))
    holders = objects.select(F.col("doc").alias("_doc"), F.col("obj").alias("_obj"), F.col("type").alias("_type"), F.col("kind").alias("_kind"))
    joined = edges.join(unsent(holders), (F.col("doc") == F.col("_doc")) & (F.col("src") == F.col("_obj")), "left")
    return joined.where(~F.coalesce(gone, F.lit(False))).select(*edges.columns)


def strip_info(info: DataFrame) -> DataFrame:
    """Information strings emptied, dates gone."""
    out = info
    for k in INFO_KEYS:
        if k in info.columns:
            out = out.withColumn(k, F.lit(""))
    return out.drop(*(k for k in (*DATE_KEYS, *STRIPPED_INFO) if k in info.columns))


def labelled_reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, label, obj) that the roots(doc, label, obj) of each label lead to, roots included, over edges(doc, src, dst).

    One shuffle by document, whatever the depth: a document's references meet in one task, as they did when
    its file was read, in three arrays of numbers. Cycles, repeated edges and references to nothing are fine.
    Null documents, labels or objects lead nowhere. The result holds an object once for each label that
    reaches it.
    """
    left = edges.select(F.col("doc").alias("e_doc"), F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("e_doc is not null and src is not null and dst is not null")
    right = roots.select(F.col("doc").alias("doc"), F.col("label").alias("label"), F.col("obj").cast("bigint").alias("obj")).where("doc is not null and label is not null and obj is not null").distinct()
    kinds = {f.name: f.dataType.simpleString() for f in right.schema}

    def run(key: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
        src, dst, obj = (t.column(c).to_numpy() for t, c in ((held, "src"), (held, "dst"), (wanted, "obj")))
        ids, at = np.unique(np.concatenate([src, dst, obj]), return_inverse=True)
        src, dst, obj = np.split(at, [len(src), 2 * len(src)])
        order = np.argsort(src, kind="stable")
        dst = dst[order]
        begins = np.searchsorted(src[order], np.arange(len(ids) + 1))
        label = wanted.column("label").combine_chunks().dictionary_encode()
        of = label.indices.to_numpy(zero_copy_only=False)
        seen, labels, found = np.zeros(len(ids), bool), [], []
        for number in range(len(label.dictionary)):
            frontier, levels = obj[of == number], []
            while len(frontier):
                frontier = np.unique(frontier)
                seen[frontier] = True
                levels.append(frontier)
                sizes = begins[frontier + 1] - begins[frontier]
                ends = np.cumsum(sizes)
                ahead = dst[np.repeat(begins[frontier] - ends + sizes, sizes) + np.arange(sizes.sum())]
                frontier = ahead[~seen[ahead]]
            reached = np.concatenate(levels)
            seen[reached] = False
            labels.append(np.full(len(reached), number))
            found.append(reached)
        if not found:
            return pa.table({c: pa.array([], wanted.schema.field(c).type) for c in ("doc", "label", "obj")})
        reached = np.concatenate(found)
        doc = wanted.column("doc").combine_chunks().take(pa.array(np.zeros(len(reached), np.int64)))
        return pa.table({"doc": doc, "label": label.dictionary.take(pa.array(np.concatenate(labels))), "obj": pa.array(ids[reached])})

    return left.groupBy("e_doc").cogroup(right.groupBy("doc")).applyInArrow(run, f"doc {kinds['doc']}, label {kinds['label']}, obj bigint")


def reachable(edges: DataFrame, roots: DataFrame, checkpoint=None) -> DataFrame:
    """(doc, obj) that roots(doc, obj) lead to, roots included. checkpoint is unused: no round is saved."""
    kind = roots.schema["obj"].dataType
    return labelled_reachable(edges, roots.withColumn("label", F.lit(0))).select("doc", F.col("obj").cast(kind).alias("obj"))


def page_objects(tree: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, page, obj): what a page that is copied takes along, itself included; shared objects once for each page.

    tree(doc, obj, page, holder) are pages as operators/pages.page_tree() gives them: holder is the node whose
    resources the page inherits, if they aren't its own. A page's reference to its parent isn't followed.
    """
    pages = objects.where("type = 'Page'").select(F.col("doc").alias("_doc"), F.col("obj").alias("_obj"))
    upward = edges.where("key = 'Parent'").join(unsent(pages), (F.col("doc") == F.col("_doc")) & (F.col("src") == F.col("_obj")), "left_anti")
    followed = edges.where("key is null or key <> 'Parent'").unionByName(upward).select("doc", "src", "dst")
    given = edges.where("key = 'Resources'").select(F.col("doc").alias("_doc"), F.col("src").alias("_src"), "dst")
    inherited = tree.where("holder <> obj").join(unsent(given), (F.col("doc") == F.col("_doc")) & (F.col("holder") == F.col("_src"))).select("doc", F.col("obj").alias("src"), "dst")
    found = labelled_reachable(followed.unionByName(inherited), tree.select("doc", F.col("page").alias("label"), "obj"))
    return found.select("doc", F.col("label").alias("page"), "obj")


def page_split(held: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc, obj, copied, raster, dropped): on how many copied and rasterised pages an object stands; dropped if only on the latter.

    held(doc, page, obj) as page_objects(), plan(doc, page, route, error) as redaction_plan(); refused documents have no rows.
    """
    joined = held.join(unsent(plan.where("route is not null").select("doc", "page", "route")), ["doc", "page"])
    counts = joined.groupBy("doc", "obj").agg(F.count_if(F.col("route") == "copy").alias("copied"), F.count_if(F.col("route") == "raster").alias("raster"))
    return counts.withColumn("dropped", F.col("copied") == 0)


def collect_garbage(objects: DataFrame, edges: DataFrame, roots: DataFrame, checkpoint=None) -> DataFrame:
    """objects that are reachable; a document without roots keeps everything."""
    alive = reachable(edges, roots, checkpoint)
    rooted = roots.select(F.col("doc").alias("_doc")).distinct()
    rootless = objects.join(unsent(rooted), F.col("doc") == F.col("_doc"), "left_anti")
    alive = alive.select(F.col("doc").alias("_doc"), F.col("obj").alias("_obj"))
    return objects.join(unsent(alive), (F.col("doc") == F.col("_doc")) & (F.col("obj") == F.col("_obj")), "left_semi").unionByName(rootless)


def unreachable(objects: DataFrame, edges: DataFrame, roots: DataFrame, checkpoint=None) -> DataFrame:
    """(doc, obj) that nothing leads to, of documents that have a root."""
    alive = collect_garbage(objects, edges, roots, checkpoint)
    return objects.select("doc", "obj").exceptAll(alive.select("doc", "obj"))


def strip_all(objects: DataFrame, edges: DataFrame, info: DataFrame, roots: DataFrame, checkpoint=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, edges, info) after the whole strip, in a fixed order: information, edges, then garbage, which the edges decide.

    Typed counts of the result are read from the objects that are left, whose keys lose what was stripped.
    """
    kept_edges = strip_edges(objects, edges)
    alive = collect_garbage(objects, kept_edges, roots, checkpoint)
    gone = F.array().cast("array<string>")
    for kind, keys in STRIPPED_KEYS.items():
        gone = F.when(F.col("type") == kind, F.array(*map(F.lit, keys))).otherwise(gone)
    gone = F.when(F.col("kind").isin("stream", "exif-image"), F.array_union(gone, F.array(F.lit("Metadata")))).otherwise(gone)
    if "keys" in objects.columns:
        alive = alive.withColumn("keys", F.array_except("keys", gone))
    ends = alive.select(F.col("doc").alias("_doc"), F.col("obj").alias("_obj"))
    kept_edges = kept_edges.join(unsent(ends), (F.col("doc") == F.col("_doc")) & (F.col("src") == F.col("_obj")), "left_semi")
    return alive, kept_edges, strip_info(info)


def without_rect(rects: DataFrame, rect_id) -> DataFrame:
    """rects but the one of that id."""
    return rects.where(~F.col("rect_id").eqNullSafe(F.lit(rect_id)))


def redaction_plan(pages: DataFrame, rects: DataFrame, encrypted: DataFrame | None = None) -> DataFrame:
    """(doc, page, route, error): how each page is rebuilt, or why its document is refused.

    A document is refused if it is in encrypted(doc), or if over 300 of its pages would become images; one
    without a rectangle is copied page by page.
    """
    out = page_routing(pages, rects).join(unsent(export_guard(rects).select("doc", F.col("error").alias("too_many"))), "doc", "left")
    if encrypted is None:
        return out.select("doc", "page", F.when(F.col("too_many").isNull(), F.col("route")).alias("route"), F.col("too_many").alias("error"))
    locked = encrypted.select("doc").distinct().withColumn("locked", F.lit(True))
    out = out.join(unsent(locked), "doc", "left")
    error = F.when(F.col("locked"), "encrypted").otherwise(F.col("too_many"))
    return out.select("doc", "page", F.when(error.isNull(), F.col("route")).alias("route"), error.alias("error"))


def page_routing(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc, page, route): raster for pages with a rectangle, copy for the others."""
    marked = rects.select("doc", "page").distinct().withColumn("_hit", F.lit(True))
    return pages.select("doc", "page").join(unsent(marked), ["doc", "page"], "left").select("doc", "page", F.when(F.col("_hit"), "raster").otherwise("copy").alias("route"))


def export_guard(rects: DataFrame) -> DataFrame:
    """(doc, pages, error): documents with over 300 pages to flatten are refused."""
    n = rects.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    return n.withColumn("error", F.when(F.col("pages") > MAX_RASTER_PAGES, F.concat(F.col("pages").cast("string"), F.lit(f" pages to rasterise, limit {MAX_RASTER_PAGES}"))))


def apply_to_all_pages(pages: DataFrame, rects: DataFrame, current: int) -> DataFrame:
    """rects, and those of the current page on each other page of their document; duplicates stay."""
    here = rects.where(F.col("page") == current)
    others = pages.select(F.col("doc").alias("_doc"), F.col("page").alias("_page")).where(F.col("_page") != current)
    copies = here.join(unsent(others), F.col("doc") == F.col("_doc")).select(*(F.col("_page").alias("page") if c == "page" else F.col(c) for c in rects.columns))
    return rects.unionByName(copies)
