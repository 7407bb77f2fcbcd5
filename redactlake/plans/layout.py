"""Queries on boxes, runs and pixels, over rows of lineitem and part read as geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.operators import documents as D
from redactlake.operators import regions as R
from redactlake.plans.registry import query, table

_KEYS = ("l_orderkey", "l_linenumber")
_ITEM = "l_orderkey, l_linenumber"


def _micro(column, name):
    """Millionths as a whole number: doubles compare exactly."""
    return F.floor(column * 1000000 + 0.5).cast("bigint").alias(name)


def _m(sql, name):
    return f"floor(({sql}) * 1000000 + 0.5)::BIGINT AS {name}"


def _runs(spark, sf_dir):
    """Suppliers as documents, line numbers as pages."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), F.concat("l_returnflag", F.lit(" "), F.col("l_partkey").cast("string")).alias("str"), (F.col("l_discount") * 5).alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_quantity") / 200).alias("w"), F.lit(0.05).alias("h"), (F.col("l_linestatus") == "O").alias("vertical"))


def _rects(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return x.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rect_id"), (F.col("l_discount") * 4).alias("x"), (F.col("l_tax") * 9).alias("y"), F.lit(0.3).alias("w"), F.lit(0.06).alias("h"), F.when(F.col("l_linestatus") == "F", F.lit("a term")).alias("term"))


_RUNS = "SELECT l_suppkey AS doc, l_linenumber AS page, l_returnflag || ' ' || l_partkey AS str, l_discount * 5 AS x, l_tax * 10 AS y, l_quantity / 200 AS w, 0.05::DOUBLE AS h, l_linestatus = 'O' AS vertical FROM lineitem"
_RECTS = "SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey * 10 + l_linenumber AS rect_id, l_discount * 4 AS x, l_tax * 9 AS y, 0.3::DOUBLE AS w, 0.06::DOUBLE AS h, CASE WHEN l_linestatus = 'F' THEN 'a term' END AS term FROM lineitem WHERE l_returnflag = 'R'"
_OVERLAP = "r.x + r.w > q.x AND q.x + q.w > r.x AND r.y + r.h > q.y AND q.y + q.h > r.y"


@query(
    "q_boxed_terms",
    f"""WITH r AS ({_RUNS}), q AS ({_RECTS})
    SELECT DISTINCT r.doc, r.str AS term FROM r JOIN q ON r.doc = q.doc AND r.page = q.page AND {_OVERLAP}
    AND least(r.y + r.h, q.y + q.h) - greatest(r.y, q.y) >= r.h / 2""",
)
def boxed_terms(spark, sf_dir):
    return R.boxed_terms(_rects(spark, sf_dir), _runs(spark, sf_dir))


@query(
    "q_check_regions",
    f"""WITH r AS ({_RUNS}), q AS ({_RECTS}), regions AS (
      SELECT doc, page, rect_id, x FROM q UNION ALL
      SELECT q.doc, q.page, q.rect_id, r.x FROM q JOIN r ON r.doc = q.doc AND r.page = q.page AND {_OVERLAP} AND q.term IS NOT NULL
      AND CASE WHEN r.vertical THEN q.y <= r.y + 0.0001::DOUBLE AND q.y + q.h >= r.y + r.h - 0.0001::DOUBLE ELSE q.x <= r.x + 0.0001::DOUBLE AND q.x + q.w >= r.x + r.w - 0.0001::DOUBLE END)
    SELECT doc, page, count(*) AS n_regions, count(DISTINCT rect_id) AS n_rects, sum({_m("x", "z").removesuffix(" AS z")})::BIGINT AS x_sum FROM regions GROUP BY doc, page""",
)
def check_regions(spark, sf_dir):
    found = R.check_regions(_rects(spark, sf_dir), _runs(spark, sf_dir))
    return found.groupBy("doc", "page").agg(F.count("*").alias("n_regions"), F.count_distinct("rect_id").alias("n_rects"), F.sum(F.floor(F.col("x") * 1000000 + 0.5).cast("bigint")).alias("x_sum"))


@query("q_region_leaks", f"SELECT {_ITEM}, l_partkey, l_suppkey, CASE WHEN l_quantity <= 3 THEN false ELSE l_partkey % 80 > 64 OR (l_partkey % 80)::DOUBLE / ((l_quantity - 3) * 40) > 0.03 END AS leaks FROM lineitem")
def region_leaks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEYS, "l_partkey", "l_suppkey", G.leaks((F.col("l_quantity") - 3) * 40, F.col("l_partkey") % 80).alias("leaks"))


@query(
    "q_pixel_bounds",
    f"""SELECT {_ITEM}, l_partkey, floor(x * 1224)::BIGINT AS fill_x0, floor(y * 1584)::BIGINT AS fill_y0, ceil((x + w) * 1224)::BIGINT AS fill_x1, ceil((y + h) * 1584)::BIGINT AS fill_y1,
    floor(greatest(0.0::DOUBLE, x) * 1224)::BIGINT + 1 AS see_x0, floor(greatest(0.0::DOUBLE, y) * 1584)::BIGINT + 1 AS see_y0, ceil(least(1.0::DOUBLE, x + w) * 1224)::BIGINT - 1 AS see_x1, ceil(least(1.0::DOUBLE, y + h) * 1584)::BIGINT - 1 AS see_y1
    FROM (SELECT *, l_discount * 10 - 0.05::DOUBLE AS x, l_tax * 10 AS y, l_quantity / 100 AS w, l_quantity / 400 AS h FROM lineitem)""",
)
def pixel_bounds(spark, sf_dir):
    box = G.Box(F.col("l_discount") * 10 - 0.05, F.col("l_tax") * 10, F.col("l_quantity") / 100, F.col("l_quantity") / 400)
    width, height = F.lit(1224), F.lit(1584)
    made = [c.cast("bigint").alias(f"{kind}_{n}") for kind, part in (("fill", G.pixel_fill(box, width, height)), ("see", G.sample_bounds(box, width, height))) for n, c in zip(("x0", "y0", "x1", "y1"), part, strict=True)]
    return table(spark, sf_dir, "lineitem").select(*_KEYS, "l_partkey", *made)


@query("q_luma", f"SELECT p_partkey, {_m('(p_size * 5 / 255::DOUBLE) * (p_partkey % 256 * 0.299::DOUBLE + p_partkey * 7 % 256 * 0.587::DOUBLE + p_partkey * 13 % 256 * 0.114::DOUBLE) + (1 - p_size * 5 / 255::DOUBLE) * 255', 'luma')} FROM part")
def luma(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", _micro(G.luma(key % 256, key * 7 % 256, key * 13 % 256, F.col("p_size") * 5), "luma"))


@query("q_clamp_scale", f"SELECT p_partkey, {_m('least(2.0::DOUBLE, 8192 / (p_retailprice * p_size), 8192 / (p_retailprice + p_size), sqrt(16777216 / ((p_retailprice * p_size) * (p_retailprice + p_size))))', 'scale')} FROM part")
def clamp_scale(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", _micro(G.clamp_scale(price * size, price + size, F.lit(G.COVER_SCALE)), "scale"))


@query("q_vertical_cover", f"SELECT p_partkey, {_m('greatest(1.15::DOUBLE, coalesce(a, 0))', 'above')}, {_m('greatest(0.3::DOUBLE, abs(coalesce(d, 0)))', 'below')} FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size / 40::DOUBLE END AS a, CASE WHEN p_partkey % 3 > 0 THEN -p_size / 80::DOUBLE END AS d FROM part)")
def vertical_cover(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    above, below = G.vertical_cover(F.when(key % 5 > 0, size / 40), F.when(key % 3 > 0, -size / 80))
    return table(spark, sf_dir, "part").select("p_partkey", _micro(above, "above"), _micro(below, "below"))


@query("q_safety_margin", f"SELECT p_partkey, {_m('greatest(p_retailprice * 0.0015::DOUBLE, p_size * 0.08::DOUBLE)', 'margin')} FROM part")
def safety_margin(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _micro(G.safety_margin(F.col("p_retailprice"), F.col("p_size")), "margin"))


@query("q_font_height", f"SELECT p_partkey, {_m('coalesce(nullif((p_size % 4)::DOUBLE, 0), nullif(sqrt((p_partkey % 3) ** 2 + (p_partkey % 5) ** 2), 0), abs((p_partkey % 5)::DOUBLE))', 'height')} FROM part")
def font_height(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    height = G.font_height((size % 4).cast("double"), (key % 3).cast("double"), (key % 5).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", _micro(height, "height"))


@query(
    "q_match_extent",
    f"""SELECT {_ITEM}, l_partkey, {_m("CASE WHEN not ltr OR s THEN o ELSE greatest(o, o + b - m) END", "x_left")}, {_m("CASE WHEN not ltr OR e THEN o + w ELSE least(o + w, o + b + n + m) END", "x_right")}
    FROM (SELECT *, l_linestatus = 'O' AS ltr, l_linenumber = 1 AS s, l_linenumber = 7 AS e, l_extendedprice / 100 AS o, l_quantity * 4 AS w, l_quantity AS b, l_quantity * 2 AS n, l_tax * 50 AS m FROM lineitem)""",
)
def match_extent(spark, sf_dir):
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    left, right = G.match_extent(F.col("l_extendedprice") / 100, q * 4, F.when(F.col("l_linestatus") == "O", "ltr").otherwise("rtl"), q, q * 2, F.col("l_tax") * 50, line == 1, line == 7)
    return table(spark, sf_dir, "lineitem").select(*_KEYS, "l_partkey", _micro(left, "x_left"), _micro(right, "x_right"))


@query(
    "q_run_boxes",
    f"""SELECT {_ITEM}, l_partkey, {_m("least(x0, x1, x2, x3)", "x")}, {_m("least(y0, y1, y2, y3)", "y")}, {_m("greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3)", "w")}, {_m("greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)", "h")}, turned AS vertical
    FROM (SELECT *, CASE WHEN turned THEN px - u0 ELSE px + s0 END / 612 AS x0, CASE WHEN turned THEN px - u1 ELSE px + s0 END / 612 AS x1, CASE WHEN turned THEN px - u0 ELSE px + s1 END / 612 AS x2, CASE WHEN turned THEN px - u1 ELSE px + s1 END / 612 AS x3,
      (792 - CASE WHEN turned THEN py + s0 ELSE py + u0 END) / 792 AS y0, (792 - CASE WHEN turned THEN py + s0 ELSE py + u1 END) / 792 AS y1, (792 - CASE WHEN turned THEN py + s1 ELSE py + u0 END) / 792 AS y2, (792 - CASE WHEN turned THEN py + s1 ELSE py + u1 END) / 792 AS y3
      FROM (SELECT *, l_linestatus = 'F' AS turned, l_discount * 6000 AS px, l_tax * 9000 AS py, 0.0::DOUBLE AS s0, l_quantity * 3 AS s1, -0.28::DOUBLE * l_quantity AS u0, l_quantity AS u1 FROM lineitem))""",
)
def run_boxes(spark, sf_dir):
    """A matrix of pure rotation by a right angle, or none, scaled by the font size."""
    q = F.col("l_quantity")
    turned = F.col("l_linestatus") == "F"
    zero = F.lit(0.0)
    pick = lambda a, b: F.when(turned, a).otherwise(b)
    matrix = [pick(zero, q), pick(q, zero), pick(-q, zero), pick(zero, q), F.col("l_discount") * 6000, F.col("l_tax") * 9000]
    viewport = [F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 792.0)]
    box = G.run_box(matrix, viewport, F.lit(612.0), F.lit(792.0), (zero, q * 3), (-q * G.BOX_DESCENT, q))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, "l_partkey", *(_micro(c, n) for c, n in zip((box.x, box.y, box.w, box.h), "xywh", strict=True)), G.is_vertical(matrix[0], matrix[1], viewport).alias("vertical"))


@query(
    "q_drawn_boxes",
    f"""SELECT {_ITEM}, l_partkey, {_m("least(a, c)", "x")}, {_m("least(b, d)", "y")}, {_m("abs(c - a)", "w")}, {_m("abs(d - b)", "h")} FROM (
      SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_discount * 12 - 0.1::DOUBLE)) AS a, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_tax * 12)) AS b, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 50)) AS c, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 40 - 0.2::DOUBLE)) AS d FROM lineitem)
    WHERE abs(c - a) > 0.005::DOUBLE AND abs(d - b) > 0.005::DOUBLE""",
)
def drawn_boxes(spark, sf_dir):
    box = G.drawn(F.col("l_discount") * 12 - 0.1, F.col("l_tax") * 12, F.col("l_quantity") / 50, F.col("l_quantity") / 40 - 0.2)
    return table(spark, sf_dir, "lineitem").where(G.big_enough(box)).select(*_KEYS, "l_partkey", *(_micro(c, n) for c, n in zip((box.x, box.y, box.w, box.h), "xywh", strict=True)))


@query(
    "q_fit_within",
    """SELECT p_partkey, CASE WHEN free THEN w ELSE greatest(1, floor(w * (m::DOUBLE / greatest(w, h)) + 0.5)) END::BIGINT AS width, CASE WHEN free THEN h ELSE greatest(1, floor(h * (m::DOUBLE / greatest(w, h)) + 0.5)) END::BIGINT AS height
    FROM (SELECT *, m IS NULL OR m = 0 OR greatest(w, h) <= m AS free FROM (SELECT p_partkey, p_size * 97 AS w, p_partkey % 4000 + 1 AS h, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1024 ELSE 2048 END AS m FROM part))""",
)
def fit_within(spark, sf_dir):
    key = F.col("p_partkey")
    most = F.when(key % 4 == 1, 0).when(key % 4 == 2, 1024).when(key % 4 == 3, 2048)
    width, height = G.fit_within(F.col("p_size") * 97, key % 4000 + 1, most)
    return table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page")).distinct()


def _page_rects(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").where(F.length("text") % 3 == 0)
    return x.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (F.length("text") % 100).cast("bigint").alias("rect_id"))


_PAGE_RECTS = "SELECT conv_id AS doc, turn AS page, length(text) % 100 AS rect_id FROM conversations WHERE length(text) % 3 = 0"


@query("q_page_routing", f"SELECT p.doc, p.page, CASE WHEN r.doc IS NULL THEN 'copy' ELSE 'raster' END AS route FROM (SELECT DISTINCT conv_id AS doc, turn AS page FROM conversations) p LEFT JOIN (SELECT DISTINCT doc, page FROM ({_PAGE_RECTS})) r USING (doc, page)")
def page_routing(spark, sf_dir):
    return D.page_routing(_pages(spark, sf_dir), _page_rects(spark, sf_dir))


@query("q_export_guard", "SELECT l_suppkey AS doc, count(DISTINCT l_partkey) AS pages, count(DISTINCT l_partkey) > 300 AS refused FROM lineitem GROUP BY l_suppkey")
def export_guard(spark, sf_dir):
    rects = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("page"))
    return D.export_guard(rects).select("doc", "pages", F.col("error").isNotNull().alias("refused"))


@query("q_rects_by_page", f"SELECT doc, page, count(*) AS n, array_to_string(list(rect_id ORDER BY rect_id), ',') AS rects FROM ({_PAGE_RECTS}) GROUP BY doc, page")
def rects_by_page(spark, sf_dir):
    return _page_rects(spark, sf_dir).groupBy("doc", "page").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("rect_id")).cast("array<string>"), ",").alias("rects"))


@query("q_apply_all_pages", f"WITH r AS ({_PAGE_RECTS}), p AS (SELECT DISTINCT conv_id AS doc, turn AS page FROM conversations) SELECT doc, page, rect_id, count(*) AS n FROM (SELECT doc, page, rect_id FROM r UNION ALL SELECT r.doc, p.page, r.rect_id FROM r JOIN p ON r.doc = p.doc AND r.page = 1 AND p.page <> 1) GROUP BY ALL")
def apply_all_pages(spark, sf_dir):
    return D.apply_to_all_pages(_pages(spark, sf_dir), _page_rects(spark, sf_dir), 1).groupBy("doc", "page", "rect_id").agg(F.count("*").alias("n"))
