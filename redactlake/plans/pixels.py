"""Queries on pixels, over pictures that Spark makes from rows of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.operators import pixels as X
from redactlake.plans.registry import query, table

_GREY = "((x * 7 + y * 13 + p_partkey * 3) % 128 * 2 + 1)"


def _rgba(width, height, grey):
    """Bytes of an opaque picture, whose pixels are grey(x, y)."""
    rows = F.sequence(F.lit(0), height - 1)
    pixel = lambda x, y: F.concat(F.repeat(F.lpad(F.hex(grey(x, y)), 2, "0"), 3), F.lit("FF"))
    line = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: pixel(x, y)), "")
    return F.unhex(F.array_join(F.transform(rows, line), ""))


def _grey(x, y):
    return (x * 7 + y * 13 + F.col("p_partkey") * 3) % 128 * 2 + 1


#: Pages whose pictures, 3 kB a page, one task makes and sorts.
_IN_A_TASK = 20_000
_BOXES = ((1, 0.25, 0.25, 0.5, 0.5), (2, 0.0, 0.0, 1.0, 1.0), (3, 0.3, 0.3, 0.01, 0.01))


@query(
    "q_coverage",
    f"""WITH px AS (SELECT p_partkey, x, y, {_GREY} AS v, CASE WHEN x BETWEEN 6 AND 17 AND y BETWEEN 4 AND 11 - p_partkey % 4 THEN 0 ELSE {_GREY} END AS o FROM part, range(24) a(x), range(16) b(y)),
    box(rect_id, b_x, b_y, b_w, b_h) AS (VALUES {', '.join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for i, x, y, w, h in _BOXES)}),
    b AS (SELECT rect_id, floor(b_x * 24) + 1 AS x0, floor(b_y * 16) + 1 AS y0, ceil((b_x + b_w) * 24) - 1 AS x1, ceil((b_y + b_h) * 16) - 1 AS y1 FROM box),
    n AS (SELECT p_partkey AS doc, rect_id, count(*) FILTER (WHERE v <= 200 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS ink, count(*) FILTER (WHERE v <= 200 AND o > 24 AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS leaked FROM px, b GROUP BY ALL)
    SELECT doc, rect_id, ink, leaked, ink > 0 AND (leaked > 64 OR leaked::DOUBLE / nullif(ink, 0) > 0.03) AS leaks FROM n""",
)
def coverage(spark, sf_dir):
    """Dark pixels of a page that show through a black box, by region; one page in four is covered whole."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.lit(24).alias("width"), F.lit(16).alias("height"))
    # the table is small, what it is made into isn't; pictures are made where they meet
    parts = parts.repartition(max(4 * spark.sparkContext.defaultParallelism, parts.count() // _IN_A_TASK), "doc")
    covered = lambda x, y: F.when(x.between(6, 17) & y.between(F.lit(4), 11 - F.col("p_partkey") % 4), 0).otherwise(_grey(x, y))
    images, outputs = (parts.withColumn("rgba", _rgba(F.lit(24), F.lit(16), g)) for g in (_grey, covered))
    boxes = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("rect_id", *"xywh"), strict=True))) for b in _BOXES))
    regions = parts.select("doc", "page", F.explode(boxes).alias("b")).select("doc", "page", "b.*")
    return X.coverage(images, outputs, regions).select("doc", "rect_id", "ink", "leaked", "leaks")


@query(
    "q_oriented",
    f"""WITH p AS (SELECT p_partkey, p_partkey % 9 AS way, 4 + p_partkey % 5 AS w, 3 + p_partkey % 4 AS h FROM part),
    px AS (SELECT p.*, x, y, {_GREY} AS v FROM p, range(8) a(x), range(6) b(y) WHERE x < w AND y < h),
    t AS (SELECT *, CASE WHEN way >= 5 THEN y ELSE x END AS tx, CASE WHEN way >= 5 THEN x ELSE y END AS ty, CASE WHEN way >= 5 THEN h ELSE w END AS tw, CASE WHEN way >= 5 THEN w ELSE h END AS th FROM px),
    f AS (SELECT *, CASE WHEN way IN (2, 3, 6, 7) THEN tw - 1 - tx ELSE tx END AS fx, CASE WHEN way IN (3, 4, 7, 8) THEN th - 1 - ty ELSE ty END AS fy FROM t)
    SELECT p_partkey AS doc, tw::INTEGER AS width, th::INTEGER AS height, md5(string_agg(printf('%02X%02X%02XFF', v, v, v), '' ORDER BY fy, fx)) AS digest FROM f GROUP BY ALL""",
)
def oriented(spark, sf_dir):
    """Pictures as their orientation wants them seen, for all eight and one that isn't defined."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key, key.alias("doc"), (key % 5 + 4).cast("int").alias("width"), (key % 4 + 3).cast("int").alias("height"), (key % 9).cast("int").alias("orientation"))
    made = X.oriented(rows.withColumn("rgba", _rgba(F.col("width"), F.col("height"), _grey)))
    return made.select("doc", "width", "height", F.md5(F.hex("rgba")).alias("digest"))


@query(
    "q_resized",
    f"""WITH px AS (SELECT p_partkey, x, y, {_GREY} AS v FROM part, range(16) a(x), range(8) b(y)),
    s AS (SELECT p_partkey, x // 2 AS x, y // 2 AS y, floor(avg(v) + 0.5)::INTEGER AS v FROM px GROUP BY ALL)
    SELECT p_partkey AS doc, 8 AS width, 4 AS height, md5(string_agg(printf('%02X%02X%02XFF', v, v, v), '' ORDER BY y, x)) AS digest FROM s GROUP BY p_partkey""",
)
def resized(spark, sf_dir):
    """Pictures scaled down to half their sides, each pixel the mean of four."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("doc"), F.lit(16).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("orientation"))
    made = X.oriented(rows.withColumn("rgba", _rgba(F.lit(16), F.lit(8), _grey)), most=8)
    return made.select("doc", "width", "height", F.md5(F.hex("rgba")).alias("digest"))
