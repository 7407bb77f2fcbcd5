"""Queries that look options, styles and first entries up."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.functions import media as M
from redactlake.functions import text as T
from redactlake.operators import documents as D
from redactlake.operators import regions as R
from redactlake.plans.registry import query, table

_STYLES = (("Brand#1", 1.3, -0.2), ("Brand#2", None, -0.45), ("Brand#3", 0.9, None))


@query(
    "q_style_cover",
    """SELECT p_partkey, greatest(1.15::DOUBLE, coalesce(s.a, 0)) AS above, greatest(0.3::DOUBLE, abs(coalesce(s.d, 0))) AS below
    FROM part LEFT JOIN (VALUES ('Brand#1', 1.3::DOUBLE, -0.2::DOUBLE), ('Brand#2', NULL, -0.45::DOUBLE), ('Brand#3', 0.9::DOUBLE, NULL)) s(f, a, d) ON s.f = p_brand""",
)
def style_cover(spark, sf_dir):
    """Font metrics by name; a page's styles are few, an unknown font has the least cover."""
    styles = spark.createDataFrame(list(_STYLES), "font string, ascent double, descent double")
    above, below = G.vertical_cover(F.col("ascent"), F.col("descent"))
    joined = table(spark, sf_dir, "part").join(F.broadcast(styles), F.col("p_brand") == F.col("font"), "left")  # three rows
    return joined.select("p_partkey", above.alias("above"), below.alias("below"))


@query(
    "q_preset_sizes",
    """SELECT p.preset, CASE WHEN m.bytes IS NULL THEN 'no measurement of ' || p.preset END AS error, CASE WHEN m.bytes IS NOT NULL THEN floor((518803 - m.bytes)::DOUBLE / 518803 * 100 + 0.5)::BIGINT END AS saved
    FROM (VALUES ('smallest'), ('balanced'), ('best'), ('tiny')) p(preset) LEFT JOIN (VALUES ('smallest', 54328), ('balanced', 119654), ('best', 395422)) m(preset, bytes) USING (preset)""",
)
def preset_sizes(spark, sf_dir):
    """Every preset needs a measurement; one without is an error of its row."""
    presets = spark.createDataFrame([(p[0],) for p in M.PRESETS] + [("tiny",)], "preset string")
    measured = spark.createDataFrame([("smallest", 54328), ("balanced", 119654), ("best", 395422)], "preset string, bytes long")
    saved = F.when(F.col("bytes").isNotNull(), T.percent_saved(F.lit(518803), F.col("bytes")))
    return presets.join(measured, "preset", "left").select("preset", F.when(F.col("bytes").isNull(), F.concat(F.lit("no measurement of "), "preset")).alias("error"), saved.alias("saved"))


@query(
    "q_option_errors",
    """SELECT p_partkey, quality BETWEEN 1 AND 100 AS quality_ok, effort BETWEEN 0 AND 6 AS effort_ok, cap IS NULL OR cap IN (1024, 1600, 2048, 3200) AS cap_ok
    FROM (SELECT p_partkey, p_partkey % 120 AS quality, p_size % 9 AS effort, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1024 WHEN 2 THEN 1600 WHEN 3 THEN 3200 ELSE 1000 END AS cap FROM part)""",
)
def option_errors(spark, sf_dir):
    key = F.col("p_partkey")
    cap = F.when(key % 5 == 1, 1024).when(key % 5 == 2, 1600).when(key % 5 == 3, 3200).when(key % 5 == 4, 1000)
    ok = M.options_ok(key % 120, F.col("p_size") % 9, cap)
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(f"{n}_ok") for n, c in zip(("quality", "effort", "cap"), ok, strict=True)))


@query("q_edited_options", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE p_partkey % 3 WHEN 0 THEN 55 WHEN 1 THEN 78 ELSE 92 END)::INT AS quality FROM part")
def edited_options(spark, sf_dir):
    """What was edited goes before what the preset says."""
    key = F.col("p_partkey")
    preset = F.element_at(F.array(F.lit("smallest"), F.lit("balanced"), F.lit("best")), (key % 3 + 1).cast("int"))
    edited = F.when(F.col("p_size") % 3 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(edited, M.preset_options(preset, F.lit("jpeg"))["quality"]).alias("quality"))


@query("q_encrypted_short_circuit", "SELECT s_suppkey AS doc, CASE WHEN s_suppkey % 7 = 0 THEN 'encrypted' ELSE id END AS id, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE n END::BIGINT AS n FROM supplier, (VALUES ('xmp', 1, 1), ('links', 2, 2)) v(id, n, k) WHERE CASE WHEN s_suppkey % 7 = 0 THEN k = 1 ELSE s_suppkey % k = 0 END")
def encrypted_short_circuit(spark, sf_dir):
    """An encrypted document has one finding, whatever else it counts."""
    key = F.col("s_suppkey")
    zero = F.lit(0)
    counts = table(spark, sf_dir, "supplier").select(key.alias("doc"), F.lit(1).alias("xmp"), F.when(key % 2 == 0, 2).otherwise(0).alias("links"), *(zero.alias(c) for c in ("annots", "attachments", "javascript", "exif", "pieceinfo", "ocg")))
    return D.count_findings(counts, F.col("doc") % 7 == 0).select("doc", "id", "n")


@query("q_first_entry", "SELECT l_orderkey AS block, l_returnflag AS tag, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS value FROM lineitem GROUP BY ALL")
def first_entry(spark, sf_dir):
    """Of a tag's entries the first one counts."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("block"), F.col("l_returnflag").alias("tag")).agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("value"))


@query("q_keyboard_boxes")
def keyboard_boxes(spark, sf_dir):
    """A fold over key presses in order; a test holds it against a plain one."""
    key = F.element_at(F.array(*map(F.lit, ("left", "right", "up", "down"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"), key.alias("key"), (F.col("l_quantity") > 25).alias("shift"))
    return R.keyboard_boxes(rows)
