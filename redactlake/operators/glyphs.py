"""Where a match lies within a run of text: measured advances, scaled to the run's own width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions import geometry as G

RUN = ("doc", "page", "seq")


def measured(runs: DataFrame, advances: DataFrame, missing: float) -> DataFrame:
    """(doc, page, seq, sums) of runs(doc, page, seq, str): sums[i] is the length of the first i characters.

    advances(ch, advance) is a font's table, one row a character; characters that it lacks count as missing.
    """
    each = runs.select(*RUN, F.posexplode(F.split("str", "")).alias("at", "ch"))
    table = advances.select(F.col("ch").alias("_ch"), F.col("advance").cast("double").alias("_advance"))
    met = each.join(table, F.col("ch") == F.col("_ch"), "left")
    listed = F.array_sort(F.collect_list(F.struct("at", F.coalesce("_advance", F.lit(missing)).alias("w"))))  # of one run
    start = F.array(F.lit(0.0))
    sums = F.aggregate(listed, start, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["w"])))
    return met.groupBy(*RUN).agg(sums.alias("sums"))


def extents(spans: DataFrame, runs: DataFrame, advances: DataFrame, page_width: Column, missing: float = 500.0) -> DataFrame:
    """(doc, page, seq, match_start, from_char, to_char, left, right): what to cover of each run that a match touches.

    spans as operators/verify.match_spans() gives them, runs(doc, page, seq, str, origin, width, height, dir). Only runs with a
    span are measured, once each. Measured lengths are scaled to the run's width, so another font of the same
    proportions gives the same places; a margin on both sides makes up for the rest. A run without a length,
    or that isn't plainly left to right, is covered whole, as is an end of the run that the match reaches.
    """
    touched = runs.join(spans.select(*RUN).distinct(), list(RUN), "left_semi")
    sums = measured(touched.select(*RUN, "str"), advances, missing)
    rows = spans.join(touched.select(*RUN, "str", "origin", "width", "height", "dir"), list(RUN)).join(sums, list(RUN))
    total = F.element_at("sums", -1)
    place = lambda i: F.get("sums", F.col(i)) * F.col("width") / total
    margin = G.safety_margin(page_width, F.col("height"))
    direction = F.when(total > 0, F.col("dir"))
    at_start, at_end = F.col("from_char") == 0, F.col("to_char") == F.length("str")
    left, right = G.match_extent(F.col("origin"), F.col("width"), direction, place("from_char"), place("to_char") - place("from_char"), margin, at_start, at_end)
    return rows.select(*RUN, "match_start", "from_char", "to_char", left.alias("left"), right.alias("right"))
