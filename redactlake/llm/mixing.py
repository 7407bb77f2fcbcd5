"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled within their source. Each one's virtual finish time is its source's tokens so far,
itself included, divided by the source's target; a second pass over a source goes on where the first
ended. The queue is all documents by finish time, cut where the token budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm import common

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all tokens that the mix takes.
BUDGET = 1.5
#: How often the mix takes a document at most.
EPOCHS = 2
#: Rows that one task orders at about the most; a source, or a stretch of the queue, is cut into such parts by a hash or by time.
PART_ROWS = 4_000


def n_words(text: Column) -> Column:
    """Each word, with the blanks after it, becomes one character; blanks before the first word go."""
    marked = F.regexp_replace(text, f"{common.WORD}{common.BLANK}*", "x")
    return F.char_length(F.ltrim(marked, F.lit(common.BLANKS))).cast("long")


def targets(sources: DataFrame, budget: Column, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds target and place to sources(source, source_size): the budget shared by weight, none above epochs times its size.

    Sharing the excess again and again ends at target = min(cap, level * weight): sources reach their caps
    in order of cap / weight, so the level follows from sums in that order. The table has one row a source.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    by_cap = Window.orderBy("reach", "place")
    rows = sources.withColumn("place", F.row_number().over(by_code) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("reach", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    rows = rows.withColumn("level", (budget - F.col("full")) / F.col("open"))
    # the first source, in that order, that doesn't reach its cap sets the level for itself and all after it
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(Window.partitionBy())
    rows = rows.withColumn("stop", level)
    free = F.col("stop").isNotNull() & (F.struct("reach", "place") >= F.struct("stop.reach", "stop.place"))
    return rows.select("source", "source_size", "place", F.when(free, F.col("stop.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """One row for each row of docs: id, text_key, size, source_size, target, taken, copies.

    size counts words (null text: 0). Null is a source of its own, after all others. A document of size 0
    is taken with the ones before it in its queue and adds nothing. The order is by MD5 of seed and id,
    then size, so reruns agree; rows equal in both are interchangeable. An empty table gives no rows.

    Running sums are made in parts: hash ranges within a source, then stretches of virtual time, each of
    some thousands of rows, with sums of the parts before; so no source, however large, is one task.
    """
    spark = docs.sparkSession
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_column).alias("id"), common.text_key(text_column).alias("text_key"), F.col(source_column).cast("string").alias("source"), n_words(common.text_of(text_column)).alias("size"), order.alias("turn"))
    rows = common.save(rows, "sizes")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits = max(6, min(20, (max(n, 1) // PART_ROWS).bit_length() + 2))
    part = F.shiftright(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = rows.withColumn("part", part)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    limit = F.lit(budget * total)
    sources = common.save(targets(sources, limit, weights, epochs), "targets")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(so_far), F.lit(0))).drop("part_size")
    parts = parts.join(sources, parts["source"].eqNullSafe(sources["source"])).select(parts["source"].alias("p_source"), F.col("part").alias("p_part"), "before", "source_size", "target", "place")
    parts = common.maybe_broadcast(common.save(parts, "parts"))
    within = Window.partitionBy("place", "part").orderBy("turn", "size", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = rows.join(parts, rows["source"].eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    queued = queued.withColumn("reached", F.col("before") + F.sum("size").over(within))
    queued = common.save(queued.select("id", "text_key", "size", "source_size", "target", "place", "turn", "reached"), "queue")
    # the queue has each document once an epoch; times run from 0 to about 1 if all targets are met
    stretches = 1 << max(4, min(20, (max(n * epochs, 1) // PART_ROWS).bit_length() + 2))
    turns = queued.where("size > 0").select("size", "place", "turn", "id", "reached", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "source_size")
    time = F.try_divide(F.col("reached") + F.col("epoch") * F.col("source_size"), F.col("target"))
    turns = turns.where("target > 0").withColumn("time", time).withColumn("stretch", F.floor(F.least(F.col("time"), F.lit(1e6)) * F.lit(stretches)).cast("long"))
    sums = turns.groupBy("stretch").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    sums = common.save(sums.withColumn("upto", F.sum("tokens").over(Window.orderBy("stretch"))), "stretches")
    # the stretch in which the budget runs out, and what the ones before it use
    cut = sums.where(F.col("upto") > limit).agg(F.min(F.struct("stretch", F.expr("upto - tokens").alias("used"), "n")).alias("c")).first()["c"]
    queue = F.struct("time", "place", "turn", "size", "id")
    if cut is None:
        last = None
    else:
        # many documents may end at one time: the stretch is sorted by ranges, and one of those is cut
        order = ("time", "place", "turn", "size", "id")
        ranges = -(-cut["n"] // PART_ROWS)
        edge = common.save(turns.where(F.col("stretch") == cut["stretch"]).select(*order).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "edge")
        ends = edge.groupBy("range").agg(F.sum("size").alias("tokens")).withColumn("upto", F.lit(cut["used"]) + F.sum("tokens").over(Window.orderBy("range")))
        at = ends.where(F.col("upto") > limit).agg(F.min(F.struct("range", F.expr("upto - tokens").alias("used"))).alias("c")).first()["c"]
        edge = edge.where(F.col("range") == at["range"]).withColumn("upto", F.lit(at["used"]) + F.sum("size").over(Window.orderBy(*order)))
        last = edge.where(F.col("upto") > limit).agg(F.min(queue).alias("q")).first()["q"]
    copies = F.lit(0)
    for epoch in range(epochs):
        at = F.try_divide(F.col("reached") + F.lit(epoch) * F.col("source_size"), F.col("target"))
        if last is None:
            fits = F.col("target") > 0
        else:
            end = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["place"]).alias("place"), F.lit(last["turn"]).alias("turn"), F.lit(last["size"]).alias("size"), F.lit(last["id"]).cast(queued.schema["id"].dataType).alias("id"))
            fits = (F.col("target") > 0) & (F.struct(at.alias("time"), "place", "turn", "size", "id") < end)
        copies = copies + F.when(fits, 1).otherwise(0)
    return queued.withColumn("copies", copies.cast("long")).select("id", "text_key", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of rows equal in id and text one stands for all. Columns may have any names."""
    plan = mix(docs).groupBy(F.col("id").alias("plan_id"), F.col("text_key").alias("plan_key")).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n"))
    plan = common.save(plan.where("copies > 0"), "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), common.text_key().alias("row_key"))
    joined = rows.join(common.maybe_broadcast(plan), F.col("row_id").eqNullSafe(F.col("plan_id")) & F.col("row_key").eqNullSafe(F.col("plan_key")))
    taken = joined.where("n = 1").select("row", "copies")
    if not plan.where("n > 1").isEmpty():
        taken = taken.unionByName(joined.where("n > 1").groupBy("row_id", "row_key").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(cast(doc_id AS VARCHAR), 'null')) AS turn
  FROM documents
), total AS (SELECT 1.5::DOUBLE * sum(size) AS budget FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2 AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), o AS (
  SELECT *, cap / weight AS reach,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM w
), l AS (SELECT o.*, (budget - used) / free AS level FROM o, total
), stop AS (SELECT reach, place, level FROM l WHERE level <= reach ORDER BY reach, place LIMIT 1
), t AS (
  SELECT l.source, l.source_size, l.place,
         CASE WHEN (l.reach, l.place) >= (stop.reach, stop.place) THEN stop.level * l.weight ELSE l.cap END AS target
  FROM l LEFT JOIN stop ON true
), q AS (
  SELECT d.doc_id, d.size, d.turn, t.source_size, t.place, t.target, e.epoch,
         (sum(d.size) OVER (PARTITION BY t.place, e.epoch ORDER BY d.turn, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) + e.epoch * t.source_size) / t.target AS time
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(epoch)
), r AS (
  SELECT q.*, sum(size) OVER (ORDER BY time, place, turn, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q
)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(CASE WHEN upto <= (SELECT budget FROM total) THEN size ELSE 0 END)::BIGINT AS taken
FROM r GROUP BY doc_id
"""
