"""Queries beyond audits: time windows, as-of joins and groupings that reports on these tables need."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redactlake.operators import sketches as S
from redactlake.plans.registry import query, table


@query("q_ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS starts, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")


@query(
    "q_ext_sessions",
    """SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session""",
)
def sessions(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order)
    rows = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("q_ext_asof", "SELECT e.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of(spark, sf_dir):
    """The last purchase of the same user before each error: one sorted pass over both instead of a range join."""
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    rows = rows.withColumn("purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(order))
    return rows.where("event_type = 'error'").select("event_id", "purchase")


@query("q_ext_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing(spark, sf_dir):
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n"))


@query("q_ext_cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    out = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "customers")


@query("q_ext_json", "SELECT event_type, (json_extract(props, '$.k'))::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"] % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("q_ext_sketches", "SELECT event_type, count(*) AS n, true AS distinct_ok, true AS ranks_ok FROM events GROUP BY event_type")
def sketches(spark, sf_dir):
    """Sketches by hour, rolled up to types: whether distinct users are within 5 % of the exact number, and the estimated quartiles within 3 % of their ranks."""
    events = table(spark, sf_dir, "events").where("value is not null")
    hourly = S.sketched(events.withColumn("hour", F.date_trunc("hour", "ts")), ["event_type", "hour"], "user_id", "value")
    found = S.estimates(S.rolled(hourly, ["event_type"]), (0.25, 0.5, 0.75))
    joined = events.join(F.broadcast(found.select(F.col("event_type").alias("of"), "n_distinct", "quantiles")), F.col("event_type") == F.col("of"))  # one row a type
    below = [F.avg((F.col("value") <= F.col("quantiles")[i]).cast("double")) for i in range(3)]
    exact = joined.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"), F.first("n_distinct").alias("about"), F.array(*below).alias("below"))
    distinct_ok = F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")
    ranks_ok = F.forall(F.arrays_zip("below", F.array(*map(F.lit, (0.25, 0.5, 0.75))).alias("rank")), lambda x: F.abs(x["below"] - x["rank"]) <= 0.03)
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(exact, "event_type").select("event_type", "n", distinct_ok.alias("distinct_ok"), ranks_ok.alias("ranks_ok"))
