"""Queries on requests, owners and edits, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.operators import history as H
from redactlake.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("q_latest_generation", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_generation(spark, sf_dir):
    return H.latest(_events(spark, sf_dir), ["user_id", "event_type"], "event_id", "value")


@query("q_superseded", "SELECT event_id AS id, user_id AS key, max_id AS by FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS max_id FROM events) WHERE event_id < max_id")
def superseded(spark, sf_dir):
    return H.superseded(_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("key"))).select("id", "key", "by")


@query("q_unsaved_owners", "SELECT user_id AS owner, arg_max(event_type IN ('click', 'view'), event_id) AS unsaved FROM events GROUP BY user_id")
def unsaved_owners(spark, sf_dir):
    return H.unsaved(_events(spark, sf_dir).select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.col("event_type").isin("click", "view").alias("set")))


@query("q_undo_redo")
def undo_redo(spark, sf_dir):
    """A fold with stacks, which no frame or plain recursion expresses; a test holds it against a plain one."""
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("commit")
    return H.timeline(_events(spark, sf_dir).select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("value")))


@query("q_request_results", "SELECT r.event_id AS id, r.user_id AS key, o.o_totalprice AS reply FROM events r JOIN orders o ON o.o_orderkey = r.event_id WHERE r.event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = r.user_id)")
def request_results(spark, sf_dir):
    """Replies meet requests by id; only those of the newest request of a key count."""
    newest = H.latest(_events(spark, sf_dir), ["user_id"], "event_id")
    replies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("reply"))
    return newest.join(replies, "event_id").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "reply")
