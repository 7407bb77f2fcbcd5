"""Edits, requests and owners over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], generation: str, *columns: str) -> DataFrame:
    """For each key the row of the newest generation: max_by pre-aggregates, so no group is sorted."""
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(generation, *(c for c in rest if c != generation))).alias("_r")).select(*keys, "_r.*")


def superseded(requests: DataFrame) -> DataFrame:
    """requests(id, key): all but the newest of each key, with the id that replaced them last."""
    newest = requests.groupBy("key").agg(F.max("id").alias("by"))
    return requests.join(newest, "key").where("id < by")


def unsaved(marks: DataFrame) -> DataFrame:
    """(owner, unsaved): whether the last of marks(owner, seq, set) set it."""
    return marks.groupBy("owner").agg(F.max_by("set", "seq").alias("unsaved"))


def timeline(edits: DataFrame) -> DataFrame:
    """(doc, present, past, future): edits(doc, seq, op, value) folded in order.

    commit puts the present on the past and forgets the future; undo and redo move along and do nothing at
    an end. The fold is over one document's ordered edits, inside the JVM.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "op", "value"))), lambda e: F.struct(e["op"].alias("op"), e["value"].alias("value")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("past"), F.lit(None).cast("string").alias("present"), none.alias("future"))

    def state(past, present, future):
        return F.struct(past.alias("past"), present.cast("string").alias("present"), future.alias("future"))

    def step(s, e):
        past, now, future = s["past"], s["present"], s["future"]
        here = F.array(now)
        committed = state(F.concat(past, here), e["value"], none)
        undone = state(F.slice(past, F.lit(1), F.greatest(F.size(past) - 1, F.lit(0))), F.try_element_at(past, F.lit(-1)), F.concat(here, future))
        redone = state(F.concat(past, here), F.try_element_at(future, F.lit(1)), F.slice(future, F.lit(2), F.greatest(F.size(future) - 1, F.lit(0))))
        return F.when(e["op"] == "commit", committed).when((e["op"] == "undo") & (F.size(past) > 0), undone).when((e["op"] == "redo") & (F.size(future) > 0), redone).otherwise(s)

    folded = edits.groupBy("doc").agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select("doc", F.col("s.present").alias("present"), F.size("s.past").alias("past"), F.size("s.future").alias("future"))
