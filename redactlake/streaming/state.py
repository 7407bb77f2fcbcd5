"""Keyed state over streams: requests that newer ones replace, owners with unsaved work, edit logs.

State is one small row a key; a micro-batch's rows of a key arrive together, in any order, and are sorted
by their sequence first. Rows older than what the state has seen are late and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def conflate(requests: DataFrame) -> DataFrame:
    """(key, id, status) of requests(key, id): the newest of a key is to run, all others are superseded."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids = sorted({int(i) for f in frames for i in f["id"]})
        newest = state.get[0] if state.exists else None
        fresh = [i for i in ids if newest is None or i > newest]
        rows = [(key[0], i, "superseded") for i in ids if i not in fresh and i != newest]
        if fresh:
            if newest is not None:
                rows.append((key[0], newest, "superseded"))
            rows += [(key[0], i, "superseded") for i in fresh[:-1]] + [(key[0], fresh[-1], "run")]
            state.update((fresh[-1],))
        yield pd.DataFrame(rows, columns=["key", "id", "status"])

    return requests.groupBy("key").applyInPandasWithState(step, "key bigint, id bigint, status string", "newest bigint", "append", NO_TIMEOUT)


def unsaved_owners(marks: DataFrame) -> DataFrame:
    """(owner, unsaved) whenever it changes, of marks(owner, seq, set)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, before = state.get if state.exists else (None, None)
        rows = sorted((int(s), bool(v)) for f in frames for s, v in zip(f["seq"], f["set"], strict=True))
        rows = [r for r in rows if seen is None or r[0] > seen]
        if rows:
            state.update(rows[-1])
            if rows[-1][1] != before:
                yield pd.DataFrame([(key[0], rows[-1][1])], columns=["owner", "unsaved"])

    return marks.groupBy("owner").applyInPandasWithState(step, "owner bigint, unsaved boolean", "seq bigint, value boolean", "update", NO_TIMEOUT)


def edit_log(edits: DataFrame) -> DataFrame:
    """(doc, present, past, future) after each micro-batch with edits(doc, seq, op, value)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, past, present, future = state.get if state.exists else (-1, [], None, [])
        past, future = list(past), list(future)
        rows = sorted((int(s), o, v) for f in frames for s, o, v in zip(f["seq"], f["op"], f["value"], strict=True))
        for seq, op, value in rows:
            if seq <= seen:
                continue
            seen = seq
            if op == "commit":
                past, present, future = [*past, present], value, []
            elif op == "undo" and past:
                past, present, future = past[:-1], past[-1], [present, *future]
            elif op == "redo" and future:
                past, present, future = [*past, present], future[0], future[1:]
        state.update((seen, past, present, future))
        yield pd.DataFrame([(key[0], present, len(past), len(future))], columns=["doc", "present", "past", "future"])

    return edits.groupBy("doc").applyInPandasWithState(step, "doc bigint, present string, past int, future int", "seen bigint, past array<string>, present string, future array<string>", "update", NO_TIMEOUT)


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """(starts, event_type, n) of closed windows; events later than the watermark are dropped by Spark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: repeated deliveries go."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
