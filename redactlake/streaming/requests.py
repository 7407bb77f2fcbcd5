"""Requests that wait for their replies: an answer in time, or the whole queue of their key fails."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled(events: DataFrame, patience: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, id, status) of events(key, id, kind, ts), kind being ask, reply or crash: each request answered or failed, once.

    A worker that doesn't answer one request within patience, by event time, is lost, and with it all that its
    key still waits for; so is one that crashes. A reply to an unknown or failed request is ignored. State holds
    a key's open requests and is gone with the last of them.
    """
    seconds = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ids, asked = (list(x) for x in state.get) if state.exists else ([], [])
        rows = []

        def fail_all() -> None:
            rows.extend((key[0], i, "failed") for i in open_ids)
            open_ids.clear()
            asked.clear()

        if state.hasTimedOut:
            fail_all()
        events = sorted((t.value // 1_000_000, k != "ask", int(i), k) for f in frames for i, k, t in zip(f["id"].fillna(-1), f["kind"], f["ts"], strict=True))
        for at, _, number, kind in events:
            if asked and at > min(asked) + seconds:
                fail_all()
            if kind == "ask":
                open_ids.append(number)
                asked.append(at)
            elif kind == "crash":
                fail_all()
            elif number in open_ids:
                place = open_ids.index(number)
                del open_ids[place], asked[place]
                rows.append((key[0], number, "answered"))
        if open_ids:
            state.update((open_ids, asked))
            due = min(asked) + seconds
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "id", "status"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(step, "key bigint, id bigint, status string", "ids array<bigint>, asked array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
