"""Keyed state over micro-batches."""

import pytest

from redactlake.streaming import state as S


def run(spark, tmp_path, batches, schema, operator, mode):
    """Feeds one Parquet file a micro-batch and returns what the sink has got."""
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    rows = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = operator(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, i
    return rows


def test_conflation(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, 1), (1, 2), (2, 5)], [(1, 4), (1, 3)]], "key long, id long", S.conflate, "append")
    assert sorted(got[:3]) == [(1, 1, "superseded"), (1, 2, "run"), (2, 5, "run")]
    assert sorted(got[3:]) == [(1, 2, "superseded"), (1, 3, "superseded"), (1, 4, "run")]


def test_owners_and_late_rows(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, 5, True)], [(1, 4, False)], [(1, 6, False)]], "owner long, seq long, set boolean", S.unsaved_owners, "update")
    assert got == [(1, True), (1, False)]


def test_edit_log(spark, tmp_path):
    batches = [[(1, 1, "commit", "a"), (1, 2, "commit", "b"), (1, 3, "undo", None)], [(1, 4, "redo", None), (1, 5, "redo", None)]]
    got = run(spark, tmp_path, batches, "doc long, seq long, op string, value string", S.edit_log, "update")
    assert got == [(1, "a", 1, 1), (1, "b", 2, 0)]


@pytest.mark.parametrize("table", ["events"])
def test_windows_close_behind_the_watermark(spark, tmp_path, data, table):
    stream = spark.readStream.schema(spark.read.parquet(f"{data}/{table}.parquet").schema).parquet(f"{data}/{table}*.parquet")
    rows = []
    query = S.windowed_counts(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path)).foreachBatch(lambda df, _: rows.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and rows
    assert len({(r.starts, r.event_type) for r in rows}) == len(rows)


def test_a_silent_worker_fails_its_whole_queue_across_restarts(spark, tmp_path):
    from redactlake.streaming.requests import settled

    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [(1, 1, "ask", at(0)), (1, 2, "ask", at(5)), (2, 7, "ask", at(0)), (3, 1, "ask", at(1))],
        [(1, 2, "reply", at(8)), (2, 7, "reply", at(9)), (3, None, "crash", at(9)), (3, 5, "ask", at(10)), (3, 5, "reply", at(11))],
        [(9, 1, "ask", at(300))],  # time goes on: what key 1 still waits for is lost
        [(9, 1, "reply", at(301)), (1, 1, "reply", at(302)), (1, 3, "ask", at(302))],
        [(1, 3, "reply", at(303)), (8, 1, "ask", at(500))],
    ]
    got = run(spark, tmp_path, batches, "key long, id long, kind string, ts string", settled, "append")
    assert sorted(got) == [(1, 1, "failed"), (1, 2, "answered"), (1, 3, "answered"), (2, 7, "answered"), (3, 1, "failed"), (3, 5, "answered"), (9, 1, "answered")]


def test_progress_of_a_batch_and_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from redactlake.streaming import progress as P

    rows, watch = P.observed(spark.range(100), F.col("id") % 4 == 0)
    assert rows.groupBy((F.col("id") % 2).alias("k")).count().count() == 2 and watch.get == {"done": 25, "total": 100}
    told = []
    listener = P.Progress(lambda *row: told.append(row))
    spark.streams.addListener(listener)
    try:
        got = run(spark, tmp_path, [[(1, True), (2, None)], [(3, True), (4, True), (5, False)]], "page long, ok boolean", lambda s: P.watched(s, "pages", F.col("ok")), "append")
        for _ in range(50):
            if len([t for t in told if t[3]]) == 2:
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert len(got) == 5 and [t for t in told if t[3]] == [("pages", 0, 1, 2), ("pages", 1, 2, 3)]
