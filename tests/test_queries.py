"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from redactlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    plain = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if v is None or v is pd.NA or v is pd.NaT or v != v else v for v in r) for r in plain.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    want = duck.execute(f"SELECT * FROM ({catalog.ORACLES[name]})").df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_undo_redo_equals_a_plain_fold(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("event_id").collect()
    docs = {}
    for e in events:
        past, now, future = docs.get(e.user_id, ([], None, []))
        if e.event_type == "error":
            if past:
                past, now, future = past[:-1], past[-1], [now, *future]
        elif e.event_type == "view":
            if future:
                past, now, future = [*past, now], future[0], future[1:]
        else:
            past, now, future = [*past, now], str(e.event_id), []
        docs[e.user_id] = (past, now, future)
    got = {r.doc: (r.present, r.past, r.future) for r in catalog.QUERIES["q_undo_redo"](spark, data).collect()}
    assert got == {k: (n, len(p), len(f)) for k, (p, n, f) in docs.items()}


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_keyboard_boxes_equal_a_plain_fold(spark, data):
    presses = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey").collect():
        presses.setdefault(r.l_suppkey, []).append((("left", "right", "up", "down")[r.l_partkey % 4], r.l_quantity > 25))
    want = {}
    for doc, keys in presses.items():
        place, side = {"x": 0.4, "y": 0.45}, {"x": 0.2, "y": 0.1}
        for key, shift in keys:
            axis = "x" if key in ("left", "right") else "y"
            back = key in ("left", "up")
            if shift:
                side[axis] = max(0.01, side[axis] - 0.02) if back else min(1 - place[axis], side[axis] + 0.02)
            else:
                place[axis] = max(0, place[axis] - 0.02) if back else min(1 - side[axis], place[axis] + 0.02)
        want[doc] = (place["x"], place["y"], side["x"], side["y"])
    got = {r.doc: (r.x, r.y, r.w, r.h) for r in catalog.QUERIES["q_keyboard_boxes"](spark, data).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
