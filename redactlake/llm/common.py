"""What the operators share: saved intermediate tables, word rules, decisions on rows, components."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, NumericType, StringType

#: The characters that part words, as a class for Java's and DuckDB's regular expressions.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters, for translate().
BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes of a table that may be broadcast.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 16_000_000

#: Between two collections of the driver's garbage, on which the removal of shuffle files depends.
GC_SECONDS = 1.0

_collected = 0.0
_scratch: dict[str, SparkSession] = {}
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from spark.checkpoint.dir; where that is unset, a temporary one, if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
        root = _local[app]
    return f"{root.rstrip('/')}/tables-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def _collect(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files that nothing needs any more."""
    global _collected
    if time.monotonic() - _collected > GC_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs only its running tasks.

    Garbage is collected before the write too: just after one, listeners may still hold the plan that was written,
    and its shuffle files would stay through the next. In a local folder Hadoop starts a chmod for each file and
    folder it makes, which until it runs shares its parent's memory and is counted as much again; so that none of
    them is the driver's, it makes the folders itself and no file marks the end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _collect(spark)
    if path.startswith("file:/"):
        os.makedirs(f"{path.removeprefix('file:')}/_temporary/0")
    df.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression=compression)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def forget(df: DataFrame) -> None:
    """Removes a table that save() returned, when nothing reads it any more."""
    path = df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else None
    for known in [p for p in _scratch if path and p.rpartition("/")[2] == path.rpartition("/")[2]]:
        _delete(_scratch.pop(known), known)


@atexit.register
def _clean() -> None:
    """Removes what save() wrote, if the session still runs; otherwise the folder's owner does."""
    for path, spark in _scratch.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM has ended before
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % folds


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller slices, so that the Python objects made of one stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def is_small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Counted: rows, and bytes of their values. Tables with other columns than numbers, flags, strings and bytes aren't small."""
    sizes = []
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif isinstance(f.dataType, (NumericType, BooleanType)):
            sizes.append(F.lit(8))
        else:
            return False
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(sum(sizes, F.lit(0)).cast("long"))).first()
    return n <= most and (size or 0) <= most_bytes


def unsent(df: DataFrame) -> DataFrame:
    """df with the hint that it be joined by sort-merge: Spark would broadcast it by the size of its files, which says little of its rows."""
    return df.hint("merge")


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if df, a saved table, is measured and found small; else for a sort-merge join."""
    return F.broadcast(df) if is_small(df, most, most_bytes) else unsent(df)


def text_key(column: str = "text") -> Column:
    """Parts rows that share an id."""
    return F.xxhash64(F.col(column).cast("string"))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that decisions(id, text_key, kept), one for each row of docs, drops; all columns stay.

    Only ids with a dropped row are joined: broadcast if they are few, else by sort-merge. Where an id
    has both kept and dropped rows (repeated ids), the rows are told apart by text; of rows equal in both
    id and text all stay, or none, or, if decisions keep some of them, one. Null ids are equal to each
    other. A row travels as one struct, so its columns may have any names.
    """
    per_id = decisions.groupBy("id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).where("k < n")
    per_id = save(per_id.select(F.col("id").alias("dropped_id"), "k"), "dropped")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("row_id"), text_key(text_column).alias("row_key"))
    marked = rows.join(maybe_broadcast(per_id), F.col("row_id").eqNullSafe(F.col("dropped_id")), "left")
    out = marked.where("k is null").select("row.*")
    mixed = per_id.where("k > 0").select(F.col("dropped_id").alias("mixed_id"))
    if mixed.isEmpty():
        return out
    some = decisions.join(mixed, F.col("id").eqNullSafe(F.col("mixed_id")), "left_semi")
    some = save(some.groupBy("id", "text_key").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).where("k > 0").select(F.col("id").alias("some_id"), F.col("text_key").alias("some_key"), (F.col("k") == F.col("n")).alias("all")), "some")
    rows = rows.join(maybe_broadcast(some), F.col("row_id").eqNullSafe(F.col("some_id")) & F.col("row_key").eqNullSafe(F.col("some_key")))
    one = rows.where("not all").groupBy("row_id", "row_key").agg(F.first("row").alias("row"))
    return out.unionByName(rows.where("all").select("row.*")).unionByName(one.select("row.*"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The smallest id reachable from each id: (id, component), for ids in edges(a, b); by large-star and small-star rounds.

    Each round finds the least neighbour of each id by partial minima and joins the edges to it. Few edges,
    by their count, are joined by broadcast. Otherwise the minima are saved and joined by a sort-merge join
    of two plain shuffles, in which the adaptive skew join splits a hub with very many edges. The rounds
    needed grow with the logarithm of the number of ids, not with the length of a chain. Tables of past
    rounds are removed.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    totals = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = totals()
    while now[0]:
        used = [edges]
        few = 4 * now[0] <= BROADCAST_ROWS  # a round never has more edges than twice those before

        def side(df: DataFrame, few: bool = few, used: list[DataFrame] = used) -> DataFrame:
            if few:
                return F.broadcast(df)
            used.append(save(df, name))
            return used[-1]

        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = side(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("u2")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        if not few:
            large = save(large, name)
            used.append(large)
        # every edge now goes from a smaller to a larger id: the small star joins each larger id's smaller neighbours
        down = side(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("b2"), "m"))
        star = F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b"))))
        small = large.join(down, F.col("b") == F.col("b2")).select(star.alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = save(small, name)
        for table in used:
            forget(table)
        seen, now = now, totals()
        if now == seen:
            break
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
