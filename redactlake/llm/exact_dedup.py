"""Exact deduplication against a persistent digest index that is bucketed and sorted by digest.

Built of DataFrame and SQL operations only. New rows get a SHA-256 digest of their normalised text, are
grouped by it, leave by a sort-merge anti-join what the index already has, and the rest is appended. The
index side of that join is read by bucket, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common

DIGEST_COLUMNS = "digest string, keep_id bigint, keep_chars bigint"


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]."""
    return F.regexp_replace(text, common.BLANK + "+", "")


class DigestIndex:
    """Digests seen so far, as a bucketed Parquet table at a path of the shared storage.

    Opening the same path in another session finds what was appended before. buckets is fixed when the
    index is made; take about one for each 200 MB that the index will hold.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({DIGEST_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, new: DataFrame) -> None:
        """One file a bucket: the shuffle deals rows as the buckets do."""
        rows = new.select("digest", "keep_id", "keep_chars").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.insertInto(self.table)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    text = common.text_of(text_column)
    return docs.select(F.col(id_column).alias("id"), F.char_length(text).cast("long").alias("n_chars"), F.sha2(normalised(text), 256).alias("digest"), common.text_key(text_column).alias("text_key"), F.monotonically_increasing_id().alias("row_no"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, digest, text_key, n_chars. Appends to the index.

    Null text is empty text; texts that are empty after normalisation are one group. Of a group the row
    with the most code points stays, then the smallest id, null ids last; of rows equal in all of these
    one. If an earlier batch had the text, its row stays and none of this batch. group_size counts this
    batch. Extra columns are not read, so their names can't clash. An empty table gives no rows.

    Only digests are shuffled, never texts; a digest that holds many rows is counted before the shuffle
    and its rows are joined to one row, which the adaptive skew join splits.
    """
    rows = common.save(digests(docs, id_column, text_column), "digests")
    first = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("row_no").alias("row_no"))
    groups = rows.groupBy("digest").agg(F.min(first).alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars"), F.col("best.row_no").alias("keep_row"), "group_size")
    known = index.read().select("digest", F.col("keep_id").alias("old_id"))
    fresh = groups.join(known.hint("merge"), "digest", "left_anti")
    fresh = common.save(fresh, "fresh")
    old = common.save(groups.join(known.hint("merge"), "digest").select("digest", F.col("old_id").alias("keep_id"), "keep_chars", F.lit(-1).cast("long").alias("keep_row"), "group_size"), "old")
    index.append(fresh)
    best = fresh.unionByName(old).withColumnRenamed("digest", "best_digest").drop("keep_chars")
    joined = rows.join(best.hint("merge"), F.col("digest") == F.col("best_digest"))
    return joined.select("id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "digest", "text_key", "n_chars")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index for one call; buckets follow the session's shuffle partitions, which follow the input."""
    return DigestIndex(spark, common.scratch_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(common.read(spark, sf_dir, "documents"), fresh_index(spark))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decisions = common.save(deduplicate(docs, fresh_index(spark)).select("id", "text_key", "kept"), "decisions")
    return common.keep_rows(docs, decisions)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""
