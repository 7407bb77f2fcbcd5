"""Token ids as files of blocks: frequency-ranked ids in a byte-aligned code with control bytes of their own.

Ids are replaced by their rank among all ids by frequency, so that the most frequent 256 take one byte. Four
ids share a control byte, two bits each, which say how many bytes (one to four) each rank takes; the ranks'
bytes stand by themselves, lowest first. A decoder looks a control byte up in tables that hold, for each of its
256 values, where its four ranks begin and how long they are, so that a block is decoded without a loop.

A folder of token files holds three tables: blocks (whole documents, in ascending order of their ids, at most
BLOCK_TOKENS ids a block unless a document alone has more), ranks (rank, id and number of occurrences, at most
the vocabulary) and parts (ids before each part of the blocks, one row for a task that wrote). Spark writes
them, so a lost executor costs its running tasks, and half-written files are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common
from redactlake.llm.packing import END_ID, encoder, tokenizer_path

BLOCK_TOKENS = 1 << 18

_SIZES = np.stack([np.arange(256) >> 2 * k & 3 for k in range(4)], axis=1) + 1  # bytes of the four ranks
_OFFSETS = np.cumsum(_SIZES, axis=1) - _SIZES
_TOTALS = _SIZES.sum(axis=1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of numbers under 2^32; the last control byte counts missing ones as of one byte without any data."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of encode()."""
    groups = np.frombuffer(control, np.uint8)
    starts = np.cumsum(_TOTALS[groups]) - _TOTALS[groups]
    at = (starts[:, None] + _OFFSETS[groups]).reshape(-1)[:n]
    held = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    word = held[at] | held[at + 1] << 8 | held[at + 2] << 16 | held[at + 3] << 24
    return word & _MASKS[_SIZES[groups].reshape(-1)[:n]]


def tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text_key, row, n, ids: all ids of each document, the end id last, as little-endian numbers of 16 or 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in common.slices(batches, 128):
            found = [np.array([*encode(text), END_ID], kind) for text in batch.column("text").to_pylist()]
            made = [pa.array([len(ids) for ids in found], pa.int64()), pa.array([ids.tobytes() for ids in found], pa.binary())]
            yield pa.record_batch([*(batch.column(c) for c in ("id", "text_key", "row")), *made], ["id", "text_key", "row", "n", "ids"])

    kind = id_type(vocabulary_of(tokenizer))
    rows = docs.select(F.col(id_column).alias("id"), common.text_of(text_column).alias("text"), common.text_key(text_column).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_key bigint, row bigint, n bigint, ids binary")


def vocabulary_of(tokenizer: str) -> int:
    return encoder(tokenizer).fast.n_vocab


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def frequencies(saved: DataFrame, vocabulary: int) -> DataFrame:
    """id, n of the ids that occur in tokens(): each task adds up its own first."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in common.slices(batches, 1024):
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    return saved.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes token files of docs to a folder that doesn't exist yet.

    Null text is empty: the end id alone. Documents stand in ascending order of their ids, null ids first,
    repeated ids by the hash of their text, equal rows one after the other; each row is a document. Texts of
    any length are encoded whole. An empty table makes files without a block. Extra columns are not read.
    """
    path = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    vocabulary = vocabulary_of(path)
    kind = id_type(vocabulary)
    saved = common.save(tokens(docs, path, id_column, text_column), "ids", compression="zstd")
    counted = frequencies(saved, vocabulary).toArrow()  # at most a row for each id of the vocabulary
    by_rank = np.lexsort((counted.column("id").to_numpy(), -counted.column("n").to_numpy()))
    ranks = counted.take(pa.array(by_rank)).append_column("rank", pa.array(np.arange(len(by_rank))))
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[ranks.column("id").to_numpy()] = np.arange(len(by_rank))
    sent = spark.sparkContext.broadcast(rank_of)
    id_kind = saved.schema["id"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, held = [], [], []

        def block() -> pa.RecordBatch:
            nonlocal number, before, ids, sizes, held
            control, data = encode(np.concatenate(held))
            values = ([part], [number], [before], [ids], [sizes], [control], [data])
            out = pa.record_batch([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)
            number, before, ids, sizes, held = number + 1, before + sum(sizes), [], [], []
            return out

        for batch in common.slices(batches, 1024):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(batch.schema.field("id").type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            for doc, coded in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                new = sent.value[np.frombuffer(coded.as_buffer(), kind)]
                if held and sum(sizes) + len(new) > BLOCK_TOKENS:
                    yield block()
                ids.append(doc)
                sizes.append(len(new))
                held.append(new)
        if held:
            yield block()

    names = ["part", "block", "before", "ids", "sizes", "control", "data"]
    ordered = saved.repartitionByRange("id", "text_key", "row").sortWithinPartitions("id", "text_key", "row").select("id", "ids")
    schema = f"part int, block bigint, before bigint, ids array<{id_kind.simpleString()}>, sizes array<bigint>, control binary, data binary"
    ordered.mapInArrow(blocks, schema).write.parquet(f"{folder}/blocks")
    spark.createDataFrame(ranks).write.parquet(f"{folder}/ranks")
    common.forget(saved)
    written = spark.read.parquet(f"{folder}/blocks").select("part", (F.col("before") + F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("n"))
    totals = written.groupBy("part").agg(F.max("n").alias("n")).orderBy("part").toArrow()  # a row for each task that wrote
    n = totals.column("n").to_numpy()
    starts = pa.table({"part": totals.column("part"), "start": pa.array(np.cumsum(n) - n, pa.int64())})
    spark.createDataFrame(starts).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """id, start, n_tokens, ids of each document of token files, or the unsigned crc32 of its ids (32 bits each) in their place."""
    by_rank = spark.read.parquet(f"{folder}/ranks").select("rank", "id").toArrow()  # at most the vocabulary
    id_of = np.zeros(by_rank.num_rows, np.uint32)
    id_of[by_rank.column("rank").to_numpy()] = by_rank.column("id").to_numpy()
    sent = spark.sparkContext.broadcast(id_of)
    parts = spark.read.parquet(f"{folder}/parts").select(F.col("part").alias("_part"), F.col("start").alias("_start"))
    found = spark.read.parquet(f"{folder}/blocks").join(common.maybe_broadcast(parts), F.col("part") == F.col("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            sizes = batch.column("sizes").flatten().to_numpy()
            ids = sent.value[decode(batch.column("control")[0].as_py(), batch.column("data")[0].as_py(), int(sizes.sum()))]
            ends = np.cumsum(sizes)
            if digest:
                raw = ids.astype("<u4").tobytes()
                last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)], pa.int64())
            else:
                last = pa.LargeListArray.from_arrays(np.append(0, ends), ids.astype(np.int64)).cast(pa.list_(pa.int64()))
            starts = ends - sizes + batch.column("start")[0].as_py()
            yield pa.record_batch([batch.column("ids").flatten(), pa.array(starts), pa.array(sizes), last], ["id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    kind = found.schema["ids"].dataType.elementType.simpleString()
    found = found.select("ids", "sizes", "control", "data", (F.col("_start") + F.col("before")).alias("start"))
    return found.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, {name} {'bigint' if digest else 'array<bigint>'}")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "token-files")
    write_tokens(common.read(spark, sf_dir, "documents"), folder)
    return read_tokens(spark, folder, digest=True).withColumnRenamed("id", "doc_id")
