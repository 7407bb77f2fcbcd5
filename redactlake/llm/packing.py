"""Best-fit-decreasing packing of tokenised documents into sequences of one length.

Lengths are whole numbers up to the capacity, and pieces of equal length are interchangeable, so the plan
needs only how many pieces have each length: a table of at most capacity rows. Best fit runs over it, from
the longest pieces to the shortest, with a segment tree over remaining capacities that finds the tightest
open sequence in logarithmic time; runs of equal pieces and equal sequences move together. Pieces then get
their places by their rank among the pieces of their length, on the executors. The plan is the one that
best-fit decreasing makes over all pieces at once, whatever their number.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm import common

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks, at about the most.
PART_ROWS = 500
#: Texts with more characters go to the tokenizers library, which needs no stack for them.
LONG_TEXT = 1_000_000

_encoders: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """The ids of a byte-level BPE tokenizer file, special tokens in texts included.

    The file's own library makes them for long texts; for others a faster encoder over the same file's
    vocabulary, whose order is its merge order, gives the same ids (a test holds one against the other).
    """

    #: Fixed value: the file's rule that parts a text before merging.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in printable}
        shown |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG_TEXT:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, text_key, piece, start, length, ids_crc32 of each piece, and its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in common.slices(batches, 128):
            rows, parts = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text), END_ID], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((at, k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
            made = [batch.column(name).take(pa.array(columns[0])) for name in ("id", "text_key")]
            made += [pa.array(c.astype(t)) for c, t in zip(columns[1:], (np.int32, np.int64, np.int64, np.int64), strict=True)]
            names = ["id", "text_key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                made.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(made, names)

    rows = docs.select(F.col(id_column).alias("id"), common.text_of(text_column).alias("text"), common.text_key(text_column).alias("text_key"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


class CapacityTree:
    """Segment tree over remaining capacities: which of them some open sequence has."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        node = self.leaves + capacity
        self.used[node] = value
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity in use that is at least that."""
        node = self.leaves + least
        if self.used[node]:
            return least
        while node > 1:  # up to the first subtree on the right that has one, then down its left edge
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for runs of pieces: (length, first rank, number, first sequence, offset).

    The r-th piece of a run goes to the r-th sequence from the first. Best fit puts a piece into the
    tightest open sequence; after that this one is the tightest still, so equal pieces fill it up before
    they go on to the next, and many equal sequences can be filled at once.
    """
    tree = CapacityTree(capacity)
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def reopen(room: int, first: int, number: int) -> None:
        if room and number:
            open_runs[room].append((first, number))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            each = (room or capacity) // length
            if room is None:
                room, first, number = capacity, sequences, -(-left // each)
                sequences += number
            else:
                first, number = open_runs[room].pop()
                if not open_runs[room]:
                    tree.set(room, False)
            whole = min(number, left // each)
            for slot in range(each if whole else 0):
                places.append((length, rank, whole, first, capacity - room + slot * length))
                rank += whole
            left -= whole * each
            reopen(room - each * length, first, whole)
            if whole < number and left:  # the last of them takes what is left
                for slot in range(left):
                    places.append((length, rank, 1, first + whole, capacity - room + slot * length))
                    rank += 1
                reopen(room - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            reopen(room, first + whole, number - whole)
    return places


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces(id, text_key, piece, length, ...).

    Each length's pieces are ranked in parts by a hash, after counting the parts before, so a length that
    a third of all pieces have is not one task. Repeated rows are pieces like any other.
    """
    spark = cut_pieces.sparkSession
    counted = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    # parts of each length: at most capacity rows, so small enough to broadcast
    split = spark.createDataFrame([(length, -(-n // PART_ROWS)) for length, n in counted.items()], "of_length long, parts long")
    rows = cut_pieces.join(F.broadcast(split), F.col("length") == F.col("of_length")).drop("of_length")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text_key", "piece"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select(F.col("length").alias("s_length"), F.col("part").alias("s_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    sums = common.maybe_broadcast(common.save(sums, "ranks"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "text_key", "piece")) - 1)
    ranked = ranked.join(sums, (F.col("length") == F.col("s_length")) & (F.col("part") == F.col("s_part"))).withColumn("rank", F.col("rank") + F.col("before"))
    plan = spark.createDataFrame(best_fit(counted, capacity), "p_length long, first_rank long, number long, first_sequence long, offset long")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")))  # some 11,000 to 15,000 runs, measured from 10^5 to 10^10 pieces: equal pieces move together
    return placed.select(*cut_pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs: id, text_key, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null text is empty: one piece of the end id alone. Documents over the capacity are cut into full pieces
    after a first one that may be shorter; others stay whole. Ids may be null or repeated; pieces of equal
    length change places, ties going by id, text hash and piece. An empty table gives no rows. Extra
    columns are not read.
    """
    cut_pieces = common.save(pieces(docs, tokenizer or tokenizer_path(), id_column, text_column, capacity, with_ids), "pieces")
    return pack(cut_pieces, capacity)


OUTPUT = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), *OUTPUT)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs).select(F.col("id").alias("doc_id"), *OUTPUT)
