"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's 64 bits are cut into three segments. Of two fingerprints that differ in at most four bits
one segment differs in at most one (4 < 2 * 3), so both have a variant in common: that segment with one
bit as a wildcard. All 64 variants of each distinct fingerprint are indexed; an equality join on them
finds candidates, and the distance is verified in the join. Whole segments, three rows a fingerprint, go
before: they find the large groups, whose members then needn't be held against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 14


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64, repeats included; no words: zero."""
    words = text.lower().split()  # bytes: both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    ends = ends[SHINGLE_WORDS - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)), ">u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        kept = [x for x in batch.schema.names if x != "text"]
        made = np.fromiter((fingerprint(x) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.record_batch([*map(batch.column, kept), pa.array(made.view(np.int64))], [*kept, "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    text = common.text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.cast("binary").alias("text"), common.text_key(text_column).alias("text_key"), F.char_length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row_no"))
    return rows.mapInArrow(_fingerprints, "id bigint, text_key bigint, n_chars bigint, row_no bigint, fp bigint")


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _variants(fp: Column) -> Column:
    """The 64 variants as bigints: which bit is the wildcard, above the segment's other bits."""
    out = []
    for first, bits in SEGMENTS:
        segment = _segment(fp, first, bits)
        out += [segment.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((first + i) << 32)) for i in range(bits)]
    return F.array(*out)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def link(prints: DataFrame) -> DataFrame:
    """(fp, component) for each distinct fp in prints(fp, id).

    First each fingerprint is held against the smallest one that shares a whole segment. Then, with the
    components of these links known, variants are indexed. A group of two members is settled where it is
    counted. In a larger group of one variant all members but those of its largest component are held
    against all others: of two members of different components one is
    among the former, so no link between components is lost, and links inside one can't change the result.
    A ball of near copies, however large, costs as many comparisons as it has members for each stranger in
    its group. Groups are aggregated before the shuffle and then joined, so the adaptive skew join splits
    them; none is held by one task. Copies of a fingerprint, however many, are a single member. Groups and
    strangers grow faster than the input, so they never go through the driver, however few they are.
    """
    nodes = common.save(prints.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes 64: a few small files are too few tasks
    whole = F.array(*(_segment(F.col("fp"), first, bits).bitwiseOR(F.lit(first << 32)) for first, bits in SEGMENTS))
    members = nodes.select("fp", "id", F.explode(whole).alias("key"))
    hubs = members.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = common.save(hubs.select(F.col("key").alias("hub_key"), F.col("hub.id").alias("hub_id"), F.col("hub.fp").alias("hub_fp")), "hubs")
    stars = members.join(common.unsent(hubs), F.col("key") == F.col("hub_key")).where((F.col("id") != F.col("hub_id")) & _near("fp", "hub_fp"))
    stars = common.save(stars.select(F.col("id").alias("a"), F.col("hub_id").alias("b")).distinct(), "stars")
    # labels of components in order of size: negative ones for those with several members, the largest first
    found = common.components(stars).select(F.col("id").alias("id2"), "component")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component")
    sizes = common.save(sizes.select(F.col("component").alias("c2"), (F.monotonically_increasing_id() - F.lit(1 << 62)).alias("label")), "sizes")
    found = found.join(common.maybe_broadcast(sizes), F.col("component") == F.col("c2")).select("id2", "component", "label")
    named = nodes.join(common.unsent(found), F.col("id") == F.col("id2"), "left").select("fp", F.coalesce("component", "id").alias("c"), F.coalesce("label", F.monotonically_increasing_id()).alias("label"))
    named = common.save(named, "named")
    keyed = named.repartition(parts, "fp").select("fp", "label", F.explode(_variants(F.col("fp"))).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("fp").alias("fp_a"), F.max("fp").alias("fp_b"), F.min("label").alias("main"), F.max("label").alias("last"), F.count("*").alias("n"))
    groups = common.save(groups.where((F.col("main") < F.col("last")) & ((F.col("n") > 2) | _near("fp_a", "fp_b"))), "groups")
    pairs = groups.where("n = 2").select(F.col("main").alias("label_a"), F.col("last").alias("label_b"))  # the aggregate holds both members
    split = common.unsent(groups.where("n > 2").select(F.col("key").alias("split_key"), "main"))
    strangers = keyed.join(split, (F.col("key") == F.col("split_key")) & (F.col("label") != F.col("main")))
    strangers = common.save(strangers.select("split_key", F.col("fp").alias("fp_a"), F.col("label").alias("label_a"), "main"), "strangers")
    # of two strangers the one with the smaller label is held against the other
    other = (F.col("label") == F.col("main")) | (F.col("label") > F.col("label_a"))
    across = keyed.join(common.unsent(strangers), (F.col("key") == F.col("split_key")) & other & _near("fp", "fp_a")).select("label_a", F.col("label").alias("label_b"))
    edges = common.save(pairs.unionAll(across).distinct(), "across")
    names = named.groupBy("label").agg(F.first("c").alias("c"))
    for side in "ab":
        name = names.select(F.col("label").alias(f"label_{side}"), F.col("c").alias(side))
        edges = edges.join(name, f"label_{side}")
    merged = common.components(edges.select("a", "b")).select(F.col("id").alias("c3"), "component")
    merged = common.maybe_broadcast(common.save(merged, "merged"))
    return named.join(merged, F.col("c") == F.col("c3"), "left").select("fp", F.coalesce("component", "c").alias("component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id, text_key, n_chars, row_no (any number of its own).

    Null and empty texts have fingerprint zero, and are linked like any other. Equal fingerprints are one
    node whatever their number. Repeated rows and ids each get their row; a null id takes the component of
    its fingerprint and never names one, unless all ids of a fingerprint are null: such a component is
    null. An empty table gives no rows. Extra columns are not read.
    """
    rows = common.save(fingerprints(docs, id_column, text_column), "fingerprints")
    linked = link(rows.where("id is not null").select("fp", "id"))
    found = rows.join(common.unsent(linked.select(F.col("fp").alias("fp2"), "component")), F.col("fp") == F.col("fp2"), "left")
    return found.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"), "text_key", "n_chars", "row_no")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that with the smallest id; rows without a component stay.

    Of several rows with that id the first of each fingerprint stays: a repeated id doesn't make texts
    alike. Texts of no shingle carry no evidence of being alike, yet they link like any other. Null ids
    leave if an id is in their component; else they name none and stay.
    """
    rows = common.save(near_duplicates(docs), "near")
    named = F.col("id").eqNullSafe(F.col("component_id"))
    firsts = rows.where(named & F.col("id").isNotNull()).groupBy("component_id", "fingerprint").agg(F.count("*").alias("n"), F.min("row_no").alias("first")).where("n > 1")
    firsts = common.save(firsts.select(F.col("component_id").alias("several"), F.col("fingerprint").alias("print"), "first"), "several")
    rows = rows.join(common.maybe_broadcast(firsts), (F.col("component_id") == F.col("several")) & (F.col("fingerprint") == F.col("print")), "left")
    kept = named & (F.col("first").isNull() | (F.col("row_no") == F.col("first")))
    return common.keep_rows(docs, common.save(rows.select("id", "text_key", kept.alias("kept")), "decisions"))
