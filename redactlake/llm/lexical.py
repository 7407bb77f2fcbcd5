"""Ranked lexical search: a tree of maxima over ranges of documents for each term, searched best first.

Documents lie in shards, ranges of at most SHARD_DOCS in the order of their ids. A shard's index holds, for
each term, its documents with the part of the score that doesn't depend on weights, and the greatest of these.
Over them stands a tree for each term: ranges of FAN documents, FAN times as many, and so on up to the shard,
each with the greatest value in it. The bound of a range for a query is the sum, over the query's terms, of
weight times the term's maximum there. A search opens the range of the highest bound first, scores documents
when it reaches ranges of FAN of them, and ends when no open range has a bound as high as the k-th score found;
ranges whose bound equals it are opened, for a tie may have a smaller id.

Across shards it goes the same way in two steps: for each query the FIRST shards of highest bound are searched,
and what they find is the score that a bound must reach in all others. No number of candidates is set.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm import common

#: Fixed value: a term is the longest run of these.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_DOCS = 8192
FAN = 16
#: Shards of highest bound in which a query's first scores are found.
FIRST = 2
#: Queries that a task holds at once.
QUERY_ROWS = 256
_TERM = re.compile(TERM)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms_of(text: str) -> list[str]:
    """All terms of a text, with repeats; only A-Z are lower-cased."""
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def count_terms(docs: DataFrame, wanted: frozenset[str] | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text_key, row, n (all terms), terms and how often each occurs, of wanted terms or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value if sent else None
        for batch in common.slices(batches, 256):
            sizes, terms, times, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = Counter(words if held is None else [w for w in words if w in held])
                sizes.append(len(words))
                terms += found.keys()
                times += found.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((terms, pa.string()), (times, pa.int64()))]
            yield pa.record_batch([*(batch.column(c) for c in ("id", "text_key", "row")), pa.array(sizes, pa.int64()), *lists], ["id", "text_key", "row", "n", "terms", "times"])

    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.select(F.col(id_column).alias("id"), common.text_of(text_column).alias("text"), common.text_key(text_column).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_key bigint, row bigint, n bigint, terms array<string>, times array<bigint>")


def shards(counted: DataFrame, with_terms: int, all_terms: int) -> DataFrame:
    """The index: shard, ids, terms, tops (each term's greatest value), starts (of its postings), places, values.

    A value is (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L, for the N documents that have L terms.
    Documents without a listed term aren't in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = 0, []

        def shard(table: pa.Table) -> pa.RecordBatch:
            terms = pa.chunked_array([table.column("terms").combine_chunks().flatten()]).combine_chunks().dictionary_encode()
            of = terms.indices.to_numpy(zero_copy_only=False)
            lengths = np.diff(table.column("terms").combine_chunks().offsets.to_numpy())
            times = table.column("times").combine_chunks().flatten().to_numpy()
            m = 10 + 90 * table.column("n").to_numpy() * with_terms // all_terms
            values = 1_000_000_000 * times // (1000 * times + 8 * np.repeat(m, lengths))
            places = np.repeat(np.arange(table.num_rows), lengths)
            order = np.lexsort((places, of))
            starts = np.searchsorted(of[order], np.arange(len(terms.dictionary) + 1))
            tops = np.maximum.reduceat(values[order], starts[:-1])
            columns = [[TaskContext.get().partitionId() << 33 | number], [table.column("id").combine_chunks()], [terms.dictionary], [tops], [starts], [places[order]], [values[order]]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kinds = [pa.int64(), pa.list_(batch.schema.field("id").type), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 4]
            held.append(batch)
            while sum(b.num_rows for b in held) >= SHARD_DOCS:
                table = pa.Table.from_batches(held)
                yield shard(table.slice(0, SHARD_DOCS))
                held, number = table.slice(SHARD_DOCS).to_batches(), number + 1
        if sum(b.num_rows for b in held):
            yield shard(pa.Table.from_batches(held))

    names = ["shard", "ids", "terms", "tops", "starts", "places", "values"]
    order = ("id", "text_key", "row")
    rows = counted.where(F.size("terms") > 0).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n", "terms", "times")
    kind = counted.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"shard bigint, ids array<{kind}>, terms array<string>, tops array<int>, starts array<int>, places array<int>, values array<int>")


class Shard:
    """One shard's trees, for the terms that some query of a block has."""

    def __init__(self, terms: list[str], starts: np.ndarray, places: np.ndarray, values: np.ndarray, asked: set[str]) -> None:
        self.number = {}
        parts = []
        for at, term in enumerate(terms):
            if term in asked:
                parts.append(np.arange(starts[at], starts[at + 1]))
                self.number[term] = len(self.number)
        picked = np.concatenate(parts) if parts else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        places, values = places[picked], values[picked].astype(np.int64)
        self.levels = []  # from ranges of FAN documents up to the shard, each terms x ranges
        ranges = max(1, -(-SHARD_DOCS // FAN))
        lowest = np.zeros((len(parts), ranges), np.int32)
        if len(picked):
            key = of * ranges + places // FAN
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lowest.reshape(-1)[key[begins]] = np.maximum.reduceat(values, begins)
        self.levels.append(lowest)
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            padded = np.pad(below, ((0, 0), (0, -below.shape[1] % FAN)))
            self.levels.append(padded.reshape(len(parts), padded.shape[1] // FAN, FAN).max(axis=2, initial=0))
        order = np.lexsort((of, places // FAN))  # postings by range, for scores
        self.of, self.places, self.values = of[order], places[order], values[order]
        self.begins = np.searchsorted(self.places // FAN, np.arange(ranges + 1))

    def search(self, weights: dict[str, int], k: int, least: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents with a score of at least that, and above 0."""
        own = [(self.number[t], w) for t, w in weights.items() if t in self.number]
        if not own:
            return []
        rows, w = (np.array(x, np.int64) for x in zip(*own, strict=True))
        dense = np.zeros(len(self.number), np.int64)
        dense[rows] = w
        top = len(self.levels) - 1
        heap = [(-int(w @ self.levels[top][rows, 0]), top, 0)]
        best: list[tuple[int, int]] = []  # (-score, place), ascending, at most k
        least = max(least, 1)
        while heap and -heap[0][0] >= least:
            _, level, node = heapq.heappop(heap)
            if level:
                first = node * FAN
                below = self.levels[level - 1][rows, first : first + FAN]
                bounds = w @ below
                for child in np.flatnonzero(bounds >= least).tolist():
                    heapq.heappush(heap, (-int(bounds[child]), level - 1, first + child))
                continue
            here = slice(self.begins[node], self.begins[node + 1])
            scores = np.zeros(FAN, np.int64)
            np.add.at(scores, self.places[here] - node * FAN, dense[self.of[here]] * self.values[here])
            best += [(-int(scores[i]), node * FAN + i) for i in np.flatnonzero(scores >= least).tolist()]
            if len(best) >= k:
                best = sorted(best)[:k]
                least = max(least, -best[-1][0])
        return [(-score, place) for score, place in sorted(best)[:k]]


def _packed(queries: DataFrame, blocks: int) -> DataFrame:
    """block, queries as JSON: QUERY_ROWS or so of (row, terms with weights, score to reach, shards already searched)."""
    one = F.to_json(F.struct("row", "weights", "least", "first"))
    return queries.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("queries"))


def _met(index: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Each shard beside each block of queries."""
    packed = common.save(_packed(queries, blocks).withColumnRenamed("block", "q_block"), "queries")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(common.maybe_broadcast(packed), F.col("block") == F.col("q_block")).drop("block", "q_block")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1):
        tops = dict(zip(batch.column("terms")[0].as_py(), batch.column("tops")[0].as_py(), strict=True))
        rows = [(q["row"], sum(w * tops.get(t, 0) for t, w in q["weights"].items())) for q in json.loads(batch.column("queries")[0].as_py())]
        rows = [(row, bound) for row, bound in rows if bound]
        row, bound = zip(*rows, strict=True) if rows else ((), ())
        yield pa.record_batch([pa.array(row, pa.int64()), pa.array([batch.column("shard")[0].as_py()] * len(rows), pa.int64()), pa.array(bound, pa.int64())], ["row", "shard", "bound"])


def _searched(first: bool, k: int):
    """Searches each shard for the queries that name it as one of their first, or for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            number = batch.column("shard")[0].as_py()
            queries = [q for q in json.loads(batch.column("queries")[0].as_py()) if (number in (q.get("first") or ())) == first]
            asked = {t for q in queries for t in q["weights"]}
            starts, places, values = (batch.column(c).flatten().to_numpy() for c in ("starts", "places", "values"))
            shard = Shard(batch.column("terms")[0].as_py(), starts, places, values, asked)
            found = [(q["row"], score, place) for q in queries for score, place in shard.search(q["weights"], k, q.get("least") or 0)]
            row, score, place = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
            yield pa.record_batch([pa.array(row), pa.array(np.full(len(row), number)), pa.array(place), batch.column("ids").flatten().take(pa.array(place)), pa.array(score)], ["row", "shard", "place", "id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", query_column: str = "text") -> DataFrame:
    """item, rank (from 1), id, score: each item's k documents of highest score above 0, equal scores by ascending id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score is the sum over the item's
    terms, once each, of weight times the value given under shards(). Null texts have no terms; an item without
    terms or without a document has no row. Null ids of documents come first among equal scores; repeated ids
    are documents of their own, by the hash of their text. Each row of items is an item, so repeated or null
    item ids are ranked each for itself. Empty tables give no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    asked = common.save(count_terms(items, None, item_column, query_column).where(F.size("terms") > 0), "items")
    vocabulary = common.save(asked.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    small = common.is_small(vocabulary)
    wanted = frozenset(vocabulary.toArrow().column("term").to_pylist()) if small else None  # measured: else all terms are counted
    counted = common.save(count_terms(docs, wanted, id_column, text_column), "terms")
    with_terms, all_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_items = asked.count()
    kind, item_kind = (t.schema["id"].dataType.simpleString() for t in (counted, asked))
    if not all_terms or not n_items:
        return spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score bigint")
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(with_terms) + 2) / (2 * F.col("df") + 1)))
    weights = df.join(common.maybe_broadcast(vocabulary.withColumnRenamed("term", "wanted")), F.col("term") == F.col("wanted"), "left_semi").select("term", weight.alias("w")).where("w > 0")
    each = asked.select("row", F.explode("terms").alias("word")).join(weights, F.col("word") == F.col("term"))
    queries = common.save(each.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights")), "weights")  # an item's own terms
    index = common.save(shards(counted, with_terms, all_terms), "index")
    common.forget(counted)
    blocks = -(-n_items // QUERY_ROWS)
    none = F.lit(None).cast("array<bigint>").alias("first")
    bounds = _met(index.select("shard", "terms", "tops"), queries.select("row", "weights", F.lit(0).alias("least"), none), blocks).mapInArrow(_bounds, "row bigint, shard bigint, bound bigint")
    highest = Window.partitionBy("row").orderBy(F.desc("bound"), "shard")
    first = bounds.withColumn("at", F.row_number().over(highest)).where(F.col("at") <= FIRST).groupBy(F.col("row").alias("f_row")).agg(F.collect_list("shard").alias("first"))
    ready = common.save(queries.join(first, F.col("row") == F.col("f_row")).select("row", "weights", F.lit(0).alias("least"), "first"), "first")
    schema = f"row bigint, shard bigint, place bigint, id {kind}, score bigint"
    begun = ready.select(F.explode("first").alias("s")).distinct()
    begun = common.save(_met(index.join(common.maybe_broadcast(common.save(begun, "begun")), F.col("shard") == F.col("s"), "left_semi"), ready, blocks).mapInArrow(_searched(True, k), schema), "found")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "shard", "place")
    kth = begun.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select(F.col("row").alias("k_row"), F.col("score").alias("least"))
    going = ready.drop("least").join(kth, F.col("row") == F.col("k_row"), "left").select("row", "weights", F.coalesce("least", F.lit(0)).alias("least"), "first")
    rest = _met(index, going, blocks).mapInArrow(_searched(False, k), schema)
    ranked = begun.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = asked.select(F.col("row").alias("a_row"), F.col("id").alias("item"))
    return ranked.join(common.maybe_broadcast(common.save(named, "named")), F.col("row") == F.col("a_row")).select("item", "rank", "id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_ALL = f"regexp_extract_all(translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'), '{TERM}')"
SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_ALL} AS t FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_ALL}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
s AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * tf.n * total.n) // total.l))) AS s FROM tf JOIN w USING (term), total),
r AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
