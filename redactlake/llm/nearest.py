"""Approximate nearest neighbours by collision counting.

Vectors of a block are projected on single random lines, each with a sorted array of its own. A query's
windows lie around its own projections; a wider bucket is just a wider window (virtual rehashing), and
they expand until they are as wide as the distance within which its neighbours lie. Vectors that collide
with the query on enough lines are verified with the exact measure.

That distance comes from a bounded sample of the rows: a query's k-th nearest of those is no nearer than
its k-th nearest of all. A vector at that distance falls into a window with a known probability on each
line, so the collision threshold follows from how seldom a neighbour may be missed; no number or share of
candidates is set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm import common

#: At most 255, so that counts take a byte.
LINES = 96
#: Half the first window, in units of the largest norm, and its growth from level to level.
FIRST_WINDOW, GROWTH = 0.05, 1.1
#: Standard deviations of a neighbour's collisions that the threshold lies below their mean: of neighbours as
#: far as the sample's k-th one in 44 is missed, of nearer ones fewer.
MARGIN = 2.0
#: Rows of the sample that tells how near neighbours are.
SAMPLE_ROWS = 8192
#: A sorted array's places are told apart in so many steps, one byte each.
STEPS = 256
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
SEED = 7


def lines(dimension: int, number: int = LINES) -> np.ndarray:
    """The random directions, equal on all executors."""
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, number))


def unit(queries: np.ndarray) -> np.ndarray:
    """Scaled by their largest component first, so that no square vanishes or overflows."""
    scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def reach(queries: np.ndarray, own: np.ndarray, sample: np.ndarray, sample_rows: np.ndarray, k: int) -> np.ndarray:
    """Distance to each query's k-th nearest of the sample but itself; infinite if there are fewer.

    sample holds vectors scaled by the largest norm, queries are unit vectors. Inner products become
    distances as in search_block().
    """
    out = np.full(len(queries), np.inf)
    for at in range(0, len(queries), 256):
        products = queries[at : at + 256] @ sample.T
        products[own[at : at + 256, None] == sample_rows[None, :]] = -np.inf
        if products.shape[1] >= k:
            best = np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k]
            out[at : at + 256] = np.sqrt(np.maximum(2 - 2 * best, 0))  # infinite where the k-th is the query itself
    return out


def search_block(vectors: np.ndarray, queries: np.ndarray, distances: np.ndarray) -> list[np.ndarray]:
    """For each query the places of the vectors to verify: those that are likely to be within its distance.

    vectors are scaled by the largest norm, queries are unit vectors. Inner products become distances:
    vectors get a coordinate that makes them unit vectors, queries a zero there.
    """
    n = len(vectors)
    rest = np.sqrt(np.maximum(0, 1 - (vectors**2).sum(axis=1, keepdims=True)))
    directions = lines(vectors.shape[1] + 1)
    projected = np.ascontiguousarray((np.hstack([vectors, rest]) @ directions).T)
    order = np.argsort(projected, axis=1)
    values = np.take_along_axis(projected, order, axis=1)  # each line's sorted array
    step = (np.arange(n) * STEPS // n).astype(np.uint8)
    places = np.empty((LINES, n), np.uint8)  # each vector's place in it
    np.put_along_axis(places, order, step[None, :], axis=1)
    centres = queries @ directions[:-1]
    known = np.isfinite(distances)
    level = np.ceil(np.log(np.maximum(np.where(known, distances, 1), 1e-9) / FIRST_WINDOW) / math.log(GROWTH))
    half = FIRST_WINDOW * GROWTH ** np.maximum(level, 0)
    first, last = (np.stack([np.searchsorted(values[i], centres[:, i] + way * half, side=side) for i in range(LINES)], axis=1) for way, side in ((-1, "left"), (1, "right")))
    first = np.minimum(first, n - 1)
    last = np.clip(last - 1, first, n - 1)
    low = step[first]
    width = step[last] - low
    found: list[np.ndarray] = [np.arange(n)] * len(queries)  # without a distance, all
    shifted, inside = np.empty((LINES, n), np.uint8), np.empty((LINES, n), bool)
    for q in np.flatnonzero(known & (distances > 0)).tolist():
        chance = math.erf(half[q] / distances[q] / math.sqrt(2))
        needed = math.floor(LINES * chance - MARGIN * math.sqrt(LINES * chance * (1 - chance)))
        np.subtract(places, low[q][:, None], out=shifted)  # places before the window wrap around
        np.less_equal(shifted, width[q][:, None], out=inside)
        found[q] = np.flatnonzero(inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= needed)
    return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, width)


def _search(k: int, high: float, largest: float):
    empty = {"query_row": pa.int64(), "query_id": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(key: tuple, data: pa.Table, asked: pa.Table) -> pa.Table:
        out = {name: [] for name in empty}
        if data.num_rows and asked.num_rows:
            width = len(data.column("vector")[0])
            vectors, queries = (_matrix(t.column("vector"), width) for t in (data, asked))
            ids, rows = data.column("id").to_numpy(), data.column("row").to_numpy()
            hits = search_block(vectors / high / largest, unit(queries), asked.column("distance").to_numpy())
            for query_row, query_id, query, hit in zip(asked.column("row").to_pylist(), asked.column("id").to_pylist(), queries, hits, strict=True):
                hit = hit[rows[hit] != query_row]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = (vectors[hit] * query).sum(axis=1)
                if len(hit) > k:  # with all that tie with the last
                    top = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    hit, scores = hit[top], scores[top]
                best = np.lexsort((rows[hit], ids[hit], -scores))[:k]
                out["query_row"].append(np.full(len(best), query_row))
                out["query_id"].append(np.full(len(best), query_id))
                out["row"].append(rows[hit][best])
                out["vec_id"].append(ids[hit][best])
                out["score"].append(scores[best])
        return pa.table({name: pa.array(np.concatenate(out[name]) if out[name] else [], kind) for name, kind in empty.items()})

    return run


def usable(column: str = "embedding"):
    """Not null, no null or non-finite component, and some component that isn't zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k candidates of largest inner product that the search found.

    is_query is a condition on vectors. All usable rows are candidates but the query's own row; ties go to
    the smaller id. Vectors that are null, zero, empty or hold null or non-finite components take no part,
    nor do null ids; vectors are compared with those of their own length. A query with fewer candidates
    gets all of them. Repeated ids are rows of their own; an empty table gives no rows. Extra columns are
    not read. Norms may be of any size: the search scales them; a score that is too small or too large for
    double precision is zero or infinite.

    Queries meet all rows, block by block: a task holds BLOCK_ROWS vectors and QUERY_ROWS queries.
    """
    part = vectors.withColumn("_asks", F.coalesce(is_query, F.lit(False))).where(F.col(id_column).isNotNull() & usable(vector_column))
    part = part.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.col("_asks").alias("asks"))
    spark = vectors.sparkSession
    rows = common.save(part.withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("vector")), "vectors")
    n, asked, high = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()
    high = float(high or 1.0)
    largest = float(rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / high) * (x / high)))).first()[0] or 1.0) ** 0.5
    drawn = rows.orderBy(F.xxhash64("row", F.lit(3))).limit(SAMPLE_ROWS).select("row", "width", "vector").toArrow()  # at most SAMPLE_ROWS rows
    widths = drawn.column("width").to_numpy()
    sample = {}
    for width in np.unique(widths).tolist():
        of_width = drawn.filter(pa.array(widths == width))
        sample[width] = of_width.column("row").to_numpy(), _matrix(of_width.column("vector"), width) / high / largest
    sent = spark.sparkContext.broadcast(sample)

    def with_distance(batches):
        for batch in common.slices(batches, QUERY_ROWS):
            width, own = batch.column("width").to_numpy(), batch.column("row").to_numpy()
            distance = np.full(len(own), np.inf)
            for w in set(width.tolist()) & set(sent.value):
                at = np.flatnonzero(width == w)
                queries = _matrix(pa.chunked_array([batch.column("vector").take(pa.array(at))]), w)
                sample_rows, held = sent.value[w]
                distance[at] = reach(unit(queries), own[at], held, sample_rows, k)
            yield batch.append_column("distance", pa.array(distance))

    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    place = lambda number, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(number)).cast("int")
    numbers = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    data = rows.select("id", "row", "vector", "width", place(blocks, 1).alias("block"), numbers(query_blocks).alias("query_block"))
    queries = rows.where("asks").select("id", "row", "vector", "width").mapInArrow(with_distance, "id bigint, row bigint, vector array<double>, width int, distance double")
    queries = queries.select("*", numbers(blocks).alias("block"), place(query_blocks, 2).alias("query_block"))
    key = ["width", "block", "query_block"]
    found = data.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_search(k, high, largest), "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
