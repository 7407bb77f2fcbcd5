"""Product codes of vectors: Lloyd's iteration on integer parts, with Hamerly's two bounds for each part.

Every component x becomes the integer floor(1024 x); a vector is cut into equal consecutive parts, and each part
position has a codebook. Each round's table holds, beside a vector's codes, one upper bound of each part's
distance to its own entry and one lower bound of its distance to the second nearest. When entries move, the
bounds move with them; only where the upper bound, made exact, isn't strictly below the lower one (or half the
way from its entry to the next) are all entries scanned. Bounds are whole numbers, rounded away from each
other, so a strict comparison proves that the entry is the only nearest one, and ties, which go to the lower
index, are always scanned. Results equal those of a full scan.

A round reads the table of the round before and writes its own; sums are added up by each task for itself
before they are shuffled, and only codebooks (entries x components) reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Parts whose distances to all entries are held at once.
SCANNED = 4096
_NEVER = np.int64(1) << 61


def root_up(squares: np.ndarray) -> np.ndarray:
    """The square roots of whole numbers, rounded up."""
    out = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    out += out * out < squares
    return out - ((out - 1) * (out - 1) >= squares) * (out > 0)


def root_down(squares: np.ndarray) -> np.ndarray:
    up = root_up(squares)
    return up - (up * up > squares)


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part to each entry; by products of doubles where these hold every sum exactly."""
    most = max((int(np.abs(x).max(initial=0)) for x in (parts, entries)), default=0)
    if parts.shape[1] * (2 * most) ** 2 < 1 << 52:
        a, b = parts.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((parts - entry) ** 2).sum(axis=1) for entry in entries], axis=1)


class Moves:
    """One part position's codebook, and how far its entries went in the last update."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None) -> None:
        self.entries = entries
        between = squared(entries, entries)
        np.fill_diagonal(between, _NEVER)
        #: half the distance to the nearest other entry, rounded down
        self.half = root_down(between.min(axis=1)) // 2 if len(entries) > 1 else np.full(1, _NEVER)
        moved = np.zeros(len(entries), np.int64) if before is None else root_up(((entries - before) ** 2).sum(axis=1))
        self.moved, order = moved, np.argsort(-moved, kind="stable")
        self.others = np.full(len(entries), moved[order[0]])  # the largest move of any other entry
        self.others[order[0]] = moved[order[1]] if len(entries) > 1 else 0

    def assign(self, parts: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(code, upper, lower) by the entries as they are now, and how many parts were scanned."""
        upper = upper + self.moved[code]
        lower = np.maximum(lower - self.others[code], -_NEVER)
        code, limit = code.copy(), np.maximum(lower, self.half[code])
        at = np.flatnonzero(~(upper < limit))
        upper[at] = root_up(((parts[at] - self.entries[code[at]]) ** 2).sum(axis=1))
        at = at[~(upper[at] < limit[at])]
        for begin in range(0, len(at), SCANNED):
            few = at[begin : begin + SCANNED]
            found = squared(parts[few], self.entries)
            code[few] = found.argmin(axis=1)  # the first of equal ones
            rows = np.arange(len(few))
            upper[few] = root_up(found[rows, code[few]])
            found[rows, code[few]] = _NEVER
            second = found.min(axis=1)
            lower[few] = np.where(second < _NEVER, root_down(np.minimum(second, _NEVER - 1)), _NEVER)
        return code, upper, lower, len(at)


def _numbers(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.reshape(-1), kind))


def _assigned(table: DataFrame, codebooks: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """table's rows with codes and bounds by the codebooks (part, entry, component); in the end with the error in their place."""
    parts, _, width = codebooks.shape
    sent = table.sparkSession.sparkContext.broadcast((codebooks, before))  # entries x components
    state = table.columns[: table.columns.index("ints")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = sent.value
        moves = [Moves(now[p], None if then is None else then[p]) for p in range(parts)]
        for batch in common.slices(batches, 8192):
            n = batch.num_rows
            ints = _numbers(batch.column("ints"), parts * width).reshape(n, parts, width)
            if "codes" in batch.schema.names:
                codes, upper, lower = (_numbers(batch.column(c), parts) for c in ("codes", "upper", "lower"))
            else:
                codes, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), _NEVER), np.full((n, parts), -_NEVER)
            for p in range(parts):
                codes[:, p], upper[:, p], lower[:, p], _ = moves[p].assign(ints[:, p], codes[:, p], upper[:, p], lower[:, p])
            kept = [batch.column(c) for c in state]
            if last:
                error = sum(((ints[:, p] - now[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                yield pa.record_batch([*kept, pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(error)], [*state, "code", "error"])
            else:
                made = [_lists(codes, pa.int32()), _lists(upper, pa.int64()), _lists(lower, pa.int64())]
                yield pa.record_batch([*kept, batch.column("ints"), *made], [*state, "ints", "codes", "upper", "lower"])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in state)
    return table.mapInArrow(run, schema + (", code string, error bigint" if last else ", ints array<int>, codes array<int>, upper array<bigint>, lower array<bigint>"))


def _means(table: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after an update: floor(sum / count) of an entry's parts; entries without any stay."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in common.slices(batches, 8192):
            ints = _numbers(batch.column("ints"), parts * width).reshape(-1, parts, width)
            codes = _numbers(batch.column("codes"), parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                of, begins = np.unique(codes[order, p], return_index=True)
                counts[p, of] += np.diff(np.append(begins, len(order)))
                sums[p, of] += np.add.reduceat(ints[order, p], begins, axis=0)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), _lists(sums[p, e], pa.int64())], ["part", "entry", "n", "sums"])

    own = table.select("ints", "codes").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    totals = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).toArrow()  # parts x entries rows
    out = codebooks.copy()
    if totals.num_rows:
        p, e, n = (totals.column(c).to_numpy() for c in ("part", "entry", "n"))
        out[p, e] = _numbers(totals.column("sums").combine_chunks(), width) // n[:, None]
    return out


def finite(column: str = "embedding"):
    """Not null, and no component null or non-finite."""
    return F.col(column).isNotNull() & F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): for each kept vector id, the columns to keep, code (two hex digits for each part) and error.

    Vectors that are null or hold null or non-finite components are dropped. All others must be cut into equal
    parts, so vectors take no part whose length isn't that of the kept vector of the smallest id, or isn't a
    positive multiple of parts. The first codebooks are the parts of the vectors with the smallest ids,
    ascending, null ids last, repeated ids by their components; with fewer vectors they have fewer entries.
    Repeated rows are coded each. An empty table gives no rows and empty codebooks. Components whose squared
    distances could exceed 64 bits raise ValueError. At most 256 entries.
    """
    number = F.transform(vector_column, lambda x: F.floor(x.cast("double") * SCALE))
    rows = vectors.where(finite(vector_column) & (F.size(vector_column) > 0) & (F.size(vector_column) % parts == 0))
    high = rows.agg(F.max(F.aggregate(F.transform(vector_column, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda s, x: F.greatest(s, x)))).first()[0] or 0.0
    largest = int(high * SCALE) + 1
    if largest >= 1 << 31:
        raise ValueError(f"components up to {high} are too large for distances of 64 bits")
    rows = rows.select(F.col(id_column).alias("id"), *(F.col(c).alias(f"kept_{c}") for c in keep), number.alias("ints"), F.size(vector_column).alias("width"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select("width").limit(1).collect()
    width = first[0][0] if first else parts
    if 4 * largest**2 * width >= 1 << 60:
        raise ValueError(f"{width} components up to {high} are too large for distances of 64 bits")
    rows = rows.where(F.col("width") == width)
    table = common.save(rows.select("id", *(f"kept_{c}" for c in keep), F.col("ints").cast("array<int>").alias("ints")), "ints")
    start = table.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").toArrow()  # at most entries rows
    seeds = _numbers(start.column("ints").combine_chunks(), width).reshape(-1, parts, width // parts)
    codebooks, before = np.ascontiguousarray(seeds.swapaxes(0, 1)), None
    if start.num_rows:
        for _ in range(rounds):
            made = common.save(_assigned(table, codebooks, before, last=False), "round")
            common.forget(table)
            table, before = made, codebooks
            codebooks = _means(table, codebooks)
        out = _assigned(table, codebooks, before, last=True)
    else:
        out = table.select("*", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).drop("ints")
    return out, codebooks


def codebooks_text(codebooks: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, codebooks.reshape(-1).tolist()))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codebooks = compress(common.read(spark, sf_dir, "embeddings"), keep=("label",))
    rows = common.save(found, "codes")
    sums = common.save(rows.groupBy(F.col("kept_label").alias("of_label")).agg(F.sum("error").alias("label_error")), "labels")
    joined = rows.join(common.maybe_broadcast(sums), F.col("kept_label").eqNullSafe(F.col("of_label")))
    digest = hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Lloyd's iteration by full scans: parts with their components in rows, and one table of codebooks for each round."""
    near = "SELECT v, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.v, x.p, c.e, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN {} c ON c.p = x.p AND c.i = x.i GROUP BY ALL) GROUP BY v, p"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS v, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS a FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"x AS MATERIALIZED (SELECT v, (i - 1) // (n // {PARTS}) AS p, (i - 1) % (n // {PARTS}) AS i, x FROM (SELECT v, len(a) AS n, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM kept))",
        f"c0 AS MATERIALIZED (SELECT p, v - 1 AS e, i, x FROM x WHERE v <= {ENTRIES})",
    ]
    for r in range(ROUNDS):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(f'c{r}')})")
        steps.append(f"m{r} AS MATERIALIZED (SELECT n.p, n.e, x.i, floor(sum(x.x)::DOUBLE / count(*))::BIGINT AS x FROM n{r} n JOIN x ON x.v = n.v AND x.p = n.p GROUP BY ALL)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, e, i))")
    steps.append(f"f AS MATERIALIZED ({near.format(f'c{ROUNDS}')})")
    steps.append("o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f JOIN kept USING (v) GROUP BY v, vec_id, label)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM c{ROUNDS}) AS codebooks_sha256 FROM o"


SQL = _sql()
