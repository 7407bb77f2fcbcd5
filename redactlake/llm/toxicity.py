"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order. Each one's logistic model sees which words a text has and the
log odds that the chain gave for the categories before it. In training these come from models that had not
seen the text: out-of-fold predictions over folds by id. A category's folds are fitted at the same time, each
in a task of its own over the broadcast sample, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common

#: Rows of each class of the last category that the chain is fitted on, at about the most, drawn by a hash of the id.
SAMPLE_ROWS = 4000
#: Words of that sample that are features: the most frequent of those in enough of its texts.
MAX_FEATURES, LEAST_TEXTS = 50_000, 5
FOLDS = 5
PENALTY = 10.0
#: Letters of a stem.
STEM = 4
STEPS = 300


def words_of(text: str) -> set[str]:
    """Distinct words, lower-cased, without the punctuation around them; and the stems of longer ones, marked."""
    words = {w.strip(".,;:!?\"'()[]{}<>*|-_") for w in text.lower().split()} - {""}
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class Sparse:
    """Rows of present features."""

    starts: np.ndarray
    features: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sparse:
        return Sparse(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))

    def take(self, at: np.ndarray) -> Sparse:
        return Sparse.of([self.features[self.starts[i] : self.starts[i + 1]] for i in at])

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(weights[self.features])]
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.features, np.repeat(values, np.diff(self.starts)), size)


@dataclass
class Linear:
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def log_odds(self, rows: Sparse, before: np.ndarray) -> np.ndarray:
        return rows.times(self.weights) + before @ self.chained + self.bias


def fit_linear(rows: Sparse, before: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Logistic regression with a squared penalty and balanced classes, by accelerated gradient steps.

    Words are scaled by their smoothed log ratio of document frequencies in the two classes, so the penalty
    falls on words that tell little.
    """
    n = len(y)
    positive = max(1, int(y.sum()))
    negative = max(1, n - positive)
    each = np.where(y == 1, n / (2 * positive), n / (2 * negative))
    with_word = rows.back(y, size)
    without = rows.back(1 - y, size)
    ratio = np.log((with_word + 1) / (positive + 2)) - np.log((without + 1) / (negative + 2))

    def slope_of(point: np.ndarray, target: np.ndarray | None) -> np.ndarray:
        """The loss's gradient; without target, its curvature's bound along the point."""
        z = rows.times(point[:size] * ratio) + before @ point[size:-1] + point[-1]
        error = (z / 4 if target is None else 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * each / n
        out = np.r_[rows.back(error, size) * ratio, before.T @ error, error.sum()]
        out[:-1] += PENALTY * point[:-1] / n
        return out

    v = np.ones(size + before.shape[1] + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        v = slope_of(v / np.linalg.norm(v), None)
    step = 0.9 / max(np.linalg.norm(v), 1e-9)
    model = np.zeros(len(v))
    ahead, last = model.copy(), model.copy()
    for t in range(STEPS):
        model = ahead - step * slope_of(ahead, y)
        ahead = model + t / (t + 3) * (model - last)
        last = model
    return Linear(model[:size] * ratio, model[size:-1], float(model[-1]))


def clipped(log_odds: np.ndarray) -> np.ndarray:
    return np.clip(log_odds, -6, 6)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]
    limits: list[float]  # log odds from which a category is predicted

    def predict(self, texts: list[str]) -> np.ndarray:
        """(texts, categories) log odds."""
        known = self.vocabulary
        rows = Sparse.of([np.fromiter((known[w] for w in words_of(t) if w in known), np.int64) for t in texts])
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.c_[out, model.log_odds(rows, clipped(out))]
        return out


def best_limit(log_odds: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap after which the F1 of out-of-fold predictions is best."""
    order = np.argsort(-log_odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    at = int(f1.argmax())
    after = log_odds[order[min(at + 1, len(y) - 1)]]
    return float((log_odds[order[at]] + after) / 2)


def fit_chain(spark: SparkSession, x: Sparse, fold: np.ndarray, targets: list[np.ndarray], size: int) -> tuple[list[Linear], list[float]]:
    """The models of the categories, in order, and the log odds from which each is predicted.

    For each category a task fits a fold's model and applies it to that fold, and one more fits the model of all rows.
    """
    sample = spark.sparkContext.broadcast((x, fold))
    before = np.zeros((len(fold), 0))
    models, limits = [], []
    for y in targets:
        step = spark.sparkContext.broadcast((before, y))

        def fit(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            (rows, of), (given, wanted) = sample.value, step.value
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    rest, own = np.flatnonzero(of != k), np.flatnonzero(of == k)
                    model = fit_linear(rows.take(rest), given[rest], wanted[rest], size)
                    made = model.log_odds(rows.take(own), given[own]) if k < FOLDS else np.r_[model.weights, model.chained, model.bias]
                    yield pa.record_batch([pa.array([k]), pa.array([made.tobytes()], pa.binary())], ["id", "made"])

        # number FOLDS is no row's fold: its model is that of all rows
        made = {r.id: np.frombuffer(r.made) for r in spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(fit, "id bigint, made binary").collect()}
        out = np.zeros(len(fold))
        for k in range(FOLDS):
            out[fold == k] = made[k]
        models.append(Linear(made[FOLDS][:size], made[FOLDS][size:-1], float(made[FOLDS][-1])))
        limits.append(best_limit(out, y))
        before = np.c_[before, clipped(out)]
    return models, limits


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE_ROWS) -> Chain | None:
    """Fits the chain in the order of categories, columns of labels that hold 0 or 1; None without rows of both classes.

    Rows with a null label or text are left out. An id with several labels counts once for each.
    """
    target = categories[-1]
    known = labels.where(F.col(id_column).isNotNull())
    for c in categories:
        known = known.where(F.col(c).isin(0, 1))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(target).cast("int")).count().collect()}  # two rows
    if len(sizes) < 2:
        return None
    span = 1 << 30
    bound = F.when(F.col(target) == 1, min(span, -(-sample * span // sizes[1]))).otherwise(min(span, -(-sample * span // sizes[0])))
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("sample")), F.lit(span)) < bound).select(F.col(id_column).alias("id"), *(F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)))
    texts = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    drawn = common.save(drawn, "drawn")
    sampled = texts.join(common.maybe_broadcast(drawn, 4 * sample), "id")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = pa.array([sorted(words_of(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([*(batch.column(c) for c in batch.schema.names if c != "text"), found], [*(c for c in batch.schema.names if c != "text"), "words"])

    ys = [f"y{i}" for i in range(len(categories))]
    rows = sampled.select(F.crc32(F.col("id").cast("string")).alias("fold"), *ys, "text").mapInArrow(distinct_words, "fold bigint, " + ", ".join(f"{y} int" for y in ys) + ", words array<string>")
    rows = common.save(rows, "sample")
    features = rows.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= LEAST_TEXTS).orderBy(F.desc("count"), "word").limit(MAX_FEATURES)
    vocabulary = {r["word"]: i for i, r in enumerate(features.select("word").collect())}
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([[sent.value[w] for w in words if w in sent.value] for words in batch.column("words").to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([*(batch.column(c) for c in ("fold", *ys)), ids], ["fold", *ys, "ids"])

    table = rows.mapInArrow(encoded, "fold bigint, " + ", ".join(f"{y} int" for y in ys) + ", ids array<int>").toArrow().sort_by([("fold", "ascending"), *((y, "ascending") for y in ys)])  # bounded by the sample and the features
    x, fold = Sparse.of([np.array(v, np.int64) for v in table.column("ids").to_pylist()]), table.column("fold").to_numpy() % FOLDS
    targets = [table.column(y).to_numpy().astype(np.float64) for y in ys]
    models, limits = fit_chain(docs.sparkSession, x, fold, targets, len(vocabulary))
    return Chain(categories, vocabulary, models, limits)


def classify(docs: DataFrame, chain: Chain | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, p_<category> and <category> (boolean) for each row of docs, categories in the order of the chain.

    A category is predicted from 0.5 on: its log odds are shifted by the limit found out of fold.

    Null and empty texts have no word: they get the bias of each model. Without a chain all probabilities
    are null and all categories false. Rows are independent of each other, so repeated rows get equal
    results and an empty table none. Each text is read to its end. Extra columns are not read.
    """
    names = chain.categories if chain else []
    rows = docs.select(F.col(id_column).alias("id"), common.text_of(text_column).alias("text"))
    if not chain:
        return rows.select("id")
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            odds = sent.value.predict(batch.column("text").to_pylist())
            columns = [batch.column("id")]
            for k, limit in enumerate(sent.value.limits):
                columns += [pa.array(1 / (1 + np.exp(-np.clip(odds[:, k] - limit, -30, 30)))), pa.array(odds[:, k] >= limit)]
            yield pa.record_batch(columns, ["id", *(x for c in names for x in (f"p_{c}", c))])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}" + "".join(f", p_{c} double, {c} boolean" for c in names))


CATEGORIES = ["quality", "toxic"]


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain finds toxic, of all documents."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    chain = train(docs, labels, CATEGORIES)
    if chain is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("p_quality"), F.lit(None).cast("double").alias("p_toxic"), F.lit(False).alias("toxic")).where("toxic")
    return classify(docs, chain).where("toxic").select(F.col("id").alias("doc_id"), "p_quality", "p_toxic", "toxic")
