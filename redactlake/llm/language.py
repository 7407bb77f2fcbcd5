"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

A word's score for a language is the sum of the log probabilities of its character n-grams under that
language, learned from a bounded sample of labelled texts. A text's labels maximise the sum of its words'
scores less a penalty for each switch of language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import common

#: First and last code point of the letters of each script (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_EDGES = np.array(sorted((a, b, i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges), np.int64)

BUCKET_BITS = 16
ORDERS = (2, 3, 4)
#: What a switch of language costs, in nats.
SWITCH = 12.0
#: The classifier is fitted on about so many labelled texts of each language at most, drawn by a hash of the id.
SAMPLE_TEXTS = 1500
#: A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.01
MAX_LANGUAGES = 2000
#: Words whose scores a task keeps, besides those of the batch at hand, and words scored at once: bounds of its memory.
CACHED_WORDS, SCORED_WORDS = 150_000, 10_000
UNKNOWN = "und"
_EXCLUDED = -1e4
_SCRIPTLESS, _OTHER = -1, len(SCRIPTS)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """The script's number for each code point, or -1 outside all ranges."""
    at = np.searchsorted(_EDGES[:, 0], codes, side="right") - 1
    inside = (at >= 0) & (codes <= _EDGES[at, 1])
    return np.where(inside, _EDGES[at, 2], _SCRIPTLESS)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words, each with a line feed before and after."""
    return np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, bucket) of each n-gram; a word's edges count as characters."""
    codes = _codes(words)
    edge = codes == 10
    word = np.cumsum(edge) - 1
    places, buckets = [], []
    hashed = codes.copy()
    inside = np.zeros(len(codes), bool)  # an edge strictly within the n-gram
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        m = len(codes) - n + 1
        inside = inside[:m] | (edge[n - 2 : n - 2 + m] if n > 2 else False)
        hashed = hashed[:m] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        ok = ~inside
        if n == 2:
            ok &= ~(edge[:-1] & edge[1:])
        mixed = hashed ^ (hashed >> np.uint32(15))
        places.append(word[:m][ok])
        buckets.append(((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS))[ok])
    return np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.uint32)]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (languages, buckets), float32
    scripts: np.ndarray  # (languages, scripts), bool
    cache: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) scores and the letters of each word; a word of no candidate's script scores zero for all."""
        places, buckets = grams(words)
        k = len(self.languages)
        out = np.stack([np.bincount(places, self.weights[i, buckets], len(words)) for i in range(k)], axis=1).astype(np.float32)
        codes = _codes(words)
        script = scripts_of(codes)
        word = np.cumsum(codes == 10) - 1
        known = script >= 0
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int32, len(words))
        held = np.zeros((len(words), len(SCRIPTS)), np.int32)
        np.add.at(held, (word[known], script[known]), 1)
        main = held.argmax(axis=1)
        allowed = self.scripts[:, main].T & (held.max(axis=1) > 0)[:, None]
        some = allowed.any(axis=1) & (letters > 0)
        out[some] = np.where(allowed[some], out[some], _EXCLUDED)
        out[~some] = 0
        return out, letters


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of a text's words; of equal paths the one that stays and has the lower label."""
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    # If no stretch of words gains over half a switch by another language, the best single one can't be bettered.
    gain = np.cumsum(scores.astype(np.float64) - scores[:, best : best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0), gain)
    if (gain - low).max(initial=0) <= switch / 2:
        return np.full(n, best, np.int32)
    came = np.zeros((n, k), np.int32)
    value = scores[0].astype(np.float64)
    own = np.arange(k)
    for t in range(1, n):
        top = int(value.argmax())
        moved = value[top] - switch > value
        came[t] = np.where(moved, top, own)
        value = np.where(moved, value[top] - switch, value) + scores[t]
    labels = np.zeros(n, np.int32)
    labels[-1] = int(value.argmax())
    for t in range(n - 1, 0, -1):
        labels[t - 1] = came[t, labels[t]]
    return labels


def label_text(scores: np.ndarray, letters: np.ndarray, switch: float = SWITCH) -> tuple[int, float, list[tuple[int, int, int]]]:
    """Main language, confidence and spans (first word, end, language).

    Confidence: the share of letters that the language labels, times the logistic of its lead in total
    score over the next language.
    """
    labels = viterbi(scores, switch)
    share = np.bincount(labels, letters, scores.shape[1])
    main = int(share.argmax())
    total = scores.sum(axis=0, dtype=np.float64)
    rest = np.delete(total, main)
    lead = float(total[main] - rest.max()) if len(rest) and share[main] == share.sum() else 30.0
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    spans = [(a, b, int(labels[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return main, float(share[main] / share.sum() / (1 + np.exp(-max(min(lead, 30.0), -30.0)))), spans


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, kind, key, n): n-gram buckets and scripts of this task's texts."""
    counts: dict[int, np.ndarray] = {}
    scripts: dict[int, np.ndarray] = {}
    for batch in common.slices(batches, 64):
        for language, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = text.lower().split()
            if words:
                c = counts.setdefault(language, np.zeros(1 << BUCKET_BITS, np.int64))
                c += np.bincount(grams(words)[1], minlength=1 << BUCKET_BITS)
                s = scripts.setdefault(language, np.zeros(len(SCRIPTS), np.int64))
                found = scripts_of(_codes(words))
                s += np.bincount(found[found >= 0], minlength=len(SCRIPTS))
    for kind, table in enumerate((counts, scripts)):
        for language, c in table.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array(np.full(len(at), language, np.int32)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["language", "kind", "key", "n"])


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE_TEXTS) -> Model:
    """Fits n-gram weights and scripts; texts and languages that are null are left out. No labelled text: a model without languages."""
    rows = labelled.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_column).cast("string")).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: is {lang_column} a language?")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BUCKET_BITS), np.float32), np.zeros((0, len(SCRIPTS)), bool))
    spark = labelled.sparkSession
    span = 1 << 30
    bounds = spark.createDataFrame([(v, i, min(span, -(-sample * span // sizes[v]))) for i, v in enumerate(languages)], "lang_value string, language int, bound long")
    drawn = rows.join(F.broadcast(bounds), F.col(lang_column).cast("string") == F.col("lang_value")).where(F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(span)) < F.col("bound"))
    counted = drawn.select("language", F.col(text_column).cast("string").alias("text")).mapInArrow(_gram_counts, "language int, kind int, key int, n bigint")
    table = counted.groupBy("language", "kind", "key").agg(F.sum("n").alias("n")).toPandas()  # bounded: languages times buckets
    counts, scripts = np.zeros((len(languages), 1 << BUCKET_BITS)), np.zeros((len(languages), len(SCRIPTS)))
    for kind, to in enumerate((counts, scripts)):
        t = table[table.kind == kind]
        to[t.language.to_numpy(), t.key.to_numpy()] = t.n.to_numpy()
    smooth = 0.5
    weights = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1])) / len(ORDERS)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, weights.astype(np.float32), share >= SCRIPT_SHARE)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", switch: float = SWITCH, carry: list[str] | None = None) -> DataFrame:
    """id, lang_pred, score, spans (first word, end, language), and the columns named in carry, for each row of docs.

    lang_pred is a learned language, or und, with score 0 and no spans, for a null text, a text without
    letters, or a model without languages. A text in scripts of no learned language scores the same for
    all; the first one is returned with a score of at most a half. Rows are independent of each other, so
    repeated rows get equal results and an empty table none. Words are white-space separated; each text is
    read to its end.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.languages, model.weights, model.scripts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        seen: dict[str, int] = {}
        scores, letters = np.zeros((0, len(m.languages)), np.float32), np.zeros(0, np.int32)
        for batch in common.slices(batches):
            texts = [(x or "").lower().split() if m.languages else [] for x in batch.column("text").to_pylist()]
            if len(seen) > CACHED_WORDS:
                seen, scores, letters = {}, scores[:0], letters[:0]
            new = list(dict.fromkeys(w for words in texts for w in words if w not in seen))
            if new:
                seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
                parts = [m.score(new[at : at + SCORED_WORDS]) for at in range(0, len(new), SCORED_WORDS)]
                scores, letters = np.concatenate([scores, *(p[0] for p in parts)]), np.concatenate([letters, *(p[1] for p in parts)])
            langs, sure, spans = [], [], []
            for words in texts:
                at = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                n = letters[at]
                if n.sum():
                    main, score, parts = label_text(scores[at], n, switch)
                    langs.append(m.languages[main])
                    sure.append(score)
                    spans.append([{"first": a, "end": b, "lang": m.languages[k]} for a, b, k in parts])
                else:
                    langs.append(UNKNOWN)
                    sure.append(0.0)
                    spans.append([])
            made = [pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            yield pa.record_batch(kept + made, [x for x in batch.schema.names if x != "text"] + ["lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), *(F.struct(F.col(c)).alias(f"carried_{i}") for i, c in enumerate(carry or [])), F.col(text_column).cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")
    return out.select("id", "lang_pred", "score", "spans", *(F.col(f"carried_{i}").getField(c).alias(c) for i, c in enumerate(carry or [])))


def held_out(id_column: str = "doc_id"):
    """False for a null id, which is neither held out nor learned from."""
    return F.coalesce(common.fold_of(id_column, 5) == 0, F.lit(False))


def learned_model(docs: DataFrame) -> Model:
    return train(docs.where(common.fold_of("doc_id", 5) != 0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return identify(docs, learned_model(docs)).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


#: A text whose language is labelled with less confidence is rejected by the pipeline.
PIPELINE_SCORE = 0.25


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those of no clear language, go."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("row"))
    found = identify(whole, learned_model(docs), carry=["row"])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= PIPELINE_SCORE)).select("row.*")
