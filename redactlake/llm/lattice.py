"""Language-model scores by a subword lattice.

The vocabulary is that of an existing tokenizer, and never changes. Every word is a lattice of its pieces:
its lattice probability is the sum over all its segmentations, by forward recursion in log space, of the
products of piece probabilities. These come from the vocabulary's scores, of which SCORE_SHARE stays for
good, and from rounds of expectation maximisation over the distinct words of the training texts.

A word that the training texts have is one more edge of its lattice, from its begin to its end, with its
discounted relative frequency. All such edges together weigh at most 1 - LATTICE_SHARE, whatever the size
of the corpus; the rest is the sum over segmentations into pieces.

Words of a text are drawn from an urn: each draw puts one more ball of its word beside URN balls that are
dealt by the probabilities above. A text's probability is that of its words in the urn and of its one end,
summed over the components of the model (one for each label of the training texts, such as their
language), weighted by their shares; labels aren't read for scoring.

Texts are read once. A task counts words into a dictionary of its own, a block, and stores each text as
places in it; then only dictionaries, not tokens, are shuffled: once by word, for the counts of the corpus,
and once by block, with each word's scores, to meet the block's texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactlake.llm import common

#: Marks where a word begins, in pieces.
BOUNDARY = "▁"
ROUNDS = 3
#: The share of each piece's probability that is the vocabulary's score, whatever the training texts have.
SCORE_SHARE = 0.05
#: The least weight of segmentations into pieces in each word's probability.
LATTICE_SHARE = 0.4
#: Balls of the urn before a text's first word.
URN = 3000.0
#: A block ends with so many bytes of text.
BLOCK_BYTES = 12_000_000
#: Words that a task scores at once, and the code points that it holds of those of one length.
BATCH_WORDS, BATCH_CELLS = 50_000, 400_000
#: Taken off each word's count; what it frees goes to the pieces too.
DISCOUNT = 0.6
#: The most frequent labels of the training texts have a component each, the others one together.
COMPONENTS = 8
HELD_OUT, UNUSED = -1, -2
_MULTIPLIER = 0x9E3779B97F4A7C15


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> tuple[list[str], list[int], np.ndarray]:
    """Pieces, the places of the 256 byte pieces, and prior probabilities.

    The file's scores order the pieces, from 0 down by one each; a piece at the r-th place gets a
    probability in proportion to 1 / (r + 3), as ranked words do. Byte pieces, which have no score of
    their own, come last.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    pieces = [model.id_to_piece(i) for i in plain]
    raw = [f"<0x{b:02X}>" for b in range(256)]
    prior = 1 / (np.arange(len(pieces) + 256) + 3.0)
    return pieces + raw, list(range(len(pieces), len(pieces) + 256)), prior / prior.sum()


def _hash(codes: np.ndarray, before: np.ndarray | np.uint64) -> np.ndarray:
    return (before ^ codes.astype(np.uint64)) * np.uint64(_MULTIPLIER) + np.uint64(0x632BE59BD9B4E019)


#: Length, the piece of each start and word or -1, and the byte pieces of the single characters without one, by start and word.
Edge = tuple[int, np.ndarray, list[tuple[int, int, np.ndarray]]]


@dataclass
class Lattice:
    """Log probabilities of pieces, found by a rolling hash of their code points."""

    keys: np.ndarray  # sorted hashes
    piece: np.ndarray  # and their pieces
    byte_piece: np.ndarray
    longest: int
    log_p: np.ndarray  # (components, pieces)

    @staticmethod
    def of(pieces: list[str], byte_piece: list[int], probabilities: np.ndarray) -> Lattice:
        plain = pieces[: byte_piece[0]]
        hashes = np.zeros(len(plain), np.uint64)
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        codes = np.zeros((len(plain), lengths.max()), np.uint64)
        for i, text in enumerate(plain):
            codes[i, : len(text)] = [*map(ord, text)]
        with np.errstate(over="ignore"):
            for at in range(codes.shape[1]):
                hashes = np.where(at < lengths, _hash(codes[:, at], hashes), hashes)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        return Lattice(hashes[order], order.astype(np.int32), np.array(byte_piece, np.int32), int(lengths.max()), np.log(probabilities))

    def edges(self, codes: np.ndarray) -> list[Edge]:
        """For words as rows of code points, by length. A single character always has an edge: its piece, or its bytes."""
        words, n = codes.shape
        across = np.ascontiguousarray(codes.T)  # (starts, words)
        out = []
        h: np.ndarray | np.uint64 = np.uint64(0)
        for length in range(1, min(n, self.longest) + 1):
            h = _hash(across[length - 1 :], h[: n - length + 1] if length > 1 else h)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found = self.keys[at] == h
            if length > 1 and not found.any():
                continue
            spelled = [(s, w, self.byte_piece[list(chr(int(across[s, w])).encode("utf-8", "replace"))]) for s, w in zip(*(x.tolist() for x in np.nonzero(~found)), strict=True)] if length == 1 else []
            out.append((length, np.where(found, self.piece[at], np.int32(-1)), spelled))
        return out

    def weigh(self, edges: list[Edge], k: int) -> list[np.ndarray]:
        out = []
        for _, piece, spelled in edges:
            weight = np.where(piece >= 0, self.log_p[k, piece], -np.inf)
            for s, w, raw in spelled:
                weight[s, w] = self.log_p[k, raw].sum()
            out.append(weight)
        return out

    def forward(self, edges: list[Edge], weights: list[np.ndarray], words: int, n: int, back: bool = False) -> np.ndarray:
        """(n + 1, words): log of the sum over all segmentations of each prefix, or suffix."""
        total = np.full((n + 1, words), -np.inf)
        total[n if back else 0] = 0
        for at in range(n - 1, -1, -1) if back else range(1, n + 1):
            if back:
                paths = np.stack([total[at + length] + weight[at] for (length, _, _), weight in zip(edges, weights, strict=True) if at + length <= n])
            else:
                paths = np.stack([total[at - length] + weight[at - length] for (length, _, _), weight in zip(edges, weights, strict=True) if at >= length])
            top = paths.max(axis=0)
            total[at] = top + np.log(np.exp(paths - top).sum(axis=0))
        return total

    def score(self, words: list[str]) -> np.ndarray:
        """(words, components) log probabilities. Memory: some 200 bytes for each character of a batch, or of its longest word."""
        out = np.zeros((len(words), len(self.log_p)))
        for at, codes in _batches(words):
            edges = self.edges(codes)
            for k in range(len(self.log_p)):
                out[at, k] = self.forward(edges, self.weigh(edges, k), *codes.shape)[-1]
        return out

    def expect(self, words: list[str], k: int) -> np.ndarray:
        """Expected number of each piece in the words, each taken once, under component k."""
        out = np.zeros(self.log_p.shape[1])
        for _, codes in _batches(words):
            edges, (rows, n) = self.edges(codes), codes.shape
            weights = self.weigh(edges, k)
            ahead, behind = self.forward(edges, weights, rows, n), self.forward(edges, weights, rows, n, back=True)
            for (length, piece, spelled), weight in zip(edges, weights, strict=True):
                expected = np.exp(ahead[: n - length + 1] + weight + behind[length:] - ahead[n])
                known = piece >= 0
                out += np.bincount(piece[known], expected[known], len(out))
                for s, w, raw in spelled:
                    np.add.at(out, raw, expected[s, w])
        return out


def _gathered(batches: Iterator[pa.RecordBatch], times: int = 1) -> Iterator[pa.RecordBatch]:
    """Larger batches: the work on words of one length is then on arrays that are worth a call."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_WORDS * times:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of words of equal length, each with the boundary mark before it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        n = int(lengths[same[0]]) + 1
        for part in np.array_split(same, -(-len(same) * n // BATCH_CELLS)) if len(same) * n > BATCH_CELLS else [same]:
            if len(part):
                joined = "".join(BOUNDARY + words[i] for i in part)
                yield part, np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4").reshape(len(part), n).astype(np.uint64)


def _blocks(components: int):
    """Blocks: rows of kind 0 are words with their counts in training texts, rows of kind 1 texts as places in the block's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        number = size = 0
        for batch in common.slices(batches):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield _block((task << 24) + number, pa.Table.from_batches(held), components)
                held, size, number = [], 0, number + 1
        if held:
            yield _block((task << 24) + number, pa.Table.from_batches(held), components)

    return run


def pack_counts(ids: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending ids as steps, and how often each occurs, in as few bytes each as hold the largest."""
    steps = np.diff(ids, prepend=0)
    wide, tall = (4 if steps.max(initial=0) > 0xFFFF else 2), (4 if times.max(initial=0) > 0xFF else 1)
    return bytes([wide, tall]) + steps.astype(f"<u{wide}").tobytes() + times.astype(f"<u{tall}").tobytes()


def unpack_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, tall = packed[0], packed[1]
    n = (len(packed) - 2) // (wide + tall)
    return np.cumsum(np.frombuffer(packed, f"<u{wide}", n, 2).astype(np.int64)), np.frombuffer(packed, f"<u{tall}", n, 2 + n * wide).astype(np.int64)


def _block(block: int, rows: pa.Table, components: int) -> pa.RecordBatch:
    use = rows.column("use").to_numpy()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(rows.column("text").combine_chunks()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    encoded = lists.flatten().dictionary_encode()
    words, codes = encoded.dictionary, encoded.indices.to_numpy()
    text = np.repeat(np.arange(len(use)), pc.list_value_length(lists).to_numpy())
    blank = pc.index(words, "").as_py()  # around a text's ends
    if blank >= 0:
        real = codes != blank
        text, codes = text[real], codes[real]
    size, texts = len(words), len(use)
    counts = np.zeros((components, size + texts), np.int64)
    for k in range(components):
        counts[k, :size] = np.bincount(codes[(use == k)[text]], minlength=size)
    counts[0, size:] = use == HELD_OUT
    pairs, times = np.unique(text * size + codes, return_counts=True)  # by text, then word
    ids = pairs % max(1, size)
    ends = np.searchsorted(pairs, np.arange(1, texts + 1) * size)
    stored = [pack_counts(ids[a:b], times[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    kept = np.r_[np.arange(size) != blank, np.ones(texts, bool)]
    columns = [
        pa.array(np.full(size + texts, block)),
        pa.array(np.r_[np.zeros(size, np.int32), np.ones(texts, np.int32)]),
        pa.concat_arrays([pa.array(np.arange(size)), rows.column("id").combine_chunks()]),
        pa.concat_arrays([words.cast(pa.binary()), pa.array(stored, pa.binary())]),
        *map(pa.array, counts),
    ]
    return pa.record_batch(columns, ["block", "kind", "id", "payload", *(f"n{k}" for k in range(components))]).filter(pa.array(kept))


@dataclass
class Corpus:
    blocks: DataFrame
    words: DataFrame  # word, owner (block), place, first (one row of each word), n0, n1, ...: its counts by component in the corpus
    tokens: np.ndarray  # by component, ends included
    distinct: np.ndarray  # by component, ends not included
    ends: np.ndarray
    vocabulary: int  # distinct training tokens, the end included

    @property
    def counts(self) -> list[str]:
        return [f"n{k}" for k in range(len(self.tokens))]


def count_words(docs: DataFrame, training, held_out, id_column: str, text_column: str, component_column: str | None) -> Corpus:
    """Word counts over all texts; training and held_out are conditions on docs. Every word has a row, those not learned from counts of 0."""
    spark = docs.sparkSession
    trains = F.coalesce(training, F.lit(False))
    label = F.col(component_column).cast("string") if component_column else F.lit(None).cast("string")
    sizes = docs.where(trains).groupBy(label.alias("label")).count().orderBy(F.desc("count"), F.asc_nulls_last("label")).limit(COMPONENTS + 1).collect()
    named = [r["label"] for r in sizes if r["label"] is not None][: COMPONENTS - 1]
    k = len(named) + (len(named) < max(1, len(sizes)))  # the others, if any, share the last component
    which = F.coalesce(F.array_position(F.array(*map(F.lit, named)).cast("array<string>"), label) - 1, F.lit(-1)).cast("int")
    use = F.when(F.coalesce(held_out, F.lit(False)), HELD_OUT).when(trains, F.when(which < 0, k - 1).otherwise(which)).otherwise(UNUSED)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), use.alias("use"), common.text_of(text_column).alias("text"))
    columns = [f"n{i}" for i in range(k)]
    blocks = common.save(rows.mapInArrow(_blocks(k), "block bigint, kind int, id bigint, payload binary" + "".join(f", {c} bigint" for c in columns)), "blocks", "zstd")
    word = Window.partitionBy("payload")
    totals = [F.sum(c).over(word).alias(c) for c in columns]
    first = F.row_number().over(word.orderBy("block")) == 1
    words = blocks.where("kind = 0").select(F.col("payload").alias("word"), F.col("block").alias("owner"), F.col("id").cast("int").alias("place"), first.alias("first"), *totals)
    words = common.save(words, "words", "zstd")
    found = {r["use"]: r["count"] for r in rows.groupBy("use").count().collect()}
    ends = np.array([found.get(i, 0) for i in range(k)])
    every = sum((F.col(c) for c in columns), F.lit(0))
    seen = words.where("first").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in columns), *(F.count_if(F.col(c) > 0) for c in columns), F.count_if(every > 0)).first()
    return Corpus(blocks, words, np.array(seen[:k]) + ends, np.array(seen[k : 2 * k]), ends, seen[2 * k] + int(ends.sum() > 0))


def fit(corpus: Corpus, vocabulary: str, rounds: int = ROUNDS) -> Lattice:
    """Piece probabilities of each component, after some rounds over its distinct training words; the vocabulary's own for one without words."""
    pieces, raw, prior = load_vocabulary(vocabulary)
    spark = corpus.words.sparkSession
    k = len(corpus.tokens)
    lattice = Lattice.of(pieces, raw, np.tile(prior, (k, 1)))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lattice)

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sent.value.log_p.shape)
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                for batch in _gathered(batches):
                    words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
                    for i in range(len(total)):
                        total[i] += sent.value.expect([words[j] for j in np.flatnonzero(batch.column(f"n{i}").to_numpy())], i)
            component, piece = np.nonzero(total)
            yield pa.record_batch([pa.array(component.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[component, piece])], ["component", "piece", "n"])

        learned = corpus.words.where(F.col("first") & (F.greatest(F.lit(0), *corpus.counts) > 0)).select("word", *corpus.counts)
        table = learned.mapInArrow(expected, "component int, piece int, n double").groupBy("component", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each component and piece
        counts = np.zeros((k, len(prior)))
        np.add.at(counts, (table.component.to_numpy(np.int64), table.piece.to_numpy(np.int64)), table.n.to_numpy())
        used = counts.sum(axis=1, keepdims=True)
        lattice = Lattice.of(pieces, raw, np.where(used > 0, SCORE_SHARE * prior + (1 - SCORE_SHARE) * counts / np.maximum(used, 1e-9), prior))
    return lattice


@dataclass
class WordModel:
    """A word's probability in each component: its own edge and its segmentations into pieces."""

    lattice: Lattice
    mass: np.ndarray  # discounted counts of all words of a component
    free: np.ndarray  # weight of segmentations into pieces

    @staticmethod
    def of(corpus: Corpus, lattice: Lattice) -> WordModel:
        words = np.maximum(corpus.tokens - corpus.ends, 0).astype(np.float64)
        freed = DISCOUNT * corpus.distinct
        return WordModel(lattice, np.maximum(words - freed, 1e-9), np.where(words > 0, np.maximum(freed / np.maximum(words, 1), LATTICE_SHARE), 1.0))

    def log_p(self, counts: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """From (words, components) counts and log lattice probabilities."""
        with np.errstate(divide="ignore"):
            own = np.log((1 - self.free) * np.maximum(counts - DISCOUNT, 0) / self.mass)
            return np.logaddexp(own, np.log(self.free) + pieces)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 1 on: Stirling's series eight places further."""
    shift = np.log(x)
    for i in range(1, 8):
        shift = shift + np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def urn(log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log probability, in each component, of drawing the words, each so many times, in a given order.

    A word's j-th draw after n others has probability (URN * p + j - 1) / (URN + n).
    """
    n = int(times.sum())
    out = n and (times > 0) @ (np.log(URN) + log_p)
    more = np.flatnonzero(times > 1)
    balls = URN * np.exp(log_p[more])
    out = out + (log_gamma(balls + times[more, None]) - log_gamma(balls + 1)).sum(axis=0)
    start = log_gamma(np.array([URN, URN + n]))
    return out + start[0] - start[1]


def score_texts(docs: DataFrame, training, held_out, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", component_column: str | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each row of docs.

    Null text is empty: its one token is the end. Tokens are words, ASCII letters lower-cased, and the end.
    The score is finite for any text: characters without a piece are spelled in bytes. Null ids are
    neither trained on nor held out by conditions on them; repeated rows are rows like any other. An empty
    table gives no rows; without training texts the vocabulary's scores alone are used. Null and rare labels
    share a component. Extra columns are not read.
    """
    corpus = count_words(docs, training, held_out, id_column, text_column, component_column)
    lattice = fit(corpus, vocabulary or vocabulary_path())
    spark = docs.sparkSession
    columns, n, ends = corpus.counts, int(corpus.tokens.sum()), int(corpus.ends.sum())
    model = WordModel.of(corpus, lattice)
    share = np.log(np.maximum(corpus.ends, 0.5) / np.maximum(corpus.ends, 0.5).sum())
    end_p = np.log(np.where(corpus.ends > 0, corpus.ends / np.maximum(corpus.tokens, 1), 0.5))
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for batch in _gathered(batches, 4):  # rows of a word are neighbours: it is scored once
                encoded = batch.column("word").dictionary_encode()
                pieces = model.lattice.score([w.decode("utf-8", "replace") for w in encoded.dictionary.to_pylist()])
                counts = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
                log_p = model.log_p(counts, pieces[encoded.indices.to_numpy()])
                yield pa.record_batch([batch.column("owner"), batch.column("place"), pa.array(counts.sum(axis=1)), *(pa.array(x.astype(np.float32)) for x in log_p.T)], ["owner", "place", "c", *(f"p{k}" for k in range(len(columns)))])

    parts = [f"p{k}" for k in range(len(columns))]
    local = corpus.words.select("word", "owner", "place", *columns).mapInArrow(scored, "owner bigint, place int, c bigint" + "".join(f", {p} float" for p in parts))
    texts = corpus.blocks.where("kind = 1").select("block", "id", F.col("payload").alias("counts"), (F.col("n0") == 1).alias("held_out"))
    total = n + 0.5 * (corpus.vocabulary + 1)

    def per_block(dictionary: pa.Table, stored: pa.Table) -> pa.Table:
        place = dictionary.column("place").to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        c, log_p = np.zeros(size, np.int64), np.zeros((size, len(parts)))
        c[place] = dictionary.column("c").to_numpy()
        log_p[place] = np.stack([dictionary.column(p).to_numpy() for p in parts], axis=1)
        base, end_base = np.log10((c + 0.5) / total), float(np.log10((ends + 0.5) / total))
        out = []
        for packed in stored.column("counts").to_pylist():
            ids, times = unpack_counts(packed)
            score = np.logaddexp.reduce(urn(log_p[ids], times) + end_p + share)
            out.append((int(times.sum()) + 1, int(times[c[ids] > 0].sum()) + (ends > 0), float(base[ids] @ times + end_base), float(score / np.log(10))))
        tokens, known, bases, scores = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"id": stored.column("id"), "held_out": stored.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n] * len(out), pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})

    # a text without words may stand in a block without words: cogroup keeps it
    return local.groupBy("owner").cogroup(texts.groupBy("block")).applyInArrow(per_block, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = common.fold_of("doc_id", 5)
    return score_texts(common.read(spark, sf_dir, "documents"), fold != 1, fold == 1, component_column="lang").withColumnRenamed("id", "doc_id")
