"""Lexical search, token files and vector codes: plain versions, round trips and edge cases."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from redactlake.llm import common, lexical, token_files, vector_codes
from redactlake.llm.packing import tokenizer_path

DOCS = "doc_id long, text string, id string, row string, terms string, n string, shard string"


def docs_of(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(d, t, *["x"] * 5) for d, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "a b"), (5, "ab"), (6, "x" * 50_000), (7, "word " * 30_000), (8, "A b <|endoftext|>")]


# 11


def plain_ranks(docs, items, k=10):
    split = lambda text: lexical.terms_of(text or "")
    texts = [(doc, Counter(split(text))) for doc, text in docs]
    with_terms, total = sum(1 for _, c in texts if c), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, query in items:
        scores = []
        for doc, counts in texts:
            m = 10 + 90 * sum(counts.values()) * with_terms // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * with_terms + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in set(split(query)) if counts[t])
            if score:
                scores.append((-score, (doc is not None, doc or 0)))
        out += [(item, i + 1, doc[1] if doc[0] else None, -score) for i, (score, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items):
    return sorted(map(tuple, lexical.rank(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)


def test_terms_are_runs_of_letters_digits_and_other_characters():
    assert lexical.terms_of("Ab-c9Éx_中.\x7fZ") == ["ab", "c9Éx", "中", "z"]


def test_ranks_of_edges_ties_and_repeated_rows(spark):
    docs = [*EDGES, (9, "same tie"), (10, "same tie"), (10, "same tie"), *((20 + i, "same tie") for i in range(12))]
    items = [(1, "word"), (1, "tie a"), (None, "AB"), (2, None), (3, ""), (4, "unknown"), (5, "a b a b x"), (6, "a"), (6, "a")]
    assert ranked(spark, docs, items) == plain_ranks(docs, items)
    assert ranked(spark, docs, []) == [] and ranked(spark, [], items) == [] and ranked(spark, [(1, None)], items) == []


@pytest.mark.parametrize("small", [True, False])
def test_ranks_over_many_shards(spark, monkeypatch, small):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(700)]
    docs += [(700 + i, docs[i][1]) for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)]
    monkeypatch.setattr(lexical, "QUERY_ROWS", 7)
    if not small:
        monkeypatch.setattr(common, "is_small", lambda *a, **k: False)  # vocabulary and queries are neither broadcast
    assert ranked(spark, docs, items) == plain_ranks(docs, items)


def test_a_search_scores_only_ranges_whose_bound_reaches_the_kth_score(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 4096)
    places = np.sort(rng.choice(4096, 600, replace=False))
    values = rng.integers(1, 1000, 600)
    values[np.isin(places // 16, (3, 77))] += 5000
    starts = np.array([0, 300, 600])
    order = np.concatenate([np.arange(0, 600, 2), np.arange(1, 600, 2)])
    shard = lexical.Shard(["a", "b"], starts, places[order], values[order], {"a", "b"})
    scored = []

    pop = lexical.heapq.heappop
    monkeypatch.setattr(lexical.heapq, "heappop", lambda heap: scored.append(pop(heap)) or scored[-1])
    got = shard.search({"a": 2, "b": 3}, 3, 0)
    plain = np.zeros(4096, np.int64)
    plain[places[0::2]] += 2 * values[0::2]
    plain[places[1::2]] += 3 * values[1::2]
    assert got == [(int(plain[i]), int(i)) for i in np.lexsort((np.arange(4096), -plain))[:3]]
    bounds = np.zeros(256, np.int64)
    for half, weight in ((0, 2), (1, 3)):
        highest = np.zeros(256, np.int64)
        np.maximum.at(highest, places[half::2] // 16, values[half::2])
        bounds += weight * highest
    leaves = [node for _, level, node in scored if level == 0]
    assert sorted(leaves) == np.flatnonzero(bounds >= got[-1][0]).tolist() and len(leaves) < 100


# 12


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_byte_code_round_trip(n):
    rng = np.random.default_rng(n)
    numbers = rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)
    control, data = token_files.encode(numbers)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in numbers)
    assert (token_files.decode(control, data, n) == numbers).all()


def plain_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    return [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def plain_rows(docs):
    out, at = [], 0
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for (doc, _), ids in zip(ordered, plain_ids([t for _, t in ordered]), strict=True):
        out.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_token_files_equal_the_tokenizers_library(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted(map(tuple, token_files.op12_token_files(spark, data).collect()))
    assert got == plain_rows(docs)


def test_token_files_of_edges(spark, tmp_path, monkeypatch):
    docs = [*EDGES, *((100 + i, "some words " * i) for i in range(40))]
    random.Random(1).shuffle(docs)
    token_files.write_tokens(docs_of(spark, docs), f"file://{tmp_path}/a")
    got = sorted(map(tuple, token_files.read_tokens(spark, f"file://{tmp_path}/a", digest=True).collect()), key=lambda r: r[1])
    assert got == plain_rows(docs)
    whole = sorted(token_files.read_tokens(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r.ids for r in whole] == plain_ids([t for _, t in ordered])
    ranks = spark.read.parquet(f"file://{tmp_path}/a/ranks").orderBy("rank").collect()
    counts = Counter(i for ids in plain_ids([t for _, t in docs]) for i in ids)
    assert [(r.id, r.n) for r in ranks] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    token_files.write_tokens(docs_of(spark, []), f"file://{tmp_path}/b")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/b").count() == 0


def test_texts_beyond_the_long_text_go_to_the_other_encoder_with_equal_ids(spark, monkeypatch):
    from redactlake.llm.packing import ByteBpe

    encoder = ByteBpe(tokenizer_path())
    rng = random.Random(3)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", "\t", "é", " ", "　", "᠎", "​", "\u0085", "<|endoftext|>", "1", "٣", "中", "\U0001f600", "!", "...", "\x1c", "\x00", "don't", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    monkeypatch.setattr("redactlake.llm.packing.LONG_TEXT", 20)
    assert [[*encoder.encode(t), 0] for t in texts] == plain_ids(texts)


# 13


def test_roots_are_rounded_away_from_each_other():
    rng = np.random.default_rng(1)
    squares = np.concatenate([rng.integers(0, 1 << 60, 1000), rng.integers(0, 1 << 30, 1000) ** 2, rng.integers(0, 1 << 30, 1000) ** 2 + 1, np.arange(50)])
    assert vector_codes.root_down(squares).tolist() == [math.isqrt(int(s)) for s in squares]
    assert vector_codes.root_up(squares).tolist() == [math.isqrt(int(s) - 1) + 1 if s else 0 for s in squares]


@pytest.mark.parametrize("spread", [2, 300, 1 << 24])
def test_bounds_give_what_full_scans_give(spread):
    """Few values make ties, large ones leave the products of doubles."""
    rng = np.random.default_rng(spread)
    parts = rng.integers(-spread, spread + 1, (1500, 4)) + spread * rng.integers(0, 5, (1500, 1)) * (spread > 2)
    entries, before = parts[:16].copy(), None
    code, upper, lower = np.zeros(1500, np.int64), np.full(1500, vector_codes._NEVER), np.full(1500, -vector_codes._NEVER)
    scanned = []
    for _ in range(8):
        code, upper, lower, n = vector_codes.Moves(entries, before).assign(parts, code, upper, lower)
        exact = [[sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in entries.tolist()] for p in parts.tolist()]
        assert code.tolist() == [row.index(min(row)) for row in exact]
        scanned.append(n)
        before, entries = entries, np.stack([parts[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else entries[e] for e in range(16)])
    assert scanned[0] > 1000
    if spread == 300:
        assert scanned[-1] < 500


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[cut(r[2], p) for r in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        found = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                groups[p].setdefault(nearest(p, cut(v, p))[0], []).append(cut(v, p))
        for p in range(parts):
            for e, members in groups[p].items():
                books[p][e] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    out = []
    for i, _, v in kept:
        found = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return sorted(out, key=repr), [x for book in books for entry in book for x in entry]


@pytest.mark.parametrize("n", [3, 400])
def test_codes_of_edges_equal_a_plain_version(spark, n):
    rng = random.Random(n)
    good = [(i if i % 50 else 7, i % 3 or None, [rng.choice([-1.5, -0.25, 0.0, 0.125, 2.0]) + i % 5 for _ in range(8)]) for i in range(n)]
    good += [(None, 1, [0.5] * 8), (2, None, [0.0] * 8), (2, None, [0.0] * 8)]
    bad = [(0, 1, None), (1, 1, [float("nan")] * 8), (1, 1, [float("inf"), *[0.0] * 7]), (1, 1, [None, *[0.0] * 7]), (-5, 1, []), (-4, 1, [1.0] * 7), (900, 1, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in [*good, *bad]], "vec_id long, label int, embedding array<double>, id int, code string, ints string")
    got, books = vector_codes.compress(df, keep=("label", "id"))
    want, plain_books = plain_codes(good)
    assert sorted(((r.id, r.code, r.error) for r in got.collect()), key=repr) == want
    assert books.reshape(-1).tolist() == plain_books
    empty, books = vector_codes.compress(df.where("false"))
    assert empty.columns == ["id", "code", "error"] and empty.count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(df.selectExpr("vec_id", "transform(embedding, x -> x * 1e30) AS embedding"))
