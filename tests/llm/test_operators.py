"""Each operator: edge cases, and brute force where SQL can't express it."""

import hashlib
import os
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from redactlake.llm import catalog, chat, common, exact_dedup, language, lattice, mixing, nearest, packing, passages, simhash, toxicity

TABLES = "documents embeddings conversations labels benchmark".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, digest string, kept string"


def docs_of(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(d, t, *(rest or ["en", "s"]), 0, "x", "x", "x", "x") for d, t, *rest in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark, data):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (4, "a b"), (None, "a b"), (5, "ab"), (6, "x" * 50_000), (7, "word " * 30_000), (8, "a b")]


def kept_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = catalog.QUERIES[name](spark, data).toPandas()
    want = con.execute(f"SELECT * FROM ({catalog.ORACLES[name]})").df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].astype(object).values.tolist())) == sorted(map(repr, want[columns].astype(object).values.tolist()))


# 1


def digest_of(turns):
    all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_reads_back(spark, data):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    hostile = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", hostile), ("assistant", hostile)]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op1_chat_format(spark, data).collect()}
    assert got == {c: digest_of(t) for c, t in turns.items()}
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text")
    made = defaultdict(list)
    for r in chat.format_conversations(rows).where("example is not null").collect():
        made[r.conv_id].append(r)
    assert len(made) > 10
    render = lambda ts: "".join(chat.OPEN + chat.escape(role) + chat.ROLE_END + chat.escape(text) + chat.CLOSE for role, text in ts)
    for conv, examples in made.items():
        replies = [i for i, (role, _) in enumerate(turns[conv]) if role == "assistant"]
        assert [r.text for r in examples] == [render(turns[conv][: i + 1]) for i in replies]
        assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in examples] == [turns[conv][i][1] for i in replies]


@pytest.mark.parametrize("text", ["", "\\", "\\[INST]", "<</s>", "[INST", "<s></s>[INST][/INST]", "a\\\\<s", "é\n</s", "[/INST] [INST"])
def test_chat_escape_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


def test_chat_edges(spark):
    rows = [(1, 0, "system", None), (1, 1, "assistant", "A"), (1, 2, "assistant", ""), (1, 3, "user", "t"), (2, None, None, "x"), (None, 0, "assistant", "n"), (3, 1, "user", "b"), (3, 1, "assistant", "a"), (3, 1, "user", "b")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    made = chat.format_conversations(turns)
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.n_examples) for r in chat.read_back(made).collect()}
    assert got == {1: (4, 1, 2), 2: (1, 0, 0), None: (1, 1, 1), 3: (3, 1, 1)}
    assert sorted(map(repr, chat.digests(turns).collect())) == sorted(map(repr, chat.read_back(made).collect()))
    examples = {(r.conv_id, r.example): r for r in made.collect()}
    assert len(examples) == 7 and examples[2, None].loss_start is None and examples[1, None].text == "<s>[INST] user [/INST]t</s>"
    second = examples[1, 1]
    assert second.text == "<s>[INST] system [/INST]</s><s>[INST] assistant [/INST]A</s><s>[INST] assistant [/INST]</s>"
    first = examples[1, 0]
    assert first.text[first.loss_start : first.loss_end] == "A" and second.text.startswith(first.text)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# 2


def test_exact_dedup_edges_and_second_batch(spark):
    index = exact_dedup.fresh_index(spark)
    out = exact_dedup.deduplicate(docs_of(spark, EDGES), index)
    rows = {(r.id, r.kept): r for r in out.collect()}
    assert rows[3, True].keep_id == 3 and rows[3, True].group_size == 3 and not rows[1, False].kept
    group = [r for r in out.collect() if r.keep_id == 4]
    assert sorted((r.id or 0, r.kept) for r in group) == [(0, False), (4, False), (4, True), (5, False), (8, False)]
    again = exact_dedup.deduplicate(docs_of(spark, [(0, "ab"), (9, "new"), (10, "new ")]), exact_dedup.DigestIndex(spark, index.path, index.buckets))
    assert sorted((r.id, r.keep_id, r.kept) for r in again.collect()) == [(0, 4, False), (9, 10, False), (10, 10, True)]
    assert index.read().groupBy("digest").count().where("count > 1").isEmpty()
    assert exact_dedup.deduplicate(docs_of(spark, []), exact_dedup.fresh_index(spark)).count() == 0


def test_exact_dedup_reads_the_index_by_bucket(spark):
    index = exact_dedup.fresh_index(spark)
    exact_dedup.deduplicate(docs_of(spark, [(1, "a"), (2, "b")]), index).count()
    groups = spark.createDataFrame([("d",)], "digest string")
    plan = groups.hint("merge").join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_exact_dedup_is_native(spark, data):
    plan = exact_dedup.op2_exact_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 3


def exact_neighbours(vectors, queries, k):
    out = {}
    for q in queries:
        scores = sorted((-float(np.sum(np.array(v) * np.array(vectors[q]))), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


def test_nearest_recall_and_order(spark, data):
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    want = exact_neighbours(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = defaultdict(list)
    for r in nearest.op3_nearest(spark, data).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1 and r.vec_id != r.query_id
        assert abs(r.score - np.sum(np.array(vectors[r.query_id]) * np.array(vectors[r.vec_id]))) < 1e-12
        got[r.query_id].append((-r.score, r.vec_id))
    assert all(v == sorted(v) and len(v) <= 20 for v in got.values())
    assert set(got) == set(want)
    assert np.mean([len({i for _, i in got[q]} & set(want[q])) / 20 for q in want]) >= 0.95


def test_nearest_recall_on_more_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in table.collect()), strict=True)
    ids, vectors = np.array(ids), np.array(vectors, np.float64)
    got = defaultdict(set)
    for r in nearest.op3_nearest(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    share = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        share.append(len(got[ids[q]] & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert len(share) >= 100 and np.mean(share) >= 0.95


@pytest.mark.parametrize("size", [1e-170, 1e-30, 1e150])
def test_nearest_of_any_norm(spark, size):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((120, 8))
    vectors[0] *= size  # a query among others of a common norm
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    want = sorted(range(1, 120), key=lambda i: -float(vectors[i] @ (vectors[0] / size)))[:20]
    assert len(set(got) & set(want)) >= 18
    alike = spark.createDataFrame([(i, v) for i, v in enumerate((vectors[1:] * size).tolist())], "vec_id long, embedding array<double>")
    assert nearest.nearest(alike, F.col("vec_id") % 20 == 0).groupBy("query_id").count().where("count >= 18").count() == 6


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (10, [])]
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, block string, row int")
    got = defaultdict(list)
    for r in nearest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(6, 2.0), (7, 2.0), (20, 1.0), (8, -1.0)], 20: [(6, 2.0), (7, 2.0), (0, 1.0), (8, -1.0)]}
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 4


def test_compact_windows_equal_the_tree():
    rng = np.random.default_rng(1)
    for n in (0, 5, 46, 47, 200, 700):
        v = rng.integers(1, 60 if n == 200 else 1 << 60, n).astype(np.uint64)
        if n == 700:
            v[300] = 0
        want = set()
        for c in range(n):
            if v[c]:
                left = right = c
                while left > 0 and v[left - 1] > v[c]:
                    left -= 1
                while right < n - 1 and v[right + 1] >= v[c]:
                    right += 1
                if right - left + 1 >= 46:
                    want.add((left, c, right))
        got = set(zip(*(x.tolist() for x in passages.compact_windows(v, 46)), strict=True))
        assert got <= want and {v[c] for _, c, _ in got} == {v[c] for _, c, _ in want}
        assert got == want or n == 200  # of equal values the first and the last of a run


def test_passages_of_fifty_words_are_found_and_no_shorter_ones(spark, documents):
    texts = {d: t.encode().lower().split() for d, t, _, _ in documents}
    holders = defaultdict(set)
    for d, words in texts.items():
        for i in range(len(words) - 49):
            holders[tuple(words[i : i + 50])].add(d)
    want = set().union(*(h for h in holders.values() if len(h) > 1))
    rows = passages.repeated_passages(docs_of(spark, documents)).collect()
    assert want and want <= {x for r in rows for x in (r.a, r.b)}
    for r in rows:
        assert r.a < r.b and r.a_end - r.a_first >= 50 and r.similarity >= 0.8
        if r.similarity == 1:
            assert texts[r.a][r.a_first : r.a_end] == texts[r.b][r.b_first : r.b_end]
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for h in holders.values():
        for x in h:
            a, b = sorted((find(x), find(min(h))))
            parent[b] = a
    classes = {x: r.class_id for r in rows for x in (r.a, r.b)}
    assert all(classes[d] <= find(d) for d in want)


def test_near_passage_with_edits_and_edges(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(120)]
    edited = passage.copy()
    edited[60] = "changed"
    other = lambda n: [word() for _ in range(n)]
    rows = [(1, " ".join(other(80) + passage + other(30))), (2, " ".join(other(10) + edited + other(200))), (3, " ".join(other(300))), (4, " ".join(other(60) + passage[:45] + other(60))), *((k + 10, t) for k, (_, t) in enumerate(EDGES)), (None, " ".join(passage))]
    found = passages.repeated_passages(docs_of(spark, rows)).collect()
    assert {(r.a, r.b) for r in found} == {(1, 2)}
    assert [(r.a_first, r.a_end, r.b_first, r.b_end) for r in found] == [(80, 200, 10, 130)]
    assert passages.repeated_passages(docs_of(spark, [])).count() == 0


def test_compact_windows_have_every_centre_of_tied_values():
    rng = np.random.default_rng(8)
    for _ in range(40):
        v = rng.integers(1, rng.integers(3, 30), 300).astype(np.uint64)
        v[rng.integers(0, 300, 2)] = 0
        want = {i + int(v[i : i + 46].argmin()) for i in range(255) if v[i : i + 46].all()}
        assert set(passages.compact_windows(v, 46)[1].tolist()) == want


def test_texts_that_share_a_passage_all_meet_the_smallest_id(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([*(word() for _ in range(20 + k % 7)), *passage, *(word() for _ in range(20))])) for k in range(200)]
    pairs = {(r.a, r.b) for r in passages.candidate_pairs(docs_of(spark, rows), "doc_id", "text").collect()}
    assert {(0, k) for k in range(1, 200)} <= pairs


def test_every_pair_of_texts_that_share_a_passage_can_be_asked_for(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([*(word() for _ in range(20 + k % 7)), *passage, *(word() for _ in range(20))])) for k in range(30)]
    docs = docs_of(spark, [*rows, (40, " ".join(word() for _ in range(100)))])
    got = passages.candidate_pairs(docs, "doc_id", "text", every=True).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def words_of(seed):
    rng = np.random.default_rng(seed)
    return lambda n: ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def test_no_class_is_lost_to_a_line_that_all_texts_share(spark):
    """150 pairs of passages, each with the line that all have in its middle and an edit on either side of it."""
    words, rng = words_of(21), np.random.default_rng(22)
    line, rows = words(48), []
    for k in range(150):
        before, behind = words(24), words(24)
        for d in range(2):
            passage = [*before, *line, *behind]
            if d:
                passage[int(rng.integers(5, 15))], passage[int(rng.integers(80, 90))] = words(2)
            rows.append((2 * k + d, " ".join([*words(int(rng.integers(10, 40))), *passage, *words(30)])))
    found = passages.repeated_passages(docs_of(spark, rows)).collect()
    texts = {d: np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64) for d, t in rows}
    want = {(2 * k, 2 * k + 1) for k in range(150) if passages.common_passages(texts[2 * k], texts[2 * k + 1])}
    assert len(want) > 140 and want <= {(r.a, r.b) for r in found}
    assert {(r.a, r.b, r.class_id) for r in found} == {(a, b, a) for a, b in want}


def test_classes_equal_those_of_all_pairs(spark):
    """Random families of passages with edits, beside lines of many lengths that others share, copies of whole texts and repeated ids."""
    words, rng = words_of(31), np.random.default_rng(32)
    lines = [words(int(n)) for n in rng.integers(8, 49, 6)]
    rows = []
    for _ in range(30):
        passage = [*words(int(rng.integers(10, 40))), *lines[rng.integers(6)], *words(int(rng.integers(30, 50)))]
        for _ in range(rng.integers(1, 5)):
            made = passage.copy()
            for i in rng.integers(0, len(made), rng.integers(0, 3)):
                made[i : i + 1] = words(int(rng.integers(0, 3)))
            rows.append((len(rows) * 3 + 1, " ".join([*words(int(rng.integers(0, 30))), *lines[rng.integers(6)], *words(5), *made, *words(int(rng.integers(0, 30)))])))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[::5])] + [(2000 + i % 3, rows[7][1]) for i in range(9)] + [(rows[3][0], rows[40][1])]
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(passages.Shingled(np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64)))
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a in texts:
        for b in (b for b in texts if b > a):
            if any(passages.common_passages(s, t) for s in texts[a] for t in texts[b]):
                linked |= {a, b}
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    found = passages.repeated_passages(docs_of(spark, rows)).collect()
    assert {(d, r.class_id) for r in found for d in (r.a, r.b)} == {(d, find(d)) for d in linked}


def test_every_short_passage_with_an_edit_is_found(spark):
    """Passages of 51 to 58 words with a word changed, so that few windows of theirs are equal for long."""
    words, rng = words_of(41), np.random.default_rng(42)
    rows = []
    for k in range(400):
        passage = words(51 + k % 8)
        edited = passage.copy()
        edited[int(rng.integers(10, 41))] = words(1)[0]
        rows += [(2 * k + d, " ".join([*words(int(rng.integers(0, 40))), *p, *words(int(rng.integers(0, 40)))])) for d, p in enumerate((passage, edited))]
    texts = {d: np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64) for d, t in rows}
    want = {(2 * k, 2 * k + 1) for k in range(400) if passages.common_passages(texts[2 * k], texts[2 * k + 1])}
    found = passages.repeated_passages(docs_of(spark, rows)).collect()
    assert len(want) == 400 and {(r.a, r.b, r.class_id) for r in found} == {(a, b, a) for a, b in want}


def test_passages_that_go_on_behind_an_edit_beside_a_common_line_are_found(spark):
    """A line of 30 words in all texts, before or behind a changed word and 25 words that two of them share; or 20 of it, between words added; junk texts beside."""
    words = words_of(51)
    line, rows = words(30), []
    for k in range(240):
        more = words(68)
        for d in range(2):
            parts = ([line, words(1 + d), more[:25]], [more[:25], words(1 + d), line], [more[:34], words(d), line[:20], words(d), more[34:]])[k % 3]
            rows.append((2 * k + d, " ".join([*words(20 + k % 5), *(w for part in parts for w in part), *words(10)])))
    rows += [(1000 + k, " ".join([*words(1) * (20 + k % 7), *["junk"] * (24 + k % 20), *words(1) * 30])) for k in range(60)]
    found = passages.repeated_passages(docs_of(spark, rows)).collect()
    texts = {d: passages.Shingled(np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64)) for d, t in rows}
    want = {(a, b) for a in texts for b in texts if a < b and passages.common_passages(texts[a], texts[b])}
    assert want == {(2 * k, 2 * k + 1) for k in range(240)} and {(r.a, r.b) for r in found} == want


def _spoiled(n: int, edits: int) -> list[tuple[int, str]]:
    """Texts of one line of 200 words, with words of their own in some places; the first tenth of texts has a fifth of the edits."""
    rng, line = np.random.default_rng(29), [f"line{i}" for i in range(200)]
    rows = []
    for d in range(n):
        words = line.copy()
        for i in rng.choice(200, edits if d >= n // 10 else edits // 5, replace=False).tolist():
            words[i] = f"own{d}x{i}"
        rows.append((d, " ".join(words)))
    return rows


def test_near_copies_without_a_common_passage_are_not_paired(spark):
    """Edits every dozen of words: windows are shared by many, and few of their pairs have a passage."""
    rows = _spoiled(120, 16)
    texts = [passages.Shingled(np.array([hash(w) & (1 << 63) - 1 for w in t.split()], np.uint64)) for _, t in rows]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if passages.common_passages(texts[a], texts[b])}
    got = {(r.a, r.b) for r in passages.candidate_pairs(docs_of(spark, rows), "doc_id", "text", every=True).collect()}
    assert want and want <= got
    assert len(got) <= 3 * len(want)


def test_texts_that_repeat_words_meet_by_few_of_their_rows(monkeypatch):
    """Rows of two texts are held against each other once if they meet, and the pairs are those of all rows."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(12):
        line = ["line"] * 30 if d % 2 else ["line"] * 25 + [f"w{d // 4}"] + ["line"] * 25
        rows.append((d, " ".join(x for _ in range(3) for x in [*line, *(f"v{rng.integers(6)}" for _ in range(3))]).encode()))
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows], pa.binary())], ["id", "text"])
    found = pa.Table.from_batches(list(passages._windows(iter([batch]))))
    held = found.group_by("id").aggregate([("key", "list"), ("c", "list")]).to_pylist()
    windows = [[{"key": k, "c": c} for h in held if h["id"] == d for k, c in zip(h["key_list"], h["c_list"], strict=True)] for d, _ in rows]
    batch = batch.append_column("windows", pa.array(windows, pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int32())]))))
    table = pa.Table.from_batches(list(passages._contexts(iter([batch])))).sort_by([("key", "ascending"), ("id", "ascending")])
    members = table.select(["key", "id"]).group_by(["key", "id"]).aggregate([])
    members = members.append_column("k", members.column("id")).append_column("context", pa.nulls(len(members), pa.binary()))
    table = table.append_column("k", pa.nulls(len(table), pa.int64())).select(["key", "id", "k", "context"])
    group = passages.Group(pa.concat_tables([members.select(table.column_names), table]))
    meet, tested = passages.Group.meet, []
    monkeypatch.setattr(passages.Group, "meet", lambda self, i, j: tested.append(len(i)) or meet(self, i, j))
    got = group.ids(group.anchored(True), of_classes=True).to_pydict()
    few, want = sum(tested), set()
    for x, y in (np.divmod(codes, len(group.key)) for codes in passages._once(group.anchored(True))):
        ok = meet(group, x, y) & (group.id[x] != group.id[y])
        want |= {(min(p), max(p)) for p in zip(group.id[x[ok]].tolist(), group.id[y[ok]].tolist(), strict=True)}
        every = len(x)
    assert set(zip(got["a"], got["b"], strict=True)) == want and want
    assert few < 0.6 * every, (few, every)


def test_passages_query_has_one_row_a_document(spark, tmp_path):
    words = words_of(61)
    text, other = words(60), words(70)
    rows = [(1, " ".join(other)), (2, None), (5, " ".join([*text, "a"])), (4, " ".join(["b", *text])), (9, " ".join(text[:55])), (9, "x"), (None, " ".join(text))]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["op4_passages"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1, None, None), (2, 2, None, None), (4, 4, 1, 61), (5, 4, 0, 60), (9, 4, 0, 55)]


def test_words_hashed_in_bulk_equal_words_hashed_one_by_one(monkeypatch):
    rng = np.random.default_rng(7)
    letters = list("abAB\x00\xa0\u0120é")
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 5)))
    texts = ["", " \t\n\x0b\x0c\r", "x", "\nIs is\x0bIS ", "A" * 40 + " " + "a" * 40 + " " + "a" * 41, "é" * 300]
    texts += ["".join(word() + str(rng.choice(list(" \t\n\x0b\x0c\r"))) * rng.integers(1, 3) for _ in range(rng.integers(0, 80))) for _ in range(100)]
    texts = [t.encode() for t in texts]
    want = [[xxhash.xxh64_intdigest(w) for w in t.lower().split()] for t in texts]
    for chunk in (passages._CHUNK, 64, 33):  # texts and words that are longer than a chunk
        monkeypatch.setattr(passages, "_CHUNK", chunk)
        seen = {}
        for _ in range(2):
            assert [g.tolist() for g in passages.word_hashes(texts, seen)] == want
        pairs = {x for ws, g in zip(want, passages.word_hashes(texts), strict=True) for x in zip(ws, g.tolist(), strict=True)}
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert passages.word_hashes([], {}) == []


def test_passages_of_repeated_lines_are_found_at_any_offset():
    rng = np.random.default_rng(5)
    words = lambda n: rng.integers(1, 2**62, n).tolist()
    line = words(12)
    for before, behind in ((200, 15), (15, 200), (40, 47), (0, 0)):
        a, b = (np.array([*words(n), *line * 10, *words(30)], np.uint64) for n in (before, behind))
        assert passages.common_passages(a, b) == [(before, before + 120, behind, behind + 120, 1.0)]
    edited = line * 5
    edited[30] = 7
    a, b = np.array([*words(100), *line * 5, *words(40)], np.uint64), np.array([*words(20), *edited, *words(70)], np.uint64)
    assert [found[:4] for found in passages.common_passages(a, b)] == [(100, 160, 20, 80)]
    for _ in range(60):  # texts of a few lines, against all longest equal stretches
        lines = [words(rng.integers(3, 25)) for _ in range(rng.integers(1, 6))]
        a, b = (np.array([w for _ in range(30) for w in (lines[rng.integers(len(lines))] if rng.random() < 0.85 else words(rng.integers(1, 15)))], np.uint64) for _ in "ab")
        s, t = passages.shingles(a), passages.shingles(b)
        equal, want = np.zeros(len(t) + 1, np.int64), set()
        for i in range(len(s) - 1, -1, -1):
            equal[:-1] = np.where(t == s[i], equal[1:] + 1, 0)
            want |= set(range(i, i + equal.max())) if equal.max() >= 46 else set()
        found = passages.common_passages(a, b)
        assert want <= {i for a0, a1, *_ in found for i in range(a0, a1 - 4)}
        assert all(f[4] >= 0.8 and f[1] - f[0] >= 50 and f[3] - f[2] >= 50 for f in found)


# 5


def test_lattice_sums_all_segmentations():
    probabilities = np.array([0.2, 0.1, 0.15, 0.05, 0.2, *np.full(256, 0.3 / 256)])
    pieces = ["▁", "a", "b", "ab", "▁a"] + [f"<0x{b:02X}>" for b in range(256)]
    lat = lattice.Lattice.of(pieces, list(range(5, 261)), probabilities[None, :])
    p = dict(zip(pieces, probabilities, strict=True))
    byte = 0.3 / 256

    def total(word):
        n = len(word)
        ways = [1.0] + [0.0] * n
        for end in range(1, n + 1):
            for start in range(end):
                piece = word[start:end]
                w = p.get(piece, 0.0)
                if not w and end == start + 1:
                    w = byte ** len(piece.encode())
                ways[end] += ways[start] * w
        return ways[n]

    words = ["ab", "aab", "b", "abé", "é", "abab" * 3]
    with np.errstate(over="ignore"):
        got = np.exp(lat.score(words)[:, 0])
        counts = lat.expect(["ab", "ab"], 0)
    assert got == pytest.approx([total("▁" + w) for w in words], rel=1e-9)
    whole = total("▁ab")
    assert counts[pieces.index("▁a")] == pytest.approx(2 * p["▁a"] * p["b"] / whole)
    assert counts[pieces.index("ab")] == pytest.approx(2 * p["▁"] * p["ab"] / whole)


def test_lattice_base_score_and_held_out_gain(spark, data, documents):
    tokens = {d: [*t.encode().lower().split(), None] for d, t, _, _ in documents}
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if fold[d] != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = lattice.op5_lattice_score(spark, data).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_lattice_gains_on_held_out_texts(spark, size):
    rows = lattice.op5_lattice_score(spark, f"/root/testdata/{size}").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lattice_score_equals_a_plain_one(spark):
    rows = [(0, "the cat saw the cat", "en"), (2, "a dog é saw", "en"), (3, "der hund der", "de"), (4, "die katze", "de"), (6, "the dog the dog the dog der", "en"), (1, "the hund qx the", "en"), (11, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.id: r for r in lattice.score_texts(docs, F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 1, component_column="lang").collect()}
    pieces, raw, prior = lattice.load_vocabulary(lattice.vocabulary_path())
    place = {p: i for i, p in enumerate(pieces[: raw[0]])}

    def ways(word, p):
        """(probability, expected pieces) over all segmentations, each followed on its own."""
        total, used = 0.0, Counter()
        stack = [(0, 1.0, ())]
        while stack:
            at, so_far, path = stack.pop()
            if at == len(word):
                total += so_far
                for i in path:
                    used[i] += so_far
                continue
            for end in range(at + 1, len(word) + 1):
                part = word[at:end]
                if part in place:
                    stack.append((end, so_far * p[place[part]], (*path, place[part])))
                elif end == at + 1:
                    spelled = [raw[b] for b in part.encode()]
                    stack.append((end, so_far * float(np.prod(p[spelled])), (*path, *spelled)))
        return total, Counter({i: n / total for i, n in used.items()})

    by_label, ends, label_p = {}, Counter(), {}
    for d, t, label in rows:
        if d % 5 != 1:
            by_label.setdefault(label, Counter()).update((t or "").split())
            ends[label] += 1
    for label, words in by_label.items():
        p = prior
        for _ in range(lattice.ROUNDS):
            expected = np.zeros(len(p))
            for w in words:
                for i, n in ways("▁" + w, p)[1].items():
                    expected[i] += n
            p = lattice.SCORE_SHARE * prior + (1 - lattice.SCORE_SHARE) * expected / expected.sum()
        label_p[label] = p
    for d, t, _ in rows:
        total = 0.0
        for label, words in by_label.items():
            n = words.total()
            free = max(lattice.LATTICE_SHARE, lattice.DISCOUNT * len(words) / n)
            drawn, x = Counter(), ends[label] / sum(ends.values()) * ends[label] / (n + ends[label])
            for w in (t or "").split():
                own = max(words[w] - lattice.DISCOUNT, 0) / (n - lattice.DISCOUNT * len(words))
                p = (1 - free) * own + free * ways("▁" + w, label_p[label])[0]
                x *= (lattice.URN * p + drawn[w]) / (lattice.URN + drawn.total())
                drawn[w] += 1
            total += x
        assert got[d].score == pytest.approx(np.log10(total), rel=1e-5)


def test_lattice_edges(spark):
    fold = F.col("doc_id") % 5
    docs = docs_of(spark, [*EDGES, (11, "日本語 \U0001f600 <0x41>"), (12, None)])
    rows = lattice.score_texts(docs, fold != 1, fold == 1, component_column="lang").collect()
    assert len(rows) == 12 and all(np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.id in (1, 2, 3, 12)} == {1}
    assert [r.held_out for r in rows if r.id is None] == [False]
    assert lattice.score_texts(docs.limit(0), fold != 1, fold == 1).count() == 0
    untrained = lattice.score_texts(docs, F.lit(False), F.lit(True)).collect()
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in untrained)


# 6


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [f"w{x}" for x in rng.integers(0, 200, 60)]
        if toxic:
            words[10] = words[30] = ["vile!", "scorn"][i % 12 // 6]
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(rng.random() < 0.8), int(toxic)))
    labels += [(1000, None, 1), (None, 1, 1), (3, 2, 0)]
    docs = docs_of(spark, [*rows, (700, None), (701, ""), (701, ""), (702, "vile " * 30_000)])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, table, ["quality", "toxic"])
    out = {}
    for r in toxicity.classify(docs, chain).collect():
        out.setdefault(r.id, []).append(r)
    held = [(i % 6 == 0, out[i][0].toxic) for i in range(400, 600)]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert not out[700][0].toxic and len(out[701]) == 2 and out[702][0].toxic
    assert all(r.toxic == (r.p_toxic >= 0.5) for rs in out.values() for r in rs)
    assert toxicity.train(docs, table.limit(0), ["quality", "toxic"]) is None
    assert toxicity.classify(docs.limit(0), chain).count() == 0


def plain_logistic(rows, before, y, size):
    """The same loss, written out on dense rows and minimised by Newton's method."""
    n, positive = len(y), max(1, y.sum())
    dense = np.zeros((n, size))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    each = np.where(y == 1, n / (2 * positive), n / (2 * max(1, n - positive)))
    ratio = np.log((y @ dense + 1) / (positive + 2)) - np.log(((1 - y) @ dense + 1) / (max(1, n - positive) + 2))
    full = np.c_[dense * ratio, before, np.ones(n)]
    keep = np.r_[np.ones(full.shape[1] - 1), 0] * toxicity.PENALTY / n
    v = np.zeros(full.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ v))
        slope = full.T @ ((p - y) * each / n) + keep * v
        v -= np.linalg.solve(full.T @ (full * (p * (1 - p) * each / n)[:, None]) + np.diag(keep + 1e-9), slope)
    return lambda rows, before: np.array([sum(v[j] * ratio[j] for j in r) for r in rows]) + before @ v[size:-1] + v[-1]


def test_chain_and_folds_equal_a_plain_chain(spark):
    rng = np.random.default_rng(6)
    n, size = 240, 30
    rows = [np.unique(rng.integers(0, size, 8)) for _ in range(n)]
    first = np.array([float((3 in r) ^ (rng.random() < 0.1)) for r in rows])
    second = np.array([float((f == 1 and 7 in r) ^ (rng.random() < 0.05)) for r, f in zip(rows, first, strict=True)])
    fold = rng.integers(0, toxicity.FOLDS, n)
    models, limits = toxicity.fit_chain(spark, toxicity.Sparse.of(rows), fold, [first, second], size)
    before = np.zeros((n, 0))
    for y, model, limit in zip((first, second), models, limits, strict=True):
        out = np.zeros(n)
        for k in range(toxicity.FOLDS):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            out[own] = plain_logistic([rows[i] for i in rest], before[rest], y[rest], size)([rows[i] for i in own], before[own])
        want = plain_logistic(rows, before, y, size)(rows, before)
        assert np.abs(model.log_odds(toxicity.Sparse.of(rows), before) - want).max() < 0.02
        f1 = lambda at, out=out, y=y: 2 * y[out >= at].sum() / ((out >= at).sum() + y.sum())
        assert f1(limit) >= max(f1(at) for at in out) - 0.01
        before = np.c_[before, np.clip(out, -6, 6)]


# 7


def test_mixing_targets_share_the_excess(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50), ("é", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources, F.lit(1.5 * 1160)).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 100, None: 50, "é": 0}, {"a": 5, "b": 2, "c": 1, "é": 5, None: 2}
    want, left, free = dict.fromkeys(size, 0.0), 1.5 * 1160, set(size)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 2 * size[s]}
        if not full:
            want |= {s: share * weight[s] for s in free}
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    assert got == pytest.approx(want)


def test_mixing_edges(spark):
    docs = docs_of(spark, [(d, t, "en", s) for (d, t), s in zip(EDGES, ["a", "b", None, "c", "c", "d", "a", "e", "f", "a"], strict=True)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(EDGES)
    total = sum(r.size for r in rows)
    assert sum(r.taken for r in rows) <= 1.5 * total and all(r.taken <= 2 * r.size for r in rows)
    assert kept_rows(mixing.mix(docs)) == kept_rows(mixing.mix(docs))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None), (2, " ")])).agg(F.sum("taken")).first()[0] == 0


def test_mixing_cuts_a_stretch_that_many_end_in(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 7)
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 3)), f"s{i:03}") for i in range(300)], "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = {r[0]: r[4] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()}
    assert {r.id: r.taken for r in mixing.mix(docs).collect()} == want


def test_mixing_comes_near_its_targets(spark, documents):
    rows = mixing.mix(docs_of(spark, documents)).collect()
    source = {d: s for d, _, _, s in documents}
    taken, target, most = Counter(), {}, max(r.size for r in rows)
    for r in rows:
        taken[source[r.id]] += r.taken
        target[source[r.id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in target)


# 8


def test_packing_matches_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    own, reference = packing.ByteBpe(path), Tokenizer.from_file(path)
    hard = ["", "<|endoftext|> x", "a" * 3000, " \n\t  x  ", "é\U0001f600日本\x00", "don't WE'LL 123,456", *(t for _, t, _, _ in documents)]
    for text in hard:
        assert own.encode(text) == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [10, 37, 100])
def test_packing_is_best_fit_decreasing(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(60):
        sizes = rng.integers(1, capacity + 1, rng.integers(0, 150)).tolist()
        bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(room, i) for i, room in enumerate(bins) if room >= s]
            if fits:
                bins[min(fits)[1]] -= s
            else:
                bins.append(capacity - s)
        used, spans = Counter(), defaultdict(list)
        for length, _, n, first, offset in packing.best_fit(Counter(sizes), capacity):
            for k in range(first, first + n):
                used[k] += length
                spans[k].append((offset, length))
        assert sorted(capacity - u for u in used.values()) == sorted(bins)
        for parts in spans.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length


def test_packing_edges(spark):
    rows = packing.pack_documents(docs_of(spark, EDGES), capacity=64, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    encode = packing.encoder(packing.tokenizer_path()).encode
    for r in rows:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert set(by_doc) == {d for d, _ in EDGES} and len(by_doc[4]) == 2
    for d, text in EDGES:
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        if d != 4:
            assert [x for r in parts for x in r.ids] == [*encode(text or ""), 0]
            assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 64 for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


# 9


def brute_components(prints, distance=simhash.DISTANCE):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, documents):
    prints = {d: plain_fingerprint(t) for d, t, _, _ in documents}
    want = {d: (f"{prints[d]:016x}", c) for d, c in brute_components(prints).items()}
    got = {r.id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, documents)).collect()}
    assert got == want


def test_simhash_links_balls_and_chains(spark):
    rng = np.random.default_rng(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = {}
    for ball in range(6):
        centre = int(rng.integers(0, 1 << 62)) * 3
        for _ in range(40):
            x = centre
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            prints[len(prints)] = x & ((1 << 64) - 1)
    x = 12345
    for step in range(30):  # each four bits from the one before
        for bit in range(4):
            x ^= 1 << (step * 4 + bit) % 64
        prints[len(prints)] = x
    table = spark.createDataFrame([(signed(x), i) for i, x in prints.items()], "fp long, id long")
    linked = {r.fp: r.component for r in simhash.link(table).collect()}
    assert {i: linked[signed(x)] for i, x in prints.items()} == brute_components(prints)


def test_groups_and_strangers_never_go_through_the_driver(spark, monkeypatch):
    sent = []
    small = common.is_small
    monkeypatch.setattr(common, "is_small", lambda df, *a: sent.append(df.columns) or small(df, *a))
    table = spark.createDataFrame([(x, x) for x in (0, 1 << 30, 1 << 62, (1 << 62) + 15, 7 << 20)], "fp long, id long")
    assert simhash.link(table).count() == 5
    assert sent and not [x for x in sent if "split_key" in x]
    few = common.save(spark.range(50).withColumnRenamed("id", "b"), "few")  # its file is small, yet it has more rows than may be sent
    plan = spark.range(9).join(common.maybe_broadcast(few, 20), F.col("id") == F.col("b"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_edges(spark):
    rows = {}
    for r in simhash.near_duplicates(docs_of(spark, EDGES)).collect():
        rows.setdefault(r.id, []).append(r)
    assert all(rows[d][0].fingerprint == "0" * 16 for d in (1, 2, 3)) and rows[3][0].component_id == 1
    assert len(rows[4]) == 2 and rows[8][0].component_id == rows[None][0].component_id == 4
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


# 10


def test_language_held_out_accuracy(spark, data):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = language.op10_language_id(spark, data).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) >= 0.95


def plain_viterbi(scores, switch):
    best = {i: (s, [i]) for i, s in enumerate(scores[0])}
    for row in scores[1:]:
        top = max(best, key=lambda i: best[i][0])
        best = {i: ((best[top][0] - switch + s, [*best[top][1], i]) if best[top][0] - switch > best[i][0] else (best[i][0] + s, [*best[i][1], i])) for i, s in enumerate(row)}
    return max(best.values(), key=lambda x: x[0])[0]


def test_viterbi_equals_a_plain_one():
    rng = np.random.default_rng(11)
    for n in (1, 2, 30, 200):
        for _ in range(20):
            scores = rng.normal(0, 2, (n, 3))
            labels = language.viterbi(scores, 5.0)
            value = scores[np.arange(n), labels].sum() - 5.0 * (np.diff(labels) != 0).sum()
            assert value == pytest.approx(plain_viterbi(scores.tolist(), 5.0))


def test_language_spans_and_edges(spark, documents):
    by_lang = defaultdict(list)
    for d, t, lang, _ in documents:
        by_lang[lang].append(t)
    model = language.train(docs_of(spark, documents))
    assert model.languages == sorted(by_lang)
    one, two = (" ".join(" ".join(by_lang[x]).split()[:200]) for x in ("en", "de"))
    rows = {r.id: r for r in language.identify(docs_of(spark, [(20, f"{one} {two}"), (21, "123 !?"), (22, "мир"), *EDGES]), model, carry=["lang"]).collect()}
    assert [s.lang for s in rows[20].spans] == ["en", "de"] and abs(rows[20].spans[0].end - 200) < 15
    assert [rows[i].lang_pred for i in (1, 2, 3, 21)] == ["und"] * 4 and rows[22].score <= 0.5
    assert rows[20].lang == "en"
    assert language.identify(docs_of(spark, []), model).count() == 0
    empty = language.train(docs_of(spark, []))
    assert {r.lang_pred for r in language.identify(docs_of(spark, EDGES), empty).collect()} == {"und"}


# shared


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    ring = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in chain + star + ring], "a long, b long")
    got = {r.id: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 207)}}
    assert common.components(edges.limit(0)).count() == 0


SAVES = """
from pyspark.sql import SparkSession
from redactlake.llm import common
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{0}/shared").getOrCreate()
common.save(spark.range(5), "before")  # makes the shared folder
open("{0}/started", "w").close()
assert sorted(r.id for r in common.save(spark.range(5), "five").collect()) == [0, 1, 2, 3, 4]
assert common.save(spark.range(0), "none").count() == 0
"""


def test_the_driver_starts_no_process_to_save_a_table(tmp_path):
    chmod = tmp_path / "bin" / "chmod"
    chmod.parent.mkdir()
    chmod.write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/started\nexec {shutil.which("chmod")} "$@"\n')
    chmod.chmod(0o755)
    subprocess.run([sys.executable, "-c", SAVES.format(tmp_path)], env=os.environ | {"PATH": f"{chmod.parent}:{os.environ['PATH']}"}, check=True)
    started = (tmp_path / "started").read_text().splitlines()
    assert started  # by tasks
    assert [x for x in started if "/_temporary/0/_temporary" not in x] == []


def test_keep_rows_with_repeated_ids(spark):
    docs = docs_of(spark, [(1, "a"), (1, "b"), (2, "a"), (3, "c"), (None, "a"), (4, "d"), (4, "d")])
    text = F.xxhash64("text")
    kept = F.when((F.col("doc_id") == 2) | F.col("doc_id").isNull() | ((F.col("doc_id") == 1) & (F.col("text") == "b")), False).otherwise(True)
    decisions = docs.select(F.col("doc_id").alias("id"), text.alias("text_key"), kept.alias("kept"))
    assert sorted((r.doc_id, r.text) for r in common.keep_rows(docs, decisions).collect()) == [(1, "a"), (3, "c"), (4, "d"), (4, "d")]
