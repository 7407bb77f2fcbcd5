"""The pipeline's stages, each on its predecessor's rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from redactlake.llm import common, exact_dedup, mixing, packing, simhash


def test_stages_take_effect(spark, data):
    docs = common.read(spark, data, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = common.save(stage(spark, docs, data), name)
        if name != "packing":
            assert docs.columns == columns
    ids = {name: [r[0] for r in df.select("doc_id").collect()] for name, df in seen.items()}
    whole = [r[0] for r in common.read(spark, data, "documents").select("doc_id").collect()]
    assert set(ids["language"]) <= set(whole) and len(ids["language"]) >= 0.95 * len(whole)
    exact = seen["exact_dedup"].selectExpr("regexp_replace(text, '[\\\\x20\\\\x09-\\\\x0D]+', '') t").collect()
    assert len({r.t for r in exact}) == len(exact) < len(ids["language"])
    assert set(ids["simhash"]) <= set(ids["exact_dedup"]) and len(set(ids["simhash"])) == len(ids["simhash"])
    assert max(Counter(ids["mixing"]).values()) == 2 and set(ids["mixing"]) <= set(ids["simhash"])
    texts = Counter((r.doc_id, r.text) for r in seen["mixing"].collect())
    encode = packing.encoder(packing.tokenizer_path()).encode
    want = Counter()
    for (d, text), n in texts.items():
        tokens = np.array([*encode(text), packing.END_ID], "<u4")
        for k, (start, length) in enumerate(packing.cut(len(tokens))):
            want[d, k, start, length, zlib.crc32(tokens[start : start + length].tobytes())] += n
    rows = seen["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run_equals_the_stages(spark, data):
    docs = common.read(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, data), "stage")
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, docs.collect()))


#: Documents with null ids and texts, repeated rows and ids, and columns named like those inside the operators.
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, row string, row_id long, row_key long, copies int, n long, k long, kept string, _id long, _rows int, _copies int, _text_key string, _copy int, id string, component_id long"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, 1, "r", 2, 3, 4, 5, 6, "x", 7, 8, 9, "own", 10, "i", 11) for d, t, lang, s in rows], CLASHES)


HARD = [
    (1, "the cat sat on the mat and slept all day long", "en", "a"),
    (1, "the cat sat on the mat and slept all day long", "en", "a"),  # a repeated row
    (2, "the cat sat on the mat and slept all day long ", "en", "a"),  # the most code points
    (3, "der hund lief durch den wald und bellte laut", "de", None),
    (3, "le chien court dans la forêt et aboie", "fr", "b"),  # a repeated id
    (None, "the dog ran through the forest all night", "en", "b"),
    (None, None, None, None),
    (4, "", "en", "a"),
    (5, " \t", None, "b"),
    (6, "12345 !!!", "en", "b"),
    (7, "the bird sang " * 2000, "en", "c"),
    (8, "x" * 30_000, "en", "c"),
    (9, "katze hund maus vogel fisch pferd", "de", "a"),
]


def test_stages_on_hard_rows(spark, data):
    docs = clashing(spark, HARD)
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.save(stage(spark, docs, data), name)
        assert docs.columns == columns
        got = [tuple(r) for r in docs.collect()]
        assert set(got) <= set(rows)
        if name == "language":
            assert not {4, 5, 6} & {r[0] for r in got} and all(r[1] is not None for r in got)
            assert sorted(r[0] for r in got if r[0] in (1, 3, 9)) == [1, 1, 3, 3, 9]
        elif name == "exact_dedup":
            assert 2 in {r[0] for r in got} and 1 not in {r[0] for r in got} and len({r[1] for r in got}) == len(got) >= 6
        elif name == "simhash":
            assert {2, 3, 7, 8, 9, None} == {r[0] for r in got}
        rows = got if name != "mixing" else rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_no_rows(spark, data):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing(spark, []), data).count() == 0


def test_one_of_equal_rows_stays(spark, data):
    same = clashing(spark, [(5, "a b c d e f", "en", "a")] * 3 + [(5, "g h i j k l", "en", "a")] + [(None, "a b c d e f", "en", "a")] * 2)
    assert sorted(r.text for r in simhash.stage_simhash(spark, same, data).collect()) == ["a b c d e f", "g h i j k l"]
    assert exact_dedup.stage_exact_dedup(spark, same, data).count() == 2
    alone = clashing(spark, [(None, "a b c d e f", "en", "a")] * 2)
    assert simhash.stage_simhash(spark, alone, data).count() == 2  # no id names them
    doubled = mixing.stage_mixing(spark, same, data)
    assert doubled.columns == same.columns and {(r.id, r._copies, r._text_key, r._copy) for r in doubled.collect()} == {("i", 9, "own", 10)}


def test_simhash_stage_sends_no_groups_through_the_driver(spark, data, monkeypatch):
    sent = []
    small = common.is_small
    monkeypatch.setattr(common, "is_small", lambda df, *a: sent.append(df.columns) or small(df, *a))
    docs = clashing(spark, [(5, "a b c d e f", "en", "a"), (6, "a b c d e f", "en", "a"), (7, "g h i j k l", "en", "a")])
    assert simhash.stage_simhash(spark, docs, data).count() == 2
    assert sent and not [x for x in sent if "split_key" in x]


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "redactlake", tmp_path / "redactlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), len(e.oracle_sql()) > 40)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    assert said.stdout.split()[1:] == ["False", "False", "True"]
