"""Page trees, page sizes and runs of text, from files."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.operators import pages as P
from redactlake.operators import verify as V
from redactlake.sources import pdf


def built(objects, root=1):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj %s endobj\n" % (n, body) for n, body in objects.items()) + b"trailer<</Root %d 0 R>>" % root


def stream(data, packed=False):
    raw = zlib.compress(data) if packed else data
    return b"<<%s/Length %d>>stream\n" % (b"/Filter/FlateDecode" * packed, len(raw)) + raw + b"\nendstream"


def tables(spark, files):
    df = spark.createDataFrame([(i, bytearray(data)) for i, data in files.items()], "file_id long, content binary")
    rows = pdf.pdf_objects(spark, df).persist()
    nodes = rows.where("node is not null").select("doc", "obj", "type", "node")
    roots = rows.where("root is not null").select("doc", F.col("root").alias("obj"))
    fonts = rows.where("font is not null").select("doc", "obj", "font")
    return nodes, roots, fonts, pdf.pdf_content(spark, df).persist()


def tree_of(spark, files):
    nodes, roots, _, _ = tables(spark, files)
    got = {}
    for r in P.page_tree(nodes, roots, lambda df: df.checkpoint()).orderBy("doc", "page").collect():
        got.setdefault(r.doc, []).append((r.obj >> 16, r.page, r.media, r.crop, r.rotate, r.fonts))
    return got


NESTED = {
    1: b"<</Type/Catalog/Pages 2 0 R>>",
    2: b"<</Type/Pages/Kids[3 0 R 4 0 R 9 0 R]/MediaBox[0 0 200 100]/Rotate -90/Resources<</Font<</F 8 0 R>>>>>>",
    3: b"<</Type/Page/Parent 2 0 R/Rotate 0>>",
    4: b"<</Type/Pages/Kids 10 0 R/Parent 2 0 R/CropBox[10 10 50 90]>>",
    5: b"<</Type/Page/Parent 4 0 R/MediaBox[0 0 50.5 60]/Resources<<>>>>",
    6: b"<</Type/Page/Parent 4 0 R>>",
    9: b"<</Type/Page/Parent 2 0 R>>",
    10: b"[6 0 R 5 0 R]",
    11: b"<</Type/Page/Parent 2 0 R>>",  # no node lists it
}


def test_pages_in_order_with_what_they_inherit(spark):
    cyclic = {**NESTED, 4: b"<</Type/Pages/Kids[6 0 R 4 0 R 12 0 R 2 0 R]>>", 12: b"<</Type/Pages/Kids[13 0 R]>>", 13: b"<</Type/Pages/Kids[12 0 R 14 0 R]/Parent 12 0 R>>", 14: b"<</Type/Page>>", 15: b"<</Type/Pages/Kids[16 0 R]/Parent 16 0 R>>", 16: b"<</Type/Pages/Kids[15 0 R 17 0 R]>>", 17: b"<</Type/Page>>"}
    deep = {1: b"<</Type/Catalog/Pages 2 0 R>>", **{n: b"<</Type/Pages/Kids[%d 0 R]/Rotate %d>>" % (n + 1, n) for n in range(2, 90)}, 90: b"<</Type/Page>>"}
    got = tree_of(spark, {1: built(NESTED), 2: built(cyclic), 3: built(deep), 4: b"%PDF-1.4", 5: built({1: b"<</Type/Catalog/Pages 7 0 R>>", 3: b"<</Type/Page>>"})})
    font = {"F": 8 << 16}
    wide, cut = [0.0, 0.0, 200.0, 100.0], [10.0, 10.0, 50.0, 90.0]
    assert got[1] == [(3, 1, wide, None, 0, font), (6, 2, wide, cut, 270, font), (5, 3, [0.0, 0.0, 50.5, 60.0], cut, 270, {}), (9, 4, wide, None, 270, font)]
    assert [(o, p) for o, p, *_ in got[2]] == [(3, 1), (6, 2), (14, 3), (9, 4)]  # 4 lists itself and the root, 12 and 13 each other; 15 and 16 hang on nothing else
    assert got[3] == [(90, 1, None, None, 89, None)]
    assert set(got) == {1, 2, 3}


@pytest.mark.parametrize(
    ("media", "crop", "rotate", "size"),
    [(None, None, None, (612, 792)), ([0, 0, 0, 9], None, 0, (612, 792)), ([300, 200, 0, 0], None, 90, (200, 300)), ([0, 0, 300, 200], [-9, 50, 100, 999], 180, (100, 150)), ([0, 0, 300, 200], [400, 0, 500, 9], 270, (200, 300)), ([0, 0, 3, 2], None, 45, (3, 2)), ([5, 5, 8, 7], None, 450, (2, 3))],
)
def test_page_size_and_viewport(spark, media, crop, rotate, size):
    df = spark.createDataFrame([(media and list(map(float, media)), crop and list(map(float, crop)), rotate)], "media array<double>, crop array<double>, rotate int")
    df = df.select(P.view_box(F.col("media"), F.col("crop")).alias("v"), P.turn(F.col("rotate")).alias("t"))
    w, h = P.page_size(F.col("v"), F.col("t"))
    row = df.select(w.alias("w"), h.alias("h"), F.array(*P.viewport(F.col("v"), F.col("t"))).alias("m"), "v").first()
    assert (row.w, row.h) == size
    corners = sorted((row.v[i] * row.m[0] + row.v[j] * row.m[2] + row.m[4], row.v[i] * row.m[1] + row.v[j] * row.m[3] + row.m[5]) for i in (0, 2) for j in (1, 3))
    assert corners == [(0, 0), (0, row.h), (row.w, 0), (row.w, row.h)]


CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000><FFFF> endcodespacerange 2 beginbfrange <0001><0003><0041> <0010><0011>[<00660069><D83DDE00>] endbfrange 1 beginbfchar <0020><00E9> endbfchar endcmap"
FONTS = {
    20: b"<</Type/Font/Subtype/Type1/FirstChar 32/Widths[%s]/Encoding/WinAnsiEncoding>>" % b" ".join(b"%d" % (200 + c) for c in range(32, 256)),
    21: b"<</Type/Font/Subtype/Type0/ToUnicode 22 0 R/DescendantFonts[23 0 R]>>",
    22: stream(CMAP, True),
    23: b"<</Type/Font/Subtype/CIDFontType2/DW 900/W[1[100 200] 3 17 300]>>",
    24: b"<</Type/Font/Subtype/Type1/FontDescriptor<</MissingWidth 333>>/Encoding<</BaseEncoding/MacRomanEncoding/Differences[65/space/uni00E9 67/fi/Q/nosuchname]>>>>",
}


def page_with(content, packed=False):
    return built({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Resources<</Font<</A 20 0 R/B 21 0 R/C 24 0 R>>>>>>", 3: b"<</Type/Page/Contents[4 0 R 5 0 R]>>", 4: stream(content, packed), 5: stream(b"ET", packed), **FONTS})


def runs_of(spark, files):
    nodes, roots, fonts, operators = tables(spark, files)
    return P.page_runs(P.page_tree(nodes, roots, lambda df: df.checkpoint()), operators, fonts)


def test_texts_by_map_differences_and_encoding(spark):
    content = b"BT /A 10 Tf (a\\200\\)) Tj /B 10 Tf <000100030010001100200005> Tj /C 10 Tf (ABCDE\\216) Tj /Z 1 Tf (x\\351) Tj [(a)-199(b)-200(c)5(d)] TJ BI /W 1 ID \x00(EI x EI /A 1 Tf (z) Tj"
    got = [(r.str, round(r.width, 6)) for r in runs_of(spark, {1: page_with(content)}).orderBy("seq").collect()]
    assert got[0] == ("a€)", round((297 + 328 + 241) / 100, 6))
    assert got[1] == ("ACfi\U0001f600é", round((100 + 300 + 300 + 300 + 900 + 300) / 100, 6))
    assert got[2] == (" éfiQEé", round(6 * 333 / 100, 6))
    assert got[3] == ("xé", 0) and got[4] == ("ab cd", round((199 + 200 - 5) / 1000, 6))
    assert got[5] == ("z", 0.322)


def plain_runs(ops):
    """An interpreter of the operators, for widths of 200 + code."""
    mul = lambda a, b: [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]
    unit = [1.0, 0, 0, 1, 0, 0]
    s, stack, line, text, out = {"m": unit, "Tf": 0, "Tc": 0, "Tw": 0, "Tz": 100, "TL": 0, "Ts": 0}, [], unit, unit, []
    for op, *args in ops:
        if op == "'":
            todo = [("T*",), ("Tj", *args)]
        elif op == '"':
            todo = [("Tw", args[0]), ("Tc", args[1]), ("T*",), ("Tj", args[2])]
        elif op == "TD":
            todo = [("TL", -args[1]), ("Td", *args)]
        else:
            todo = [(op, *args)]
        for name, *a in todo:
            if name == "q":
                stack.append(dict(s))
            elif name == "Q":
                s = stack.pop() if stack else s
            elif name == "cm":
                s["m"] = mul(a, s["m"])
            elif name == "BT":
                line = text = unit
            elif name == "Tm":
                line = text = a
            elif name in ("Td", "T*"):
                line = text = mul([1, 0, 0, 1, *(a or (0, -s["TL"]))], line)
            elif name == "Tj":
                z = s["Tz"] / 100
                advance = (sum(200 + ord(c) for c in a[0]) / 1000 * s["Tf"] + len(a[0]) * s["Tc"] + a[0].count(" ") * s["Tw"]) * z
                seen = mul(text, s["m"])
                out.append((a[0], mul([s["Tf"] * z, 0, 0, s["Tf"], 0, s["Ts"]], seen), advance * (seen[0] ** 2 + seen[1] ** 2) ** 0.5))
                text = mul([1, 0, 0, 1, advance, 0], text)
            else:
                s[name] = a[0]
    return out


def test_matrices_and_widths_equal_a_plain_interpreter(spark):
    rng = random.Random(4)
    number = lambda: rng.randrange(-30, 31) / 4
    files, want = {}, {}
    for doc in range(1, 9):
        ops = [("BT",)]
        for _ in range(60):
            op = rng.choice(["q", "Q", "cm", "Tm", "Td", "TD", "T*", "Tj", "Tj", "'", '"', "Tc", "Tw", "Tz", "TL", "Ts", "Tf", "BT"])
            n = {"cm": 6, "Tm": 6, "Td": 2, "TD": 2, '"': 2, "Tc": 1, "Tw": 1, "Tz": 1, "TL": 1, "Ts": 1, "Tf": 1}.get(op, 0)
            ops.append((op, *(number() for _ in range(n)), *([rng.choice(["a b", "", "xyz", " "])] if op in ("Tj", "'", '"') else [])))
        word = lambda op, a: " ".join([*(["/A"] if op == "Tf" else []), *(f"({x})" if isinstance(x, str) else f"{x:f}" for x in a), op])
        content = "/A 0 Tf " + "\n".join(word(op, a) for op, *a in ops)
        files[doc], want[doc] = page_with(content.encode(), doc % 2 == 0), plain_runs([("Tf", 0), *ops])
    got = {}
    for r in runs_of(spark, files).orderBy("doc", "seq").collect():
        got.setdefault(r.doc, []).append((r.str, r.matrix, r.width))
    for doc in want:
        assert [t for t, _, _ in got[doc]] == [t for t, _, _ in want[doc]]
        for (_, m, w), (_, m2, w2) in zip(got[doc], want[doc], strict=True):
            assert m == pytest.approx(m2, rel=1e-9, abs=1e-6) and w == pytest.approx(w2, rel=1e-9, abs=1e-6)


def test_runs_feed_search_and_boxes(spark):
    content = b"BT /A 10 Tf 14 TL 100 500 Td (first ) Tj (line) Tj T* (next) Tj ET"
    runs = runs_of(spark, {1: page_with(content)}).persist()
    assert [(r.str, r.has_eol) for r in runs.orderBy("seq").collect()] == [("first ", False), ("line", True), ("next", False)]
    assert [(r.doc, r.text) for r in V.document_text(V.page_text(runs)).collect()] == [(1, "first line\nnext")]
    found = V.match_spans(V.haystack_offsets(runs), "line next").orderBy("seq").collect()
    assert [(r.from_char, r.to_char) for r in found] == [(0, 4), (0, 4)]
    box = G.run_box([F.col("matrix")[i] for i in range(6)], [F.lit(float(v)) for v in (1, 0, 0, -1, 0, 792)], F.lit(612.0), F.lit(792.0), (F.lit(0.0), F.col("width")), (F.lit(0.0), F.col("height")))
    x, y, h = runs.where("str = 'next'").select(box.x, box.y, box.h).first()
    assert (x, y, h) == pytest.approx((100 / 612, (792 - 486 - 10) / 792, 10 / 792))


def test_hostile_files_give_rows_or_an_error_row(spark):
    digits = b"9" * 5000
    files = {1: built({1: b"[" + digits + b"]"}), 2: b"%PDF-1.4\n" + digits + b" 0 obj 1 endobj", 3: b"%PDF-1.4\n4294967296 0 obj 1 endobj", 4: built({1: b"<</Type/ObjStm/N (abc)/First 4>>stream\nx\nendstream"}), 5: built({1: b"<</Type/ObjStm/N 1/First 4>>stream\nab c x\nendstream"}), 6: built({1: b"[1 99999 R 1 70000 R]"})}
    df = spark.createDataFrame([(i, bytearray(data)) for i, data in files.items()], "file_id long, content binary")
    rows = pdf.pdf_objects(spark, df).collect()
    assert sorted(r.doc for r in rows) == [1, 2, 3, 4, 5, 6] and all(r.error and r.obj is None for r in rows)
    assert all(r.error and r.content is None for r in pdf.clean_files(df).collect())
    assert pdf.pdf_content(spark, df).count() == 0


def test_a_file_inflates_to_its_room_and_no_further(monkeypatch):
    monkeypatch.setattr(pdf, "MAX_INFLATED", 1000)
    bomb = stream(bytes(5000), True).replace(b"<<", b"<</Type/ObjStm/N 0/First 0")
    for data in (built({1: bomb}), built({n: stream(bytes(400), True).replace(b"<<", b"<</Type/ObjStm/N 0/First 0") for n in (1, 2, 3)})):
        with pytest.raises(pdf.Malformed, match="inflate to over 1000"):
            pdf.read(data)
    page = list(pdf.operators_of(page_with(b"BT (a) Tj " + b" " * 5000, True)))
    assert [r[-1] for r in page if r[-1]] == ["streams inflate to over 1000 bytes"] * 2


def test_thousands_of_mutated_files_never_fail_otherwise():
    from test_pdf import EVERYTHING

    rng = random.Random(1)
    seeds = [EVERYTHING, built(NESTED), page_with(b"BT /A 1 Tf (a) Tj [(b) 3 <41>] TJ ET", True)]
    parts = [b"9" * 5000, b"1 0 R", b"99999999999 0 obj", b"/N (abc)", b"<<", b">>", b"[", b"]", b"stream", b"endobj", b"-", b"1.5", b"(", b"<FEFF>", b"/Kids 5", b"true", b"/Type/Font/Widths[1 (a)]", b"/Length 3 0 R", b"/Type/Page/Contents 3 0 R"]
    for i in range(4000):
        data = bytearray(seeds[i % 3])
        for _ in range(rng.randrange(1, 5)):
            at, kind = rng.randrange(len(data)), rng.randrange(4)
            if kind == 0:
                data[at] = rng.randrange(256)
            elif kind == 1:
                del data[at : at + rng.randrange(1, 30)]
            else:
                data[at:at] = rng.choice(parts) if kind == 2 else data[rng.randrange(len(data)) :][:40]
        for use in (lambda d: list(pdf.rows_of(d)), pdf.clean, lambda d: list(pdf.operators_of(d))):
            try:
                use(bytes(data))
            except pdf.BROKEN:
                pass


def test_a_copied_page_takes_its_own_objects(spark):
    from redactlake.operators import documents as D

    data = built(
        {
            1: b"<</Type/Catalog/Pages 2 0 R>>",
            2: b"<</Type/Pages/Kids[3 0 R 4 0 R 5 0 R]/Resources<</XObject<</X 6 0 R>>>>/Metadata 12 0 R>>",
            3: b"<</Type/Page/Parent 2 0 R/Contents 7 0 R>>",
            4: b"<</Type/Page/Parent 2 0 R/Contents 8 0 R/Resources<</XObject<</Y 9 0 R>>>>>>",
            5: b"<</Type/Page/Parent 2 0 R/Contents 7 0 R/Resources 10 0 R>>",
            6: b"<</SMask 11 0 R>>", 7: stream(b""), 8: stream(b""), 9: b"<</Own 9 0 R/Group 11 0 R>>", 10: b"<</Parent 12 0 R>>", 11: b"[]", 12: b"1",
        }
    )
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data))], "file_id long, content binary")
    rows = pdf.pdf_objects(spark, df).persist()
    parts = pdf.structure(rows)
    nodes = rows.where("node is not null").select("doc", "obj", "type", "node")
    tree = P.page_tree(nodes, rows.where("root is not null").select("doc", F.col("root").alias("obj")), lambda df: df.checkpoint()).persist()
    held = D.page_objects(tree, parts.objects, parts.edges).persist()
    got = {(r.page, r.obj >> 16) for r in held.where("doc = 1").collect()}
    assert got == {(1, 3), (1, 7), (1, 6), (1, 11), (2, 4), (2, 8), (2, 9), (2, 11), (3, 5), (3, 7), (3, 10), (3, 12)}
    assert held.count() == 2 * len(got)
    rects = spark.createDataFrame([(1, 2)] + [(2, p) for p in range(1, 302)], "doc long, page int")
    plan = D.redaction_plan(tree.select("doc", "page").unionByName(spark.range(4, 302).selectExpr("2L AS doc", "int(id) AS page")), rects)
    split = {r.obj >> 16: (r.copied, r.raster, r.dropped) for r in D.page_split(held, plan).collect()}
    assert split == {3: (1, 0, False), 7: (2, 0, False), 6: (1, 0, False), 11: (1, 1, False), 4: (0, 1, True), 8: (0, 1, True), 9: (0, 1, True), 5: (1, 0, False), 10: (1, 0, False), 12: (1, 0, False)}


def test_reachable_at_any_depth(spark):
    from redactlake.operators import documents as D

    edges = spark.createDataFrame([(1, i, i + 1) for i in range(3000)] + [(1, 3000, 0), (2, 5, 6), (2, 5, 6), (3, 1, 2), (None, 1, 2), (1, None, 4)], "doc long, src long, dst long")
    roots = spark.createDataFrame([(1, 7), (1, 7), (2, 9), (4, 1), (None, 1), (3, None)], "doc long, obj long")
    got = D.reachable(edges, roots).groupBy("doc").agg(F.count("*"), F.count_distinct("obj")).collect()
    assert sorted(map(tuple, got)) == [(1, 3001, 3001), (2, 1, 1), (4, 1, 1)]
    assert D.reachable(edges, roots.where("false")).count() == 0


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_no_table_that_grows_with_the_pages_is_sent_to_the_driver(spark):
    """Saved rounds are sized by the small file they come from, so a plan would broadcast them whatever their rows."""
    nodes, roots, fonts, operators = tables(spark, {i: built(NESTED) for i in range(3)})
    rounds = []
    tree = P.page_tree(nodes, roots, lambda df: rounds.append(broadcasts(df)) or df.checkpoint())
    assert len(rounds) > 1 and not any(rounds)
    assert broadcasts(P.page_runs(tree, operators, fonts)) == 0


def test_runs_are_made_without_a_row_for_each_character(spark):
    """What is shuffled are pages, fonts and the strings that these show, however long a page's texts are."""
    nodes, roots, fonts, operators = tables(spark, {1: page_with(b"BT /A 10 Tf (abcdefghij) Tj /B 10 Tf <00010002000300010002> Tj [(klm)-250(nop)] TJ ET")})
    tree = P.page_tree(nodes, roots, lambda df: df.checkpoint())
    runs = P.page_runs(tree, operators, fonts)
    assert [r.str for r in runs.orderBy("seq").collect()] == ["abcdefghij", "ABCAB", " "]
    rows = re.findall(r"Exchange\s+hashpartitioning\(([^)]*)\)", runs._jdf.queryExecution().executedPlan().toString())
    assert rows and not any(re.search(r"\bcode#|\bseq#|\bat#", x) for x in rows), rows


def test_one_reading_gives_the_tree_the_fonts_and_the_operators(spark, monkeypatch):
    files = {1: built(NESTED), 2: page_with(b"BT /A 10 Tf (a) Tj ET", True), 3: b"hello", 4: b"%PDF-1.4\n1 0 obj<<"}
    nodes, roots, fonts, operators = tables(spark, files)
    rows = pdf.pdf_text(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file_id long, content binary")).persist()
    whole = lambda df, *columns: sorted(map(repr, df.select("doc", *columns).collect()))
    assert whole(rows.where("node is not null"), "obj", "type", "node") == whole(nodes, "obj", "type", "node")
    assert whole(rows.where("root is not null"), F.col("root").alias("obj")) == whole(roots, "obj")
    assert whole(rows.where("described is not null"), "obj", F.col("described").alias("font")) == whole(fonts, "obj", "font")
    columns = ["page", "seq", "op", "nums", "items", "font"]
    assert whole(rows.where("op is not null"), *columns) == whole(operators.where("op is not null"), *columns)
    assert sorted(r.doc for r in rows.where("error is not null").collect()) == [3, 4]
    read, times = pdf.read, []
    monkeypatch.setattr(pdf, "read", lambda data: times.append(1) or read(data))
    assert list(pdf.text_rows_of(files[2])) and len(times) == 1
