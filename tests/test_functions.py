"""Golden values of scalar functions, and what decides a leak."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactlake.functions import text as T
from redactlake.operators import regions as R
from redactlake.operators import verify as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("before", "after", "want"), [(1000, 250, 75), (1000, 1200, -20), (1000, 1000, 0), (0, 100, 0), (200, 205, -2)])
def test_percent_saved(spark, before, after, want):
    assert value(spark, T.percent_saved(F.lit(before), F.lit(after))) == want


@pytest.mark.parametrize(("n", "want"), [(512, "512 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1048575, "1024.0 KB"), (1048576, "1.00 MB"), (1280, "1.3 KB"), (0, "0 B")])
def test_format_bytes(spark, n, want):
    assert value(spark, T.format_bytes(F.lit(n).cast("bigint"))) == want


@pytest.mark.parametrize("degrees", [1.5, -0.000004, 123.456789, 1.000005, 0.000015, 1.000025, -43.002545, 179.9999999, 0.0])
def test_coordinate(spark, degrees):
    assert value(spark, T.coordinate(F.lit(degrees))) == f"{degrees:.5f}"


@pytest.mark.parametrize(
    ("text", "term", "want"),
    [("the Appendix.", "Appendix", True), ("the Appendix.", "ppen", False), ("Phone: +1 (555) 123-4567", "+1 (555) 123-4567", True), ("15.5", "5.5", False), ("Anaïs", "Ana", False), ("Anaïs", "anaïs", True), ("flee", "lee", False), ("John\nSmith", "John Smith", True), ("a  b", "a b", True)],
)
def test_survives_as_a_word(spark, text, term, want):
    assert value(spark, T.survives(T.flat(F.lit(text)), T.flat(F.lit(term)))) is want
    pages = spark.createDataFrame([(1, 1, text), (1, 2, "other")], "doc long, page int, text string")
    found = V.surviving_pages(pages, spark.createDataFrame([(term,), (" ",)], "term string")).collect()
    assert [r.pages for r in found] == ([[1]] if want else [])


def test_terms_without_a_word(spark):
    pages = spark.createDataFrame([(1, 1, "costs $$ now"), (1, 2, "a$$b")], "doc long, page int, text string")
    assert [r.pages for r in V.surviving_pages(pages, spark.createDataFrame([("$$",)], "term string")).collect()] == [[1]]


def test_term_across_a_page_break_leaks_in_the_document_only(spark):
    pages = spark.createDataFrame([(1, 1, "seen John"), (1, 2, "Smith here")], "doc long, page int, text string")
    terms = spark.createDataFrame([("John Smith",)], "term string")
    assert V.surviving_pages(pages, terms).count() == 0
    assert V.leaked_terms(V.document_text(pages), terms).count() == 1


def test_haystack_carries_a_line_end_from_an_empty_run(spark):
    runs = [(1, 1, 0, "John", False), (1, 1, 1, "", True), (1, 1, 2, "Smith", True), (1, 1, 3, None, True), (1, 1, 4, "x", False)]
    placed = V.haystack_offsets(spark.createDataFrame(runs, "doc long, page int, seq int, str string, has_eol boolean"))
    assert [(r.seq, r.start) for r in placed.orderBy("seq").collect()] == [(0, 0), (2, 5), (4, 11)]
    spans = [(r.seq, r.from_char, r.to_char) for r in V.match_spans(placed, "john  SMITH").orderBy("seq").collect()]
    assert spans == [(0, 0, 4), (2, 0, 5)]


def picture(visible, side=100):
    rgb = np.zeros((side, side), float)
    rgb.flat[:0] = 0
    out = rgb.copy()
    inner = out[1 : side - 1, 1 : side - 1]
    inner.flat[:visible] = 255
    out[1 : side - 1, 1 : side - 1] = inner
    return rgb, out


@pytest.mark.parametrize(("visible", "want"), [(0, False), (10, False), (64, False), (65, True), (100, True)])
def test_region_leaks(visible, want):
    source, output = picture(visible)
    assert R.region_leaks(source, output, (0, 0, 1, 1)) is want


def test_region_leaks_fails_closed():
    assert R.region_leaks(np.zeros((4, 4)), np.zeros((4, 5)), (0, 0, 1, 1))
    assert not R.region_leaks(np.full((50, 50), 255.0), np.full((50, 50), 255.0), (0, 0, 1, 1))


def test_uncovered(spark):
    side = 20
    white, black = bytes([255, 255, 255, 255]) * side * side, bytes([0, 0, 0, 255]) * side * side
    kind = "doc bigint, page int, width int, height int, rgba binary"
    source = spark.createDataFrame([(1, 1, side, side, bytearray(black)), (1, 2, side, side, bytearray(black))], kind)
    output = spark.createDataFrame([(1, 1, side, side, bytearray(black)), (1, 2, side, side, bytearray(white))], kind)
    boxes = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 1.0, 1.0), (1, 2, 8, 0.0, 0.0, 1.0, 1.0)], "doc bigint, page int, rect_id bigint, x double, y double, w double, h double")
    assert [r.rect_id for r in R.uncovered(source, output, boxes).collect()] == [8]


def test_png_reads_back(spark):
    from redactlake.operators.media import strip_bytes

    made = R.encode_png(R.on_white(bytes([255, 0, 0, 128]) * 6, 3, 2))
    assert strip_bytes(made)[0] == made


def test_garbage_collection_keeps_everything_without_a_root(spark):
    from redactlake.operators import documents as D

    objects = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "doc long, obj long")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1)], "doc long, src long, dst long")
    roots = spark.createDataFrame([(1, 1)], "doc long, obj long")
    assert {tuple(r) for r in D.collect_garbage(objects, edges, roots).collect()} == {(1, 1), (1, 2), (2, 1)}


def test_exif_segment_in_the_first_64_kib(spark):
    from redactlake.operators.documents import has_exif_segment

    hit = b"\xff\xe1\x00\n" + b"Exif\0\0"
    rows = spark.createDataFrame([(1, bytearray(b"ab" + hit)), (2, bytearray(bytes(70000) + hit)), (3, bytearray(b"\xff\xe1Exif\0\0"))], "id int, c binary")
    assert [r.v for r in rows.orderBy("id").select(has_exif_segment(F.col("c")).alias("v")).collect()] == [True, False, False]


def test_sketches_of_parts_merge_into_those_of_the_whole(spark):
    from pyspark.sql import functions as F

    from redactlake.operators import sketches as S

    rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("part"), (F.col("id") % 5_000).alias("who"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("value"))
    found = S.estimates(S.rolled(S.sketched(rows, ["k", "part"], "who", "value"), ["k"]), (0.0, 0.5, 1.0)).collect()
    assert len(found) == 3
    for r in found:
        assert r.n in (6666, 6667) and abs(r.n_distinct - 5000) <= 250
        assert abs(r.quantiles[1] - 10_000) <= 600 and r.quantiles[0] <= 3 and r.quantiles[2] >= 19_990
