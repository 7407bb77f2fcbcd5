"""PDF files read into tables, stripped and written again."""

import zlib

import pytest
from pyspark.sql import functions as F

from redactlake.operators import documents as D
from redactlake.sources import pdf
from redactlake.sources.containers import Malformed


def packed(n, parts):
    head, at = [], 0
    for number, body in parts:
        head.append(b"%d %d" % (number, at))
        at += len(body) + 1
    first = b" ".join(head) + b" "
    raw = zlib.compress(first + b" ".join(body for _, body in parts))
    return b"%d 0 obj<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\r\n" % (n, len(parts), len(first), len(raw)) + raw + b"\nendstream endobj\n"


EVERYTHING = (
    b"%PDF-1.6\n% a comment with (parens\n1 0 obj<</Type/Catalog/Pages 2 0 R/Metadata 3 0 R/AcroForm 8 0 R/Names<</JavaScript 9 0 R/Dests 10 0 R>>/PieceInfo<<>>>>endobj\n"
    b"3 0 obj<</Type/Metadata/Length 14 0 R>>stream\nab endstream c\nendstream endobj 14 0 obj 14 endobj\n"
    b"5 0 obj<</Subtype/Image/Filter[/DCTDecode]/Metadata 3 0 R/Length 20>>stream\n\xff\xd8\xff\xe1\x00\x10Exif\x00\x00........\nendstream endobj\n"
    + packed(20, [(2, b"<</Type/Pages/Kids[4 0 R]/Count 1>>"), (4, b"<</Type/Page/Parent 2 0 R/Annots 11 0 R/Resources<</XObject<</I 5 0 R>>>>/AA<</O 9 0 R>>>>"), (7, b"<</Title<FEFF00E9>/Author(a\\(b\\)\\101(c))/ModDate(D:20240102030405+01'00')/Trapped/True/Own(kept)>>")])
    + b"8 0 obj<<>>endobj 9 0 obj<</S/JavaScript/JS(app#)>>endobj 10 0 obj[]endobj 11 0 obj[12 0 R<</Subtype/Link/A -1.50/B true>>]endobj 12 0 obj<</Subtype/Text/Contents(x)>>endobj\n"
    b"trailer<</Root 1 0 R/Info 7 0 R>>startxref 0 %%EOF"
)


def test_values():
    got = pdf.parse(b"<</A[1 -2.5 (a\\\\\\n\\\r\nb(c)) <4 1 4>]/B#20C true/D null/E 3 0 R/F/G>>", 0)[0]
    assert got == {"A": [1, -2.5, b"a\\\nb(c)", b"A@"], "B C": True, "D": None, "E": pdf.Ref(3, 0), "F": "G"} and isinstance(got["F"], pdf.Name)
    assert pdf.parse(pdf._dump(got), 0)[0] == got
    for bad in (b"<</A 1", b"[1", b"(a", b"<41", b"[" * 2000, b"}", b"<<1 2>>"):
        with pytest.raises(Malformed):
            pdf.parse(bad, 0)


def test_a_later_object_replaces_an_earlier_one():
    doc = pdf.read(b"%PDF-1.4\n1 0 obj(a)endobj 1 0 obj(b)endobj trailer<</Root 1 0 R>>trailer<</Info 2 0 R>>")
    assert doc.objects == {pdf.Ref(1, 0): b"b"} and doc.trailer == {"Root": (1, 0), "Info": (2, 0)}


def test_tables_of_a_file(spark):
    files = spark.createDataFrame([(1, bytearray(EVERYTHING)), (2, bytearray(b"%PDF-1.4\n1 0 obj(x)endobj trailer<</Encrypt 1 0 R>>")), (3, bytearray(b"hello")), (4, None), (5, bytearray(b"%PDF-1.4\n1 0 obj<<"))], "file_id long, content binary")
    tables = pdf.structure(pdf.pdf_objects(spark, files).persist())
    assert {r.obj >> 16: (r.kind, r.type) for r in tables.objects.where("doc = 1").collect()} == {1: ("dict", "Catalog"), 2: ("dict", "Pages"), 3: ("stream", "Metadata"), 4: ("dict", "Page"), 5: ("exif-image", None), 7: ("dict", None), 8: ("dict", None), 9: ("dict", None), 10: ("array", None), 11: ("array", None), 12: ("dict", None), 14: ("value", None)}
    assert {(r.src >> 16, r.key, r.dst >> 16) for r in tables.edges.collect()} == {(1, "Pages", 2), (1, "Metadata", 3), (1, "AcroForm", 8), (1, "Names/JavaScript", 9), (1, "Names/Dests", 10), (2, "Kids", 4), (3, "Length", 14), (4, "Parent", 2), (4, "Annots", 11), (4, "Resources", 5), (4, "AA", 9), (5, "Metadata", 3), (11, None, 12)}
    assert [(r.Title, r.Author, r.Created, str(r.Modified)) for r in tables.info.where("doc = 1").select("Title", "Author", "Created", F.date_format("Modified", "yyyy-MM-dd HH:mm:ss").alias("Modified")).collect()] == [("é", "a(b)A(c)", None, "2024-01-02 02:04:05")]
    assert {r.id: r.n for r in D.count_findings(D.object_counts(tables.objects, tables.annotations)).collect()} == {"xmp": 1, "annots": 1, "links": 1, "javascript": 1, "exif": 1, "pieceinfo": 1}
    assert tables.encrypted.collect() == [(2,)] and sorted(r.doc for r in tables.errors.collect()) == [3, 4, 5]
    left, edges, _ = D.strip_all(tables.objects, tables.edges, tables.info, tables.roots, lambda df: df.persist())
    assert sorted(r.obj >> 16 for r in left.collect()) == [1, 2, 4, 5, 7, 10]


def test_a_cleaned_file_has_nothing_to_find(spark):
    files = spark.createDataFrame([(1, bytearray(EVERYTHING)), (2, bytearray(b"%PDF-1.4\n1 0 obj(x)endobj trailer<</Encrypt 1 0 R>>")), (3, bytearray(b"%PDF-1.4\n1 0 obj(x)endobj"))], "file_id long, content binary")
    done = {r.file_id: r for r in pdf.clean_files(files).collect()}
    assert done[2].content is None and done[2].error == "encrypted"
    again = pdf.read(bytes(done[1].content))
    assert sorted(ref.number for ref in again.objects) == [1, 2, 4, 5, 7, 10]
    assert again.objects[pdf.Ref(7, 0)] == {**dict.fromkeys(D.INFO_KEYS, b""), "Own": b"kept"}
    assert again.objects[pdf.Ref(5, 0)].raw == pdf.read(EVERYTHING).objects[pdf.Ref(5, 0)].raw
    tables = pdf.structure(pdf.pdf_objects(spark, spark.createDataFrame([(1, done[1].content)], "file_id long, content binary")).persist())
    assert {r.id for r in D.count_findings(D.object_counts(tables.objects, tables.annotations)).collect()} == {"exif"}  # picture data stay as they are
    assert pdf.read(bytes(done[3].content)).objects.keys() == {(1, 0), (2, 0)}  # no root: all stays


def test_the_cross_reference_stream_names_every_object():
    made = pdf.save(pdf.read(EVERYTHING))
    at = int(made[made.rindex(b"startxref") + 10 :].split()[0])
    entries, end = pdf.parse(made, made.index(b"obj", at) + 3)
    table = zlib.decompress(pdf._raw(made, made.index(b"stream", end) + 6, entries, {})[0])
    found = {n: (table[i * 11], int.from_bytes(table[i * 11 + 1 : i * 11 + 9]), int.from_bytes(table[i * 11 + 9 : i * 11 + 11])) for i, n in enumerate(entries["Index"][::2])}
    assert all(made.startswith(b"%d %d obj" % (n, g), place) for n, (kind, place, g) in found.items() if kind == 1)
    assert {n for n, (kind, *_) in found.items() if kind} >= {ref.number for ref in pdf.read(EVERYTHING).objects}
