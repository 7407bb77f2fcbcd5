"""Export in stages: nothing unverified is published, and a batch played again changes nothing."""

from redactlake.operators import export as E
from redactlake.sources import pdf
from test_pdf import EVERYTHING


def listed(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_dir())


def test_a_batch_played_again_changes_nothing(spark, tmp_path):
    files = spark.createDataFrame([(1, bytearray(EVERYTHING)), (2, bytearray(b"%PDF-1.4\n1 0 obj(x)endobj trailer<</Encrypt 1 0 R>>")), (3, bytearray(b"hello")), (4, None), (5, bytearray(EVERYTHING)), (5, bytearray(EVERYTHING)), (None, bytearray(EVERYTHING))], "file_id long, content binary")
    folder = f"file://{tmp_path}/out"
    E.publish(files, folder, 0)
    E.publish(files.where("file_id = 1").selectExpr("file_id + 10 AS file_id", "content"), folder, 1)
    first = sorted(map(repr, E.manifest(spark, folder).collect())), sorted(map(repr, E.published(spark, folder).collect())), listed(tmp_path)
    E.publish(files, folder, 0)
    assert first == (sorted(map(repr, E.manifest(spark, folder).collect())), sorted(map(repr, E.published(spark, folder).collect())), listed(tmp_path))
    got = {r.file_id: (r.status, r.reason) for r in E.manifest(spark, folder).collect()}
    assert got[1] == got[11] == ("published", None) and got[2] == ("refused", "encrypted") and got[5] == ("refused", "repeated id")
    assert got[3][0] == got[4][0] == "refused" and len(got) == 6
    assert sorted((r.file_id, r.batch) for r in E.published(spark, folder).collect()) == [(1, 0), (11, 1)]


def test_what_is_left_after_cleaning_is_not_published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pdf, "clean_files", lambda files: files.selectExpr("file_id", "content", "CAST(NULL AS STRING) AS error"))  # a clean that does nothing
    files = spark.createDataFrame([(1, bytearray(EVERYTHING)), (2, bytearray(b"%PDF-1.4\n1 0 obj<</Type/Catalog/Names<</X 2 0 R>>>>endobj 2 0 obj<</S/JavaScript>>endobj trailer<</Root 1 0 R>>")), (3, bytearray(b"%PDF-1.4\n1 0 obj<</Type/Catalog>>endobj trailer<</Root 1 0 R>>"))], "file_id long, content binary")
    E.publish(files, f"file://{tmp_path}/out", 7)
    got = {r.file_id: r.reason for r in E.manifest(spark, f"file://{tmp_path}/out").collect()}
    assert got == {1: "information strings are left", 2: "findings are left: javascript", 3: None}


def test_redactions_that_need_pages_rendered_are_refused(spark, tmp_path):
    files = spark.createDataFrame([(i, bytearray(EVERYTHING)) for i in (1, 2, 3)], "file_id long, content binary")
    plan = spark.createDataFrame([(1, 1, "raster", None), (1, 2, "copy", None), (2, 1, None, "301 pages to rasterise, limit 300"), (3, 1, "copy", None)], "doc long, page int, route string, error string")
    E.publish(files, f"file://{tmp_path}/out", 0, plan)
    got = {r.file_id: r.reason for r in E.manifest(spark, f"file://{tmp_path}/out").collect()}
    assert got == {1: "1 pages to render", 2: "301 pages to rasterise, limit 300", 3: None}


def test_cleaned_files_are_read_again_once(spark, tmp_path, monkeypatch):
    seen, read = spark.sparkContext.accumulator(0), pdf.pdf_objects

    def counted(session, files):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return read(session, files.mapInArrow(run, files.schema))

    monkeypatch.setattr(pdf, "pdf_objects", counted)
    E.publish(spark.createDataFrame([(i, bytearray(EVERYTHING)) for i in range(5)], "file_id long, content binary"), f"file://{tmp_path}/out", 0)
    assert seen.value == 5
