"""Export of cleaned PDF files in stages: clean, stage, read again, verify, and only then publish by a manifest.

A folder holds two tables, both parted by batch: staged (cleaned bytes) and manifest (what became of each
document). The manifest of a batch is written last, by Spark's commit, and names what is published, so readers
never see a document that wasn't verified, nor half a batch. A batch that is played again replaces its own
parts by the same rows; other batches are not touched. A stream exports by foreachBatch(), whose batch ids are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.operators import documents as D
from redactlake.operators.rounds import saver, unsent
from redactlake.sources import pdf


def publish(files: DataFrame, folder: str, batch: int, plan: DataFrame | None = None) -> None:
    """Exports files(file_id, content) as one batch; see published() and manifest().

    A file is refused if it can't be read, is encrypted, still has a finding (but for EXIF inside of pictures) or
    an information string when its cleaned bytes are read again, or, by plan(doc, page, route, error) as
    redaction_plan() gives it, if its redactions are refused or need pages that would have to be rendered.
    Repeated file ids are refused all. Null ids take no part.
    """
    spark = files.sparkSession
    kept = files.where("file_id is not null")
    staged = f"{folder}/staged/batch={batch}"
    pdf.clean_files(kept).write.mode("overwrite").parquet(staged)
    cleaned = spark.read.parquet(staged)
    whole = cleaned.where("content is not null").select("file_id", "content").repartition(spark.sparkContext.defaultParallelism)  # a few bytes take long to read
    again = saver(spark)(pdf.pdf_objects(spark, whole).drop("node", "font"))  # read once for all that follows
    told = again.groupBy("doc").agg(F.max("error").alias("unreadable"), F.max(F.exists(F.map_values(F.coalesce("strings", F.create_map().cast("map<string,string>"))), lambda s: s != "")).alias("named"))
    parts = pdf.structure(again)
    found = D.count_findings(D.object_counts(parts.objects, parts.annotations)).where("id <> 'exif'").groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("found"))  # of at most eight kinds
    per_id = cleaned.groupBy("file_id").agg(F.count("*").alias("n"), F.first("error").alias("error"), F.first(F.sha2("content", 256)).alias("sha256"))
    rows = per_id.join(unsent(told.withColumnRenamed("doc", "file_id")), "file_id", "left").join(unsent(found.withColumnRenamed("doc", "file_id")), "file_id", "left")
    reason = F.coalesce(
        F.when(F.col("n") > 1, "repeated id"),
        F.col("error"),
        F.col("unreadable"),
        F.when(F.col("named"), "information strings are left"),
        F.concat(F.lit("findings are left: "), F.nullif(F.col("found"), F.lit(""))),
    )
    if plan is not None:
        refused = plan.groupBy(F.col("doc").alias("file_id")).agg(F.max("error").alias("planned"), F.count_if(F.col("route") == "raster").alias("raster"))
        rows = rows.join(unsent(refused), "file_id", "left")
        reason = F.coalesce(F.when(F.col("n") > 1, "repeated id"), F.col("planned"), F.when(F.col("raster") > 0, F.concat(F.col("raster").cast("string"), F.lit(" pages to render"))), reason)
    rows = rows.select("file_id", F.when(reason.isNull(), "published").otherwise("refused").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("sha256")).alias("sha256"))
    rows.write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, status, reason, sha256, batch) of all batches whose export has ended."""
    return spark.read.option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest").withColumn("batch", F.col("batch").cast("bigint"))


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, batch, content) of the documents that manifests publish."""
    named = manifest(spark, folder).where("status = 'published'").select("batch", "file_id")
    staged = spark.read.option("basePath", f"{folder}/staged").parquet(f"{folder}/staged").withColumn("batch", F.col("batch").cast("bigint"))
    return staged.join(unsent(named), ["batch", "file_id"], "left_semi").select("file_id", "batch", "content")
