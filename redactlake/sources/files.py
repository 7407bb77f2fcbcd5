"""Files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.functions import media


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_id, path, length, content, format, error) of all files under a path; the format comes from the bytes.

    A file's row has an error instead of failing the job. file_id is a hash of the path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    empty = F.when(F.length("content") == 0, "empty file")
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "length", "content", media.detect_format("content").alias("format"), F.coalesce(empty, media.format_error("content")).alias("error"))


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same, for files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "length", "content", media.detect_format("content").alias("format"), media.format_error("content").alias("error"))


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Writes each row's bytes to a file of its own, by the executors, through Arrow's file systems; folder is a URI or a shared path."""

    def write(batches):
        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for batch in batches:
            for file, data in zip(batch.column(name).to_pylist(), batch.column(content).to_pylist(), strict=True):
                if file and data is not None:
                    with system.open_output_stream(f"{root}/{file.replace('/', '_')}") as out:
                        out.write(data)
        yield from ()

    files.select(name, content).mapInArrow(write, "done int").collect()  # no rows


def is_pdf_name(name, mime=None):
    by_name = F.rlike(name, F.lit(r"(?i)\.pdf$"))
    return by_name if mime is None else by_name | (mime == "application/pdf")
