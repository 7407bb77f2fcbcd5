"""Pixels of pictures: orientation, size, and what shows through a cover.

A picture is a row (width, height, rgba), four bytes a pixel from the top left. Pictures stay where Spark has
put them: each is worked on by arrays within its task, and what is asked of it travels to it as a small array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.operators.rounds import unsent
from redactlake.sources import containers, exif
from redactlake.sources.containers import Malformed

PAGE = ("doc", "page")


def _picture(raw: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 4)


def luma(rgba: np.ndarray) -> np.ndarray:
    """Brightness over white."""
    p = rgba.astype(np.float64)
    alpha = p[..., 3] / 255
    return alpha * (p[..., 0] * 0.299 + p[..., 1] * 0.587 + p[..., 2] * 0.114) + (1 - alpha) * 255


def summed(mask: np.ndarray) -> np.ndarray:
    """Summed-area table: how many are set above and to the left of each corner."""
    out = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    out[1:, 1:] = mask.cumsum(axis=0).cumsum(axis=1)
    return out


def _within(table: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    return table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]


def coverage(images: DataFrame, outputs: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, page, rect_id, ink, leaked, leaks) of regions(doc, page, rect_id, x, y, w, h): dark pixels of the source in a
    region, those of them that aren't black in the output, and whether that is too many for one of the rectangle's regions.

    images, outputs(doc, page, width, height, rgba). Tables of sums over both masks make a region four
    lookups, whatever its size. Where the two pictures differ in size, all of a page's regions leak, without
    counts; a page without a picture on either side has none. ink and leaked are of the region that leaks most.
    """
    asked = regions.where("rect_id is not null").groupBy(*PAGE).agg(F.collect_list(F.struct("rect_id", *(F.col(c).cast("double").alias(c) for c in "xywh"))).alias("regions"))  # of one page
    made = outputs.select(*PAGE, F.col("width").alias("out_width"), F.col("height").alias("out_height"), F.col("rgba").alias("out_rgba"))
    both = images.select(*PAGE, "width", "height", "rgba").join(unsent(made), list(PAGE)).join(unsent(asked), list(PAGE))
    kinds = {c: both.schema[c].dataType.simpleString() for c in PAGE}
    rect_kind = regions.schema["rect_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                one = lambda c, row=row: row.column(c)[0].as_py()
                boxes = row.column("regions").flatten()
                n, w, h = len(boxes), one("width"), one("height")
                same = (w, h) == (one("out_width"), one("out_height"))
                ink = leaked = pa.nulls(n, pa.int64())
                if same:
                    dark = luma(_picture(one("rgba"), w, h)) <= G.INK_LUMA
                    shown = dark & (luma(_picture(one("out_rgba"), w, h)) > G.BLACK_LUMA)
                    x, y, bw, bh = (boxes.field(c).to_numpy(zero_copy_only=False) for c in "xywh")
                    x0, y0 = np.floor(np.maximum(0, x) * w) + 1, np.floor(np.maximum(0, y) * h) + 1
                    x1, y1 = np.ceil(np.minimum(1, x + bw) * w) - 1, np.ceil(np.minimum(1, y + bh) * h) - 1
                    some = (x1 > x0) & (y1 > y0)
                    corners = [np.where(some, v, 0).astype(np.int64) for v in (x0, y0, x1, y1)]
                    ink, leaked = (pa.array(_within(summed(mask), *corners)) for mask in (dark, shown))
                keys = [row.column(c).take(pa.array(np.zeros(n, np.int64))) for c in PAGE]
                yield pa.record_batch([*keys, boxes.field("rect_id"), pa.array(np.full(n, same)), ink, leaked], [*PAGE, "rect_id", "same", "ink", "leaked"])

    found = both.mapInArrow(run, f"doc {kinds['doc']}, page {kinds['page']}, rect_id {rect_kind}, same boolean, ink bigint, leaked bigint")
    found = found.withColumn("leaks", ~F.col("same") | G.leaks(F.col("ink"), F.col("leaked")))
    worst = F.max(F.struct("leaks", "leaked", "ink")).alias("m")
    return found.groupBy(*PAGE, "rect_id").agg(worst).select(*PAGE, "rect_id", "m.ink", "m.leaked", "m.leaks")


def turned(picture: np.ndarray, orientation: int) -> np.ndarray:
    """The picture as an EXIF orientation from 1 to 8 wants it seen; others leave it as it is."""
    if orientation in (5, 6, 7, 8):
        picture = picture.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        picture = picture[::-1]
    return picture[:, ::-1] if orientation in (2, 3, 6, 7) else picture


def resampled(picture: np.ndarray, width: int, height: int) -> np.ndarray:
    """Scaled down: each pixel is the mean of the area it covers, colours by their opacity; along one axis, then the other.

    Sums up to fractional places come from running sums, so an axis costs the same for every scale.
    """
    p = picture.astype(np.float64)
    p[..., :3] *= p[..., 3:] / 255
    for axis, size in ((0, height), (1, width)):
        n = p.shape[axis]
        if size == n:
            continue
        sums = np.concatenate([np.zeros_like(p.take([0], axis)), p.cumsum(axis=axis)], axis=axis)
        edges = np.arange(size + 1) * n / size
        whole = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - whole).reshape([-1 if a == axis else 1 for a in range(3)])
        upto = sums.take(whole, axis) + part * p.take(whole, axis)
        p = np.diff(upto, axis=axis) * size / n
    p[..., :3] *= 255 / np.maximum(p[..., 3:], 1e-9)
    return np.clip(np.floor(p + 0.5), 0, 255).astype(np.uint8)


def oriented(pictures: DataFrame, most: int | None = None) -> DataFrame:
    """pictures(..., width, height, rgba, orientation) upright, and scaled down so that no side is over most; other columns stay.

    Null or unknown orientations leave a picture as it is; a null picture stays null. Nothing is scaled up.
    """
    shown_width = F.when(F.col("orientation").between(5, 8), F.col("height")).otherwise(F.col("width"))
    shown_height = F.when(F.col("orientation").between(5, 8), F.col("width")).otherwise(F.col("height"))
    w, h = G.fit_within(shown_width, shown_height, F.lit(most).cast("int"))
    rows = pictures.withColumn("_w", w.cast("int")).withColumn("_h", h.cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw, w, h, way, to_w, to_h = (row.column(c)[0].as_py() for c in ("rgba", "width", "height", "orientation", "_w", "_h"))
                new = {"width": w, "height": h, "rgba": raw}
                if raw is not None:
                    picture = turned(_picture(raw, w, h), way or 1)
                    new = {"width": to_w, "height": to_h, "rgba": (resampled(picture, to_w, to_h) if (to_h, to_w) != picture.shape[:2] else picture).tobytes()}
                columns = [pa.array([new[f.name]], f.type) if f.name in new else row.column(f.name) for f in batch.schema if f.name not in ("_w", "_h")]
                yield pa.record_batch(columns, [f.name for f in batch.schema if f.name not in ("_w", "_h")])

    return rows.mapInArrow(run, pictures.schema)


def _orientation_of(data: bytes) -> int | None:
    """The orientation that a file's EXIF block names, if it has one that can be read."""
    form = containers.detect(data)
    try:
        for code, marker, _, _, at, length in containers.WALKS[form](data) if form else ():
            prefix = 6 if at is not None and data[at : at + 6] == b"Exif\0\0" else 0
            if code in ("eXIf", "EXIF") or (form == "jpeg" and marker == 0xE1 and prefix):
                return exif.orientation(data[at : at + length], prefix)
    except Malformed:
        return None
    return None


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, rgba, orientation, error) of the JPEG and PNG files in a folder, as they are stored; see oriented().

    Spark's image source decodes them. A file that it can't decode has a null picture and an error; Spark lists no empty files.
    """
    decoded = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, width, height, channels, data = (batch.column(c)[i].as_py() for c in ("origin", "width", "height", "nChannels", "data"))
                rgba = None
                if channels in (1, 3, 4):
                    held = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                    rgb = held[..., [2, 1, 0]] if channels > 1 else held.repeat(3, axis=2)
                    alpha = held[..., 3:] if channels == 4 else np.full((height, width, 1), 255, np.uint8)
                    rgba = np.concatenate([rgb, alpha], axis=2).tobytes()
                kept = (width, height) if rgba is not None else (None, None)
                yield pa.record_batch([pa.array([v], t) for v, t in zip((origin, *kept, rgba), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["file", "width", "height", "rgba"])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_orientation_of(c.as_py() or b"") for c in batch.column("content")]
            yield pa.record_batch([batch.column("file"), pa.array(found, pa.int32())], ["file", "orientation"])

    seen = decoded.mapInArrow(pixels, "file string, width int, height int, rgba binary")
    named = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  (the two sources spell a path's start in their own ways)
    known = files.mapInArrow(ways, "file string, orientation int").select(named("file").alias("of"), "orientation")
    joined = known.join(seen.withColumn("seen", named("file")).drop("file"), F.col("of") == F.col("seen"), "left")
    return joined.select(F.col("of").alias("file"), "width", "height", "rgba", "orientation", F.when(F.col("rgba").isNull(), "picture can't be decoded").alias("error"))
