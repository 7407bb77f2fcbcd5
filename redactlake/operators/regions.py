"""Rectangles against runs and pictures: joins of boxes within a page, and what shows through a cover."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.functions import geometry as G
from redactlake.functions import text as T

PAGE = ("doc", "page")


def _paired(rects: DataFrame, runs: DataFrame, how: str, condition) -> DataFrame:
    """Pages first: a page has few boxes, so only those of one page meet."""
    right = runs.select(*(F.col(c).alias(f"run_{c}") for c in runs.columns))
    on = (F.col("doc") == F.col("run_doc")) & (F.col("page") == F.col("run_page")) & condition(G.Box.of(), G.Box.of("run_"))
    return rects.join(right, on, how)


def boxed_terms(rects: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, term): distinct trimmed texts of runs(doc, page, str, x, y, w, h) that a rectangle covers by half their height."""
    left = runs.where(~T.is_blank(F.col("str")))
    right = rects.select(*(F.col(c).alias(f"rect_{c}") for c in ("doc", "page", "x", "y", "w", "h")))
    on = (F.col("doc") == F.col("rect_doc")) & (F.col("page") == F.col("rect_page")) & G.covers(G.Box.of(), G.Box.of("rect_"))
    return left.join(right, on, "left_semi").select("doc", T.trim(F.col("str")).alias("term")).distinct()


def check_regions(rects: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, page, rect_id, x, y, w, h): what to look at for each rectangle: itself, and runs that a searched one spans."""
    own = rects.select("doc", "page", "rect_id", "x", "y", "w", "h")
    searched = _paired(rects.where("term is not null"), runs, "inner", lambda rect, run: G.overlaps(rect, run) & G.spans(rect, run, F.col("run_vertical")))
    return own.unionByName(searched.select("doc", "page", "rect_id", *(F.col(f"run_{c}").alias(c) for c in "xywh")))


def uncovered(images: DataFrame, outputs: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc, page, rect_id) of rectangles that show ink through. images, outputs(doc, page, width, height, rgba); regions as check_regions().

    A page's two pictures and its regions meet in one task. Pictures of different size count as a leak.
    """
    both = images.join(outputs.select(*PAGE, F.col("width").alias("out_width"), F.col("height").alias("out_height"), F.col("rgba").alias("out_rgba")), list(PAGE))

    def check(pictures: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        hits = []
        for page in pictures.itertuples():
            source, output = (luma_of(raw, w, h) for raw, w, h in ((page.rgba, page.width, page.height), (page.out_rgba, page.out_width, page.out_height)))
            hits += [(b.doc, b.page, b.rect_id) for b in boxes.itertuples() if region_leaks(source, output, (b.x, b.y, b.w, b.h))]
        return pd.DataFrame(sorted(set(hits)), columns=["doc", "page", "rect_id"])

    return both.groupBy(*PAGE).cogroup(regions.groupBy(*PAGE)).applyInPandas(check, "doc bigint, page int, rect_id bigint")


def luma_of(rgba: bytes, width: int, height: int) -> np.ndarray:
    p = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.float64)
    alpha = p[..., 3] / 255
    return alpha * (p[..., :3] @ np.array([0.299, 0.587, 0.114])) + (1 - alpha) * 255


def region_leaks(source: np.ndarray, output: np.ndarray, box: tuple[float, float, float, float]) -> bool:
    if source.shape != output.shape:
        return True
    h, w = source.shape
    x, y, bw, bh = box
    x0, y0 = int(np.floor(max(0, x) * w)) + 1, int(np.floor(max(0, y) * h)) + 1
    x1, y1 = int(np.ceil(min(1, x + bw) * w)) - 1, int(np.ceil(min(1, y + bh) * h)) - 1
    if x1 <= x0 or y1 <= y0:
        return False
    ink = source[y0:y1, x0:x1] <= G.INK_LUMA
    leaked = int((ink & (output[y0:y1, x0:x1] > G.BLACK_LUMA)).sum())
    return bool(ink.any()) and (leaked > G.LEAK_PIXELS or leaked / int(ink.sum()) > G.LEAK_SHARE)


def on_white(rgba: bytes, width: int, height: int) -> np.ndarray:
    """RGB over white, for formats without transparency."""
    p = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.float64)
    alpha = p[..., 3:] / 255
    return np.floor(alpha * p[..., :3] + (1 - alpha) * 255 + 0.5).astype(np.uint8)


def encode_png(rgb: np.ndarray, level: int = 6) -> bytes:
    """An RGB or RGBA array as a PNG file."""
    import struct
    import zlib

    height, width, channels = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgb))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if channels == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def keyboard_boxes(keys: DataFrame) -> DataFrame:
    """(doc, x, y, w, h): where keys(doc, seq, key, shift) have taken a box: arrows move it, with shift they size it.

    The box starts in the middle of the page, moves and grows by fixed steps, and stays on the page.
    """
    x, y, w, h = G.KEY_BOX
    start = F.struct(*(F.lit(v).alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "key", "shift")))
    step, least, one, zero = F.lit(G.KEY_STEP), F.lit(G.KEY_LEAST), F.lit(1.0), F.lit(0.0)

    def axis(box, key, place, side, back, forth):
        is_back, is_forth = key["key"] == back, key["key"] == forth
        moved = F.when(is_back, F.greatest(zero, box[place] - step)).when(is_forth, F.least(one - box[side], box[place] + step)).otherwise(box[place])
        sized = F.when(is_back, F.greatest(least, box[side] - step)).when(is_forth, F.least(one - box[place], box[side] + step)).otherwise(box[side])
        return F.when(key["shift"], box[place]).otherwise(moved), F.when(key["shift"], sized).otherwise(box[side])

    def press(box, key):
        nx, nw = axis(box, key, "x", "w", "left", "right")
        ny, nh = axis(box, key, "y", "h", "up", "down")
        return F.struct(nx.alias("x"), ny.alias("y"), nw.alias("w"), nh.alias("h"))

    return keys.groupBy("doc").agg(F.aggregate(ordered, start, press).alias("b")).select("doc", "b.*")
