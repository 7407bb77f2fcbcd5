"""Geometry of pages, runs of text and boxes, as column expressions.

Boxes are in shares of the page from its top left corner. Whatever covers errs to the outside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Canvas limits, in pixels.
MAX_SIDE, MAX_AREA = 8192, 16_777_216
#: Pages that one export may flatten.
MAX_RASTER_PAGES = 300
#: Least cover above and below the baseline, in font heights, and a box's reach below it.
ASCENT, DESCENT, BOX_DESCENT = 1.15, 0.3, 0.28
#: Margin beside a match: share of the page's width, or of the font height.
MARGIN_PAGE, MARGIN_FONT = 0.0015, 0.08
#: Coverage check: scale, luma of ink and of black, and what may show through.
COVER_SCALE, INK_LUMA, BLACK_LUMA, LEAK_SHARE, LEAK_PIXELS = 2, 200, 24, 0.03, 64
SPAN_EPSILON = 1e-4
#: Smallest box drawn by pointer; and by keyboard: start, step, smallest side.
DRAWN_LEAST = 0.005
KEY_BOX, KEY_STEP, KEY_LEAST = (0.4, 0.45, 0.2, 0.1), 0.02, 0.01


@dataclass
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + c) for c in "xywh"))


def clamp_scale(width: Column, height: Column, scale: Column) -> Column:
    return F.least(scale.cast("double"), MAX_SIDE / width, MAX_SIDE / height, F.sqrt(MAX_AREA / (width * height)))


def vertical_cover(ascent: Column, descent: Column) -> tuple[Column, Column]:
    """(above, below) the baseline; unknown metrics are null."""
    return F.greatest(F.lit(ASCENT), F.coalesce(ascent, F.lit(0.0))), F.greatest(F.lit(DESCENT), F.abs(F.coalesce(descent, F.lit(0.0))))


def safety_margin(page_width: Column, font_height: Column) -> Column:
    return F.greatest(page_width * MARGIN_PAGE, font_height * MARGIN_FONT)


def font_height(height: Column, c: Column, d: Column) -> Column:
    """The first of these that isn't zero or unknown: the run's height, its matrix's second axis, that axis's last part."""
    return F.coalesce(F.nullif(height, F.lit(0.0)), F.nullif(F.hypot(c, d), F.lit(0.0)), F.abs(d))


def match_extent(origin: Column, width: Column, direction: Column, before: Column, matched: Column, margin: Column, at_start: Column, at_end: Column) -> tuple[Column, Column]:
    """(left, right) of a match in a run. Runs that aren't plain left to right are covered whole."""
    right = origin + width
    whole = F.coalesce(direction, F.lit("")) != "ltr"
    return F.when(whole | at_start, origin).otherwise(F.greatest(origin, origin + before - margin)), F.when(whole | at_end, right).otherwise(F.least(right, origin + before + matched + margin))


def run_box(matrix: list[Column], viewport: list[Column], page_width: Column, page_height: Column, along: tuple[Column, Column], across: tuple[Column, Column]) -> Box:
    """The upright box around a run's rectangle, of lengths along and across its baseline, seen through the viewport."""
    a, b, c, d, e, f = matrix
    t = viewport
    least = F.lit(4.9e-324)
    along_length, across_length = F.greatest(F.hypot(a, b), least), F.greatest(F.hypot(c, d), least)
    xs, ys = [], []
    for s in along:
        for u in across:
            px = e + s * a / along_length + u * c / across_length
            py = f + s * b / along_length + u * d / across_length
            xs.append((px * t[0] + py * t[2] + t[4]) / page_width)
            ys.append((px * t[1] + py * t[3] + t[5]) / page_height)
    x, y = F.least(*xs), F.least(*ys)
    return Box(x, y, F.greatest(*xs) - x, F.greatest(*ys) - y)


def is_vertical(a: Column, b: Column, viewport: list[Column]) -> Column:
    t = viewport
    return F.abs(a * t[1] + b * t[3]) > F.abs(a * t[0] + b * t[2])


def overlaps(p: Box, q: Box) -> Column:
    """Boxes that only touch don't overlap."""
    return (p.x + p.w > q.x) & (q.x + q.w > p.x) & (p.y + p.h > q.y) & (q.y + q.h > p.y)


def covers(run: Box, rect: Box) -> Column:
    """The rectangle overlaps the run and shares half of its height at least."""
    return overlaps(run, rect) & (F.least(run.y + run.h, rect.y + rect.h) - F.greatest(run.y, rect.y) >= run.h / 2)


def spans(rect: Box, run: Box, vertical: Column) -> Column:
    """The rectangle reaches from end to end of the run, along its baseline."""
    across = (rect.x <= run.x + SPAN_EPSILON) & (rect.x + rect.w >= run.x + run.w - SPAN_EPSILON)
    down = (rect.y <= run.y + SPAN_EPSILON) & (rect.y + rect.h >= run.y + run.h - SPAN_EPSILON)
    return F.when(vertical, down).otherwise(across)


def clipped(box: Box) -> Box:
    """As search results are: origin not below 0, sides not above 1, each by itself."""
    return Box(F.greatest(F.lit(0.0), box.x), F.greatest(F.lit(0.0), box.y), F.least(F.lit(1.0), box.w), F.least(F.lit(1.0), box.h))


def pixel_fill(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) of the pixels that a box blacks out: outward to whole ones."""
    return F.floor(box.x * width), F.floor(box.y * height), F.ceil((box.x + box.w) * width), F.ceil((box.y + box.h) * height)


def sample_bounds(box: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) of the pixels that a check looks at: on the page, one pixel in from the edge."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.floor(F.greatest(zero, box.x) * width) + 1, F.floor(F.greatest(zero, box.y) * height) + 1, F.ceil(F.least(one, box.x + box.w) * width) - 1, F.ceil(F.least(one, box.y + box.h) * height) - 1


def luma(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """Brightness over white, of channels from 0 to 255."""
    a = alpha / 255
    return a * (r * 0.299 + g * 0.587 + b * 0.114) + (1 - a) * 255


def leaks(ink: Column, leaked: Column) -> Column:
    """Strictly over 64 pixels, or strictly over 3 % of the ink."""
    return F.when(ink <= 0, F.lit(False)).otherwise((leaked > LEAK_PIXELS) | (F.try_divide(leaked.cast("double"), ink.cast("double")) > LEAK_SHARE))


def drawn(x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
    """The box between two pointer positions, each held on the page."""
    p = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in (x0, y0, x1, y1)]
    return Box(F.least(p[0], p[2]), F.least(p[1], p[3]), F.abs(p[2] - p[0]), F.abs(p[3] - p[1]))


def big_enough(box: Box) -> Column:
    return (box.w > DRAWN_LEAST) & (box.h > DRAWN_LEAST)


def fit_within(width: Column, height: Column, most: Column) -> tuple[Column, Column]:
    """Scaled down so that the longer side is at most so many pixels; null or 0 is no limit; never up."""
    longest = F.greatest(width, height)
    free = most.isNull() | (most == 0) | (longest <= most)
    scale = F.try_divide(most.cast("double"), longest.cast("double"))
    side = lambda v: F.when(free, v.cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(v * scale + 0.5)))
    return side(width), side(height)
