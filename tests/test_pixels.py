"""Pixels: coverage by sums over areas, orientation, size, pictures from files."""

import struct
import zlib

import numpy as np
import pytest

from redactlake.operators import pixels as X
from redactlake.operators import regions as R


def test_sums_over_areas_equal_a_scan_of_each_region(spark):
    rng = np.random.default_rng(3)
    pages, boxes = [], []
    for page in range(6):
        w, h = int(rng.integers(1, 60)), int(rng.integers(1, 60))
        source = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        output = np.where(rng.random((h, w, 1)) < 0.05, source, [0, 0, 0, 255]).astype(np.uint8)
        pages.append((1, page, w, h, bytearray(source.tobytes()), bytearray(output.tobytes())))
        boxes += [(1, page, i, *(float(v) for v in (*rng.uniform(-0.3, 1, 2), *rng.uniform(0, 1.3, 2)))) for i in range(40)]
    boxes += [(1, 0, 0, 0.0, 0.0, 1.0, 1.0), (1, 99, 1, 0.0, 0.0, 1.0, 1.0), (1, 6, 7, 0.0, 0.0, 1.0, 1.0), (1, 0, None, 0.0, 0.0, 1.0, 1.0)]
    images = spark.createDataFrame([p[:5] for p in pages] + [(1, 6, 1, 1, bytearray(4))], "doc long, page int, width int, height int, rgba binary")
    outputs = spark.createDataFrame([(*p[:4], p[5]) for p in pages] + [(1, 6, 1, 2, bytearray(8))], "doc long, page int, width int, height int, rgba binary")
    regions = spark.createDataFrame(boxes, "doc long, page int, rect_id int, x double, y double, w double, h double")
    got = {(r.page, r.rect_id): (r.ink, r.leaked, r.leaks) for r in X.coverage(images, outputs, regions).collect()}
    want = {}
    for _, page, rect, *box in boxes[:-3]:
        _, _, w, h, source, output = pages[page]
        want[page, rect] = want.get((page, rect), False) or R.region_leaks(*(R.luma_of(bytes(p), w, h) for p in (source, output)), tuple(box))
    assert {k: v[2] for k, v in got.items()} == {**want, (6, 7): True} and got[6, 7][:2] == (None, None)
    assert any(want.values()) and not all(want.values())


def png(rgba, orientation=None, order=">"):
    h, w = rgba.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    block = b"" if orientation is None else chunk(b"eXIf", {">": b"MM\0*", "<": b"II*\0"}[order] + struct.pack(order + "IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0))
    body = b"".join(b"\0" + row.tobytes() for row in rgba)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + block + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_pictures_from_files_in_every_orientation(spark, tmp_path):
    rng = np.random.default_rng(1)
    picture = rng.integers(0, 256, (3, 5, 4)).astype(np.uint8)
    picture[..., 3] = 255
    for way in range(9):
        (tmp_path / f"{way}.png").write_bytes(png(picture, way, "<>"[way % 2]))
    (tmp_path / "none.png").write_bytes(png(picture))
    (tmp_path / "broken.png").write_bytes(png(picture)[:40])
    (tmp_path / "other.jpg").write_bytes(b"\xff\xd8\xff no picture")
    read = X.read_pictures(spark, f"file://{tmp_path}")
    got = {r.file.rpartition("/")[2]: r for r in X.oriented(read).collect()}
    h, w = 3, 5
    # where a pixel of the upright picture comes from
    places = {1: lambda x, y: (x, y), 2: lambda x, y: (w - 1 - x, y), 3: lambda x, y: (w - 1 - x, h - 1 - y), 4: lambda x, y: (x, h - 1 - y), 5: lambda x, y: (y, x), 6: lambda x, y: (y, h - 1 - x), 7: lambda x, y: (w - 1 - y, h - 1 - x), 8: lambda x, y: (w - 1 - y, x)}
    for name, way in [*((f"{i}.png", i) for i in range(9)), ("none.png", 1)]:
        size = (h, w) if way >= 5 else (w, h)
        assert (got[name].width, got[name].height) == size and got[name].error is None
        seen = np.frombuffer(got[name].rgba, np.uint8).reshape(size[1], size[0], 4)
        for y in range(size[1]):
            for x in range(size[0]):
                sx, sy = places[way or 1](x, y)
                assert (seen[y, x] == picture[sy, sx]).all(), (way, x, y)
    assert all(got[n].rgba is None and got[n].error for n in ("broken.png", "other.jpg"))


@pytest.mark.parametrize(("w", "h", "to_w", "to_h"), [(7, 5, 3, 2), (16, 9, 5, 9), (10, 10, 1, 1), (6, 4, 6, 4), (31, 17, 30, 16)])
def test_resize_equals_a_plain_area_average(w, h, to_w, to_h):
    rng = np.random.default_rng(w)
    picture = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
    picture[..., 3] = rng.choice([0, 100, 255], (h, w))
    got = X.resampled(picture, to_w, to_h)
    for y in range(to_h):
        for x in range(to_w):
            total = np.zeros(4)
            for sy in range(h):
                for sx in range(w):
                    share = max(0, min(sx + 1, (x + 1) * w / to_w) - max(sx, x * w / to_w)) * max(0, min(sy + 1, (y + 1) * h / to_h) - max(sy, y * h / to_h))
                    p = picture[sy, sx].astype(float)
                    total += share * np.array([*(p[:3] * p[3] / 255), p[3]])
            total /= w * h / (to_w * to_h)
            assert abs(total[3] - got[y, x, 3]) <= 1
            if total[3] > 1:
                assert (abs(total[:3] * 255 / total[3] - got[y, x, :3]) <= 1).all()


def test_nothing_is_scaled_up_and_null_pictures_stay(spark):
    rows = spark.createDataFrame([(1, 2, 3, bytearray(range(24)), 6), (2, None, None, None, None), (3, 40, 1, bytearray(160), None)], "k int, width int, height int, rgba binary, orientation int")
    got = {r.k: (r.width, r.height, r.rgba and len(r.rgba)) for r in X.oriented(rows, most=10).collect()}
    assert got == {1: (3, 2, 24), 2: (None, None, None), 3: (10, 1, 40)}


def test_pictures_are_made_by_many_tasks_and_stay_there(spark, data):
    from redactlake.plans import catalog

    plan = catalog.QUERIES["q_coverage"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3 and plan.count("Exchange") == 4  # keys of pages, and then what was found
