"""Containers: plant everything, find everything; strip, and nothing is found; hostile files are errors."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactlake.operators import media as O
from redactlake.sources import containers as C
from redactlake.sources import exif as E


def tiff(order="<", orientation=6, gps=True):
    """A TIFF tree with every field that is summarised."""
    n = "II" if order == "<" else "MM"
    heap = b""
    out = {}

    def directory(entries, at, following=0):
        nonlocal heap
        body = struct.pack(order + "H", len(entries))
        for tag, kind, count, raw in entries:
            if len(raw) <= 4:
                value = raw.ljust(4, b"\0")
            else:
                value = struct.pack(order + "I", 4000 + len(heap))
                heap += raw
            body += struct.pack(order + "HHI", tag, kind, count) + value
        out[at] = body + struct.pack(order + "I", following)

    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    number = lambda tag, kind, v: (tag, kind, 1, struct.pack(order + ("H" if kind == 3 else "I"), v))
    main = [number(E.ORIENTATION, 3, orientation), text(E.MAKE, "ACME"), text(E.MODEL, "Pixelbird 9"), text(E.SOFTWARE, "soft 1"), text(E.DATE_TIME, "2024:01:02 03:04:05"), number(E.EXIF_DIRECTORY, 4, 1000)]
    if gps:
        main.append(number(E.GPS_DIRECTORY, 4, 2000))
    directory(main, 8, 3000)
    directory([(E.MAKER_NOTE, 7, 4, b"abcd"), text(E.DATE_TIME_ORIGINAL, "2019:01:01 00:00:00"), text(E.BODY_SERIAL, "042817336611"), text(E.LENS_SERIAL, "LNS-9931")], 1000)
    degrees = lambda *p: struct.pack(order + "6I", *p)
    directory([text(E.LAT_REF, "N"), (E.LAT, 5, 3, degrees(51, 1, 30, 1, 3230, 100)), text(E.LON_REF, "w"), (E.LON, 5, 3, degrees(0, 1, 7, 1, 4366, 100))], 2000)
    directory([number(E.THUMB_OFFSET, 4, 3500), number(E.THUMB_LENGTH, 3, 77)], 3000)
    data = bytearray(4000) + heap
    data[:8] = n.encode() + struct.pack(order + "HI", 0x2A, 8)
    for at, body in out.items():
        data[at : at + len(body)] = body
    return bytes(data)


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


SCAN = segment(0xDA, b"\0" * 10) + b"\x12\xff\x00\x34\xff\xd0\x56"


def jpeg(*extra, scan=SCAN):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + b"".join(extra) + segment(0xDB, bytes(65)) + scan + b"\xff\xd9"


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(*extra):
    return C.PNG_SIGNATURE + chunk(b"IHDR", bytes(13)) + b"".join(extra) + chunk(b"IDAT", b"abc") + chunk(b"IEND", b"")


def riff(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def webp(*extra):
    body = b"WEBP" + riff(b"VP8X", bytes([0x2C]) + bytes(9)) + b"".join(extra) + riff(b"VP8 ", b"pix")
    return b"RIFF" + struct.pack("<I", len(body)) + body


DIRTY = {
    1: jpeg(segment(0xE1, b"Exif\0\0" + tiff()), segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0x"), segment(0xED, b"Photoshop 3.0\0"), segment(0xFE, b"hi"), segment(0xE2, b"ICC_PROFILE\0"), segment(0xE7, b"vendor")),
    2: png(chunk(b"tEXt", b"Author\0me"), chunk(b"eXIf", tiff(">")), chunk(b"tIME", bytes(7)), chunk(b"gAMA", bytes(4)), chunk(b"vNDr", b"q")),
    3: webp(riff(b"ICCP", b"icc"), riff(b"EXIF", b"Exif\0\0" + tiff()), riff(b"XMP ", b"<x/>"), riff(b"vend", b"12")),
    4: jpeg(segment(0xE1, b"Exif\0\0II broken")),
    5: png()[:-4],
    6: b"%PDF-1.7",
    7: b"",
}
EXIF_IDS = ["exif-gps", "exif-thumbnail", "exif-device", "exif-serial", "exif-timestamp", "exif-software", "exif-makernote"]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in DIRTY.items()], "file_id bigint, content binary")


def ids(spark, files):
    found = {}
    for r in O.findings(files, C.segments(spark, files)).orderBy("file_id", "ord").collect():
        found.setdefault(r.file_id, []).append(r.id)
    return found


def test_finds_everything_planted(spark, files):
    found = ids(spark, files)
    app7 = DIRTY[1].index(segment(0xE7, b"vendor"))
    assert found[1] == [*EXIF_IDS, "jpeg-xmp", "jpeg-iptc", "jpeg-comment", f"jpeg-app-e7-{app7}"]
    vndr = DIRTY[2].index(b"vNDr") - 4
    assert found[2] == ["png-text-tEXt-33", *EXIF_IDS, "png-time", f"png-chunk-vNDr-{vndr}"]
    assert found[3] == [*EXIF_IDS, "webp-xmp", f"webp-chunk-vend-{DIRTY[3].index(b'vend')}"]
    assert found[4] == ["exif-unreadable"]
    assert set(found) == {1, 2, 3, 4}


def test_details(spark, files):
    rows = {(r.file_id, r.id): r.detail for r in O.findings(files, C.segments(spark, files)).collect()}
    assert rows[1, "exif-gps"] == rows[2, "exif-gps"] == "51.50897, -0.12879"
    assert rows[1, "exif-device"] == "ACME Pixelbird 9"
    assert rows[1, "exif-serial"] == "042817336611, LNS-9931"
    assert rows[1, "exif-timestamp"] == "2024:01:02 03:04:05"
    assert rows[1, "exif-thumbnail"].startswith("77 bytes;")


def test_strip_then_nothing_is_found_and_pictures_are_whole(spark, files):
    out = O.strip(files)
    stripped = {r.file_id: r for r in out.collect()}
    assert ids(spark, out.where("content is not null")) == {}
    assert SCAN in bytes(stripped[1].content) and b"ICC_PROFILE" in bytes(stripped[1].content)
    assert bytes(stripped[2].content) == png(chunk(b"gAMA", bytes(4)))
    assert [n.id for n in stripped[1].notes] == ["kept-orientation"]
    assert stripped[5].error and stripped[6].error and stripped[7].error
    assert b"ICC_PROFILE" not in O.strip_bytes(DIRTY[1], keep_color=False)[0]


@pytest.mark.parametrize("key", [1, 2, 3])
def test_strip_is_idempotent(key):
    once = O.strip_bytes(DIRTY[key])[0]
    assert O.strip_bytes(once)[0] == once
    if key == 3:
        assert once[20] == 0x20 and O.strip_bytes(DIRTY[3], False)[0][20] == 0


def test_trailing_bytes_and_thumbnails_go():
    assert O.strip_bytes(jpeg() + b"secret")[0] == jpeg()
    fat = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(range(7)) + b"\x01\x01" + b"rgb") + SCAN + b"\xff\xd9"
    header = O.strip_bytes(fat)[0][2:20]
    assert header == b"\xff\xe0\x00\x10JFIF\0" + bytes(range(7)) + b"\0\0"


@pytest.mark.parametrize("order", ["<", ">"])
def test_byte_orders_agree(order):
    s = E.summarize(tiff(order), 0)
    assert (s.orientation, round(s.lat, 6), round(s.lon, 6)) == (6, 51.508972, -0.128794)
    assert s.taken.startswith("2024") and s.thumb_bytes == 77


@pytest.mark.parametrize("data", [b"\xff\xd8\xff\xe1\x00\x01", b"\xff\xd8\xff\xe1\xff\xff", b"\xff\xd8\xffab", C.PNG_SIGNATURE + b"\xff\xff\xff\xffIDAT", C.PNG_SIGNATURE, b"RIFF\xff\xff\xff\x00WEBP", b"RIFF\x0c\0\0\0WEBPVP8 \xff\0\0\0", b"abc", b""])
def test_hostile_files_are_errors(data):
    with pytest.raises(C.Malformed):
        C.segments_of(data)


@given(st.binary(max_size=300), st.sampled_from([b"\xff\xd8\xff", C.PNG_SIGNATURE, b"RIFF\x20\0\0\0WEBP"]))
@settings(max_examples=300, deadline=None)
def test_walks_end_or_refuse(tail, head):
    try:
        _, found = C.segments_of(head + tail)
    except C.Malformed:
        return
    assert all(a[3] == b[2] for a, b in zip(found, found[1:], strict=False))


def test_animated(spark):
    rows = [(1, bytearray(png(chunk(b"acTL", bytes(8))))), (2, bytearray(png())), (3, bytearray(webp(riff(b"ANIM", bytes(6))))), (4, bytearray(png(chunk(b"acTL", bytes(8)))[:-4]))]
    files = spark.createDataFrame(rows, "file_id bigint, content binary")
    assert {r.file_id: r.animated for r in O.animated(C.segments(spark, files)).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_files_round_trip(spark, tmp_path):
    from redactlake.sources import files as S

    (tmp_path / "a.jpg").write_bytes(DIRTY[1])
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.jpg"].format == "jpeg" and rows["a.jpg"].error is None
    assert rows["b.txt"].format is None and rows["b.txt"].error.startswith("unsupported")
    S.write_files(spark.createDataFrame([("out.bin", bytearray(b"123"))], "name string, content binary"), str(tmp_path / "out"))
    assert (tmp_path / "out/out.bin").read_bytes() == b"123"
