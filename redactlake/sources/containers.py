"""Walks over image containers: files become rows of segments.

A walk is sequential, each segment saying where the next begins, so it runs in Python on the file's bytes;
all that follows from the segments is expressed on columns. A malformed file yields one row with an error
and no segment: a partial walk would pass for a whole one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from redactlake.functions.media import PNG_SIGNATURE

#: The longest payload prefix that a kind depends on.
PREFIX_BYTES = 96
SEGMENT = "format: string, seq: int, code: string, marker: int, start_at: bigint, end_at: bigint, data_at: bigint, data_len: bigint, payload: binary, error: string"
_MAX_CHUNK = 0x7FFFFFFF
#: In scan data: an FF that neither is stuffed nor begins a restart marker.
_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)

Segment = tuple[str, int | None, int, int, int | None, int]


class Malformed(ValueError):
    """The file breaks its format's rules."""


def unsigned(data: bytes, at: int, layout: str, what: str = "value") -> int:
    """An integer at a place, which has to be within the data."""
    if at < 0 or at + struct.calcsize(layout) > len(data):
        raise Malformed(f"truncated {what}: needed {struct.calcsize(layout)} byte(s) at {at}, file is {len(data)}")
    return struct.unpack_from(layout, data, at)[0]


def jpeg_walk(data: bytes) -> Iterator[Segment]:
    """(code, marker, start, end, payload start, payload length); ends with the end marker, or the file."""
    if data[:2] != b"\xff\xd8":
        raise Malformed("not a JPEG: missing SOI")
    yield "D8", 0xD8, 0, 2, None, 0
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise Malformed(f"expected a marker at {at}")
        name = at + 1
        while unsigned(data, name, "B", "marker") == 0xFF:
            name += 1
        marker = data[name]
        if marker in (0xD8, 0xD9, 0x01) or 0xD0 <= marker <= 0xD7:
            yield f"{marker:02X}", marker, at, name + 1, None, 0
            if marker == 0xD9:
                return
            at = name + 1
            continue
        length = unsigned(data, name + 1, ">H", "length")
        if length < 2:
            raise Malformed(f"segment length {length} at {name + 1}")
        payload, end = name + 3, name + 1 + length
        if end > len(data):
            raise Malformed(f"segment at {at} runs past end of file")
        if marker == 0xDA:  # picture data follow, up to the next marker
            found = _SCAN_END.search(data, end)
            end = found.start() if found else max(end, len(data) - 1)
        yield f"{marker:02X}", marker, at, end, payload, length - 2
        at = end


def png_walk(data: bytes) -> Iterator[Segment]:
    if data[:8] != PNG_SIGNATURE:
        raise Malformed("not a PNG: bad signature")
    at = 8
    while at < len(data):
        length = unsigned(data, at, ">I", "length")
        if length > _MAX_CHUNK:
            raise Malformed(f"chunk length {length} at {at}")
        unsigned(data, at + 4, "4s", "type")
        code = _ascii(data[at + 4 : at + 8])
        end = at + 12 + length
        if end > len(data):
            raise Malformed(f"chunk {code} at {at} runs past end")
        yield code, None, at, end, at + 8, length
        if code == "IEND":
            return
        at = end
    raise Malformed("truncated PNG: no IEND chunk")


def webp_walk(data: bytes) -> Iterator[Segment]:
    """Bounded by the size that the header declares; less than a chunk header at the end is ignored."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Malformed("not a WebP: bad RIFF/WEBP header")
    declared = unsigned(data, 4, "<I", "size")
    if declared > len(data) - 8:
        raise Malformed(f"truncated WebP: header declares {declared} bytes from offset 8, file has {len(data) - 8}")
    at, limit = 12, 8 + declared
    while at + 8 <= limit:
        code, size = _ascii(data[at : at + 4]), unsigned(data, at + 4, "<I", "size")
        if size > _MAX_CHUNK:
            raise Malformed(f"chunk size {size} at {at}")
        if at + 8 + size > limit:
            raise Malformed(f"chunk {code} at {at} runs past end")
        yield code, None, at, at + 8 + size + size % 2, at + 8, size
        at += 8 + size + size % 2


def _ascii(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


WALKS = {"jpeg": jpeg_walk, "png": png_walk, "webp": webp_walk}


def detect(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == PNG_SIGNATURE:
        return "png"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def segments_of(data: bytes) -> tuple[str, list[Segment]]:
    """Format and segments; raises Malformed for a bad file and for an unsupported one."""
    form = detect(data)
    if form is None:
        raise Malformed("unsupported file: expected one of jpeg, png, webp")
    return form, list(WALKS[form](data))


@udtf(returnType=SEGMENT)
class Segments:
    """SELECT f.file_id, s.* FROM files f, LATERAL segments(f.content) s"""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content or b"")
        try:
            form, found = segments_of(data)
        except Malformed as e:
            yield detect(data), None, None, None, None, None, None, None, None, str(e)
            return
        for seq, (code, marker, start, end, at, length) in enumerate(found):
            payload = None if at is None else data[at : at + min(length, PREFIX_BYTES)]
            yield form, seq, code, marker, start, end, at, length, payload, None


def segments(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of segments, or one with an error, for files(file_id, content)."""
    spark.udtf.register("segments", Segments)
    return spark.sql("SELECT f.file_id, s.* FROM {files} f, LATERAL segments(f.content) s", files=files)
