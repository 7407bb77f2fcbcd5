"""EXIF blocks: a TIFF directory tree as one summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from redactlake.sources.containers import Malformed, unsigned

#: Tags, and bytes of a value of each type.
ORIENTATION, MAKE, MODEL, SOFTWARE, DATE_TIME = 0x0112, 0x010F, 0x0110, 0x0131, 0x0132
EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
MAKER_NOTE, DATE_TIME_ORIGINAL, BODY_SERIAL, LENS_SERIAL = 0x927C, 0x9003, 0xA431, 0xA435
THUMB_OFFSET, THUMB_LENGTH = 0x0201, 0x0202
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
TYPE_BYTES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
ASCII, SHORT, LONG, RATIONAL = 2, 3, 4, 5

SUMMARY = "orientation bigint, lat double, lon double, make string, model string, software string, taken string, serials array<string>, maker_note boolean, thumb_bytes bigint"


@dataclass
class Summary:
    orientation: int | None = None
    lat: float | None = None
    lon: float | None = None
    make: str | None = None
    model: str | None = None
    software: str | None = None
    taken: str | None = None
    serials: list[str] = field(default_factory=list)
    maker_note: bool = False
    thumb_bytes: int | None = None


class Tiff:
    """A TIFF header at a place in a file; offsets count from there."""

    def __init__(self, data: bytes, base: int) -> None:
        self.data, self.base = data, base
        order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
        if order is None:
            raise Malformed("EXIF: TIFF header is neither II nor MM")
        self.short, self.long = f"{order}H", f"{order}I"
        magic = unsigned(data, base + 2, self.short)
        if magic != 0x2A:
            raise Malformed(f"EXIF: bad TIFF magic {magic}")
        self.first = base + self.u32(base + 4)

    def u16(self, at: int) -> int:
        return unsigned(self.data, at, self.short, "u16")

    def u32(self, at: int) -> int:
        return unsigned(self.data, at, self.long, "u32")

    def directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
        """tag: (type, count, where the value field is), the first of equal tags; and where the directory ends."""
        n = self.u16(at)
        entries: dict[int, tuple[int, int, int]] = {}
        for place in range(at + 2, at + 2 + 12 * n, 12):
            entries.setdefault(self.u16(place), (self.u16(place + 2), self.u32(place + 4), place + 8))
        return entries, at + 2 + 12 * n

    def value_at(self, entry: tuple[int, int, int]) -> int:
        kind, count, place = entry
        width = TYPE_BYTES[kind] if kind < len(TYPE_BYTES) else 0
        return place if width * count <= 4 else self.base + self.u32(place)

    def text(self, entry: tuple[int, int, int] | None) -> str | None:
        """Trimmed, up to a NUL; nothing for other types and for blanks."""
        if entry is None or entry[0] != ASCII:
            return None
        at = self.value_at(entry)
        if at + entry[1] > len(self.data):
            raise Malformed(f"truncated ascii: needed {entry[1]} byte(s) at {at}, file is {len(self.data)}")
        raw = self.data[at : at + entry[1]].split(b"\0", 1)[0]
        return raw.decode("latin-1").strip() or None

    def number(self, entry: tuple[int, int, int] | None) -> int | None:
        if entry is None:
            return None
        return self.u16(entry[2]) if entry[0] == SHORT else self.u32(entry[2]) if entry[0] == LONG else None

    def degrees(self, entry: tuple[int, int, int]) -> float:
        if entry[0] != RATIONAL or entry[1] < 3:
            raise Malformed("EXIF: bad GPS rational")
        at, total = self.value_at(entry), 0.0
        for power in range(3):
            num, den = self.u32(at + 8 * power), self.u32(at + 8 * power + 4)
            total += (num / den if den else 0) / 60**power
        return total


def orientation(data: bytes, base: int) -> int | None:
    """Read on its own, so that damage elsewhere can't cost it."""
    tiff = Tiff(data, base)
    return tiff.number(tiff.directory(tiff.first)[0].get(ORIENTATION))


def summarize(data: bytes, base: int) -> Summary:
    tiff = Tiff(data, base)
    main, end = tiff.directory(tiff.first)
    out = Summary(tiff.number(main.get(ORIENTATION)), make=tiff.text(main.get(MAKE)), model=tiff.text(main.get(MODEL)), software=tiff.text(main.get(SOFTWARE)), taken=tiff.text(main.get(DATE_TIME)))
    if EXIF_DIRECTORY in main:
        exif, _ = tiff.directory(base + tiff.u32(main[EXIF_DIRECTORY][2]))
        out.maker_note = MAKER_NOTE in exif
        if out.taken is None:
            out.taken = tiff.text(exif.get(DATE_TIME_ORIGINAL))
        out.serials = [s for s in (tiff.text(exif.get(BODY_SERIAL)), tiff.text(exif.get(LENS_SERIAL))) if s]
    if GPS_DIRECTORY in main:
        gps, _ = tiff.directory(base + tiff.u32(main[GPS_DIRECTORY][2]))
        if LAT in gps and LON in gps:
            signs = [-1 if (tiff.text(gps.get(ref)) or "").upper() == away else 1 for ref, away in ((LAT_REF, "S"), (LON_REF, "W"))]
            out.lat, out.lon = tiff.degrees(gps[LAT]) * signs[0], tiff.degrees(gps[LON]) * signs[1]
    following = tiff.u32(end)
    if following:
        thumb, _ = tiff.directory(base + following)
        if THUMB_LENGTH in thumb and THUMB_OFFSET in thumb:
            out.thumb_bytes = tiff.number(thumb[THUMB_LENGTH])
    return out
