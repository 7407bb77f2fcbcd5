"""PDF files: their indirect objects as rows, and files written again without what a strip removes.

Objects are read in the order of the file, a later one replacing an earlier one of its number, so files with
a damaged cross-reference table are read too. Object streams are unpacked (Flate only). A file is walked by
one Python call on its bytes; what follows from its objects is expressed on columns. A malformed file yields
one row with an error and no object, an encrypted one a row that says so. Refused as malformed are also object
numbers from 2^31, generations from 2^16, numbers of over 18 digits before the point, values nested deeper than
_DEEPEST, and files whose streams inflate to over MAX_INFLATED bytes together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from redactlake.operators.documents import INFO_KEYS, STRIPPED_INFO, STRIPPED_KEYS
from redactlake.sources.containers import Malformed

_NODE = "node struct<kids: array<bigint>, parent: bigint, media: array<double>, crop: array<double>, rotate: int, fonts: map<string, bigint>>"
_FONT = "struct<code_bytes: int, widths: array<struct<lo: int, hi: int, width: double>>, missing: double, encoding: string, differences: array<struct<code: int, name: string>>, to_unicode: bigint>"
ROW = f"""obj bigint, kind string, type string, subtype string, keys array<string>, filters array<string>, refs array<struct<key: string, dst: bigint>>,
annotations array<struct<obj: bigint, subtype: string>>, root bigint, info bigint, encrypted boolean, strings map<string, string>, created bigint, modified bigint, error string,
{_NODE},
font {_FONT}"""
#: What pdf_content() gives: an operator of a page, or a range of a character map (op is bf, page its stream).
OPERATOR_ROW = "page bigint, seq int, op string, nums array<double>, items array<struct<codes: binary, shift: double>>, font string, error string"
#: What pdf_text() gives: described is an object that is a font, font the name of the one in force.
TEXT_ROW = f"obj bigint, type string, root bigint, {_NODE}, described {_FONT}, {OPERATOR_ROW}"
_EXIF_WINDOW = 65536 + 9
_EXIF = re.compile(rb"\xff\xe1..Exif\x00\x00", re.DOTALL)
_DEEPEST = 100
#: Bytes that the streams of one file may inflate to together.
MAX_INFLATED = 256_000_000
#: Failures of one file, which become its error row.
BROKEN = (Malformed, ValueError, OverflowError, RecursionError)
#: Rows of several files that are handed on together.
_ROWS = 2000
#: Objects of one object stream in written files.
_PACKED = 200

_WS = rb"[\x00\t\n\x0c\r ]"
_SKIP = re.compile(rb"(?:" + _WS + rb"++|%[^\r\n]*+)*+")
_BEFORE = frozenset(bytes([x]) for x in b"\x00\t\n\x0c\r %")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
#: A list of nothing but numbers parted by blanks, which widths are.
_NUMBERS = re.compile(rb"\[[\t\n\x0c\r ]*+((?:[+-]?(?:\d++\.?\d*+|\.\d++)[\t\n\x0c\r ]++)*+[+-]?(?:\d++\.?\d*+|\.\d++))[\t\n\x0c\r ]*+\]")
_REF = re.compile(rb"(\d+)" + _WS + rb"+(\d+)" + _WS + rb"+R(?![A-Za-z0-9])")
_NAME = re.compile(rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)")
_MARK = re.compile(rb"(?<!\d)(\d+)" + _WS + rb"+(\d+)" + _WS + rb"+obj\b|\btrailer\b")
_LENGTH = re.compile(rb"(?<!\d)(\d+)" + _WS + rb"+(\d+)" + _WS + rb"+obj" + _WS + rb"+(\d+)" + _WS + rb"*endobj")
_STRING_PART = re.compile(rb"[()\\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_CONSTANTS = {b"t": ((b"true", True),), b"f": ((b"false", False),), b"n": ((b"null", None),)}
_OCTAL = re.compile(rb"[0-7]{1,3}")
_HASHED = re.compile(rb"#([0-9A-Fa-f]{2})")
_DATE = re.compile(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:Z|([+-])(\d\d)'?(\d\d)?)?")


class Name(str):
    """A name, told apart from a string."""


class Ref(NamedTuple):
    number: int
    generation: int

    @property
    def key(self) -> int:
        return self.number << 16 | self.generation


class Stream(NamedTuple):
    entries: dict
    raw: bytes


class Document(NamedTuple):
    objects: dict[Ref, Any]
    trailer: dict
    room: list[int]

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    def value(self, v: Any) -> Any:
        """v, or what it refers to."""
        for _ in range(_DEEPEST):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v)
        return None


def _skip(data: bytes, at: int) -> int:
    return _SKIP.match(data, at).end() if data[at : at + 1] in _BEFORE else at


def _ref(number: bytes, generation: bytes) -> Ref:
    if len(number) > 10 or len(generation) > 5 or int(number) >= 1 << 31 or int(generation) >= 1 << 16:
        raise Malformed(f"object number {number[:20]!r} {generation[:20]!r} out of range")
    return Ref(int(number), int(generation))


def _number(digits: bytes) -> int | float:
    if len(digits) < 18 and digits.isdigit():
        return int(digits)
    if len(digits) > 18 and len(digits.partition(b".")[0].lstrip(b"+-0")) > 18:
        raise Malformed(f"number of {len(digits)} digits")
    return float(digits) if b"." in digits else int(digits)


def _inflated(raw: bytes, doc: Document) -> bytes:
    """Inflated bytes, as far as the stream is whole, within the room that the file's other streams have left."""
    try:
        plain = zlib.decompressobj().decompress(raw, doc.room[0] + 1)
    except zlib.error as e:
        raise Malformed(f"stream: {e}") from e
    doc.room[0] -= len(plain)
    if doc.room[0] < 0:
        raise Malformed(f"streams inflate to over {MAX_INFLATED} bytes")
    return plain


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth, start = [], 1, at + 1
    while found := _STRING_PART.search(data, start):
        out.append(data[start : found.start()])
        start, sign = found.end(), found.group()
        if sign == b"\\":
            if octal := _OCTAL.match(data, start):
                out.append(bytes([int(octal.group(), 8) & 255]))
                start = octal.end()
            elif data[start : start + 2] == b"\r\n":
                start += 2
            else:
                c = data[start : start + 1]
                out.append(b"" if c in b"\r\n" else _ESCAPES.get(c, c))
                start += 1
            continue
        depth += 1 if sign == b"(" else -1
        if not depth:
            return b"".join(out), start
        out.append(sign)
    raise Malformed(f"string at {at} has no end")


def parse(data: bytes, at: int, depth: int = 0) -> tuple[Any, int]:
    """The value at a place, and the place behind it."""
    if depth > _DEEPEST:
        raise Malformed(f"values nested too deep at {at}")
    at = _skip(data, at)
    head = data[at : at + 1]
    if head.isdigit():
        found = _REF.match(data, at)
        if found:
            return _ref(found[1], found[2]), found.end()
        found = _NUMBER.match(data, at)
        return _number(found.group()), found.end()
    if data[at : at + 2] == b"<<":
        entries, at = {}, _skip(data, at + 2)
        while data[at : at + 2] != b">>":
            key, at = parse(data, at, depth + 1)
            if not isinstance(key, Name):
                raise Malformed(f"expected a name before {at}")
            entries[key], at = parse(data, at, depth + 1)
            at = _skip(data, at)
        return entries, at + 2
    if head == b"[":
        if found := _NUMBERS.match(data, at):
            return list(map(_number, found[1].split())), found.end()
        items, at = [], _skip(data, at + 1)
        while data[at : at + 1] != b"]":
            item, at = parse(data, at, depth + 1)
            items.append(item)
            at = _skip(data, at)
        return items, at + 1
    if head == b"(":
        return _literal(data, at)
    if head == b"<":
        end = data.find(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
        if end < 0:
            raise Malformed(f"string at {at} has no end")
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if head == b"/":
        found = _NAME.match(data, at)
        plain = found.group(1)
        if b"#" in plain:
            plain = _HASHED.sub(lambda m: bytes([int(m.group(1), 16)]), plain)
        return Name(plain.decode("latin-1")), found.end()
    for word, meant in _CONSTANTS.get(head, ()):
        if data.startswith(word, at):
            return meant, at + len(word)
    if found := _NUMBER.match(data, at):
        return _number(found.group()), found.end()
    raise Malformed(f"no value at {at}")


def _raw(data: bytes, at: int, entries: dict, lengths: dict[Ref, int]) -> tuple[bytes, int]:
    """A stream's bytes from behind its keyword: by its length if the end stands there, else up to the next end."""
    at += 2 if data[at : at + 2] == b"\r\n" else 1
    length = entries.get("Length")
    length = lengths.get(length) if isinstance(length, Ref) else length
    if isinstance(length, int) and 0 <= length <= len(data) - at and data.startswith(b"endstream", _skip(data, at + length)):
        return data[at : at + length], _skip(data, at + length) + 9
    end = data.find(b"endstream", at)
    if end < 0:
        raise Malformed(f"stream at {at} has no end")
    return re.sub(rb"\r?\n\Z|\r\Z", b"", data[at:end]), end + 9


def _unpacked(stream: Stream, doc: Document) -> Iterator[tuple[Ref, Any]]:
    """Objects of an object stream."""
    plain = _plain(stream, doc)
    n, first = (doc.value(stream.entries.get(k)) for k in ("N", "First"))
    if not isinstance(n, int) or not isinstance(first, int) or n < 0 or first < 0:
        raise Malformed(f"object stream of {n!r} objects from {first!r}")
    head = plain[:first].split()[: 2 * n]
    for number, at in zip(head[::2], head[1::2], strict=False):
        if not number.isdigit() or not at.isdigit() or len(at) > 10:
            raise Malformed(f"object stream names {number[:20]!r} at {at[:20]!r}")
        yield _ref(number, b"0"), parse(plain, first + int(at))[0]


def _plain(stream: Stream, doc: Document) -> bytes:
    """A stream's bytes without their filter, which must be Flate, if there is one."""
    filters = doc.value(stream.entries.get("Filter"))
    filters = [filters] if isinstance(filters, Name) else filters or []
    if filters not in ([], ["FlateDecode"]) or doc.value(stream.entries.get("DecodeParms")):
        raise Malformed(f"stream with filters {str(filters)[:100]}")
    return _inflated(stream.raw, doc) if filters else stream.raw


def read(data: bytes) -> Document:
    """Objects and trailer; an encrypted document has no objects, since they can't be read."""
    if data.find(b"%PDF-", 0, 1024) < 0:
        raise Malformed("not a PDF: no header")
    lengths = {_ref(a, b): int(n) for a, b, n in _LENGTH.findall(data) if len(n) <= 18}
    found, trailer, at = [], {}, 0
    while mark := _MARK.search(data, at):
        value, at = parse(data, mark.end())
        if mark[1] is None:
            trailer |= value if isinstance(value, dict) else {}
            continue
        after = _skip(data, at)
        if isinstance(value, dict) and data.startswith(b"stream", after):
            raw, at = _raw(data, after + 6, value, lengths)
            if value.get("Type") == "XRef":
                trailer |= {k: value[k] for k in ("Root", "Info", "Encrypt", "ID") if k in value}
                continue
            value = Stream(value, raw)
        found.append((_ref(mark[1], mark[2]), value))
    doc = Document({}, trailer, [MAX_INFLATED])
    if doc.encrypted:
        return doc
    if not found:
        raise Malformed("no objects")
    numbers = {ref: v for ref, v in found if isinstance(v, int)}  # what an object stream's entries may refer to
    for ref, value in found:
        if isinstance(value, Stream) and value.entries.get("Type") == "ObjStm":
            doc.objects.update(_unpacked(value, Document(numbers, {}, doc.room)))
        else:
            doc.objects[ref] = value
    return doc


def refs_within(value: Any) -> Iterator[Ref]:
    """Every reference held in a value, however deep."""
    if isinstance(value, Ref):
        yield value
    elif isinstance(value, Stream):
        yield from refs_within(value.entries)
    elif isinstance(value, (list, dict)):
        for item in value.values() if isinstance(value, dict) else value:
            yield from refs_within(item)


def _name(value: Any) -> str | None:
    return str(value) if isinstance(value, Name) else None


def _entries(value: Any) -> dict:
    return value.entries if isinstance(value, Stream) else value if isinstance(value, dict) else {}


def _edges(doc: Document, value: Any) -> Iterator[tuple[str | None, int]]:
    """(key, object) of references; those of a name tree that stands in the catalog itself are under Names/key."""
    if not isinstance(value, (dict, Stream)):
        yield from ((None, ref.key) for ref in refs_within(value))
    entries = _entries(value)
    for key, held in entries.items():
        if key == "Names" and entries.get("Type") == "Catalog" and isinstance(held, dict):
            yield from ((f"Names/{inner}", ref.key) for inner, v in held.items() for ref in refs_within(v))
        else:
            yield from ((str(key), ref.key) for ref in refs_within(held))


def _text(value: Any) -> str | None:
    if not isinstance(value, bytes):
        return None
    for mark, code in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if value.startswith(mark):
            return value[len(mark) :].decode(code, "replace")
    return value.decode("latin-1")


def _millis(value: Any) -> int | None:
    """A date as milliseconds since 1970; null if it isn't one."""
    found = _DATE.match(_text(value) or "")
    if not found:
        return None
    year, *rest = (int(x) if x else None for x in found.groups()[:6])
    month, day, *clock = rest
    away = timedelta(hours=int(found[8] or 0), minutes=int(found[9] or 0)) * (-1 if found[7] == "-" else 1)
    try:
        when = datetime(year, month or 1, day or 1, *(x or 0 for x in clock), tzinfo=timezone.utc) - away
    except (ValueError, OverflowError):
        return None
    return round(when.timestamp() * 1000)


def _annotations(doc: Document, ref: Ref, page: dict) -> list[tuple[int, str | None]]:
    """What a page lists: objects by their id, those that stand in the list itself by a negative one."""
    listed = doc.value(page.get("Annots"))
    out = []
    for i, item in enumerate(listed if isinstance(listed, list) else ()):
        entries = _entries(doc.value(item))
        if entries:
            out.append((item.key if isinstance(item, Ref) else -(ref.key << 20 | i) - 1, _name(doc.value(entries.get("Subtype")))))
    return out


def _floats(value: Any, n: int | None = None) -> list[float] | None:
    if isinstance(value, list) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value) and n in (None, len(value)):
        return list(map(float, value))
    return None


def _listed(doc: Document, value: Any) -> list:
    value = doc.value(value)
    return [doc.value(v) if isinstance(v, Ref) else v for v in value] if isinstance(value, list) else []


def _node(doc: Document, of: str | None, entries: dict) -> tuple | None:
    """What a node of the page tree says itself: the nodes below (the catalog has the tree's root), its parent, boxes, rotation and named fonts."""
    if of not in ("Catalog", "Pages", "Page") and "Kids" not in entries:
        return None
    kids = [entries.get("Pages")] if of == "Catalog" else doc.value(entries.get("Kids")) if of != "Page" else []
    parent = entries.get("Parent")
    boxes = (_floats(_listed(doc, entries.get(k)), 4) for k in ("MediaBox", "CropBox"))
    rotate = doc.value(entries.get("Rotate"))
    resources = doc.value(entries.get("Resources"))
    fonts = None
    if isinstance(resources, dict):
        named = doc.value(resources.get("Font"))
        fonts = {str(k): v.key for k, v in named.items() if isinstance(v, Ref)} if isinstance(named, dict) else {}
    rotate = int(rotate) % 360 if isinstance(rotate, (int, float)) and abs(rotate) < 1 << 31 else None
    return [k.key for k in kids if isinstance(k, Ref)] if isinstance(kids, list) else [], parent.key if isinstance(parent, Ref) else None, *boxes, rotate, fonts


def _font(doc: Document, entries: dict) -> tuple:
    """A font's widths by ranges of codes, its encoding and its character map."""
    composite = _name(doc.value(entries.get("Subtype"))) == "Type0"
    unicode = entries.get("ToUnicode")
    widths, missing, differences, code = [], 0.0, [], 0
    encoding = doc.value(entries.get("Encoding"))
    if composite:
        inner = _entries((_listed(doc, entries.get("DescendantFonts")) or [None])[0])
        default, items = doc.value(inner.get("DW")), _listed(doc, inner.get("W"))
        missing = float(default) if isinstance(default, (int, float)) else 1000.0
        while len(items) > 1:
            first, following = items[:2]
            if isinstance(first, int) and isinstance(following, list):
                widths += [(first + i, first + i, w) for i, w in enumerate(_floats(following) or [])]
                items = items[2:]
            elif _floats(items[:3], 3) and all(isinstance(x, int) for x in items[:2]):
                widths.append((first, following, float(items[2])))
                items = items[3:]
            else:
                break
    else:
        first, described = doc.value(entries.get("FirstChar")), _entries(doc.value(entries.get("FontDescriptor")))
        given = doc.value(described.get("MissingWidth"))
        missing = float(given) if isinstance(given, (int, float)) else 0.0
        first = first if isinstance(first, int) else 0
        widths = [(i, i, w) for i, w in enumerate(_floats(_listed(doc, entries.get("Widths"))) or [], first)]
        if isinstance(encoding, dict):
            for item in _listed(doc, encoding.get("Differences")):
                if isinstance(item, Name):
                    differences.append((code, str(item)))
                code = item if isinstance(item, int) else code + 1
            encoding = doc.value(encoding.get("BaseEncoding"))
    widths = [w for w in widths if 0 <= w[0] <= w[1] < 1 << 16]
    differences = [d for d in differences if 0 <= d[0] < 256]
    return 2 if composite else 1, widths, missing, _name(encoding), differences, unicode.key if isinstance(unicode, Ref) else None


def rows_of(data: bytes) -> Iterator[tuple]:
    """A row for the trailer, then one for each object; columns as in ROW."""
    doc = read(data)
    root, info = (doc.trailer.get(k) for k in ("Root", "Info"))
    entries = _entries(doc.value(info))
    strings = {k: t for k in INFO_KEYS if (t := _text(doc.value(entries.get(k)))) is not None}
    dates = [_millis(doc.value(entries.get(k))) for k in ("CreationDate", "ModDate")]
    yield (*(None,) * 8, *(r.key if isinstance(r, Ref) else None for r in (root, info)), doc.encrypted, strings, *dates, *(None,) * 3)
    trees = {_entries(v).get("Names") for v in doc.objects.values() if _entries(v).get("Type") == "Catalog" and isinstance(_entries(v).get("Names"), Ref)}
    for ref, value in doc.objects.items():
        entries = _entries(value)
        filters = doc.value(entries.get("Filter")) if isinstance(value, Stream) else None
        filters = [str(f) for f in (filters if isinstance(filters, list) else [filters]) if isinstance(f, Name)]
        kind = "stream" if isinstance(value, Stream) else "dict" if isinstance(value, dict) else "array" if isinstance(value, list) else "value"
        subtype = _name(doc.value(entries.get("Subtype"))) or _name(doc.value(entries.get("S")))
        if kind == "stream" and subtype == "Image" and "DCTDecode" in filters and _EXIF.search(value.raw[:_EXIF_WINDOW]):
            kind = "exif-image"
        of = "Names" if ref in trees else _name(doc.value(entries.get("Type")))
        yield ref.key, kind, of, subtype, list(map(str, entries)), filters, list(_edges(doc, value)), _annotations(doc, ref, entries) if of == "Page" else [], *(None,) * 7, _node(doc, of, entries), _font(doc, entries) if of == "Font" else None


@udtf(returnType=ROW)
class PdfObjects:
    """SELECT f.file_id, o.* FROM files f, LATERAL pdf_objects(f.content) o"""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = list(rows_of(bytes(content or b"")))
        except BROKEN as e:
            found = [(*(None,) * 14, str(e), None, None)]
        yield from found


_WORD = re.compile(rb"[A-Za-z'\"][A-Za-z0-9*'\"]*")
_IMAGE_END = re.compile(_WS + rb"EI(?=" + _WS + rb"|\Z)")
#: Numbers that operators which place text take, and those that show it.
_PLACING = {"q": 0, "Q": 0, "cm": 6, "BT": 0, "ET": 0, "Td": 2, "Tm": 6, "T*": 0, "Tc": 1, "Tw": 1, "Tz": 1, "TL": 1, "Ts": 1, "Tf": 1}


def _words(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) of a content stream or a character map; pictures that stand in it are passed over."""
    at, operands = _skip(data, 0), []
    while at < len(data):
        word = _WORD.match(data, at)
        if word is None:
            value, at = parse(data, at)
            operands.append(value)
        else:
            at = word.end()
            if word.group() == b"BI":
                end = _IMAGE_END.search(data, at)
                at = end.end() if end else len(data)
            elif word.group() in (b"true", b"false", b"null"):
                operands.append(None)
            else:
                yield word.group().decode(), operands
            operands = [] if word.group() not in (b"true", b"false", b"null") else operands
        at = _skip(data, at)


def _operators(data: bytes) -> Iterator[tuple[str, list[float], list, str | None]]:
    """(op, numbers, shown items, font in force) of the operators that place or show text; combined ones are taken apart."""
    font, fonts = None, []
    for op, operands in _words(data):
        numbers = _floats(operands) or []
        shown = operands[-1:] if op in ("Tj", "'", '"') else operands[-1] if op == "TJ" and operands and isinstance(operands[-1], list) else []
        if op == '"':
            numbers = _floats(operands[:-1], 2) or [0.0, 0.0]
            yield "Tw", numbers[:1], [], font
            yield "Tc", numbers[1:], [], font
        if op in ("'", '"'):
            yield "T*", [], [], font
        if op == "TD" and len(numbers) == 2:
            yield "TL", [-numbers[1]], [], font
            op = "Td"
        if op == "q":
            fonts.append(font)
        elif op == "Q" and fonts:
            font = fonts.pop()
        elif op == "Tf" and len(operands) == 2 and isinstance(operands[0], Name):
            font, numbers = str(operands[0]), _floats(operands[1:]) or [0.0]
        if op in ("Tj", "TJ", "'", '"'):
            yield "Tj", [], [(v, None) if isinstance(v, bytes) else (None, float(v)) for v in shown if isinstance(v, (bytes, int, float))], font
        elif _PLACING.get(op) == len(numbers):
            yield op, numbers, [], font


def _mapped(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first code, last code, text of the first in UTF-16) of a character map."""
    for op, operands in _words(data):
        step = {"endbfchar": 2, "endbfrange": 3}.get(op)
        for at in range(0, len(operands) - (step or 0) + 1, step) if step else ():
            codes, target = operands[at : at + step - 1], operands[at + step - 1]
            if not all(isinstance(c, bytes) and 0 < len(c) <= 2 for c in codes):
                continue
            lo, hi = int.from_bytes(codes[0]), int.from_bytes(codes[-1])
            for i, text in enumerate(target[: hi - lo + 1] if isinstance(target, list) else [target]):
                if isinstance(text, bytes) and len(text) >= 2 and len(text) % 2 == 0:
                    yield lo + i, lo + i if isinstance(target, list) else hi, text


def operators_of(data: bytes) -> Iterator[tuple]:
    """Rows as in OPERATOR_ROW. A page or map that can't be read has one row that says why, beside what stands before the fault."""
    yield from _operators_in(read(data))


def _operators_in(doc: Document) -> Iterator[tuple]:
    for ref, value in doc.objects.items():
        entries, seq = _entries(value), 0
        kind = _name(doc.value(entries.get("Type")))
        try:
            if kind == "Page":
                held = doc.value(entries.get("Contents"))
                streams = [s for s in (_listed(doc, held) if isinstance(held, list) else [held]) if isinstance(s, Stream)]
                for op, numbers, items, font in _operators(b"\n".join(_plain(s, doc) for s in streams)):
                    yield ref.key, seq, op, numbers, items, font, None
                    seq += 1
            elif kind == "Font" and isinstance(stream := doc.value(entries.get("ToUnicode")), Stream):
                for lo, hi, text in _mapped(_plain(stream, doc)):
                    yield entries["ToUnicode"].key, seq, "bf", [float(lo), float(hi)], [(text, None)], None, None
                    seq += 1
        except BROKEN as e:
            yield ref.key, seq, None, None, None, None, str(e)


@udtf(returnType=OPERATOR_ROW)
class PdfContent:
    """SELECT f.file_id, c.* FROM files f, LATERAL pdf_content(f.content) c"""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            yield from operators_of(bytes(content or b""))
        except BROKEN:  # pdf_objects() has the row that says why
            return


def text_rows_of(data: bytes) -> Iterator[tuple]:
    """Rows as in TEXT_ROW, maps as pairs: the trailer's, those of nodes and fonts, and operators."""
    doc = read(data)
    root = doc.trailer.get("Root")
    rows = [(None, None, root.key if isinstance(root, Ref) else None, *(None,) * 9)]
    for ref, value in doc.objects.items():
        entries = _entries(value)
        of = _name(doc.value(entries.get("Type")))
        node, font = _node(doc, of, entries), _font(doc, entries) if of == "Font" else None
        if node or font:
            node = node and (*node[:-1], None if node[-1] is None else list(node[-1].items()))
            rows.append((ref.key, of, None, node, font, *(None,) * 7))
    yield from rows
    for row in _operators_in(doc):
        yield *(None,) * 5, *row


def pdf_content(spark: SparkSession, files: DataFrame) -> DataFrame:
    """For files(file_id, content): the text operators of each page and the ranges of character maps, as in OPERATOR_ROW, beside doc."""
    spark.udtf.register("pdf_content", PdfContent)
    return spark.sql("SELECT f.file_id AS doc, c.* FROM {files} f, LATERAL pdf_content(f.content) c", files=files)


def pdf_text(files: DataFrame) -> DataFrame:
    """For files(file_id, content): what pdf_objects() says of page trees and fonts and what pdf_content() gives, as in TEXT_ROW beside doc, of one reading of each file."""
    schema = StructType([StructField("doc", files.schema["file_id"].dataType), *StructType.fromDDL(TEXT_ROW)])
    kinds = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        def made(docs, rows):
            columns = docs, *zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, kind.type) for c, kind in zip(columns, kinds, strict=True)], kinds)

        docs, rows = [], []
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time
                try:
                    found = list(text_rows_of(batch.column("content")[at].as_py() or b""))
                except BROKEN as e:
                    found = [(*(None,) * 11, str(e))]
                docs += [batch.column("file_id")[at].as_py()] * len(found)
                rows += found
                if len(rows) > _ROWS:
                    yield made(docs, rows)
                    docs, rows = [], []
        if rows:
            yield made(docs, rows)

    return files.select("file_id", "content").mapInArrow(run, schema)


def pdf_objects(spark: SparkSession, files: DataFrame) -> DataFrame:
    """For files(file_id, content): file_id, a trailer's row (obj is null) or an error's, and a row for each object."""
    spark.udtf.register("pdf_objects", PdfObjects)
    return spark.sql("SELECT f.file_id AS doc, o.* FROM {files} f, LATERAL pdf_objects(f.content) o", files=files)


class Structure(NamedTuple):
    """The tables that operators/documents takes."""

    objects: DataFrame
    edges: DataFrame
    roots: DataFrame
    info: DataFrame
    annotations: DataFrame
    encrypted: DataFrame
    errors: DataFrame


def structure(rows: DataFrame) -> Structure:
    """The tables of what pdf_objects() gives, which should be a saved table, since each of them reads it."""
    inner = rows.where("obj is not null")
    trailers = rows.where("obj is null and error is null")
    strings = (F.element_at("strings", F.lit(k)).alias(k) for k in INFO_KEYS)
    return Structure(
        inner.select("doc", "obj", "kind", "type", "subtype", "keys", "filters"),
        inner.select("doc", F.col("obj").alias("src"), F.explode("refs").alias("r")).select("doc", "src", "r.dst", "r.key"),
        trailers.select("doc", F.explode(F.array("root", "info")).alias("obj")).where("obj is not null"),
        trailers.where("not encrypted").select("doc", *strings, F.timestamp_millis("created").alias("Created"), F.timestamp_millis("modified").alias("Modified")),
        inner.select("doc", F.explode("annotations").alias("a")).select("doc", "a.obj", "a.subtype"),
        trailers.where("encrypted").select("doc"),
        rows.where("error is not null").select("doc", "error"),
    )


def _dump(value: Any) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m.group()[0], value.encode("latin-1"))
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, dict):
        return b"<<" + b" ".join(_dump(k) + b" " + _dump(v) for k, v in value.items()) + b">>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(_dump, value)) + b"]"
    return f"{value:.10f}".rstrip("0").encode() if isinstance(value, float) else b"%d" % value


def save(doc: Document) -> bytes:
    """The document as bytes: streams by themselves, other objects packed into object streams, and a cross-reference stream."""
    out, size = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], 15
    places: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    top = max((ref.number for ref in doc.objects), default=0)

    def put(ref: Ref, entries: dict, raw: bytes | None) -> None:
        nonlocal size
        places[ref.number] = 1, size, ref.generation
        body = _dump(entries if raw is None else entries | {Name("Length"): len(raw)})
        tail = b"" if raw is None else b"\nstream\n" + raw + b"\nendstream"
        out.append(b"%d %d obj\n" % ref + body + tail + b"\nendobj\n")
        size += len(out[-1])

    packed = []
    for ref, value in doc.objects.items():
        if isinstance(value, Stream):
            put(ref, value.entries, value.raw)
        elif ref.generation:
            put(ref, value, None)
        else:
            packed.append((ref, _dump(value)))
    for start in range(0, len(packed), _PACKED):
        part, top = packed[start : start + _PACKED], top + 1
        head, at = [], 0
        for i, (ref, body) in enumerate(part):
            head.append(b"%d %d" % (ref.number, at))
            places[ref.number] = 2, top, i
            at += len(body) + 1
        first = b" ".join(head) + b"\n"
        raw = zlib.compress(first + b"\n".join(body for _, body in part))
        put(Ref(top, 0), {Name("Type"): Name("ObjStm"), Name("N"): len(part), Name("First"): len(first), Name("Filter"): Name("FlateDecode")}, raw)
    top += 1
    places[top] = 1, size, 0
    numbers = sorted(places)
    table = b"".join(a.to_bytes(1) + b.to_bytes(8) + c.to_bytes(2) for a, b, c in map(places.__getitem__, numbers))
    index = [x for n in numbers for x in (n, 1)]
    entries = {Name("Type"): Name("XRef"), Name("Size"): top + 1, Name("W"): [1, 8, 2], Name("Index"): index, Name("Filter"): Name("FlateDecode")}
    begun = size
    put(Ref(top, 0), entries | {Name(k): doc.trailer[k] for k in ("Root", "Info") if k in doc.trailer}, zlib.compress(table))
    return b"".join(out) + b"startxref\n%d\n%%%%EOF\n" % begun


def clean(data: bytes) -> bytes:
    """The file without information strings and dates, the keys a strip removes, and the objects that nothing leads to then.

    An encrypted file is refused. Without a root nothing is collected.
    """
    doc = read(data)
    if doc.encrypted:
        raise Malformed("encrypted")
    for value in list(doc.objects.values()):
        entries = _entries(value)
        kind = _name(doc.value(entries.get("Type")))
        gone = set(STRIPPED_KEYS.get(kind, ())) | ({"Metadata"} if isinstance(value, Stream) else set())
        for key in gone & entries.keys():
            del entries[key]
        names = doc.value(entries.get("Names")) if kind == "Catalog" else None
        for key in STRIPPED_KEYS["Names"] if isinstance(names, dict) else ():
            names.pop(key, None)
    info = doc.value(doc.trailer.get("Info"))
    if not isinstance(info, dict) or not isinstance(doc.trailer["Info"], Ref):
        doc.trailer["Info"] = Ref(max(ref.number for ref in doc.objects) + 1, 0)
        info = doc.objects[doc.trailer["Info"]] = {}
    for key in STRIPPED_INFO:
        info.pop(key, None)
    info.update((Name(key), b"") for key in INFO_KEYS)
    if isinstance(doc.trailer.get("Root"), Ref):
        alive, todo = set(), [doc.trailer["Root"], doc.trailer["Info"]]
        while todo:
            ref = todo.pop()
            if ref not in alive:
                alive.add(ref)
                todo += refs_within(doc.objects.get(ref))
        for ref in doc.objects.keys() - alive:
            del doc.objects[ref]
    return save(doc)


def clean_files(files: DataFrame) -> DataFrame:
    """(file_id, content, error) of files(file_id, content): each file cleaned, or why it is refused."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time
                key, data = batch.column("file_id").slice(at, 1), batch.column("content")[at].as_py()
                try:
                    content, error = clean(data or b""), None
                except BROKEN as e:
                    content, error = None, str(e)
                yield pa.record_batch([key, pa.array([content], pa.binary()), pa.array([error], pa.string())], ["file_id", "content", "error"])

    return files.select("file_id", "content").mapInArrow(run, f"file_id {files.schema['file_id'].dataType.simpleString()}, content binary, error string")
