"""Image containers as column expressions: formats, kinds of segments, what a strip keeps.

A strip keeps what is named here and drops all else; the format comes from the bytes, never from a name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures, kinds and MIME types of the formats.
PNG_SIGNATURE = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])
FORMATS = ("jpeg", "png", "webp")
MIME = {"jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "avif": "image/avif"}
EXTENSION = {"jpeg": "jpg", "png": "png", "webp": "webp", "avif": "avif"}
EXIF_PREFIX = b"Exif\x00\x00"
XMP_PREFIX = b"http://ns.adobe.com/xap/1.0/"
IPTC_PREFIX = b"Photoshop 3.0"
#: Marker, payload prefix and kind of JPEG segments that aren't structural, in order.
JPEG_KINDS = (
    (0xE0, b"JFIF", "jfif"),
    (0xE2, b"ICC_PROFILE", "icc"),
    (0xEE, b"Adobe", "adobe"),
    (0xE1, EXIF_PREFIX, "exif"),
    (0xE1, XMP_PREFIX, "xmp"),
    (0xED, IPTC_PREFIX, "iptc"),
    (0xFE, b"", "comment"),
)
PNG_KINDS = {
    "structural": ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "sBIT", "bKGD", "hIST", "acTL", "fcTL", "fdAT"),
    "color": ("gAMA", "cHRM", "sRGB", "iCCP", "cICP", "mDCV", "cLLI", "pHYs"),
    "text": ("tEXt", "zTXt", "iTXt"),
    "exif": ("eXIf",),
    "time": ("tIME",),
}
WEBP_KINDS = {"structural": ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF"), "color": ("ICCP",), "exif": ("EXIF",), "xmp": ("XMP ",)}
#: Kinds that are always kept, and those that are unless colour profiles are to go.
KEPT = {"jpeg": ("structural", "jfif", "adobe"), "png": ("structural",), "webp": ("structural",)}
KEPT_COLOR = {"jpeg": "icc", "png": "color", "webp": "color"}
VP8X_ICC, VP8X_EXIF, VP8X_XMP = 0x20, 0x08, 0x04
#: Compression presets: format (null: the source's), quality, effort, longest side.
PRESETS = (("smallest", "webp", 55, 4, 2048), ("balanced", None, 78, 2, None), ("best", None, 92, 2, None))


def _starts(content: Column, prefix: bytes, at: int = 1) -> Column:
    return F.substring(content, at, len(prefix)) == F.lit(bytearray(prefix))


def detect_format(content: Column) -> Column:
    """jpeg, png or webp; null for anything else."""
    return F.when(_starts(content, b"\xff\xd8\xff"), "jpeg").when(_starts(content, PNG_SIGNATURE), "png").when(_starts(content, b"RIFF") & _starts(content, b"WEBP", 9), "webp")


def format_error(content: Column) -> Column:
    """What is wrong with a file's format; null if nothing is."""
    return F.when(detect_format(content).isNull(), F.lit("unsupported file: expected one of " + ", ".join(FORMATS)))


def require_format(content: Column) -> Column:
    """jpeg, png or webp; the query fails on anything else."""
    return F.when(format_error(content).isNull(), detect_format(content)).otherwise(F.raise_error(format_error(content)))


def mime_type(form: Column) -> Column:
    out = None
    for name, mime in MIME.items():
        out = F.when(form == name, mime) if out is None else out.when(form == name, mime)
    return out


def extension(form: Column) -> Column:
    return F.when(form == "jpeg", "jpg").otherwise(form)


def is_standalone(marker: Column) -> Column:
    return marker.isin(0xD8, 0xD9, 0x01) | marker.between(0xD0, 0xD7)


def jpeg_kind(marker: Column, payload: Column) -> Column:
    out = F.when(is_standalone(marker) | (marker == 0xDA) | marker.between(0xC0, 0xCF) | marker.between(0xDB, 0xDF), "structural")
    for code, prefix, kind in JPEG_KINDS:
        out = out.when((marker == code) & (_starts(payload, prefix) if prefix else F.lit(True)), kind)
    return out.otherwise("unknown")


def _kind(code: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for kind, codes in kinds.items():
        out = F.when(code.isin(*codes), kind) if out is None else out.when(code.isin(*codes), kind)
    return out.otherwise("unknown")


def png_kind(code: Column) -> Column:
    return _kind(code, PNG_KINDS)


def webp_kind(code: Column) -> Column:
    """Codes have four characters; a blank at the end is part of one."""
    return _kind(code, WEBP_KINDS)


def is_kept(form: str, kind: Column, keep_color: Column | bool = True) -> Column:
    return kind.isin(*KEPT[form]) | ((kind == KEPT_COLOR[form]) & (keep_color if isinstance(keep_color, Column) else F.lit(keep_color)))


def vp8x_flags(flags: Column, icc_kept: Column) -> Column:
    cleared = flags.bitwiseAND(F.lit(~(VP8X_EXIF | VP8X_XMP) & 0xFF))
    return F.when(icc_kept, cleared).otherwise(cleared.bitwiseAND(F.lit(~VP8X_ICC & 0xFF)))


def text_keyword(data: Column) -> Column:
    """Up to the first NUL of at most 80 bytes, which are Latin-1."""
    head = F.decode(F.substring(data, 1, 80), "ISO-8859-1")
    return F.coalesce(F.nullif(F.substring_index(head, "\0", 1), F.lit("")), F.lit("(unnamed)"))


def degrees(parts: list[tuple[Column, Column]], reference: Column, negative: str) -> Column:
    """Degrees, minutes and seconds as numerators and denominators; a zero denominator counts as zero."""
    total = F.lit(0.0)
    for power, (num, den) in enumerate(parts):
        total = total + F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num.cast("double"), den.cast("double"))) / 60**power
    return total * F.when(F.upper(F.coalesce(reference, F.lit(""))) == negative, -1.0).otherwise(1.0)


def orientation_exif(orientation: Column) -> Column:
    """The smallest EXIF block, big-endian, that says how to turn the picture: as hexadecimal digits."""
    return F.concat(F.lit((EXIF_PREFIX + b"MM\x00\x2a\x00\x00\x00\x08\x00\x01\x01\x12\x00\x03\x00\x00\x00\x01").hex().upper()), F.lpad(F.hex(orientation.bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lit("0000" + "00000000"))


def preset_options(preset: Column, source: Column) -> Column:
    """Format, quality, effort and longest side of a preset; null for an unknown one."""
    out = None
    for name, form, quality, effort, side in PRESETS:
        made = F.struct((F.lit(form) if form else source).alias("format"), F.lit(quality).alias("quality"), F.lit(effort).alias("effort"), F.lit(side).cast("int").alias("max_dim"))
        out = F.when(preset == name, made) if out is None else out.when(preset == name, made)
    return out


#: The longest sides that may be asked for.
CAPS = (1024, 1600, 2048, 3200)


def options_ok(quality: Column, effort: Column, cap: Column) -> tuple[Column, Column, Column]:
    """Whether each of the options is one that can be asked for; no cap is one."""
    return quality.between(1, 100), effort.between(0, 6), cap.isNull() | F.coalesce(cap.isin(*CAPS), F.lit(False))
