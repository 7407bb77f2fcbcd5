"""Queries on image containers, over files and segments made from rows of part."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import media as M
from redactlake.functions import text as T
from redactlake.operators import media as O
from redactlake.plans.registry import query, table
from redactlake.sources import containers

_HEADS = ("FFD8FFE000104A464946", "89504E470D0A1A0A0000000D", "524946461A00000057454250", "25504446", "FFD8", "5249464600000000574542")
_HEAD_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADS)) + " END"
_FORMAT_SQL = "CASE WHEN starts_with(h, 'FFD8FF') THEN 'jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, '52494646') AND h[17:24] = '57454250' THEN 'webp' END"


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@query("q_detect_format", f"SELECT p_partkey, {_FORMAT_SQL} AS format, CASE {_FORMAT_SQL} WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' END AS mime, {_FORMAT_SQL} IS NULL AS refused FROM (SELECT p_partkey, {_HEAD_SQL} AS h FROM part)")
def detect_format(spark, sf_dir):
    content = F.unhex(_pick(_HEADS, F.col("p_partkey")))
    form = M.detect_format(content)
    return table(spark, sf_dir, "part").select("p_partkey", form.alias("format"), M.mime_type(form).alias("mime"), M.format_error(content).isNotNull().alias("refused"))


_PAYLOADS = ("JFIF", "ICC_PROFILE", "Adobe", "http://ns.adobe.com/xap/1.0/", "Photoshop 3.0", "other")
_PAYLOAD_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_PAYLOADS)) + " END"
_JPEG_SQL = """CASE WHEN m IN (216, 217, 1, 218) OR m BETWEEN 208 AND 215 OR m BETWEEN 192 AND 207 OR m BETWEEN 219 AND 223 THEN 'structural'
 WHEN m = 224 AND p LIKE 'JFIF%' THEN 'jfif' WHEN m = 226 AND p LIKE 'ICC_PROFILE%' THEN 'icc' WHEN m = 238 AND p LIKE 'Adobe%' THEN 'adobe'
 WHEN m = 225 AND p LIKE 'http://ns.adobe.com/xap/1.0/%' THEN 'xmp' WHEN m = 237 AND p LIKE 'Photoshop 3.0%' THEN 'iptc' WHEN m = 254 THEN 'comment' ELSE 'unknown' END"""


def _jpeg(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", ((key * 5) % 64 + 192).alias("m"), _pick(_PAYLOADS, key).cast("binary").alias("p"))


_JPEG_ROWS = f"SELECT p_partkey, (p_partkey * 5) % 64 + 192 AS m, {_PAYLOAD_SQL} AS p FROM part"


@query("q_jpeg_classify", f"SELECT p_partkey, kind, kind IN ('structural', 'jfif', 'adobe', 'icc') AS kept, kind IN ('structural', 'jfif', 'adobe') AS kept_plain FROM (SELECT p_partkey, {_JPEG_SQL} AS kind FROM ({_JPEG_ROWS}))")
def jpeg_classify(spark, sf_dir):
    rows = _jpeg(spark, sf_dir).select("p_partkey", M.jpeg_kind(F.col("m"), F.col("p")).alias("kind"))
    return rows.select("p_partkey", "kind", M.is_kept("jpeg", F.col("kind")).alias("kept"), M.is_kept("jpeg", F.col("kind"), False).alias("kept_plain"))


_PNG_CODES = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "sBIT", "acTL", "gAMA", "iCCP", "pHYs", "tEXt", "zTXt", "iTXt", "eXIf", "tIME", "vNDr", "ihdr")
_WEBP_CODES = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP", "EXIF", "XMP ", "XMP", "VP8", "vend")


def _code_sql(codes, kinds):
    code = f"CASE p_partkey % {len(codes)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes)) + " END"
    kind = "CASE " + " ".join(f"WHEN code IN ({', '.join(repr(c) for c in group)}) THEN '{name}'" for name, group in kinds.items()) + " ELSE 'unknown' END"
    return f"SELECT p_partkey, code, kind, kind IN ('structural', 'color') AS kept FROM (SELECT *, {kind} AS kind FROM (SELECT p_partkey, {code} AS code FROM part))"


def _chunks(spark, sf_dir, form):
    codes, kind = (_PNG_CODES, M.png_kind) if form == "png" else (_WEBP_CODES, M.webp_kind)
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(codes, F.col("p_partkey")).alias("code"))
    return rows.withColumn("kind", kind(F.col("code"))).withColumn("kept", M.is_kept(form, F.col("kind")))


@query("q_png_classify", _code_sql(_PNG_CODES, M.PNG_KINDS))
def png_classify(spark, sf_dir):
    return _chunks(spark, sf_dir, "png")


@query("q_webp_classify", _code_sql(_WEBP_CODES, M.WEBP_KINDS))
def webp_classify(spark, sf_dir):
    return _chunks(spark, sf_dir, "webp")


@query("q_dropped", f"SELECT code, count(*) AS n, min(p_partkey) AS first_key FROM ({_code_sql(_PNG_CODES, M.PNG_KINDS)}) WHERE NOT kept GROUP BY code")
def dropped(spark, sf_dir):
    """Segments that aren't in the allowlist, as an anti-join."""
    chunks = _chunks(spark, sf_dir, "png").select("p_partkey", "code")
    allowed = spark.createDataFrame([(c,) for kind in ("structural", "color") for c in M.PNG_KINDS[kind]], "code string")
    return chunks.join(F.broadcast(allowed), "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))  # 19 rows


@query("q_animated", "SELECT p_partkey // 10 AS file_id, bool_or(p_partkey % 17 = 6) AS animated FROM part GROUP BY 1")
def animated(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "png").select(F.floor(F.col("p_partkey") / 10).cast("bigint").alias("file_id"), F.lit("png").alias("format"), "code", F.lit(None).cast("string").alias("error"))
    return O.animated(rows)


@query("q_vp8x_flags", "SELECT p_partkey, (p_partkey % 256) & CASE WHEN p_partkey % 2 = 0 THEN 243 ELSE 211 END AS flags FROM part")
def vp8x_flags(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", M.vp8x_flags(key % 256, key % 2 == 0).alias("flags"))


@query("q_orientation_exif", "SELECT p_partkey, '4578696600004D4D002A000000080001011200030000000100' || '0' || (p_partkey % 9) || '000000000000' AS block FROM part")
def orientation_exif(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", M.orientation_exif(F.col("p_partkey") % 9).alias("block"))


@query(
    "q_exif_gps",
    """SELECT p_partkey, printf('%.5f', lat + 0.0::DOUBLE) || ', ' || printf('%.5f', lon + 0.0::DOUBLE) AS place FROM (
      SELECT p_partkey, (p_size + (CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 60)::DOUBLE / (p_partkey % 7) END) / 60 + p_retailprice / 100 / 3600) * CASE WHEN p_partkey % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS lat,
             (p_partkey % 180)::DOUBLE * CASE WHEN p_partkey % 3 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS lon FROM part)""",
)
def exif_gps(spark, sf_dir):
    key, one = F.col("p_partkey"), F.lit(1)
    lat = M.degrees([(F.col("p_size"), one), (key % 60, key % 7), (F.col("p_retailprice"), F.lit(100))], F.when(key % 2 == 0, "s").otherwise("N"), "S")
    lon = M.degrees([(key % 180, one), (F.lit(5), F.lit(0)), (F.lit(0), one)], F.when(key % 3 == 0, "W"), "W")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(T.coordinate(lat), F.lit(", "), T.coordinate(lon)).alias("place"))


@query("q_percent_saved", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b <= 0 THEN 0 ELSE floor((b - a)::DOUBLE / b * 100 + 0.5)::BIGINT END AS saved FROM (SELECT *, l_partkey % 500 * 10 AS b, l_suppkey * 37 % 4000 AS a FROM lineitem)")
def percent_saved(spark, sf_dir):
    saved = T.percent_saved(F.col("l_partkey") % 500 * 10, F.col("l_suppkey") * 37 % 4000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", saved.alias("saved"))


@query(
    "q_format_bytes",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (k // 10) || '.' || (k % 10) || ' KB' ELSE (m // 100) || '.' || lpad((m % 100)::VARCHAR, 2, '0') || ' MB' END AS size
    FROM (SELECT *, (n * 10 + 512) // 1024 AS k, (n * 100 + 524288) // 1048576 AS m FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 1100 WHEN 1 THEN l_partkey * l_suppkey ELSE l_orderkey * 1023 END AS n FROM lineitem))""",
)
def format_bytes(spark, sf_dir):
    line = F.col("l_linenumber") % 3
    n = F.when(line == 0, F.col("l_partkey") % 1100).when(line == 1, F.col("l_partkey") * F.col("l_suppkey")).otherwise(F.col("l_orderkey") * 1023)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.format_bytes(n).alias("size"))


_NAMES = ("a.pdf", "B.PDF", ".hidden", "photo.jpeg", "two.dots.png", "plain", "x.Pdf.txt")
_NAME_SQL = "p_name || CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


@query(
    "q_file_names",
    f"""SELECT p_partkey, regexp_replace(n, '(?i)\\.pdf$', '') || '-redacted.pdf' AS redacted, regexp_replace(n, '^(.+)\\.[^.]*$', '\\1') || '-small.' || CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'webp' END AS small,
    CASE WHEN regexp_matches(n, '^.+\\.[^.]*$') THEN regexp_replace(n, '^(.+)(\\.[^.]*)$', '\\1-clean\\2') ELSE n || '-clean' END AS clean, regexp_matches(n, '(?i)\\.pdf$') AS pdf
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_NAME_SQL} ELSE CASE p_partkey % 7 {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))} END END AS n FROM part)""",
)
def file_names(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 2 == 0, F.concat("p_name", _pick(_NAMES, key))).otherwise(_pick(_NAMES, key))
    form = _pick(("jpeg", "png", "webp"), key)
    return table(spark, sf_dir, "part").select("p_partkey", T.redacted_name(name).alias("redacted"), T.with_suffix(name, "-small", M.extension(form)).alias("small"), O.clean_name(name).alias("clean"), F.rlike(name, F.lit(r"(?i)\.pdf$")).alias("pdf"))


@query(
    "q_preset_options",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'webp' ELSE s END AS format, CASE p_partkey % 3 WHEN 0 THEN 55 WHEN 1 THEN 78 ELSE 92 END AS quality, CASE p_partkey % 3 WHEN 0 THEN 4 ELSE 2 END AS effort, CASE p_partkey % 3 WHEN 0 THEN 2048 END AS max_dim
    FROM (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'jpeg' ELSE 'png' END AS s FROM part)""",
)
def preset_options(spark, sf_dir):
    key = F.col("p_partkey")
    options = M.preset_options(_pick(("smallest", "balanced", "best"), key), _pick(("jpeg", "png"), key))
    return table(spark, sf_dir, "part").select("p_partkey", options.alias("o")).select("p_partkey", "o.*")


def _png_files(spark, sf_dir):
    """A PNG for each part: header, a text chunk that holds its name, an unknown chunk for some, end."""
    name = F.encode(F.concat(F.lit("Title"), F.lit("\0"), F.col("p_name")), "ISO-8859-1")
    chunk = lambda kind, data: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("bigint")), 8, "0")), F.lit(bytearray(kind)), data, F.unhex(F.lpad(F.hex(F.crc32(F.concat(F.lit(bytearray(kind)), data))), 8, "0")))
    empty = F.lit(bytearray())
    extra = F.when(F.col("p_partkey") % 4 == 0, chunk(b"vNDr", F.lit(bytearray(b"abc")))).otherwise(empty)
    content = F.concat(F.lit(bytearray(M.PNG_SIGNATURE)), chunk(b"IHDR", F.lit(bytearray(13))), chunk(b"tEXt", name), extra, chunk(b"IEND", empty))
    broken = F.when(F.col("p_partkey") % 50 == 49, F.substring(content, 1, 40)).otherwise(content)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), broken.alias("content"), "p_name")


_TEXT_END = "45 + 6 + length(p_name)"


@query(
    "q_png_segments",
    f"""SELECT p_partkey AS file_id, s.code AS code, s.a::BIGINT AS start_at, s.b::BIGINT AS end_at FROM (SELECT p_partkey, unnest(list_filter([
      {{'code': 'IHDR', 'a': 8, 'b': 33}}, {{'code': 'tEXt', 'a': 33, 'b': {_TEXT_END}}}, {{'code': CASE WHEN p_partkey % 4 = 0 THEN 'vNDr' END, 'a': {_TEXT_END}, 'b': {_TEXT_END} + 15}},
      {{'code': 'IEND', 'a': {_TEXT_END} + CASE WHEN p_partkey % 4 = 0 THEN 15 ELSE 0 END, 'b': {_TEXT_END} + 12 + CASE WHEN p_partkey % 4 = 0 THEN 15 ELSE 0 END}}], lambda x: x.code IS NOT NULL)) AS s FROM part WHERE p_partkey % 50 <> 49)
    UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 50 = 49""",
)
def png_segments(spark, sf_dir):
    return containers.segments(spark, _png_files(spark, sf_dir)).select("file_id", "code", "start_at", "end_at")


@query(
    "q_media_findings",
    f"""SELECT p_partkey AS file_id, 0::BIGINT AS ord, 'png-text-tEXt-33' AS id, 'Keyword Title' AS title, 'tEXt, ' || (6 + length(p_name)) || ' bytes' AS detail FROM part WHERE p_partkey % 50 <> 49
    UNION ALL SELECT p_partkey, 1, 'png-chunk-vNDr-' || ({_TEXT_END}), 'Chunk of type vNDr', '3 bytes in one of the chunks outside the allowlist; a strip drops it.' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 50 <> 49""",
)
def media_findings(spark, sf_dir):
    files = _png_files(spark, sf_dir)
    return O.findings(files, containers.segments(spark, files)).select("file_id", F.col("ord").cast("bigint").alias("ord"), "id", "title", "detail")


@query("q_media_strip", "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 50 <> 49 THEN '89504E470D0A1A0A0000000D49484452' || repeat('00', 13) || '2E90680F' || '0000000049454E44AE426082' END AS content, p_partkey % 50 = 49 AS failed, 0::BIGINT AS remaining FROM part")
def media_strip(spark, sf_dir):
    """Stripped files, and how many findings reading them again still gives."""
    stripped = O.strip(_png_files(spark, sf_dir))
    again = O.findings(stripped, containers.segments(spark, stripped.where("content is not null"))).groupBy("file_id").agg(F.count("*").alias("n"))
    return stripped.join(again, "file_id", "left").select("file_id", F.hex("content").alias("content"), F.col("error").isNotNull().alias("failed"), F.coalesce("n", F.lit(0)).alias("remaining"))


@query("q_top_findings", "SELECT o_custkey AS file_id, array_to_string(list(o_orderpriority ORDER BY o_orderkey)[1:5], ',') AS shown, greatest(0, count(*) - 5) AS more FROM orders GROUP BY o_custkey")
def top_findings(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("id"))
    return O.top_findings(found).select("file_id", F.array_join("shown", ",").alias("shown"), F.col("more").cast("bigint").alias("more"))


def _hex(number, digits):
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), digits, "0"))


def _broken(content, size):
    """Cut short for some."""
    return F.when(F.col("p_partkey") % 50 == 49, F.substring(content, 1, size)).otherwise(content)


_JPEG_HEAD, _JPEG_TAIL = "FFD8FFE000104A46494600010100000100010000", "FFDA0002112233FFD9"
_TURN = "'FFE100224578696600004D4D002A000000080001011200030000000100' || '0' || (p_partkey % 9) || '000000000000'"


def _jpeg_files(spark, sf_dir):
    """A JPEG for each part: header, its name as a comment, an EXIF block that turns it, an application segment for some, a scan."""
    key, name = F.col("p_partkey"), F.encode("p_name", "ISO-8859-1")
    raw = lambda digits: F.unhex(F.lit(digits))
    extra = F.when(key % 4 == 0, raw("FFE90005616263")).otherwise(F.lit(bytearray()))
    content = F.concat(raw(_JPEG_HEAD), raw("FFFE"), _hex(F.octet_length(name) + 2, 4), name, raw("FFE10022"), F.unhex(M.orientation_exif(key % 9)), extra, raw(_JPEG_TAIL))
    return table(spark, sf_dir, "part").select(key.alias("file_id"), _broken(content, 26).alias("content"))


def _found(spark, files):
    return O.findings(files, containers.segments(spark, files)).select("file_id", F.col("ord").cast("bigint").alias("ord"), "id", "title", "detail")


def _stripped(spark, files):
    """Stripped files, how many findings reading them again still gives, and how many notes."""
    stripped = O.strip(files)
    again = O.findings(stripped, containers.segments(spark, stripped.where("content is not null"))).groupBy("file_id").agg(F.count("*").alias("n"))
    return stripped.join(again, "file_id", "left").select("file_id", F.hex("content").alias("content"), F.col("error").isNotNull().alias("failed"), F.coalesce("n", F.lit(0)).alias("remaining"), F.coalesce(F.size("notes"), F.lit(0)).cast("bigint").alias("n_notes"))


@query(
    "q_jpeg_findings",
    """SELECT p_partkey AS file_id, 0::BIGINT AS ord, 'jpeg-comment' AS id, 'JPEG comment' AS title, length(p_name) || ' bytes.' AS detail FROM part WHERE p_partkey % 50 <> 49
    UNION ALL SELECT p_partkey, 1, 'jpeg-app-e9-' || (60 + length(p_name)), 'Application segment 0xE9', '3 bytes in one of the segments outside the allowlist; a strip drops it.' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 50 <> 49""",
)
def jpeg_findings(spark, sf_dir):
    return _found(spark, _jpeg_files(spark, sf_dir))


@query(
    "q_jpeg_strip",
    f"""SELECT p_partkey AS file_id, CASE WHEN p_partkey % 50 <> 49 THEN '{_JPEG_HEAD}' || CASE WHEN p_partkey % 9 > 1 THEN {_TURN} ELSE '' END || '{_JPEG_TAIL}' END AS content,
    p_partkey % 50 = 49 AS failed, 0::BIGINT AS remaining, CASE WHEN p_partkey % 50 <> 49 AND p_partkey % 9 > 1 THEN 1 ELSE 0 END::BIGINT AS n_notes FROM part""",
)
def jpeg_strip(spark, sf_dir):
    return _stripped(spark, _jpeg_files(spark, sf_dir))


def _webp_files(spark, sf_dir):
    """A WebP for each part: extended header, picture, its name as XMP, an unknown chunk for some."""
    key, name = F.col("p_partkey"), F.encode("p_name", "ISO-8859-1")
    raw = lambda digits: F.unhex(F.lit(digits))
    n = F.octet_length(name)
    little = lambda x: F.concat(_hex(x % 256, 2), _hex(F.floor(x / 256), 2), raw("0000"))
    pad = F.when(n % 2 == 1, raw("00")).otherwise(F.lit(bytearray()))
    extra = F.when(key % 4 == 0, raw("76656E640300000061626300")).otherwise(F.lit(bytearray()))
    size = F.lit(34) + 8 + n + n % 2 + F.when(key % 4 == 0, 12).otherwise(0)
    content = F.concat(raw("52494646"), little(size), raw("57454250565038580A0000002E000000000000000000565038200300000011223300"), F.lit(bytearray(b"XMP ")), little(n), name, pad, extra)
    return table(spark, sf_dir, "part").select(key.alias("file_id"), _broken(content, 40).alias("content"))


@query(
    "q_webp_findings",
    """SELECT p_partkey AS file_id, 0::BIGINT AS ord, 'webp-xmp' AS id, 'XMP packet' AS title, length(p_name) || ' bytes of XML.' AS detail FROM part WHERE p_partkey % 50 <> 49
    UNION ALL SELECT p_partkey, 1, 'webp-chunk-vend-' || (50 + length(p_name) + length(p_name) % 2), 'Chunk of type vend', '3 bytes in one of the chunks outside the allowlist; a strip drops it.' FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 50 <> 49""",
)
def webp_findings(spark, sf_dir):
    return _found(spark, _webp_files(spark, sf_dir))


@query("q_webp_strip", "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 50 <> 49 THEN '524946462200000057454250565038580A00000002000000000000000000565038200300000011223300' END AS content, p_partkey % 50 = 49 AS failed, 0::BIGINT AS remaining, 0::BIGINT AS n_notes FROM part")
def webp_strip(spark, sf_dir):
    return _stripped(spark, _webp_files(spark, sf_dir))


def _tiff():
    """An EXIF block for each part: device, orientation, software, time, maker note, serials, position and thumbnail; both byte orders, broken for some."""
    import struct

    key = F.col("p_partkey")
    texts = {
        "model": F.concat(F.lit("M"), F.lpad((key % 10000).cast("string"), 4, "0")),
        "time": F.concat(F.lit("2024:01:02 03:04:"), F.lpad((key % 60).cast("string"), 2, "0")),
        "serial": F.concat(F.lit("SN"), F.lpad((key % 1000000).cast("string"), 6, "0")),
    }
    orders = []
    for order in ("<", ">"):
        little = order == "<"
        number = lambda v, n=8, little=little: F.concat(*(_hex(F.shiftright(v, 8 * i) % 256, 2) for i in (range(n // 2) if little else range(n // 2 - 1, -1, -1))))
        fixed = lambda *v, order=order: F.lit(bytearray(b"".join(struct.pack(order + k, x) for k, x in v)))
        entry = lambda tag, kind, n, value, fixed=fixed: F.concat(fixed(("H", tag), ("H", kind), ("I", n)), value)
        at = lambda v, fixed=fixed: fixed(("I", v))
        inline = lambda text: F.lit(bytearray(text.ljust(4, b"\0")))
        short = lambda v, fixed=fixed: fixed(("H", v), ("H", 0))
        side = lambda odd, even: F.when(key % 2 == 1, inline(odd)).otherwise(inline(even))
        ratio = lambda v, number=number, fixed=fixed: F.concat(number(v), fixed(("I", 1)))
        count = lambda n, fixed=fixed: fixed(("H", n))
        magic = F.when(key % 50 == 49, F.lit(bytearray(b"XX"))).otherwise(F.lit(bytearray(b"II" if little else b"MM")))
        pieces = [
            magic, fixed(("H", 42), ("I", 8)),
            count(7), entry(0x010F, 2, 4, inline(b"Cam")), entry(0x0110, 2, 6, at(224)), entry(0x0112, 3, 1, short(6)), entry(0x0131, 2, 4, inline(b"Sw1")), entry(0x0132, 2, 20, at(230)), entry(0x8769, 4, 1, at(128)), entry(0x8825, 4, 1, at(170)), at(98),
            count(2), entry(0x0201, 4, 1, at(308)), entry(0x0202, 4, 1, number(key % 500 + 1)), at(0),
            count(3), entry(0x927C, 7, 4, inline(b"note")), entry(0xA431, 2, 9, at(250)), entry(0xA435, 2, 3, inline(b"L1")), at(0),
            count(4), entry(0x0001, 2, 2, side(b"S", b"N")), entry(0x0002, 5, 3, at(260)), entry(0x0003, 2, 2, side(b"w", b"E")), entry(0x0004, 5, 3, at(284)), at(0),
            *(F.concat(texts[t].cast("binary"), F.lit(bytearray(1))) for t in ("model", "time", "serial")), F.lit(bytearray(1)),
            ratio(key % 90), ratio(key % 4 * 15), ratio(F.lit(36)), ratio(key % 180), ratio(F.lit(15)), ratio(F.lit(18)),
        ]
        orders.append(F.concat(*pieces))
    return F.when(key % 4 < 2, orders[0]).otherwise(orders[1])


def _exif_files(spark, sf_dir):
    """A JPEG, PNG or WebP for each part that holds an EXIF block of 308 bytes; every second WebP's begins with the prefix that a JPEG's has."""
    key, raw = F.col("p_partkey"), lambda digits: F.unhex(F.lit(digits))
    block, prefix = F.col("block"), F.lit(bytearray(M.EXIF_PREFIX))
    jpeg = F.concat(raw(_JPEG_HEAD), raw("FFE1013C"), prefix, block, raw(_JPEG_TAIL))
    png = F.concat(F.lit(bytearray(M.PNG_SIGNATURE)), raw("0000000D49484452" + "00" * 13 + "2E90680F"), raw("0000013465584966"), block, raw("00000000"), raw("0000000049454E44AE426082"))
    webp = lambda n, held: F.concat(raw("52494646"), raw(f"{(12 + 8 + n).to_bytes(4, 'little').hex()}"), raw("574542505650382000000000"), F.lit(bytearray(b"EXIF")), raw(n.to_bytes(4, "little").hex()), held)
    made = F.when(key % 3 == 0, jpeg).when(key % 3 == 1, png).when(key % 2 == 0, webp(308, block)).otherwise(webp(314, F.concat(prefix, block)))
    return table(spark, sf_dir, "part").withColumn("block", _tiff()).select(key.alias("file_id"), made.alias("content"))


_EXIF_SQL = (
    ("'exif-gps'", "printf('%.5f', (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * (k % 90 + (k % 4) / 4.0 + 0.01)) || ', ' || printf('%.5f', (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * (k % 180 + 0.255))"),
    ("'exif-thumbnail'", "(k % 500 + 1) || ' bytes; may predate later edits of the picture.'"),
    ("'exif-device'", "'Cam M' || lpad((k % 10000)::VARCHAR, 4, '0')"),
    ("'exif-serial'", "'SN' || lpad((k % 1000000)::VARCHAR, 6, '0') || ', L1'"),
    ("'exif-timestamp'", "'2024:01:02 03:04:' || lpad((k % 60)::VARCHAR, 2, '0')"),
    ("'exif-software'", "'Sw1'"),
    ("'exif-makernote'", "'Opaque bytes in the format of one vendor.'"),
)


@query(
    "q_exif_findings",
    "WITH f AS (SELECT p_partkey AS k FROM part) "
    + " UNION ALL ".join(f"SELECT k AS file_id, {i}::BIGINT AS ord, {ident} AS id, {detail} AS detail FROM f WHERE k % 50 <> 49" for i, (ident, detail) in enumerate(_EXIF_SQL))
    + """ UNION ALL SELECT k, 0, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'png-' ELSE 'webp-' END || 'exif-unreadable', CASE WHEN k % 3 = 0 OR (k % 3 = 2 AND k % 2 = 1) THEN 314 ELSE 308 END || ' bytes that do not parse; a strip drops the whole block.' FROM f WHERE k % 50 = 49""",
)
def exif_findings(spark, sf_dir):
    """What EXIF blocks of files tell, in both byte orders and all containers; and what is found again after a strip: nothing."""
    files = _exif_files(spark, sf_dir)
    found = O.findings(files, containers.segments(spark, files)).select("file_id", F.col("ord").cast("bigint").alias("ord"), "id", "detail")
    stripped = O.strip(files).where("content is not null")
    return found.unionByName(O.findings(stripped, containers.segments(spark, stripped)).select("file_id", F.col("ord").cast("bigint").alias("ord"), "id", "detail"))
