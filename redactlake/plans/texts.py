"""Queries on texts: what of a term, a line or a layer can be recovered."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import text as T
from redactlake.operators import glyphs as G
from redactlake.operators import verify as V
from redactlake.plans.registry import query, table

_SPACE = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _flat(x):
    return f"regexp_replace(lower({x}), '{_SPACE}+', ' ', 'g')"


def _trimmed(x):
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _found(text, pattern):
    word = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({text}, '(^|{word})' || {pattern} || '({word}|$)')"


def _terms(select):
    literal = r"'([.*+?^${}()|\[\]\\])', '\\\1', 'g'"
    return f"SELECT term, regexp_replace({_flat('term')}, {literal}) AS pattern FROM ({select})"


def _leaked(docs):
    """CTEs up to leaked(doc, term): pairs whose flat text holds the flat term anywhere, then those where it stands as a word."""
    return f"""terms AS MATERIALIZED (SELECT term, pattern, {_flat("term")} AS flat FROM ({_terms(_LONG)})), docs AS MATERIALIZED ({docs}),
    pairs AS MATERIALIZED (SELECT doc, t, term, pattern FROM docs JOIN terms ON contains(t, flat)),
    leaked AS (SELECT DISTINCT doc, term FROM pairs WHERE {_found("t", "pattern")})"""


_SHORT = f"SELECT DISTINCT {_trimmed('t')} AS term FROM (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS t FROM benchmark UNION ALL SELECT 'un (ai)' UNION ALL SELECT ' the ') WHERE {_trimmed('t')} <> ''"
_LONG = f"SELECT DISTINCT {_trimmed('text')} AS term FROM benchmark WHERE {_trimmed('text')} <> ''"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def _short_terms(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)).alias("term"))
    return own.unionByName(spark.createDataFrame([("un (ai)",), (" the ",)], "term string"))


def _long_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("term"))


# Terms of two words: short ones are found on several pages, which are what this query lists. Pages are read
# whole; whole benchmark texts are the terms of q_leaked_terms and q_verify_clean.
@query(
    "q_surviving_pages",
    f"""WITH terms AS ({_terms(_SHORT)}), pages AS (SELECT conv_id AS doc, turn AS page, {_flat("text")} AS t FROM conversations)
    SELECT doc, term, array_to_string(list(page ORDER BY page), ',') AS pages, count(*) AS n_pages
    FROM (SELECT DISTINCT doc, page, term FROM pages, terms WHERE {_found("t", "pattern")}) GROUP BY doc, term""",
)
def surviving_pages(spark, sf_dir):
    out = V.surviving_pages(_pages(spark, sf_dir), _short_terms(spark, sf_dir))
    return out.select("doc", "term", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.size("pages").cast("bigint").alias("n_pages"))


@query(
    "q_leaked_terms",
    f"""WITH {_leaked(f"SELECT doc_id AS doc, {_flat('text')} AS t FROM documents")} SELECT doc, term FROM leaked""",
)
def leaked_terms(spark, sf_dir):
    return V.leaked_terms(_documents(spark, sf_dir), _long_terms(spark, sf_dir)).select("doc", "term")


@query(
    "q_recoverable_strings",
    f"""SELECT doc_id AS doc, len(s) AS n_strings, md5(array_to_string(list_sort(s), chr(10))) AS digest
    FROM (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trimmed("x")}), lambda x: x <> '')) AS s FROM documents)""",
)
def recoverable_strings(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc", T.recoverable_strings(F.col("text")).alias("s"))
    return rows.select("doc", F.size("s").cast("bigint").alias("n_strings"), F.md5(F.array_join(F.sort_array("s"), "\n")).alias("digest"))


@query(
    "q_match_count",
    f"""SELECT doc_id AS doc, ((length(t) - length(replace(t, 'of the', ''))) / 6)::BIGINT AS n_matches
    FROM (SELECT doc_id, {_flat("text")} AS t FROM documents)""",
)
def match_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc", T.match_count(T.flat(F.col("text")), F.lit("of the")).alias("n_matches"))


@query(
    "q_verify_clean",
    f"""WITH {_leaked(f"SELECT doc_id AS doc, text, {_flat('text')} AS t FROM documents")},
    found AS (SELECT doc, count(*) AS n FROM leaked GROUP BY doc),
    mail AS (SELECT doc, 1 AS n FROM docs WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9-]+[.][a-z]+'))
    SELECT doc, coalesce(found.n, 0)::BIGINT AS n_leaked, coalesce(mail.n, 0)::BIGINT AS n_addresses, coalesce(found.n, 0) + coalesce(mail.n, 0) = 0 AS clean
    FROM docs LEFT JOIN found USING (doc) LEFT JOIN mail USING (doc)""",
)
def verify_clean(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    addresses = docs.where(F.rlike("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9-]+[.][a-z]+"))).select("doc")
    return V.report(docs, leaked=V.leaked_terms(docs, _long_terms(spark, sf_dir)), addresses=addresses)


@query("q_has_text_layer", f"SELECT conv_id AS doc, bool_or({_trimmed('coalesce(text, chr(32))')} <> '') AS has_text FROM conversations GROUP BY conv_id")
def has_text_layer(spark, sf_dir):
    return V.has_text_layer(_pages(spark, sf_dir))


@query("q_document_text", "SELECT conv_id AS doc, length(string_agg(text, chr(10) ORDER BY turn, text)) AS n_chars, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def document_text(spark, sf_dir):
    return V.document_text(_pages(spark, sf_dir)).select("doc", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _lines(spark, sf_dir):
    """Documents as one page each, their lines as runs."""
    rows = _documents(spark, sf_dir).select("doc", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "str"))
    return rows.withColumn("has_eol", F.lit(True))


@query("q_page_text", "SELECT doc_id AS doc, md5(string_agg(str || CASE WHEN seq % 2 = 0 THEN chr(10) ELSE '' END, '' ORDER BY seq)) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS str, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents) GROUP BY doc_id")
def page_text(spark, sf_dir):
    runs = _lines(spark, sf_dir).withColumn("has_eol", F.col("seq") % 2 == 0)
    return V.page_text(runs).select("doc", F.md5("text").alias("digest"))


_LINES = "SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS str, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents"
_PLACED = f"""SELECT *, sum(length(str) + 1) OVER w - length(str) - 1 + CASE WHEN first_value(seq) OVER w > 0 THEN 1 ELSE 0 END AS start
    FROM ({_LINES}) WHERE length(str) > 0 WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING)"""


@query("q_haystack_offsets", f"SELECT doc, seq::BIGINT AS seq, start::BIGINT AS start FROM ({_PLACED})")
def haystack_offsets(spark, sf_dir):
    return V.haystack_offsets(_lines(spark, sf_dir)).select("doc", F.col("seq").cast("bigint").alias("seq"), F.col("start").cast("bigint").alias("start"))


@query(
    "q_match_spans",
    f"""WITH p AS ({_PLACED}), h AS (SELECT doc, CASE WHEN min(start) > 0 THEN ' ' ELSE '' END || string_agg(lower(str), ' ' ORDER BY seq) AS hay FROM p GROUP BY doc),
    s AS (SELECT doc, string_split(hay, 'and the') AS parts FROM h WHERE contains(hay, 'and the')),
    m AS (SELECT doc, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + 7 * (i - 1))) AS place FROM s)
    SELECT p.doc, p.seq::BIGINT AS seq, place::BIGINT AS match_start, (greatest(place, start) - start)::BIGINT AS from_char, (least(place + 7, start + length(str)) - start)::BIGINT AS to_char
    FROM p JOIN m USING (doc) WHERE greatest(place, start) < least(place + 7, start + length(str))""",
)
def match_spans(spark, sf_dir):
    spans = V.match_spans(V.haystack_offsets(_lines(spark, sf_dir)), "and  the")
    return spans.select("doc", *(F.col(c).cast("bigint").alias(c) for c in ("seq", "match_start", "from_char", "to_char")))


_ADVANCE = "CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN ascii(c) * 7 % 400 + 200 ELSE 500 END"
_LENGTH = f"list_sum(list_transform(string_split({{0}}, ''), lambda c: {_ADVANCE}))"


@query(
    "q_glyph_extents",
    f"""WITH p AS ({_PLACED}), h AS (SELECT doc, CASE WHEN min(start) > 0 THEN ' ' ELSE '' END || string_agg(lower(str), ' ' ORDER BY seq) AS hay FROM p GROUP BY doc),
    s AS (SELECT doc, string_split(hay, 'and the') AS parts FROM h WHERE contains(hay, 'and the')),
    m AS (SELECT doc, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + 7 * (i - 1))) AS place FROM s),
    t AS (SELECT p.doc, p.seq, str, place, (greatest(place, start) - start)::BIGINT AS a, (least(place + 7, start + length(str)) - start)::BIGINT AS b FROM p JOIN m USING (doc) WHERE greatest(place, start) < least(place + 7, start + length(str))),
    g AS (SELECT *, length(str) * 5.0 AS w, CASE WHEN a = 0 THEN 0.0 ELSE {_LENGTH.format("str[:a]")} END AS before, {_LENGTH.format("str[a + 1:b]")} AS inside, {_LENGTH.format("str")} AS total, greatest(612 * 0.0015, 10 * 0.08) AS margin FROM t)
    SELECT doc, seq::BIGINT AS seq, place::BIGINT AS match_start, round(CASE WHEN a = 0 THEN 36.0 ELSE greatest(36.0, 36.0 + before * w / total - margin) END, 6)::DOUBLE AS left_x,
    round(CASE WHEN b = length(str) THEN 36.0 + w ELSE least(36.0 + w, 36.0 + (before + inside) * w / total + margin) END, 6)::DOUBLE AS right_x FROM g""",
)
def glyph_extents(spark, sf_dir):
    """How far a match reaches within its line, by a font's advances scaled to the line's width."""
    code = F.sequence(F.lit(32), F.lit(126))
    advances = spark.range(1).select(F.explode(code).alias("c")).select(F.char("c").alias("ch"), (F.col("c") * 7 % 400 + 200).alias("advance"))
    lines = _lines(spark, sf_dir)
    runs = lines.select("doc", "page", "seq", "str", F.lit(36.0).alias("origin"), (F.length("str") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.lit("ltr").alias("dir"))
    found = G.extents(V.match_spans(V.haystack_offsets(lines), "and  the"), runs, F.broadcast(advances), F.lit(612.0))  # 95 rows
    return found.select("doc", F.col("seq").cast("bigint").alias("seq"), F.col("match_start").cast("bigint").alias("match_start"), F.round("left", 6).alias("left_x"), F.round("right", 6).alias("right_x"))
