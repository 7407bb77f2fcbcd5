"""What survives in a text: the checks that read an output again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions import text as T

def wanted_terms(terms: DataFrame) -> DataFrame:
    """Trimmed, not blank, each once: (term)."""
    return terms.select(T.trim(F.col("term")).alias("term")).where(F.length("term") > 0).distinct()


def occurrences(pages: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """(by..., term) where a page's text has the term as whole words. pages(by..., text), terms(term).

    A regular expression can't be joined on, so pages meet terms by the term's longest word, which any page
    with the term has as a word of its own. That join has words and keys alone; texts join the pairs that
    are left, where the term has to be contained literally before the expression decides. Terms without a
    word are as many as there are distinct ones; each is looked for by its first character.
    """
    flat_terms = terms.select("term", T.flat(F.col("term")).alias("flat_term")).withColumn("token", F.coalesce(T.longest_token(F.col("flat_term")), F.substring("flat_term", 1, 1)))
    flat_pages = pages.select(*by, T.flat(F.col("text")).alias("flat_text"))
    signs = F.array_distinct(F.regexp_extract_all(F.col("flat_text"), F.lit(f"([^{T.WORD[1:-1]}])"), F.lit(1)))
    words = flat_pages.select(*by, F.explode(F.concat(T.tokens(F.col("flat_text")), signs)).alias("token"))
    met = words.join(flat_terms, "token").select(*(F.col(c).alias(f"_{c}") for c in by), "term", "flat_term").distinct()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = flat_pages.join(met, same).where(F.contains("flat_text", "flat_term") & T.survives(F.col("flat_text"), F.col("flat_term")))
    return found.select(*by, "term")


def surviving_pages(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term, pages): ascending pages of a document on which a term is still found. pages(doc, page, text)."""
    hits = occurrences(pages, wanted_terms(terms), ["doc", "page"])
    return hits.groupBy("doc", "term").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc, text): pages joined by line breaks, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))


def page_text(runs: DataFrame) -> DataFrame:
    """(doc, page, text): runs in order, a line break after each that ends a line. runs(doc, page, seq, str, has_eol)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "str", "has_eol")))
    joined = F.array_join(F.transform(ordered, lambda r: F.concat(r["str"], F.when(r["has_eol"], "\n").otherwise(""))), "")
    return runs.where("str is not null").groupBy("doc", "page").agg(joined.alias("text"))


def leaked_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term) with the term anywhere in the document, across page breaks too. documents(doc, text)."""
    return occurrences(documents, wanted_terms(terms), ["doc"]).distinct()


def has_text_layer(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.bool_or(~T.is_blank(F.coalesce("text", F.lit("")))).alias("has_text"))


def report(docs: DataFrame, **lists: DataFrame) -> DataFrame:
    """(doc, n_<list>..., clean): a document is clean if every list of problems(doc) is empty for it."""
    out = docs.select("doc")
    for name, problems in lists.items():
        counts = problems.groupBy("doc").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counts, "doc", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    clean = F.lit(True)
    for name in lists:
        clean = clean & (F.col(f"n_{name}") == 0)
    return out.withColumn("clean", clean)


def haystack_offsets(runs: DataFrame) -> DataFrame:
    """Adds start, where a run begins in its page's search text: lower-cased runs, one space after a line end.

    runs(doc, page, seq, str, has_eol). A line may end on an empty run, which adds no text of its own.
    """
    order = Window.partitionBy("doc", "page").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.where("str is not null").withColumn("_full", F.when(F.length("str") > 0, F.col("seq"))).withColumn("_eol", F.when(F.col("has_eol"), F.col("seq")))
    marked = marked.withColumn("_last", F.max("_full").over(before)).withColumn("_end", F.max("_eol").over(before))
    marked = marked.where(F.length("str") > 0)
    ended = F.col("_end").isNotNull() & (F.col("_end") >= F.coalesce("_last", F.col("_end")))
    marked = marked.withColumn("_gap", F.when(ended, 1).otherwise(0))
    so_far = F.coalesce(F.sum(F.length("str") + F.col("_gap")).over(before), F.lit(0))
    return marked.withColumn("start", so_far + F.col("_gap")).drop("_full", "_eol", "_last", "_end", "_gap")


def match_spans(placed: DataFrame, needle: str) -> DataFrame:
    """(doc, page, seq, match_start, from_char, to_char): the part of each run that a match covers.

    placed is what haystack_offsets() gives. A page's matches come from its text as a whole, without
    overlap; then each run is compared with the matches of its own page only.
    """
    runs = F.array_sort(F.collect_list(F.struct("start", F.length("str").alias("n"), F.lower("str").alias("s"))))
    # a run that starts behind the end of the one before is preceded by one space
    end = lambda i: F.when(i == 0, 0).otherwise(F.col("runs")[i - 1]["start"] + F.col("runs")[i - 1]["n"])
    pieces = F.transform(F.col("runs"), lambda r, i: F.concat(F.when(r["start"] > end(i), " ").otherwise(""), r["s"]))
    pages = placed.groupBy("doc", "page").agg(runs.alias("runs")).select("doc", "page", F.array_join(pieces, "").alias("hay"), T.flat(F.lit(needle)).alias("needle"))
    pages = pages.where((F.length("needle") > 0) & F.contains("hay", "needle"))
    parts = F.split(F.col("hay"), F.concat(F.lit(r"\Q"), F.col("needle"), F.lit(r"\E")), -1)
    before = pages.select("doc", "page", F.length("needle").alias("n"), F.size(parts).alias("parts"), F.posexplode(F.transform(parts, F.length)).alias("i", "length"))
    so_far = F.sum("length").over(Window.partitionBy("doc", "page").orderBy("i"))
    matches = before.withColumn("match_start", (so_far + F.col("i") * F.col("n")).cast("int")).where("i < parts - 1").select("doc", "page", "match_start", "n")
    joined = placed.join(matches, ["doc", "page"]).withColumn("a", F.greatest("match_start", "start")).withColumn("b", F.least(F.col("match_start") + F.col("n"), F.col("start") + F.length("str")))
    return joined.where("a < b").select("doc", "page", "seq", "match_start", (F.col("a") - F.col("start")).alias("from_char"), (F.col("b") - F.col("start")).alias("to_char"))
