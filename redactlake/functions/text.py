"""Text functions as column expressions, with the semantics that audits rely on.

White space is the Unicode set that browsers trim, line breaks and the byte-order mark included; lengths
count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space, as the inside of a Java character class.
SPACE = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Letters, digits and the underscore of any script: what makes a word.
WORD = r"[\p{L}\p{N}_]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def flat(text: Column) -> Column:
    """Lower case, every run of white space as one space: a line break reads as a space."""
    return F.regexp_replace(F.lower(text), rf"[{SPACE}]+", " ")


def is_blank(text: Column) -> Column:
    return F.length(trim(text)) == 0


def escaped(text: Column) -> Column:
    """A regular expression that matches the text literally."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def survives(flat_text: Column, flat_term: Column) -> Column:
    """Whether the term occurs as whole words; both are flat already."""
    return F.rlike(flat_text, F.concat(F.lit(f"(?<!{WORD})"), escaped(flat_term), F.lit(f"(?!{WORD})")))


def tokens(flat_text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(flat_text, F.lit(f"({WORD}+)"), F.lit(1)))


def longest_token(flat_term: Column) -> Column:
    """The term's longest word, the first of equals; null if it has none. A text with the term has it as a word."""
    words = F.regexp_extract_all(flat_term, F.lit(f"({WORD}+)"), F.lit(1))
    sized = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.try_element_at(F.array_sort(sized), F.lit(1)).getField("w")


def match_count(text: Column, needle: Column) -> Column:
    """Non-overlapping literal occurrences; none for an empty needle."""
    taken = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(F.try_divide(taken, F.length(needle)))).otherwise(0).cast("bigint")


def recoverable_strings(text: Column) -> Column:
    """Trimmed lines that aren't empty, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), trim), lambda s: s != ""))


def rounded(number: Column) -> Column:
    """To the nearest whole number, halves up, also below zero."""
    return F.floor(number + 0.5)


def percent_saved(before: Column, after: Column) -> Column:
    """Whole per cent; negative if it grew, 0 if there was nothing."""
    return F.when(before <= 0, F.lit(0)).otherwise(rounded(F.try_divide((before - after).cast("double"), before.cast("double")) * 100)).cast("bigint")


def format_bytes(count: Column) -> Column:
    """B, KB with one decimal or MB with two. Integer arithmetic, for binary fractions tie at halves."""
    kb = F.floor((count * 10 + 512) / 1024).cast("bigint")
    mb = F.floor((count * 100 + 524288) / 1048576).cast("bigint")
    fixed = lambda n, d: F.concat(F.floor(n / 10**d).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(10**d)).cast("string"), d, "0"))
    return F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B"))).when(count < 1048576, F.concat(fixed(kb, 1), F.lit(" KB"))).otherwise(F.concat(fixed(mb, 2), F.lit(" MB")))


def coordinate(degrees: Column) -> Column:
    """Five decimals, to the nearest of the exact binary value, halves up; a formatter would round its shortest decimal.

    The product with 10^5 and its rounding error, by splitting the factor into halves, are the exact product.
    """
    x = F.abs(degrees.cast("double"))
    product, shifted = x * 100000.0, x * 134217729.0
    high = shifted - (shifted - x)
    error = (high * 100000.0 - product) + (x - high) * 100000.0
    whole = F.floor(product)
    n = (whole + F.when((product - whole - 0.5) + error >= 0, 1).otherwise(0)).cast("bigint")
    digits = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(6)), F.lit("0"))
    point = F.length(digits) - 5
    return F.concat(F.when(degrees < 0, "-").otherwise(""), F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(5)))


# Names of files that are handed out.


def redacted_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("-redacted.pdf"))


def with_suffix(name: Column, suffix: str, extension: Column | None = None) -> Column:
    """suffix before the extension, or the extension replaced; a name that begins with its only dot has none."""
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")
    own = F.when(F.rlike(name, F.lit(r"(?s)^.+\.[^.]*$")), F.substring(name, F.length(stem) + 1, F.lit(1 << 30))).otherwise("")
    return F.concat(stem, F.lit(suffix), own if extension is None else F.concat(F.lit("."), extension))
