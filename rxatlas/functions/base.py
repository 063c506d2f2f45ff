"""Small Column helpers shared by every module.

Absent values are NULL throughout the library: ``nz`` turns blank text into NULL once, at ingest,
and ``coalesce`` does the rest. Empty strings appear only where a sheet or a key needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """Trimmed text, NULL when blank."""
    return filled(F.trim(as_col(c), F.lit(BLANKS)))


def filled(c: Column) -> Column:
    """A computed text, NULL when empty. ``nullif`` refers to its value twice, so that nested ones compute it four and eight times;
    an array function refers to it once and, unlike a lambda, is compiled, and folded where the value is a constant (absent columns)."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def non_empty(c: Column | str) -> Column:
    """The value itself (untrimmed), NULL when it is the empty string."""
    return F.nullif(as_col(c), F.lit(""))


def text(c: Column | str) -> Column:
    """NULL shown as the empty string."""
    return F.coalesce(as_col(c), F.lit(""))


def opt(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df``, or a NULL string literal when the frame does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def staged(df: DataFrame, name: str, otherwise) -> Column:
    """A value computed by an earlier projection of the frame, else its expression."""
    return F.col(name) if name in df.columns else otherwise()


def first_value(*cols: Column | str) -> Column:
    """First non-blank value, trimmed."""
    parts = [nz(c) for c in cols]
    return parts[0] if len(parts) == 1 else F.coalesce(*parts)


def display_value(*cols: Column | str) -> Column:
    return F.coalesce(first_value(*cols), F.lit("Not available"))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def is_tidy(c: Column) -> Column:
    """ASCII text whose only white space are single blanks: told by byte searches, without a pattern."""
    return is_ascii(c) & all_of([~F.contains(c, F.lit(s)) for s in ("  ", "\t", "\n", "\x0b", "\x0c", "\r")])


def single_blanks(c: Column | str) -> Column:
    """Runs of white space as one blank; the pattern runs only over texts that have any."""
    return let(as_col(c), lambda v: F.when(is_tidy(v), v).otherwise(F.regexp_replace(v, r"(?U)\s+", " ")))


def collapse_ws(c: Column | str) -> Column:
    """Runs of white space become one blank, ends trimmed; NULL when nothing is left."""
    return filled(F.trim(single_blanks(c)))


def clean_block(c: Column | str, strip: str = " :;-") -> Column:
    """X1 with further characters stripped from both ends."""
    return filled(F.trim(single_blanks(c), F.lit(strip)))


def extract(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when there is none."""
    return filled(F.regexp_extract(as_col(c), pattern, group))


def by_letters(value: Column, body) -> Column:
    """``body`` of a mode of patterns: plain for ASCII texts, where it finds the same, and by Unicode classes for others."""
    return F.when(is_ascii(value), body("")).otherwise(body("U"))


def lower_trim(c: Column | str) -> Column:
    return F.lower(F.trim(text(c), F.lit(BLANKS)))


def contains_ci(haystack: Column | str, needle: Column | str) -> Column:
    return F.contains(F.lower(text(haystack)), F.lower(as_col(needle)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def case(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Ordered CASE WHEN."""
    out = reduce(lambda acc, b: acc.when(b[0], b[1]), branches[1:], F.when(*branches[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(c: Column, size: int) -> Column:
    """Distinct substrings of one to ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))

    def of_size(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))

    return F.array_distinct(F.concat(*[of_size(n) for n in range(1, size + 1)]))


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are expensive to compute.

    The optimizer moves a filter below the projections that compute its columns and copies their
    expressions into it, once per use. A row id it cannot look through keeps the filter above them.
    """
    marked = df.withColumn("_row_id", F.monotonically_increasing_id())
    return marked.filter((F.col("_row_id") >= 0) & condition).drop("_row_id")


def character(code: Column) -> Column:
    """The character of a code point; codes that are none become the replacement character."""
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    valid = F.when(known, code).when(code.isNotNull(), F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")


def cp1252(c: Column) -> Column:
    """Latin-1 text re-read as windows-1252."""
    codes = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", errors="ignore")]
    return F.translate(c, "".join(map(chr, codes)), "".join(bytes([i]).decode("cp1252") for i in codes))


def tokens(c: Column | str) -> Column:
    """Lower-case alphanumeric tokens in order."""
    return F.filter(F.split(F.lower(text(c)), r"[^a-z0-9]+"), lambda t: t != "")


def join_array(c: Column, sep: str) -> Column:
    """Array joined to text, NULL when the array is empty."""
    return F.nullif(F.array_join(c, sep), F.lit(""))
