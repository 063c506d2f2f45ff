"""Company identity (X13, X14) and the manufacturer / holder display rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_col, collapse_ws, first_value, is_ascii, join_array, let, nz, opt, staged, text

# Fixed value: legal-form words that do not identify a company.
LEGAL_FORMS = r"(?=[lpigbskac])\b(?:limited|ltd|plc|inc|llc|gmbh|bv|b v|b\.v|sa|s a|s\.a|ag|kft|pty|pvt|private|company|co)\b"


def company_key(c: Column | str) -> Column:
    """Lower case, legal forms dropped, letters and digits only."""
    def read(value: Column) -> Column:
        return F.when(is_ascii(value), F.regexp_replace(value, LEGAL_FORMS, "")).otherwise(F.regexp_replace(value, f"(?U){LEGAL_FORMS}", ""))

    return F.regexp_replace(let(text(collapse_ws(F.lower(as_col(c)))), read), "[^a-z0-9]+", "")


def same_company(left: Column | str, right: Column | str) -> Column:
    """One key is a prefix of the other. Not transitive: never a grouping key."""
    return same_as_key(left, company_key(right))


def same_as_key(name: Column | str, key: Column) -> Column:
    """X14 with one key given: the other is computed once, not at each of its uses."""
    return let(company_key(name), lambda k: same_company_keys(k, key))


def same_company_keys(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def split_parts(c: Column | str) -> Column:
    """``;``-separated parts, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text(c), ";"), lambda p: F.trim(p)), lambda p: p != "")


def other_companies(parts: Column, owner_key: Column) -> Column:
    """Parts of a manufacturer list that are not the holder, whose key is given."""
    return F.filter(parts, lambda p: ~same_as_key(p, owner_key))


def holder(df: DataFrame) -> Column:
    names = [opt(df, c) for c in ("company", "mah", "ma_holder")]
    return staged(df, "_holder", lambda: first_value(*names))


def holder_key(df: DataFrame) -> Column:
    return staged(df, "_holder_key", lambda: company_key(holder(df)))


def manufacturer_name(df: DataFrame) -> Column:
    """The manufacturer list without the holder, NULL when nothing else is left."""
    def value() -> Column:
        key = holder_key(df)

        def without_holder(name: Column) -> Column:
            def shown(others: Column) -> Column:
                listed = F.nullif(F.array_join(others, "; "), F.lit(""))
                # one part that is left is known not to be the holder
                return F.when((F.size(others) < 2) | ~same_as_key(listed, key), listed)

            # a list of separators only has no parts: it stays as it is
            parts = let(other_companies(split_parts(name), key), shown)
            return F.when(F.rlike(name, F.lit("[^; ]")), parts).otherwise(F.when(~same_as_key(name, key), name))

        return let(nz(opt(df, "manufacturer_name")), without_holder)

    return staged(df, "_maker", value)


def company_display(df: DataFrame) -> Column:
    """First commercial company, unless it is the holder."""
    company = first_value(
        *[opt(df, n) for n in ("commercial_company", "brand_owner", "labeler_name", "sponsor", "applicant")]
    )
    return let(company, lambda c: F.when(~same_as_key(c, holder_key(df)), c))


def manufacturer_country(df: DataFrame) -> Column:
    """NULL without a manufacturer, or when it merely repeats the product country."""
    def value() -> Column:
        country = nz(opt(df, "manufacturer_country"))
        normal = [F.coalesce(collapse_ws(F.lower(c)), F.lit("")) for c in (country, opt(df, "country"))]
        repeats = (normal[0] == normal[1]) & nz(opt(df, "manufacturer_source")).isNull()
        return F.when(manufacturer_name(df).isNotNull() & ~repeats, country)

    return staged(df, "_maker_country", value)


def with_company_values(df: DataFrame) -> DataFrame:
    """The company rules as projections, each computed once per row."""
    df = df.withColumn("_holder", holder(df))
    df = df.withColumn("_holder_key", holder_key(df))
    df = df.withColumn("_maker", manufacturer_name(df))
    return df.withColumn("_maker_country", manufacturer_country(df))


def strip_holder_manufacturers(df: DataFrame) -> DataFrame:
    """Drop the holder from the manufacturer list; no manufacturer left clears country and source."""
    name = F.col("manufacturer_name")
    staged_df = df.withColumns({"_parts": split_parts(name), "_key": company_key("company")})
    staged_df = staged_df.withColumn("_others", other_companies(F.col("_parts"), F.col("_key")))
    changed = (F.size("_parts") > 0) & (F.col("_parts") != F.col("_others"))
    left = F.when(changed, join_array(F.col("_others"), "; ")).otherwise(name)
    emptied = changed & (F.size("_others") == 0)
    blanked = {
        c: F.when(~emptied, F.col(c)) for c in ("manufacturer_country", "manufacturer_source") if c in df.columns
    }
    return staged_df.withColumns({"manufacturer_name": left, **blanked}).drop("_parts", "_key", "_others")
