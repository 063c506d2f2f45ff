"""URL precedence rules of a product row (X25-X27, X31) and field availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .base import any_of, case, first_value, non_empty, nz, opt, staged, text
from .text import percent_encode

# --- Fixed values: why a field is missing ------------------------------------------------------
NOT_SUPPLIED = "Not supplied by regulator"
PENDING = "Pending document enrichment"
NOT_APPLICABLE = "Not applicable for this source"
NOT_EXTRACTED = "Product record not extracted"
DOCUMENT_FIELDS = ["smpc_url", "pil_url", "assessment_report_url"]
ENRICHMENT_FIELDS = ["pack_size", "manufacturer_name", "manufacturer_country"]
NO_DOCUMENT_SOURCES = [
    "FDA", "FDA Orange Book", "FDA Purple Book", "Health Canada", "TGA Australia", "Medsafe New Zealand",
]
LINK_FIELDS = ["product_url", "url", "source_url", "smpc_url", "pil_url", "assessment_report_url"]


def _url_key(c: Column) -> Column:
    return F.lower(F.rtrim(nz(c), F.lit("/")))


def distinct_url(url: Column, *blocked: Column) -> Column:
    """The URL, NULL when it equals a blocked one (letter case and trailing ``/`` ignored)."""
    value = nz(url)
    repeated = any_of([F.coalesce(_url_key(value) == _url_key(b), F.lit(False)) for b in blocked])
    return F.when(~repeated, value)


def product_or_url(df: DataFrame) -> Column:
    return F.coalesce(non_empty(opt(df, "product_url")), non_empty(opt(df, "url")))


def product_details_url(df: DataFrame) -> Column:
    """X27."""
    def value() -> Column:
        own = distinct_url(product_or_url(df), *[opt(df, f) for f in DOCUMENT_FIELDS])
        return F.coalesce(own, nz(opt(df, "source_url")))

    return staged(df, "_details", value)


def smpc_url(df: DataFrame) -> Column:
    def value() -> Column:
        is_smpc = F.upper(opt(df, "document_type")).isin("SPC", "SMPC")
        return F.coalesce(non_empty(opt(df, "smpc_url")), F.when(is_smpc, product_or_url(df)))

    return staged(df, "_smpc", value)


def pil_url(df: DataFrame) -> Column:
    return staged(df, "_pil", lambda: distinct_url(opt(df, "pil_url"), smpc_url(df)))


def assessment_url(df: DataFrame) -> Column:
    report = opt(df, "assessment_report_url")
    return staged(df, "_report", lambda: distinct_url(report, smpc_url(df), opt(df, "pil_url")))


def with_link_values(df: DataFrame) -> DataFrame:
    """The URL rules as projections, each computed once per row."""
    df = df.withColumns({"_details": product_details_url(df), "_smpc": smpc_url(df)})
    return df.withColumns({"_pil": pil_url(df), "_report": assessment_url(df)})


def pil_or_assessment_url(df: DataFrame) -> Column:
    """The leaflet, else the assessment report when it is neither the summary nor the leaflet shown."""
    report = distinct_url(opt(df, "assessment_report_url"), smpc_url(df), pil_url(df))
    return F.coalesce(pil_url(df), report)


def infer_document_type(df: DataFrame) -> Column:
    """X31."""
    return F.coalesce(
        non_empty(opt(df, "document_type")),
        case([
            (non_empty(opt(df, "smpc_url")).isNotNull(), F.lit("SPC")),
            (non_empty(opt(df, "pil_url")).isNotNull(), F.lit("PIL")),
            (non_empty(opt(df, "assessment_report_url")).isNotNull(), F.lit("Assessment report")),
        ]),
    )


def missing_reason(df: DataFrame, field: str) -> Column:
    """Why a field of a row has no value."""
    branches = [(text(nz(opt(df, "connector_mode"))) == "manual_registry", F.lit(NOT_EXTRACTED))]
    if field in DOCUMENT_FIELDS:
        branches.append((text(nz(opt(df, "source"))).isin(*NO_DOCUMENT_SOURCES), F.lit(NOT_APPLICABLE)))
    if field in DOCUMENT_FIELDS + ENRICHMENT_FIELDS:
        branches.append((any_of([non_empty(opt(df, f)).isNotNull() for f in LINK_FIELDS]), F.lit(PENDING)))
    return case(branches, F.lit(NOT_SUPPLIED))


def field_value(df: DataFrame, field: str, *values: Column) -> Column:
    return F.coalesce(first_value(*values), missing_reason(df, field))


def region_for_country(c: Column | str) -> Column:
    """The few aliases the store itself knows."""
    name = F.lower(nz(c))
    return case([
        (name.isin("united kingdom", "uk", "great britain"), F.lit("UK")),
        (name.isin("united states", "usa", "us"), F.lit("US")),
        (name.isin("canada"), F.lit("CA")),
        (name.isin("european union", "eu"), F.lit("EU")),
    ])


def country_region(c: Column | str) -> Column:
    """Region of a country by precedence of the lists; anything else is Global."""
    key = F.col(c) if isinstance(c, str) else c
    return F.coalesce(dims.lookup(dims.region_by_country(), key), F.lit("Global"))


def lookup_url(query: Column | str, country: Column | str) -> Column:
    """Search page of a country's register."""
    name = F.col(country) if isinstance(country, str) else country
    encoded = percent_encode(F.trim(F.col(query) if isinstance(query, str) else query))
    search = {c: dims.COUNTRY_SEARCH_URL["EU"] for c in dims.EU_COUNTRIES}
    search |= {c: u for c, u in dims.COUNTRY_SEARCH_URL.items() if c not in ("EU", "Switzerland")}
    fixed = {c: u for c, u in dims.COUNTRY_REGISTRY_URL.items() if c not in search}
    fixed.setdefault("Switzerland", dims.COUNTRY_SEARCH_URL["Switzerland"])
    template = F.coalesce(dims.lookup(search | fixed, name))
    other = F.concat(
        F.lit(dims.OTHER_SEARCH_URL), percent_encode(F.concat(name, F.lit(" medicine register "))), encoded
    )
    return F.coalesce(F.replace(template, F.lit("{q}"), encoded), other)
