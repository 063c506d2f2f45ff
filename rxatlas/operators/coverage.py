"""Coverage of countries and fields, counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import links
from ..functions import text as tx
from ..functions.base import all_of, any_of, filter_computed, non_empty, nz, opt, text
from ..functions.english import english_row
from ..functions.rows import DISPLAY_FILTERS, with_display
from .identity import most_common_first

GAP_ORD = 1 << 61
HAYSTACK = [
    "substance", "product", "company", "country", "region", "status", "source", "registration_number",
    "registration_date", "document_type",
]


def searchable(shown: str = "shown") -> dict[str, Column]:
    """The displayed values behind the thirteen text filters, in the order they are searched."""
    order = [
        "substance", "product", "company", "ma_holder", "strength", "dosage_form", "pack_size", "atc_code",
        "therapeutic_category", "manufacturer_name", "manufacturer_country", "registration_number",
        "registration_date",
    ]
    return {n: F.col(f"{shown}.{'molecule' if n == 'substance' else n}") for n in order}


def filter_rows(df: DataFrame, filters: dict[str, Column | str]) -> DataFrame:
    """Exact and substring filters on raw and displayed values.

    ``filters`` maps ``country``, ``region``, ``source``, ``status``, ``table_search`` and
    ``<field>_filter`` to a constant or to a column of the frame (one value per query). Blank means off.
    """
    def wanted(name: str) -> Column | None:
        value = filters.get(name)
        if value is None or (isinstance(value, str) and value.strip() == ""):
            return None
        return text(F.lit(value) if isinstance(value, str) else value)

    # exact filters on raw columns come first, so that they can reach the scan
    for name in ("country", "source", "region"):
        value = wanted(name)
        if value is not None:
            off = value.isin("", "ALL") if name == "region" else value == ""
            df = df.filter(off | (text(opt(df, name)) == value))
    cells = searchable()
    conditions: list[Column] = []
    asking: list[Column] = []  # per condition, whether a row's query asks for it
    for field in DISPLAY_FILTERS:
        value = wanted(f"{field}_filter")
        if value is not None:
            needle = F.lower(F.trim(value))
            asking.append(needle != "")
            conditions.append((needle == "") | F.contains(F.lower(cells[field]), needle))
    status = wanted("status")
    if status is not None:
        asking.append(status != "")
        conditions.append((status == "") | (F.col("shown.registration_status") == status))
    search = wanted("table_search")
    if search is not None:
        needle = F.lower(F.trim(search))
        raw = F.concat_ws(" ", *[text(opt(df, c)) for c in HAYSTACK])
        hay = F.lower(F.concat_ws(" ", raw, *[text(c) for c in cells.values()]))
        asking.append(needle != "")
        conditions.append((needle == "") | F.contains(hay, needle))
    if not conditions:
        return df

    def shown(rows: DataFrame) -> DataFrame:
        return filter_computed(with_display(rows), all_of(conditions)).drop("shown")

    if all(isinstance(v, str) for v in filters.values()):
        return shown(df)
    # display values are built for rows whose query looks at them; the frame is read twice, so callers stage it
    asks = any_of(asking)
    return df.filter(~asks).unionByName(shown(df.filter(asks)))


# --- Country gaps (J4) ------------------------------------------------------------------------


def lookup_row_columns(substance: Column, country: Column, scope: Column) -> dict[str, Column]:
    """A placeholder row that points to a country's register; ``scope`` is '' for a single country."""
    clean = F.trim(substance)
    region = F.when(scope.isin("ALL", "AF", "ME", "AS"), scope).otherwise(links.country_region(country))
    url = links.lookup_url(clean, country)
    known = {k: v for k, v in dims.LOOKUP_SOURCES.items() if k}
    kind = F.when(dims.one_of(country, dims.EU_COUNTRIES) & ~scope.isin("ALL", "AF", "ME", "AS"), F.lit("EU")).otherwise(region)
    usable = F.when(kind.isin("EU", "AF", "ME", "AS", "ALL"), kind)
    empty = F.lit(None).cast("string")
    return {
        "substance": clean,
        "product": F.concat(clean, F.lit(" "), country, F.lit(" generic regulatory registry lookup")),
        "company": empty,
        "country": country,
        "region": region,
        "status": F.lit(dims.LOOKUP_STATUS),
        "document_type": F.coalesce(dims.lookup({k: v[1] for k, v in known.items()}, usable), F.lit(dims.LOOKUP_SOURCES[""][1])),
        "source": F.coalesce(dims.lookup({k: v[0] for k, v in known.items()}, usable), F.lit(dims.LOOKUP_SOURCES[""][0])),
        "source_url": url,
        "product_url": url,
        "url": url,
    }


def scope_countries() -> Column:
    """Countries to cover for a query's ``country`` / ``region``; empty when nothing is to be filled.

    The country wins over a single-country region, and the lists are constants: no join is needed.
    """
    lists = {"EU": dims.EU_COUNTRIES, "ALL": dims.all_countries(), **dims.MULTI_COUNTRY_REGIONS}
    none = F.array().cast("array<string>")
    listed = dims.lookup(lists, text("region"))
    single = F.coalesce(F.array(F.nullif(text("country"), F.lit(""))), none)
    of_region = dims.lookup({k: [v] for k, v in dims.SINGLE_COUNTRY_REGIONS.items()}, text("region"))
    return F.when(listed.isNotNull(), listed).when(text("country") != "", single).otherwise(F.coalesce(of_region, none))


def country_gap_rows(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """A placeholder per country of a query's scope that has no row.

    ``queries``: (query_id, substance, country, region, source), one row per query; ``rows``: the
    filtered rows with ``query_id``. A region list looks at rows of that region (ALL: of any), a
    single country only at whether the query has any row. Only distinct (query, country, region)
    combinations of the rows are shuffled.
    """
    wide = text("region").isin("EU", "ALL", *dims.MULTI_COUNTRY_REGIONS)
    scoped = (
        queries.filter(text("source") == "")
        .withColumn("_wide", wide)
        .select("query_id", "substance", F.col("region").alias("_scope"), "_wide", F.posexplode(scope_countries()).alias("_pos", "_c"))
    )
    seen = rows.select("query_id", text("country").alias("_c"), text("region").alias("_r")).distinct()
    answered = seen.select("query_id").distinct()
    wide_gaps = (
        scoped.filter("_wide")
        .join(
            seen.withColumnRenamed("query_id", "_qid").withColumnRenamed("_c", "_rc"),
            (F.col("query_id") == F.col("_qid")) & (F.col("_c") == F.col("_rc"))
            & ((F.col("_scope") == "ALL") | (F.col("_r") == F.col("_scope"))),
            "left_anti",
        )
    )
    single_gaps = scoped.filter("NOT _wide").join(answered, "query_id", "left_anti")
    gaps = wide_gaps.unionByName(single_gaps)
    scope = F.when(F.col("_wide"), text("_scope")).otherwise("")
    columns = lookup_row_columns(F.col("substance"), F.col("_c"), scope)
    place = (F.lit(GAP_ORD) + F.col("_pos")).alias("ord")  # after every real row
    return gaps.select("query_id", place, *[c.alias(n) for n, c in columns.items()])


# --- Counts -----------------------------------------------------------------------------------


def count_by(df: DataFrame, col: str, within: tuple[str, ...] = ()) -> DataFrame:
    """A1: rows per value, absent shown as Unknown, in name order."""
    value = F.coalesce(non_empty(col), F.lit("Unknown")).alias(col)
    return df.select(*within, value).groupBy(*within, col).count().orderBy(*within, col)


def default_category(df: DataFrame, substance: Column | str | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """A4: most common derived category of a result, else the category of the substance; one row (for each of ``within``)."""
    query = F.lit(substance) if isinstance(substance, str) else substance
    searched = F.coalesce(non_empty(opt(df, "searched_substance")), non_empty(opt(df, "substance")), *([query] if query is not None else []))
    value = F.coalesce(
        tx.short_category(opt(df, "therapeutic_category"), searched, opt(df, "atc_code")),
        tx.category_from_atc(opt(df, "atc_code")),
    )
    best = most_common_first(df, value, within=list(within))
    if query is None:
        return best
    return best.select(*within, F.coalesce("value", tx.category_from_substance(query)).alias("value"))


COVERAGE_FIELDS = [
    ("Strength", "strength"), ("Dosage Form", "dosage_form"), ("Route", "route"), ("Pack Size", "pack_size"),
    ("ATC Code", "atc_code"), ("Therapeutic Category", "therapeutic_category"), ("SMPC URL", "smpc_url"),
    ("PIL URL", "pil_url"), ("Assessment Report", "assessment_report_url"), ("Expiry Date", "expiry_date"),
]


def coverage_by_source(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """A2: per source (of each of ``within``) the records and, per field, how many have a value (partly derived from the name).

    One aggregation of counters; the default category only matters as "is there any", so it is a
    second aggregate of one row, or of one for each of ``within``.
    """
    rows = english_row(df)
    derived = {
        "strength": tx.extract_strength, "dosage_form": tx.extract_dosage_form,
        "route": tx.extract_route, "pack_size": tx.extract_pack_size,
    }

    def value(field: str) -> Column:
        own = non_empty(opt(df, field))
        if field in derived:
            return F.coalesce(own, derived[field](opt(df, "product")))
        if field == "therapeutic_category":
            return F.coalesce(own, tx.category_from_atc(opt(df, "atc_code")))
        return own

    source = F.coalesce(non_empty(opt(df, "source")), F.lit("Unknown")).alias("Source")
    counted = rows.select(*within, source, *[value(f).isNotNull().alias(label) for label, f in COVERAGE_FIELDS])
    sums = counted.groupBy(*within, "Source").agg(
        F.count("*").alias("Records"), *[F.count_if(F.col(label)).alias(label) for label, _ in COVERAGE_FIELDS]
    )
    default = default_category(df, within=within).select(*within, F.col("value").isNotNull().alias("x"))
    if within:
        sums = sums.join(default, list(within), "left")
        has_default = F.coalesce("x", F.lit(False))
    else:
        has_default = default.scalar()
    filled = sums.withColumn(
        "Therapeutic Category", F.when(has_default, F.col("Records")).otherwise(F.col("Therapeutic Category"))
    )
    shown = filled.select(
        *within, "Source", "Records",
        *[F.concat(F.col(label).cast("string"), F.lit("/"), F.col("Records").cast("string")).alias(label) for label, _ in COVERAGE_FIELDS],
    )
    if within:
        return shown.orderBy(*within, "Source")
    empty = sums.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("Not available").alias("Source"), F.lit(0).cast("bigint").alias("Records")
    )
    return shown.unionByName(empty, allowMissingColumns=True).orderBy("Source")


def sample_counts(df: DataFrame, samples: list[str]) -> DataFrame:
    """A3: rows whose substance or product contains each sample name, and all rows, in one pass."""
    substance, product = F.lower(text("substance")), F.lower(text("product"))
    hits = [
        F.count_if(F.contains(substance, F.lit(s)) | F.contains(product, F.lit(s))).alias(s) for s in samples
    ]
    one = df.agg(F.count("*").alias("_all"), *hits)
    pairs = F.array(*[F.struct(F.lit(s).alias("sample"), F.col(s).alias("records")) for s in samples])
    return one.select(F.col("_all").alias("total"), F.explode(pairs).alias("p")).select("p.sample", "p.records", "total")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A5: distinct non-blank values in case-insensitive order."""
    return df.select(nz(col).alias(col)).filter(F.col(col).isNotNull()).distinct().orderBy(F.lower(col), col)


def country_coverage(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Distinct EU countries present, out of 27."""
    eu = (F.col("region") == "EU") & dims.one_of(F.col("country"), dims.EU_COUNTRIES)
    present = df.groupBy(*within).agg(F.count_distinct(F.when(eu, F.col("country"))).alias("present"))
    total = len(dims.EU_COUNTRIES)
    return present.select(*within, "present", F.lit(total).alias("total"), (F.col("present") == total).alias("complete"))


def page_summary(df: DataFrame, page: int, size: int) -> DataFrame:
    """A10: product records, registry links and the span of rows a page shows."""
    manual = text(opt(df, "connector_mode")) == "manual_registry"
    n = F.col("total")
    first = F.lit((page - 1) * size)
    return df.agg(
        F.count("*").alias("total"), F.count_if(~manual).alias("product_rows"), F.count_if(manual).alias("registry_rows")
    ).select(
        "total", "product_rows", "registry_rows",
        F.when(n > first, first + 1).otherwise(0).cast("bigint").alias("first_shown"),
        F.least(n, F.lit(page * size).cast("bigint")).alias("last_shown"),
    )


def _provenance(n: Column, sources: Column, query: Column, generated_at: Column | None) -> dict[str, Column]:
    stamp = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return {
        "Query": query, "Generated At": stamp, "Record Count": n,
        "Sources": F.coalesce(F.nullif(sources, F.lit("")), F.lit("Not available")),
        "Status": F.when(n > 0, "Records found").otherwise("No records found"),
    }


def provenance(df: DataFrame, query: str, generated_at: Column | None = None) -> DataFrame:
    """K4: one row that says where an export comes from. The set holds source names only: bounded."""
    sources = F.array_join(F.array_sort(F.collect_set(non_empty(opt(df, "source")))), ", ")
    one = df.agg(F.count("*").alias("n"), sources.alias("s"))
    return one.select(*[c.alias(n) for n, c in _provenance(F.col("n"), F.col("s"), F.lit(query), generated_at).items()])


def provenance_of_queries(queries: DataFrame, df: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """K4 for every query of (query_id, substance), those without records too."""
    sources = F.array_join(F.array_sort(F.collect_set(non_empty(opt(df, "source")))), ", ")
    counted = df.groupBy("query_id").agg(F.count("*").alias("n"), sources.alias("s"))
    rows = queries.select("query_id", "substance").join(counted, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("query_id", *[c.alias(n) for n, c in _provenance(F.col("n"), F.col("s"), F.col("substance"), generated_at).items()])
