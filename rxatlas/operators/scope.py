"""Source selection and table-level set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.base import case, nz, text
from .identity import keep_first

NO_TEXTS = "array<string>"


def _strings(values: list[str]) -> Column:
    return dims.literal_list(values)


def _lower_in(item: Column, names: list[str]) -> Column:
    return dims.one_of(F.lower(item), [n.lower() for n in names])


def _with_source(selected: Column, name: Column) -> Column:
    """The selection, with ``name`` appended unless it is there in some letter case or is NULL."""
    there = F.exists(selected, lambda s: F.lower(s) == F.lower(name))
    return F.when(name.isNull() | there, selected).otherwise(F.concat(selected, F.array(name)))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Results of several sources under each other; columns a source lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def parse_sources(sources: Column | str | list[str]) -> Column:
    """Trimmed names from a list or a comma-separated text; EU names bring the national sources along."""
    if isinstance(sources, list):
        listed = _strings(sources)
    elif isinstance(sources, str):
        listed = F.split(F.lit(sources), ",")
    else:
        listed = F.coalesce(sources, F.array().cast(NO_TEXTS))
    names = F.filter(F.transform(listed, lambda s: F.trim(s)), lambda s: s != "")
    wants_eu = F.exists(names, lambda s: F.lower(s).isin("ema", "eu", "eu national"))
    lowered = F.transform(names, lambda s: F.lower(s))
    more = F.filter(_strings(dims.EU_NATIONAL_SOURCES), lambda s: ~F.array_contains(lowered, F.lower(s)))
    return F.when(wants_eu, F.concat(names, more)).otherwise(names)


def scope_sources(sources: Column, country: Column, region: Column, source: Column) -> Column:
    """The sources a query is answered from, by explicit source, region and country."""
    selected = parse_sources(sources)
    country, region, source = text(country), text(region), text(source)
    lookup_only = _strings([dims.LOOKUP_ONLY])

    def kept(names: list[str], of: Column = selected) -> Column:
        return F.filter(of, lambda s: _lower_in(s, names))

    def exactly(names: list[str]) -> Column:
        hits = F.filter(selected, lambda s: dims.one_of(s, names))
        return F.when(F.size(hits) > 0, hits).otherwise(lookup_only)

    def added(name: str) -> Column:
        return kept([name], _with_source(selected, F.lit(name)))

    widened = _with_source(selected, dims.lookup({r: dims.REGION_DEFAULT_SOURCE[r] for r in ("CH", "JP", "RU")}, region))
    default = dims.lookup(dims.COUNTRY_DEFAULT_SOURCE, country)
    with_default = _with_source(widened, default)
    served = F.filter(
        with_default,
        lambda s: F.coalesce(F.array_contains(dims.lookup(dims.source_countries(), F.lower(s)), country), F.lit(False)),
    )
    listed = dims.one_of(country, [*dims.AFRICA_COUNTRIES, *dims.MIDDLE_EAST_COUNTRIES, *dims.ASIA_COUNTRIES])
    return case(
        [
            (source != "", F.array(source)),
            (region == "EU", kept(["ema", *dims.EU_NATIONAL_SOURCES])),
            (region == "UK", kept(["MHRA"])),
            (region == "US", kept(["FDA"])),
            (region == "CA", kept(["Health Canada"])),
            (region == "AU", added("TGA Australia")),
            (region == "NZ", added("Medsafe New Zealand")),
            (region == "ALL", exactly(sorted({*dims.DEFAULT_SOURCES, *sum(dims.REGION_LIVE_SOURCES.values(), [])}))),
            *[(region == r, exactly(dims.REGION_LIVE_SOURCES[r])) for r in ("AF", "ME", "AS")],
            (country == "", widened),
            (default.isNull() & listed, lookup_only),
            (F.size(served) > 0, served),
        ],
        with_default,
    )


def select_live_sources(queries: DataFrame) -> DataFrame:
    """Adds ``live_sources`` and ``effective_live`` to (sources, country, region, source, mode, live)."""
    asked = F.when(F.size("sources") > 0, F.col("sources")).otherwise(_strings(sorted(dims.FAST_SOURCES)))
    selected = parse_sources(asked)
    scoped = scope_sources(selected, F.col("country"), F.col("region"), F.col("source"))
    is_full = F.col("mode") == "full"
    narrowed = (text("country") != "") | (text("region") != "") | (text("source") != "")
    fast = F.filter(selected, lambda s: s.isin(*dims.FAST_SOURCES))
    default = F.lower(text(dims.lookup(dims.COUNTRY_DEFAULT_SOURCE, F.col("country"))))
    slow = default.isin(*[s.lower() for s in dims.SLOW_COUNTRY_DEFAULTS])
    requested = F.array_contains(F.transform(asked, lambda s: F.lower(F.trim(s))), default)
    return queries.withColumns({
        "live_sources": F.when(is_full, selected).when(narrowed, scoped).otherwise(fast),
        "effective_live": F.col("live") & ~(~is_full & slow & ~requested),
    })


def merged_options(primary: DataFrame, fixed: DataFrame, col: str) -> DataFrame:
    """U4: fixed options, then others, unique without regard to case; columns ``col`` and ``pos``.

    Both frames carry ``pos``; the result keeps it as a sortable struct.
    """
    both = fixed.select(nz(col).alias(col), F.struct(F.lit(0).alias("part"), "pos").alias("pos")).unionByName(
        primary.select(nz(col).alias(col), F.struct(F.lit(1).alias("part"), "pos").alias("pos"))
    )
    return keep_first(both.filter(F.col(col).isNotNull()), [F.lower(col)], "pos").orderBy("pos")


def skip_in_mode(df: DataFrame, mode: str) -> DataFrame:
    """Outside full mode everything but the fast sources starts as skipped."""
    if mode == "full":
        return df.withColumn("status", F.lit("queued"))
    return df.withColumn("status", F.when(F.col("source").isin(*dims.FAST_SOURCES), "queued").otherwise("skipped"))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """U8: rows for which the condition holds are removed; an unknown condition keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """U8 for a table of keys."""
    return df.join(keys.select(*on), on, "left_anti")


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns replaced where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def lookup_country_by_company(df: DataFrame) -> DataFrame:
    """Countries corrected by company; the correction list is a constant map."""
    return df.withColumn("country", F.coalesce(dims.lookup(dims.COMPANY_COUNTRY, F.col("company")), F.col("country")))


def status_with_metadata(status: DataFrame, sources: DataFrame) -> DataFrame:
    """Status rows with the registry's metadata, defaults where a name is not registered."""
    wanted = ["name", "region", "countries", "enabled", "supports_live_search", "supports_documents"]
    joined = status.join(sources.select(*wanted), "name", "left")
    return joined.withColumns({
        "region": text("region"),
        "countries": F.coalesce("countries", F.array().cast(NO_TEXTS)),
        **{c: F.coalesce(c, F.lit(False)) for c in ("enabled", "supports_live_search", "supports_documents")},
    })


def status_with_health(status: DataFrame, health: DataFrame) -> DataFrame:
    """+ latest health per source (A7), "not checked" where there is none."""
    latest = health.withColumnRenamed("source", "name")
    return status.join(latest, "name", "left").withColumn("last_status", F.coalesce("last_status", F.lit("not checked")))


def setdefault_links(rows: DataFrame, links: DataFrame, fields: tuple[str, ...] = ("smpc_url", "pil_url")) -> DataFrame:
    """One link row per query, applied only where a field is absent; an empty text is not absent."""
    renamed = links.select("query_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(renamed, "query_id", "left")
    own = {f: (F.col(f) if f in rows.columns else F.lit(None).cast("string")) for f in fields}
    return joined.withColumns({f: F.coalesce(own[f], F.col(f"_{f}")) for f in fields}).drop(*[f"_{f}" for f in fields])


