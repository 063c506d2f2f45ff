"""Registry of source mappers (R1) and the source search built on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators.identity import dedupe_by_url_key
from ..operators.search import expand_synonyms, stamp_query
from ..store_paths import stage
from . import mappers

CENTRAL_URL = dims.COUNTRY_SEARCH_URL["EU"].partition("?")[0]

#: called with a source's raw frame, or with its named frames where it takes several
Mapper = Callable[..., DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    region: str
    countries: tuple[str, ...]
    supports_documents: bool = False
    enabled: bool = True
    supports_live_search: bool = True
    rate_limit_per_minute: int | None = None
    mapper: Mapper | None = field(default=None, compare=False)


def built_in_mappers() -> dict[str, Mapper]:
    """The mapper of every connector whose payload has a fixed layout."""
    found: dict[str, Mapper] = {name: partial(mappers.map_regional_pages, source=name) for name, *_ in dims.REGIONAL_REGISTERS}
    found |= {name: partial(mappers.map_positional, source=name) for name in mappers.POSITIONAL}
    return found | {
        "FDA": mappers.map_us_labels,
        "MHRA": mappers.map_uk_index,
        "EMA": partial(mappers.map_central_eu, countries=dims.EU_COUNTRIES, source_url=CENTRAL_URL),
        "EU MRI Product Index": mappers.map_mri,
        "Health Canada": mappers.map_canada,
        "TGA Australia": mappers.map_au_list,
        "Medsafe New Zealand": partial(mappers.map_header_table, source="Medsafe New Zealand", kind="nz"),
        "CDSCO India": mappers.map_text_windows,
        "BPOM Indonesia": mappers.map_indonesia,
        "DAV Vietnam": mappers.map_vietnam,
        "Belgium FAMHP": mappers.map_belgium,
        "France BDPM": mappers.map_france,
        "Ireland medicines.ie": mappers.map_ireland,
        "Spain CIMA": mappers.map_spain,
    }


class Registry:
    """Sources by name; a mapper turns a source's raw frame, or its named frames, into canonical rows."""

    def __init__(self, sources: list[Source] | None = None):
        listed = sources if sources is not None else [
            Source(name, region, tuple(countries), documents, enabled, mapper=built_in_mappers().get(name))
            for name, region, countries, documents, enabled in dims.connectors()
        ]
        self._sources = {s.name.lower(): s for s in listed}

    def register_mapper(self, source: Source, mapper: Mapper) -> None:
        self._sources[source.name.lower()] = Source(**{**source.__dict__, "mapper": mapper})

    def by_name(self, name: str) -> Source | None:
        return self._sources.get(name.strip().lower())

    def enabled(self) -> list[Source]:
        return [s for s in self._sources.values() if s.enabled]

    def metadata(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s.name, s.region, list(s.countries), s.supports_live_search, s.supports_documents, s.enabled, s.rate_limit_per_minute)
            for s in self._sources.values()
        ]
        ddl = (
            "name string, region string, countries array<string>, supports_live_search boolean, supports_documents boolean, "
            "enabled boolean, rate_limit_per_minute int"
        )
        return spark.createDataFrame(rows, ddl)


ORD_BITS = 48
TAKE_TERMS = ("Health Canada", "France BDPM")  # their data sets are whole registers, searched for all terms at once


def source_search(queries: DataFrame, raw: dict[str, DataFrame | dict], registry: Registry) -> DataFrame:
    """Every enabled source's mapper over its raw frame for every search term, stamped and de-duplicated.

    ``queries``: (query_id, substance); ``raw``: source -> frame with ``query`` (the term it was landed
    for) and ``ord``, or the named frames of a mapper that takes several. Arrival order is (source, term, ord), packed
    into one BIGINT: ``ord`` of a raw frame stays below 2**48 (the readers' numbers do up to a million file blocks); larger ones are an error.
    """
    found = []
    for place, source in enumerate(registry.enabled()):
        if source.name not in raw or source.mapper is None:
            continue
        terms = expand_synonyms(queries.withColumn("source", F.lit(source.name)), single_term_sources=True)
        frames = raw[source.name]
        if isinstance(frames, dict) and "query" not in frames and source.name in TAKE_TERMS:
            frames = {**frames, "query": terms.select(F.col("term").alias("query")).distinct()}
        rows = source.mapper(**frames) if isinstance(frames, dict) else source.mapper(frames)
        # staged, so that the planner knows their size and, where they are few, does not shuffle the rows to find it
        asked = stage(terms.select("query_id", F.col("substance").alias("_searched"), "term", "term_pos"), "terms")
        joined = rows.join(asked, F.col("query") == F.col("term"))
        stamped = stamp_query(joined, "_searched").drop("_searched", "term", "query")
        own = F.when(F.col("ord") < 1 << ORD_BITS, F.col("ord")).otherwise(F.raise_error(F.lit(f"ord of a raw frame must stay below 2**{ORD_BITS}")))
        order = F.lit(place << 54).cast("bigint") + F.shiftleft(F.col("term_pos").cast("bigint"), ORD_BITS) + own
        found.append(stamped.withColumn("ord", order).drop("term_pos", "place"))
    if not found:
        raise ValueError("no enabled source has a raw frame")
    return dedupe_by_url_key(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), kept=True)
