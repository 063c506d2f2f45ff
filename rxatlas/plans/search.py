"""User-level search functions (E1, E2, E4, E5, E7-E9): many queries at once over the product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.base import text
from ..functions.english import english_text
from ..functions.rows import DISPLAY_FILTERS, display_row, export_row
from ..operators import coverage, documents, identity, jobs, ordering, quality, scope, search, store
from ..store_paths import checkpoint, stage

QUERY_DEFAULTS = {
    "sources": ("array<string>", None), "country": ("string", ""), "region": ("string", ""), "source": ("string", ""),
    "sort_by": ("string", ""), "sort_dir": ("string", "asc"), "page": ("long", 1), "page_size": ("long", 50),
}
FILTERS = ["country", "region", "source", "status", "table_search", *[f"{f}_filter" for f in DISPLAY_FILTERS]]


def prepared_queries(queries: DataFrame) -> DataFrame:
    """(query_id, substance, …) with every optional parameter present and the sources scoped."""
    for name, (kind, default) in QUERY_DEFAULTS.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(default).cast(kind))
    if "status" in queries.columns:
        queries = queries.withColumn("status", english_text("status"))
    queries = queries.withColumn("sources", scope.parse_sources(F.col("sources")))
    return queries.withColumn(
        "scoped", scope.scope_sources(F.col("sources"), F.col("country"), F.col("region"), F.col("source"))
    )


def combined(queries: DataFrame, products: DataFrame, live: DataFrame | None = None, mode: str = "substring") -> DataFrame:
    """E2 core: cached hits and live rows of every query merged by identity, attributes propagated."""
    asked = queries.select("query_id", F.col("substance").alias("query_substance"), "scoped")
    hits = search.search_many(asked, products, mode)
    hits = hits.filter(
        ~search.is_lookup_fallback(products) & search.matches_selected_sources(products, F.col("scoped"))
    ).drop("scoped", "query_substance")
    if live is None:
        merged = identity.dedupe_keep_first(hits, kept=True)
    else:
        merged = identity.merge_cached_live(hits, live.filter(~search.is_lookup_fallback(live)))
    # the attributes of a molecule are gathered from these rows and joined back to them: found once, kept in the shared folder
    return identity.propagate_by_molecule(stage(merged, "hits"), kept=True)


def saved_search(queries: DataFrame, products: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Merged rows of every query in the default order of its own selection."""
    asked = prepared_queries(queries).withColumn("scoped", F.col("sources"))
    rows = combined(asked, products, live)
    joined = rows.join(stage(asked.select("query_id", "sources"), "asked-sources"), "query_id")
    return joined.orderBy("query_id", *ordering.default_order(rows, F.col("sources"))).drop("sources")


def search_rows(
    queries: DataFrame, products: DataFrame, live: DataFrame | None = None, include_lookup_rows: bool = True,
    mode: str = "substring",
) -> DataFrame:
    """E1 without the final sort: (query_id, product columns)."""
    asked = prepared_queries(queries)
    filters = [f for f in FILTERS if f in asked.columns]
    settings = asked.select("query_id", F.col("substance").alias("query_substance"), *[F.col(f).alias(f"_f_{f}") for f in filters])
    wanted: dict[str, Column | str] = {f: F.col(f"_f_{f}") for f in filters}
    dropped = ["query_substance", *[f"_f_{f}" for f in filters]]

    rows = combined(asked, products, live, mode).join(settings, "query_id")
    rows = rows.filter(search.relevant_to_substance(rows, F.col("query_substance")))
    # the hits are needed for the result, for the gaps and for the suppression: computed once, kept in the shared folder
    rows = checkpoint(coverage.filter_rows(rows, wanted).drop(*dropped))
    if include_lookup_rows:
        gaps = coverage.country_gap_rows(asked, rows).join(settings, "query_id")
        gap_filters = {k: v for k, v in wanted.items() if k != "source"}
        gaps = coverage.filter_rows(gaps, gap_filters).drop(*dropped)
        rows = rows.unionByName(gaps, allowMissingColumns=True)
    rows = search.suppress_generic(rows)
    return rows if include_lookup_rows else search.drop_generic(rows)


def search_sorted(
    queries: DataFrame, products: DataFrame, live: DataFrame | None = None, include_lookup_rows: bool = True,
    mode: str = "substring",
) -> DataFrame:
    """Every query's rows in the order it asks for."""
    rows = search_rows(queries, products, live, include_lookup_rows, mode)
    order = prepared_queries(queries).select("query_id", "sort_by", "sort_dir", "sources")
    joined = rows.join(order, "query_id")
    return joined.orderBy("query_id", *ordering.query_order(joined)).drop("sort_by", "sort_dir", "sources")


def result_page(queries: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The asked page of every query for display, with its counts and its EU coverage."""
    asked = prepared_queries(queries)
    settings = asked.select("query_id", "sort_by", "sort_dir", "sources")
    sortable = rows.join(settings, "query_id")
    page = ordering.page_of_queries(sortable, asked, ordering.query_order(sortable))
    page = identity.propagate_by_molecule(page.drop("sort_by", "sort_dir", "sources"))
    metadata = ("data_confidence", "enrichment_status", "missing_fields", "ai_next_action")
    shown = display_row(quality.attach_quality(page), keep=("query_id", "rank", "ord", *metadata))
    manual = search.is_manual(rows)
    summary = rows.groupBy("query_id").agg(
        F.count("*").alias("total"), F.count_if(~manual).alias("product_rows"), F.count_if(manual).alias("registry_rows")
    )
    return {
        "rows": shown,
        "by_source": coverage.count_by(rows, "source", ("query_id",)),
        "by_country": coverage.count_by(rows, "country", ("query_id",)),
        "summary": summary,
        "eu_coverage": coverage.country_coverage(rows, ("query_id",)),
    }


def export(queries: DataFrame, rows: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """E5: the 41-column sheet of every query's rows.

    The default category is one row per query, joined back; manual registry rows are left out of the
    sheet but, as in the counts, not out of the default.
    """
    from ..functions import text as tx

    # staged, so that the planner knows how small they are: joined by shuffle, the rows of a query would come together in one task
    asked = stage(queries.select("query_id", F.col("substance").alias("query_substance")), "asked")
    joined = rows.join(asked, "query_id")
    searched = F.coalesce(*[F.nullif(text(c), F.lit("")) for c in ("searched_substance", "substance", "query_substance") if c in joined.columns])
    columns = {c: (F.col(c) if c in joined.columns else F.lit(None).cast("string")) for c in ("therapeutic_category", "atc_code")}
    category = F.coalesce(
        tx.short_category(columns["therapeutic_category"], searched, columns["atc_code"]),
        tx.category_from_atc(columns["atc_code"]),
    )
    common = identity.most_common_first(joined, category, within=["query_id"])
    defaults = asked.join(common, "query_id", "left").select(
        "query_id", F.coalesce("value", tx.category_from_substance("query_substance")).alias("default_category")
    )
    kept = search.drop_manual_for_export(joined).join(stage(defaults, "default-categories"), "query_id", "left")
    stamp = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return export_row(kept, F.col("query_substance"), F.col("default_category"), stamp, keep=("query_id", "ord"))


def export_all(queries: DataFrame, rows: DataFrame, path: str, generated_at: Column | None = None, whole: bool = True) -> dict[str, DataFrame | int]:
    """E5: every query's export in one call: files, ``sheet``, ``coverage`` by source and ``provenance``, all from the same rows.

    With ``whole`` all rows of a query are exported; otherwise the page it asks for (``page``, ``page_size``, sorted as asked), prepared for
    display. Files stand in ``path`` in one folder for each query, named by its substance. ``written`` counts the rows of all files.
    """
    if not whole:
        asked = prepared_queries(queries)
        sortable = rows.join(asked.select("query_id", "sort_by", "sort_dir", "sources"), "query_id")
        page = ordering.page_of_queries(sortable, asked, ordering.query_order(sortable))
        rows = prepare_cached(page.drop("sort_by", "sort_dir", "sources", "rank"))
    rows = stage(rows, "export-rows")
    named = queries.select("query_id", F.concat_ws("_", store.safe_filename("substance"), store.safe_filename("query_id")).alias("file"))
    sheet = stage(export(queries, rows, generated_at).join(stage(named, "export-files"), "query_id"), "export-sheet")
    return {
        "written": store.write_exports(sheet, path),
        "sheet": sheet.drop("file"),
        "coverage": coverage.coverage_by_source(rows, ("query_id",)),
        "provenance": coverage.provenance_of_queries(queries, rows, generated_at),
    }


def prepare_cached(rows: DataFrame) -> DataFrame:
    """Q4: stored rows made ready for display, without reading documents: G4, then Q3."""
    return quality.attach_quality(identity.propagate_by_molecule(rows))


def enrich_cached(rows: DataFrame, docs: DataFrame, eu_links: DataFrame | None = None) -> DataFrame:
    """Q4: stored rows enriched from their documents: D14 for UK rows, D15, D13, then ``prepare_cached``.

    ``docs``: (doc_url, text). The result is what K2 saves back.
    """
    enriched = documents.apply_uk_metadata(rows.filter(text("source") == "MHRA"), documents.uk_metadata(docs))
    enriched = enriched.unionByName(rows.filter(text("source") != "MHRA"), allowMissingColumns=True)
    if eu_links is not None:
        enriched = documents.apply_eu_links(enriched, eu_links)
    return prepare_cached(documents.enrich_rows(enriched, docs))


def job_status(spark: SparkSession, path: str, started: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(``jobs`` and ``progress``, stored results, health per source) of the jobs whose sources report into ``path``
    (``streams.job_sink``)."""

    def part(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    results = part("results")
    run = jobs.job_run(started, jobs.merged_progress(part("progress")), results, _first_crash(part("crashes")))
    return run, results, jobs.latest_health(part("health"))


def _first_crash(crashes: DataFrame) -> DataFrame:
    return crashes.groupBy("job_id").agg(F.min("crash").alias("crash"))


def data_health(products: DataFrame, samples: tuple[str, ...] = (
    "metformin", "paracetamol", "dapagliflozin", "quetiapine", "mirabegron",
)) -> DataFrame:
    """E7 (after K1): how many rows there are, and how many per sample substance."""
    return coverage.sample_counts(products, list(samples))


def products_list(products: DataFrame) -> DataFrame:
    """The whole store ordered by product."""
    wanted = ["product", "substance", "company", "country", "region", "status", "source", "registration_date"]
    ordered = products.orderBy(text("product"), "ord") if "ord" in products.columns else products.orderBy(text("product"))
    return ordered.select(*[c for c in wanted if c in products.columns])


def connector_status(spark) -> DataFrame:
    """Status of the fourteen core connectors with their metadata."""
    tables = dims.dims(spark)
    return scope.status_with_metadata(tables["source_status"], tables["source"])


def connector_health(spark, latest_health: DataFrame) -> DataFrame:
    return scope.status_with_health(connector_status(spark), latest_health)


