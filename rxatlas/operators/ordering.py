"""Ranking, sorting and paging.

A rank within a group never needs the whole group in one task: bounded ranks are taken in two
levels over salted sub-groups, unbounded ones from a range-partitioned sort plus partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.base import lower_trim, non_empty, opt, text

# Fixed value: sortable columns; anything else falls back to the default order.
SORT_COLUMNS = {
    "substance": "substance", "product": "product", "company": "company", "country": "country",
    "region": "region", "status": "status", "source": "source", "strength": "strength",
    "dosage_form": "dosage_form", "pack_size": "pack_size", "atc_code": "atc_code",
    "therapeutic_category": "therapeutic_category", "ma_holder": "company",
    "manufacturer_name": "manufacturer_name", "manufacturer_country": "manufacturer_country",
    "registration_number": "registration_number", "registration_date": "registration_date",
}
SALTS = 64


def rank_source(source: Column | str, selected: Column | list[str]) -> Column:
    """Position of a source in the selection; unknown sources come last."""
    chosen = F.array(*[F.lit(s) for s in selected]).cast("array<string>") if isinstance(selected, list) else selected
    lowered = F.filter(F.transform(chosen, lambda s: F.lower(F.trim(s))), lambda s: s != "")
    position = F.array_position(lowered, lower_trim(source))
    return F.when(position > 0, position - 1).otherwise(F.size(lowered)).cast("int")


def document_rank(df: DataFrame) -> list[Column]:
    """W3 sort keys: rows with a document first, then SPC, PIL, PAR, others."""
    linked = F.when(
        non_empty(opt(df, "smpc_url")).isNotNull() | non_empty(opt(df, "pil_url")).isNotNull(), 0
    ).otherwise(1)
    kind = F.upper(text(opt(df, "document_type")))
    rank = F.when(kind == "SPC", 0).when(kind == "PIL", 1).when(kind == "PAR", 2).otherwise(9)
    return [linked, rank, text(opt(df, "product")), text(opt(df, "registration_number"))]


def best_document(df: DataFrame) -> DataFrame:
    """Best document per registration number, as an aggregate over the rank."""
    from .identity import keep_first

    return keep_first(df, [text(opt(df, "registration_number"))], F.struct(*document_rank(df), F.col("ord")))


def default_order(df: DataFrame, selected: Column | list[str]) -> list[Column]:
    return [
        rank_source(opt(df, "source"), selected).asc(),
        *[text(opt(df, c)).asc() for c in ("country", "product", "document_type")],
        F.col("ord").asc(),
    ]


def sort_default(df: DataFrame, selected: list[str]) -> DataFrame:
    """L1: by source rank, country, product, document type (case-sensitive), then arrival."""
    return df.orderBy(*default_order(df, selected))


def sort_order(df: DataFrame, by: str, direction: str = "asc", selected: list[str] | None = None) -> list[Column]:
    if by not in SORT_COLUMNS:
        return default_order(df, selected or [])
    key = F.lower(text(opt(df, SORT_COLUMNS[by])))
    return [key.desc() if direction == "desc" else key.asc(), F.col("ord").asc()]


def sort_by(df: DataFrame, by: str, direction: str = "asc", selected: list[str] | None = None) -> DataFrame:
    """L2: by one column without regard to case; equal keys stay in arrival order in both directions."""
    return df.orderBy(*sort_order(df, by, direction, selected))


def query_order(df: DataFrame) -> list[Column]:
    """L1/L2 for a frame of many queries, each with its own ``sort_by``, ``sort_dir`` and ``sources``."""
    lowered = {name: F.lower(text(opt(df, col))) for name, col in SORT_COLUMNS.items()}
    key = F.lit(None).cast("string")
    for name, value in lowered.items():
        key = F.when(F.col("sort_by") == name, value).otherwise(key)
    descending = F.col("sort_dir") == "desc"
    other = key.isNull()
    return [
        F.when(~descending, key).asc(),
        F.when(descending, key).desc(),
        F.when(other, rank_source(opt(df, "source"), F.col("sources"))).asc(),
        *[F.when(other, text(opt(df, c))).asc() for c in ("country", "product", "document_type")],
        F.col("ord").asc(),
    ]


def top_within(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """L3: first ``n`` rows per group with their rank.

    The first level limits every (group, salt) sub-group, so that the final level sees at most
    ``SALTS * n`` rows of any group; both limits are also applied map-side.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)))
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    few = salted.withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= n)
    return few.drop("_salt", "_local").withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)


def rank_within(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Exact row numbers within groups of any size.

    The sorted rows are checkpointed to the shared folder, so that partition numbers are fixed; a
    row's rank is its place in its partition plus the rows of its group in earlier partitions. The
    offsets table has one row per group and partition border, never one per input row.
    """
    from ..store_paths import checkpoint

    ordered = checkpoint(df.orderBy(*[F.col(g) for g in group], *order))
    placed = ordered.withColumn("_i", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_i", 33))
    pieces = placed.groupBy(*group, "_part").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(g).alias(f"_at_{g}") for g in group], F.col("_part").alias("_at_part"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_at_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_at_{g}"))
    place = (F.col("_i") - F.col("_first") + F.col("_before") + 1).alias(rank)
    return placed.join(offsets, same).select(*df.columns, place)


def clamp_size(size: Column) -> Column:
    return F.least(F.greatest(size, F.lit(10)), F.lit(200))


def page_of_queries(df: DataFrame, queries: DataFrame, order: list[Column], clamp_last: bool = True) -> DataFrame:
    """One page per query, for many queries at once.

    ``queries`` has (query_id, page, page_size), one row per query. Page sizes are clamped to 10..200 (the feature) and
    page numbers to the existing ones. Each salted sub-group of a query keeps the rows up to the end of the query's
    page, so the final ranking sees at most ``SALTS`` times as many rows as that page is deep.
    """
    counts = df.groupBy("query_id").agg(F.count("*").alias("_n"))
    size = clamp_size(F.col("page_size"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("_n") / size))
    page = F.greatest(F.col("page"), F.lit(1))
    page = F.least(page, pages) if clamp_last else page
    spans = (
        queries.select("query_id", "page", "page_size").join(counts, "query_id")
        .select("query_id", ((page - 1) * size).alias("_start"), (page * size).alias("_end"))
    )
    salted = df.join(spans, "query_id").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)))
    few = salted.withColumn("_local", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).filter("_local <= _end")
    ranked = few.drop("_salt", "_local").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter((F.col("rank") > F.col("_start")) & (F.col("rank") <= F.col("_end"))).drop("_start", "_end")


def paginate(df: DataFrame, order: list[Column], page: int, size: int, clamp_last: bool = True) -> DataFrame:
    """L4 for one result: a sort with offset and limit."""
    size = min(max(size, 10), 200)
    page = max(page, 1)
    if clamp_last:
        page = min(page, max(1, -(-df.count() // size)))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def order_sources_for_job(df: DataFrame) -> DataFrame:
    """Fast sources before slow ones, then by name."""
    return df.orderBy(F.col("source").isin(*dims.SLOW_SOURCES), F.lower("source"))


def top_jobs(jobs: DataFrame, n: int = 25) -> DataFrame:
    """Newest first."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id")).limit(n)
