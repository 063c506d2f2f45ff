"""De-duplication, merging and propagation by identity.

Every operator here is an aggregation with map-side combine: a key that holds a large share of all
rows is reduced to one row per map task before the shuffle. Arrival order is explicit (``ord``), so
results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import lower_trim, non_empty, nz, opt, text
from ..store_paths import stage


def result_key(df: DataFrame, url: Column | None = None) -> list[Column]:
    """The five-part identity of a row; absent parts compare equal."""
    link = url if url is not None else F.coalesce(non_empty(opt(df, "product_url")), non_empty(opt(df, "url")))
    parts = [lower_trim(opt(df, c)) for c in ("source", "product", "country", "registration_number")]
    return [*parts, lower_trim(link)]


def key_digest(keys: list[Column]) -> Column:
    """128 bits (of SHA-256) that stand for a key: NULL parts are a value like any other, and no two lists of parts read the same.

    Rows are grouped by it instead of by the parts: they are not carried beside the row, and sorting compares eight bytes instead of texts
    that begin alike.
    """
    told = [F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in (k.cast("string") for k in keys)]
    return F.substring(F.unhex(F.sha2(F.concat(*told), 256)), 1, 16)


def keep_first(df: DataFrame, keys: list[Column], order: Column | str = "ord", last: bool = False) -> DataFrame:
    """First (or last) row per key by ``order``; NULL key parts are a value like any other."""
    rows = df.select(
        key_digest(keys).alias("_k"),
        F.struct(*df.columns).alias("_row"),
        (F.col(order) if isinstance(order, str) else order).alias("_o"),
    )
    pick = F.max_by if last else F.min_by
    return rows.groupBy("_k").agg(pick("_row", "_o").alias("_row")).select("_row.*")


RECURRING = 10  # keys that recur are few if there is at most one for so many rows
BUCKETS = 25  # recurring keys are marked in a table of 2 ** BUCKETS bits whatever their number


def by_recurrence(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key (64 bits of it in ``_k``) may recur, and those that are alone with theirs; without the latter if many recur.

    A key that recurs marks one of 2 ** BUCKETS bits, so the marks are a small table however many keys there are; a key that shares
    its bit counts as recurring. ``rows`` are read three times, so callers stage them.
    """
    bucket = F.col("_k").bitwiseAND(F.lit((1 << BUCKETS) - 1))
    bit = bucket.bitwiseAND(F.lit(63)).cast("int")
    twice = rows.groupBy("_k").agg(F.count("*").alias("_n")).filter("_n > 1")
    marks = twice.select(F.shiftright(bucket, 6).alias("_w"), bit.alias("_bit"))
    marks = marks.select("_w", F.expr("shiftleft(1L, _bit)").alias("_m"))
    words = stage(marks.groupBy("_w").agg(F.bit_or("_m").alias("_m")), "recurring-keys")
    if (words.agg(F.sum(F.bit_count("_m"))).first()[0] or 0) * RECURRING > rows.count():
        return rows, None
    marked = rows.withColumn("_w", F.shiftright(bucket, 6)).join(words, "_w", "left")
    recurs = F.coalesce(F.getbit(F.col("_m"), bit), F.lit(0)) == 1
    return marked.filter(recurs).select(*rows.columns), marked.filter(~recurs).select(*rows.columns)


def keep_first_kept(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``keep_first`` by ``ord`` over rows that are wide and rarely share a key: they are staged, and only those whose key may recur are shuffled."""
    several, alone = by_recurrence(stage(df.select("*", F.xxhash64(key_digest(keys)).alias("_k")), "keyed-rows"))
    first = keep_first(several.select(*df.columns), keys)
    return first if alone is None else alone.select(*df.columns).unionByName(first)


def _scope(df: DataFrame) -> list[Column]:
    return [F.col("query_id")] if "query_id" in df.columns else []


def dedupe_keep_first(df: DataFrame, kept: bool = False) -> DataFrame:
    """G1: first row per result key (and query); with ``kept`` through staged rows."""
    return (keep_first_kept if kept else keep_first)(df, _scope(df) + result_key(df))


def dedupe_by_url_key(df: DataFrame, kept: bool = False) -> DataFrame:
    """Rows without a product dropped, then first per key with the plain ``url`` as fifth part; with ``kept`` through staged rows."""
    return (keep_first_kept if kept else keep_first)(drop_without_product(df), _scope(df) + result_key(df, opt(df, "url")))


def drop_without_product(df: DataFrame) -> DataFrame:
    """P9."""
    return df.filter(non_empty("product").isNotNull())


LIVE_ORD = 1 << 62


def merge_cached_live(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Cached rows keep-first; live rows fill the gaps of the row with their key or are appended.

    Cached rows come first whatever the numbers of the live ones: an appended row's ``ord`` is raised by ``LIVE_ORD``.

    One aggregation: per key the first cached row as a whole, and per field the first non-empty live
    value. Later cached duplicates contribute nothing; later live duplicates fill what is still empty. Where few keys recur, only
    their rows are aggregated: the others are what they become.
    """
    both = cached.withColumn("origin", F.lit("cached")).unionByName(
        live.withColumn("origin", F.lit("live")), allowMissingColumns=True
    )
    fields = [c for c in both.columns if c not in ("origin", "ord", "query_id")]
    types = dict(both.dtypes)
    owned, offered = [c for c in fields if c in cached.columns], [c for c in fields if c in live.columns]
    scope = _scope(both)
    rows = stage(both.select("*", F.xxhash64(key_digest(scope + result_key(both))).alias("_k")), "merge-rows")
    is_live = F.col("origin") == "live"

    def empty(c: str) -> Column:
        value = F.col(c)
        return value.isNull() | (value == "") if types[c] == "string" else value.isNull()

    several, others = by_recurrence(rows)
    merged = several.groupBy(key_digest(scope + result_key(both)).alias("_digest")).agg(
        *[F.first(c).alias("query_id") for c in scope],
        F.min_by(F.struct("ord", *owned), F.when(~is_live, F.col("ord"))).alias("_cached"),
        F.min(F.when(is_live, F.col("ord"))).alias("_live_ord"),
        *[F.min_by(F.col(c), F.when(is_live & ~empty(c), F.col("ord"))).alias(f"_live_{c}") for c in offered],
    )
    is_cached = F.col("_cached").isNotNull()

    def filled(c: str) -> Column:
        own = F.col(f"_cached.{c}") if c in owned else F.lit(None).cast(types[c])
        own = F.nullif(own, F.lit("")) if types[c] == "string" else own
        return F.coalesce(own, *([F.col(f"_live_{c}")] if c in offered else [])).alias(c)

    found = merged.select(
        *scope,
        F.coalesce(F.col("_cached.ord"), F.col("_live_ord") + F.lit(LIVE_ORD)).alias("ord"),
        F.when(is_cached, "cached").otherwise("live").alias("origin"),
        *[filled(c) for c in fields],
    )
    if others is None:
        return found
    alone = others.select(
        *scope,
        F.when(is_live, F.col("ord") + F.lit(LIVE_ORD)).otherwise(F.col("ord")).alias("ord"),
        "origin",
        *[F.when(~empty(c), F.col(c)).alias(c) for c in fields],
    )
    return alone.unionByName(found)


def first_in_group(
    df: DataFrame, keys: dict[str, Column], fields: list[str], order: str = "ord", kept: bool = False
) -> DataFrame:
    """Adds ``first_<field>``, the group's first non-empty value; rows with a NULL key part get NULL.

    The group values are a partial aggregate, joined back on the key. The joined side has one row per
    group: the adaptive planner broadcasts it when it is small and splits hot keys when it is not. By then the rows are
    shuffled; with ``kept`` (for rows that are staged themselves) the values are staged, so that their size is known before.
    """
    keyed = df.withColumns({f"_{n}": c for n, c in keys.items()})
    names = [f"_{n}" for n in keys]
    values = (
        keyed.filter(" AND ".join(f"{n} IS NOT NULL" for n in names))
        .groupBy(*names)
        .agg(*[
            F.min_by(non_empty(f), F.when(non_empty(f).isNotNull(), F.col(order))).alias(f"first_{f}") for f in fields
        ])
    )
    return keyed.join(stage(values, "group-values") if kept else values, names, "left").drop(*names)


def fill_from_group(df: DataFrame, keys: dict[str, Column], fields: list[str], order: str = "ord", kept: bool = False) -> DataFrame:
    """G4/G5 core: empty ``fields`` filled with the group's first non-empty value."""
    if not fields:
        return df
    found = first_in_group(df, keys, fields, order, kept)
    filled = found.withColumns({f: F.coalesce(non_empty(f), F.col(f"first_{f}")) for f in fields})
    return filled.select(*df.columns)


def molecule_key(df: DataFrame) -> Column:
    """First non-blank of searched substance, substance and source substance, lower case."""
    return F.lower(F.coalesce(*[nz(opt(df, c)) for c in ("searched_substance", "substance", "source_substance")]))


def propagate_by_molecule(df: DataFrame, fields: tuple[str, ...] = ("atc_code", "therapeutic_category"), kept: bool = False) -> DataFrame:
    """Attributes shared by all rows of a molecule."""
    keys = {"molecule": molecule_key(df)}
    if "query_id" in df.columns:
        keys["query"] = F.col("query_id")
    present = [f for f in fields if f in df.columns]
    return fill_from_group(df, keys, present, kept=kept)


def merge_by_registration(df: DataFrame) -> DataFrame:
    """Document links and holder shared by all rows of a registration number."""
    fields = [f for f in ("smpc_url", "pil_url", "assessment_report_url", "company") if f in df.columns]
    return fill_from_group(df, {"reg": non_empty("registration_number")}, fields)


def dedupe_uk(df: DataFrame, limit: int | None = None) -> DataFrame:
    """First row per (registration number, document type, url); with ``limit`` the first so many of them."""
    keys = [text(opt(df, c)) for c in ("registration_number", "document_type", "url")]
    rows = keep_first(df, keys)
    return rows if limit is None else rows.orderBy("ord").limit(limit)


def most_common_first(df: DataFrame, value: Column, order: str = "ord", within: list[str] | None = None) -> DataFrame:
    """A4 core: most frequent value, the first encountered on a tie."""
    within = within or []
    counts = (
        df.select(*within, value.alias("value"), F.col(order).alias("_o"))
        .filter("value IS NOT NULL")
        .groupBy(*within, "value")
        .agg(F.count("*").alias("n"), F.min("_o").alias("first_ord"))
    )
    best = F.max_by("value", F.struct("n", -F.col("first_ord"))).alias("value")
    return counts.groupBy(*within).agg(best)
