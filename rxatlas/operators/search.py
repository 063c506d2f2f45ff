"""Search predicates and joins of queries with products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.base import any_of, contains_ci, filter_computed, lower_trim, non_empty, nz, opt, text, tokens
from ..functions.english import strip_accents
from ..store_paths import stage
from . import contain

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(c: Column, ascii_only: bool = False) -> Column:
    """Case folding: Unicode by default, ASCII letters only for parity with the store's LIKE."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower()) if ascii_only else F.lower(c)


def search_store(df: DataFrame, query: str, like: bool = False, ascii_only: bool = False) -> DataFrame:
    """Substance or product contains the query; with ``like`` the query's % and _ are wildcards."""
    substance, product = fold(text("substance"), ascii_only), fold(text("product"), ascii_only)
    needle = fold(F.lit(query), ascii_only)
    if like:
        pattern = F.concat(F.lit("%"), F.replace(needle, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        return df.filter(F.like(substance, pattern) | F.like(product, pattern))
    return df.filter(F.contains(substance, needle) | F.contains(product, needle))


def has_all_tokens(value: Column, query_tokens: Column) -> Column:
    """P2 on prepared tokens: the query has tokens and every one occurs in the value."""
    words = tokens(value)
    return (F.size(query_tokens) > 0) & (F.size(F.array_except(query_tokens, words)) == 0)


def matches_all_tokens(value: Column | str, query: Column | str) -> Column:
    """P2."""
    value = F.col(value) if isinstance(value, str) else value
    return has_all_tokens(value, tokens(query))


def relevant_to_substance(df: DataFrame, query: Column | str) -> Column:
    """The ladder that decides whether a row really belongs to the searched substance."""
    asked = tokens(query)
    product = text(opt(df, "product"))
    groups = F.regexp_extract_all(product, F.lit(r"\(([^)]{3,120})\)"), F.lit(1))
    active = F.concat_ws(" ", opt(df, "active_substance"), opt(df, "active_substances"))
    return (
        F.when(F.size(asked) == 0, True)
        .when(has_all_tokens(product, asked), True)
        .when(F.size(groups) > 0, F.exists(groups, lambda g: has_all_tokens(g, asked)))
        .when(has_all_tokens(active, asked), True)
        .when(has_all_tokens(opt(df, "source_substance"), asked), True)
        .when(F.size(asked) > 1, False)
        .when(lower_trim(opt(df, "source")) == "mhra", False)
        .otherwise(True)
    )


def is_lookup_fallback(df: DataFrame) -> Column:
    """P5: a placeholder row of a named source rather than a product record."""
    kind, mode = lower_trim(opt(df, "document_type")), lower_trim(opt(df, "connector_mode"))
    placeholder = (
        F.contains(kind, F.lit("lookup fallback"))
        | F.contains(kind, F.lit("registry search handoff"))
        | (mode == "manual_registry")
        | F.endswith(lower_trim(opt(df, "product")), F.lit("regulator lookup"))
    )
    source = text(nz(opt(df, "source")))
    return (source != "") & placeholder & ~source.isin(*dims.GENERIC_SOURCES)


def matches_selected_sources(df: DataFrame, selected: Column | list[str]) -> Column:
    """No selection, the row's source is selected, or its country belongs to a selected source."""
    chosen = F.array(*[F.lit(s) for s in selected]) if isinstance(selected, list) else selected
    if isinstance(selected, list) and not selected:
        return F.lit(True)
    lowered = F.transform(chosen, lambda s: F.lower(F.trim(s)))
    served = F.flatten(
        F.transform(lowered, lambda s: F.coalesce(dims.lookup(dims.source_countries(), s), F.array().cast("array<string>")))
    )
    country = text(nz(opt(df, "country")))
    return (
        (F.coalesce(F.size(chosen), F.lit(0)) <= 0)
        | F.array_contains(lowered, lower_trim(opt(df, "source")))
        | F.array_contains(served, country)
    )


def suppress_generic(df: DataFrame) -> DataFrame:
    """Generic look-up rows dropped in countries that have a connector row.

    Only the countries with connector rows are aggregated (a few hundred per query at most).
    """
    scope = ["query_id"] if "query_id" in df.columns else []
    generic = text("source").isin(*dims.GENERIC_SOURCES)
    covered = (
        df.filter(non_empty("country").isNotNull() & ~generic)
        .select(*scope, "country").distinct().withColumn("_covered", F.lit(True))
    )
    joined = df.join(covered, [*scope, "country"], "left")
    return joined.filter(~(generic & F.col("_covered").isNotNull())).select(*df.columns)


def drop_generic(df: DataFrame) -> DataFrame:
    """P8."""
    return df.filter(~text("source").isin(*dims.GENERIC_SOURCES))


def is_manual(df: DataFrame) -> Column:
    """A registry link rather than a product record."""
    return text(opt(df, "connector_mode")) == "manual_registry"


def drop_manual_for_export(df: DataFrame) -> DataFrame:
    """P10."""
    manual = text(nz(opt(df, "connector_mode"))) == "manual_registry"
    return df.filter(~(manual | F.contains(F.lower(text(opt(df, "document_type"))), F.lit("registry search handoff"))))


def record_matches(df: DataFrame, query: Column | str, fields: list[str]) -> Column:
    """Substring of any of the name fields."""
    needle = F.lower(F.trim(F.lit(query) if isinstance(query, str) else query))
    return any_of([F.contains(F.lower(text(opt(df, f))), needle) for f in fields])


def record_matches_tokens(df: DataFrame, query: Column | str, fields: list[str]) -> Column:
    """Every query token among the tokens of the fields; an empty query matches."""
    asked = tokens(F.lit(query) if isinstance(query, str) else query)
    return (F.size(asked) == 0) | has_all_tokens(F.concat_ws(" ", *[opt(df, f) for f in fields]), asked)


def accent_insensitive_contains(value: Column | str, query: Column | str) -> Column:
    """Substring without regard to letter case or accents."""
    hay = F.col(value) if isinstance(value, str) else value
    needle = F.lit(query) if isinstance(query, str) else query
    return F.contains(F.lower(strip_accents(text(hay))), F.lower(strip_accents(needle)))


def column_filters(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Every non-blank filter is a substring of its displayed cell, whatever the letter case."""
    for name, wanted in filters.items():
        if wanted.strip():
            df = df.filter(contains_ci(name, F.lit(wanted.strip())))
    return df


# --- Queries joined with products ---------------------------------------------------------------


def stamp_query(df: DataFrame, substance: Column | str) -> DataFrame:
    """The register's own substance name is kept aside, the searched one takes its place."""
    searched = F.col(substance) if isinstance(substance, str) else substance
    return df.withColumns({
        "source_substance": F.col("substance"), "searched_substance": searched, "substance": searched,
    })


def expand_synonyms(queries: DataFrame, single_term_sources: bool = False) -> DataFrame:
    """(query, term, term_pos): the query itself, then its synonyms, case-insensitively unique.

    The synonym table is a fixed map, so this is a projection and an explode, not a join. With
    ``single_term_sources`` the frame carries a ``source`` and two sources get the plain query only.
    """
    name = F.lower(F.trim("substance"))
    parts = F.filter(F.split(F.replace(name, F.lit("+"), F.lit(" ")), r"(?U)\s+"), lambda p: ~p.isin("", "and", "&"))
    none = F.array().cast("array<string>")
    by_words = F.coalesce(dims.lookup(dims.SYNONYMS, F.array_join(parts, " ")), none)
    by_name = F.coalesce(dims.lookup(dims.SYNONYMS, name), none)
    found = F.array_distinct(F.concat(by_words, by_name))
    extra = F.filter(found, lambda t: F.lower(t) != F.lower("substance"))
    if single_term_sources:
        extra = F.when(lower_trim("source").isin(*dims.SINGLE_TERM_SOURCES), none).otherwise(extra)
    terms = F.concat(F.array("substance"), extra)
    return queries.select("*", F.posexplode(terms).alias("term_pos", "term"))


def expand_local_terms(queries: DataFrame) -> DataFrame:
    """One register is searched with the local-language name first, then the original."""
    local = dims.lookup(dims.RUSSIAN_NAMES, F.lower(F.trim("substance")))
    terms = F.filter(F.array_distinct(F.array(local, F.trim("substance"))), lambda t: t.isNotNull())
    return queries.select("*", F.posexplode(terms).alias("term_pos", "term"))


def _rarest_token(asked: DataFrame, offers: DataFrame) -> DataFrame:
    """``asked`` with ``_anchor``: of the tokens in ``_keys`` the one that the fewest rows offer; queries with a token
    that no row offers have no hit and go."""
    sizes = offers.groupBy("_anchor").agg(F.count("*").alias("_rows"))
    each = asked.select("_needle", F.explode("_needle").alias("_anchor")).join(sizes, "_anchor")
    best = each.groupBy("_needle").agg(F.min_by("_anchor", F.struct("_rows", "_anchor")).alias("_anchor"), F.count("*").alias("_known"))
    return best.filter(F.col("_known") == F.size("_needle")).select("_needle", "_anchor")


def search_many(queries: DataFrame, products: DataFrame, mode: str = "substring") -> DataFrame:
    """Every query against all products, as an equi-join; adds the query's columns to each hit.

    ``substring``: through the gram index of ``contain``: distinct query texts meet the products that hold their anchor, and
    ``contains`` verifies; names recur from product to product, so each distinct pair of texts is searched once and its hits are joined back.
    ``token``: the anchor is the query's rarest token and all tokens must
    occur; hits inside a token are not found. A product row is repeated only for anchors it holds, and meets distinct
    query texts; the queries' other columns join the hits.
    """
    if mode == "token":
        asked = queries.withColumn("_needle", F.array_sort(F.array_distinct(tokens("query_substance")))).filter(F.size("_needle") > 0)
        hay = products.withColumn("_hay", F.array_distinct(tokens(F.concat_ws(" ", "substance", "product"))))
        offers = hay.withColumn("_anchor", F.explode("_hay"))
        anchors = _rarest_token(asked.select("_needle").distinct(), offers.select("_anchor"))
        hits = offers.join(anchors, "_anchor").filter(F.size(F.array_except("_needle", "_hay")) == 0).drop("_anchor", "_hay")
    else:
        asked = queries.filter(F.col("query_substance").isNotNull()).withColumn("_needle", F.lower("query_substance"))
        lowered = products.withColumns({"_s": F.lower(text("substance")), "_p": F.lower(text("product"))})
        texts = stage(lowered.select("_s", "_p").distinct(), "searched-texts")
        anchors = contain.anchored(asked, "_needle", texts, ["_s", "_p"])
        # staged, so that the planner knows their size and broadcasts them only if they are few
        found = stage(contain.containing(texts, ["_s", "_p"], anchors, "_needle"), "found-texts")
        hits = lowered.join(found, ["_s", "_p"]).drop("_s", "_p")
    known = asked.dropDuplicates(queries.columns)
    known = known if mode == "token" else stage(known, "asked")
    return hits.join(known, "_needle").select(*queries.columns, *products.columns)


def search_few(queries: list[tuple[str, str]], products: DataFrame) -> DataFrame:
    """J2 for a short list of (id, substance) given by the caller: a narrow explode, no join at all."""
    asked = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(s).alias("query_substance")) for i, s in queries])
    substance, product = F.lower(text("substance")), F.lower(text("product"))
    hit = F.filter(
        asked,
        lambda q: F.contains(substance, F.lower(q["query_substance"])) | F.contains(product, F.lower(q["query_substance"])),
    )
    found = products.select("*", F.explode(hit).alias("_q"))
    return found.select("_q.query_id", "_q.query_substance", *products.columns)


def fuzzy_token_query(df: DataFrame, value: Column | str, query: str, max_edits: int = 1) -> DataFrame:
    """Every query token within ``max_edits`` of some word; an exact word scores 4, a near one 1.

    Adds ``fuzzy_score``: the sum of the best score per query token. The query's tokens are an array
    of literals, so the test is a narrow expression.
    """
    import re

    asked = [t for t in re.split(r"[,+\-!(){}\[\]^~*?:%/\s]+", query.strip().lower()) if t]
    words = tokens(F.col(value) if isinstance(value, str) else value)

    def score(token: str) -> Column:
        exact = F.array_contains("_words", F.lit(token))
        near = F.exists("_words", lambda w: F.levenshtein(w, F.lit(token), max_edits) >= 0)
        return F.when(exact, 4).when(near, 1).otherwise(0)

    if not asked:
        return df.withColumn("fuzzy_score", F.lit(0))
    scored = df.withColumn("_words", words).withColumn("_best", F.array(*[score(t) for t in asked]))
    hits = filter_computed(scored, F.forall("_best", lambda s: s > 0))
    return hits.withColumn("fuzzy_score", F.aggregate("_best", F.lit(0), lambda a, s: a + s)).drop("_best", "_words")


def _deletions(word: Column) -> Column:
    """The word and what is left of it without one of its characters: two words one edit apart share one of these."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def fuzzy_search_many(queries: DataFrame, products: DataFrame, value: Column | str) -> DataFrame:
    """P15 for many queries: (query_id, ord, fuzzy_score) of the products that have every token of the query or a word one edit from it.

    Distinct query tokens meet distinct words of the products through their deletion neighbourhoods, and the edit distance verifies; the
    rows then meet the tokens through their words. ``queries``: (query_id, query_substance); ``products`` carry ``ord``.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query_substance"))).alias("token"))
    rows = products.select("ord", F.explode(F.array_distinct(tokens(F.col(value) if isinstance(value, str) else value))).alias("word"))
    rows = stage(rows, "words-of-rows")
    left = asked.select("token").distinct().withColumn("variant", F.explode(_deletions(F.col("token"))))
    right = rows.select("word").distinct().withColumn("variant", F.explode(_deletions(F.col("word"))))
    near = left.join(right, "variant").select("token", "word").distinct().filter(F.levenshtein("token", "word", 1) >= 0)
    scored = near.select("token", "word", F.when(F.col("token") == F.col("word"), 4).otherwise(1).alias("score"))
    by_token = rows.join(scored, "word").groupBy("ord", "token").agg(F.max("score").alias("score"))
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("tokens"))
    hits = by_token.join(asked, "token").groupBy("query_id", "ord").agg(F.sum("score").cast("int").alias("fuzzy_score"), F.count("*").alias("found"))
    return hits.join(sizes, "query_id").filter("found = tokens").select("query_id", "ord", "fuzzy_score")
