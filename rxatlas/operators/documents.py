"""Enrichment of product rows from document texts.

Extraction runs once per document; rows meet the extracted fields, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import leaflet as lf
from ..functions import text as tx
from ..functions.base import clean_block, non_empty, opt, text

URL_ORDER = ["smpc_url", "pil_url", "assessment_report_url", "product_url", "url"]
MAKER = ["manufacturer_name", "manufacturer_country", "manufacturer_source"]
LINK_FIELDS = ["smpc_url", "pil_url", "assessment_report_url"]
UK_FIELDS = ["company", *MAKER, "pack_size", *LINK_FIELDS]
# Fixed value: field of an extraction -> column of the row.
EXTRACTION_FIELDS = {
    "ma_holder": "company", "manufacturer_name": "manufacturer_name", "manufacturer_country": "manufacturer_country",
    "strength": "strength", "dosage_form": "dosage_form", "route": "route", "pack_size": "pack_size",
    "therapeutic_category": "therapeutic_category", "registration_number": "registration_number",
    "registration_date": "registration_date", "expiry_date": "expiry_date", "atc_code": "atc_code",
}
EXTRACTION_KEY = ["source", "country", "product", "registration_number", "smpc_url", "pil_url", "url"]


def read_documents(pages: DataFrame, edge: int | None = None) -> DataFrame:
    """Text of a document from its pages, in page order.

    ``pages``: (url, page_no from 0, n_pages, text). With ``edge`` only the first and last so many pages are read.
    """
    kept = pages if edge is None else pages.filter((F.col("page_no") < edge) | (F.col("page_no") >= F.col("n_pages") - edge))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", text("text").alias("text"))))
    return kept.groupBy("url").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def uk_metadata(docs: DataFrame) -> DataFrame:
    """Metadata of UK documents: (doc_url, company, manufacturer fields, pack_size)."""
    found = docs.withColumns({"_maker": lf.manufacturers("text"), "_block": F.get(lf.manufacturer_blocks("text"), F.lit(0))})
    return found.select(
        "doc_url", lf.ma_holder("text").alias("company"), F.col("_maker").alias("manufacturer_name"),
        lf.extract_countries(F.coalesce("_block", "_maker")).alias("manufacturer_country"),
        F.when(F.col("_maker").isNotNull(), "MHRA document").alias("manufacturer_source"),
        lf.pack_info("text").alias("pack_size"),
    )


def extracted_fields(docs: DataFrame) -> DataFrame:
    """What a document offers to any row that links to it, one row per ``doc_url`` with a text."""
    known = docs.filter(non_empty("text").isNotNull())
    found = F.regexp_extract_all(F.col("text"), F.lit(f"(?iU){tx.strength_pattern()}"), F.lit(0))
    preferred = F.filter(found, lambda m: F.rlike(m, F.lit(f"(?iU){tx.PREFERRED_UNITS}")))
    maker = lf.report_manufacturer("text")
    return known.select(
        "doc_url",
        tx.collapse_ws(F.get(preferred, F.lit(0))).alias("strength_1"), tx.collapse_ws(F.get(found, F.lit(0))).alias("strength_2"),
        form_rank(F.col("text")).alias("form_rank"), route_rank(F.col("text")).alias("route_rank"),
        F.upper(tx.extract("text", f"(?iU){tx.ATC_LABEL}", 1)).alias("atc_1"),
        F.upper(tx.extract("text", rf"(?iU)\b{tx.ATC}\b")).alias("atc_2"),
        lf.report_pack("text").alias("pack_size"), lf.indication("text").alias("therapeutic_category"),
        maker["name"].alias("maker"), maker["country"].alias("maker_country"),
        tx.find_email("text").alias("email"), tx.find_phone("text").alias("phone"),
    )


def _rank(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Position of the first pattern that occurs."""
    out = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(rules))):
        out = F.when(F.rlike(c, F.lit(f"(?iU){pattern}")), F.lit(i)).otherwise(out)
    return out


def form_rank(c: Column) -> Column:
    return _rank(c, tx.DOSAGE_FORMS)


def route_rank(c: Column) -> Column:
    return _rank(c, tx.ROUTES)


def _label(rank: Column, rules: list[tuple[str, str]]) -> Column:
    return F.get(dims.literal_list([label for label, _ in rules]), rank)


def document_urls(df: DataFrame) -> Column:
    """A row's distinct document URLs in priority order; three sources have none."""
    urls = F.array_distinct(F.array_compact(F.array(*[non_empty(opt(df, f)) for f in URL_ORDER])))
    kept = F.filter(urls, lambda u: F.endswith(F.lower(u), F.lit(".pdf")) | F.contains(F.lower(u), F.lit("/docs/")))
    return F.when(~text(opt(df, "source")).isin(*dims.DOCUMENT_SKIP_SOURCES), kept)


def enrich_rows(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Empty fields filled from the row's documents, in URL order, until the row is complete.

    ``docs``: (doc_url, text). A row is complete once strength, form, pack and category are known;
    the URLs after that one contribute nothing, whether or not the URLs before it have a document. Documents are landed files, so there is no cap on
    how many a run may read. A row has at most five documents, collected in order.
    """
    links = rows.select("ord", F.posexplode(document_urls(rows)).alias("pos", "doc_url"))
    wanted = docs.join(links.select("doc_url").distinct(), "doc_url", "left_semi")
    fields = extracted_fields(wanted)
    offered = links.join(fields, "doc_url").groupBy("ord").agg(
        F.array_sort(F.collect_list(F.struct("pos", *[c for c in fields.columns if c != "doc_url"]))).alias("_docs")
    )
    return _apply(rows.join(offered, "ord", "left"), rows)


def _first_of(docs: Column, value) -> Column:
    return F.get(F.filter(F.transform(docs, value), lambda v: v.isNotNull()), F.lit(0))


def _first_at(docs: Column, value) -> Column:
    """Place among the row's URLs of the first document with a value; NULL when there is none."""
    return F.get(F.filter(F.transform(docs, lambda x: F.when(value(x).isNotNull(), x["pos"])), lambda v: v.isNotNull()), F.lit(0))


def _apply(joined: DataFrame, rows: DataFrame) -> DataFrame:
    product = text(opt(rows, "product"))
    found = F.regexp_extract_all(product, F.lit(f"(?iU){tx.strength_pattern()}"), F.lit(0))
    preferred = F.filter(found, lambda m: F.rlike(m, F.lit(f"(?iU){tx.PREFERRED_UNITS}")))
    staged = joined.withColumns({
        "_s1": tx.collapse_ws(F.get(preferred, F.lit(0))), "_s2": tx.collapse_ws(F.get(found, F.lit(0))),
        "_form": form_rank(product), "_route": route_rank(product),
        "_a1": F.upper(tx.extract(product, f"(?iU){tx.ATC_LABEL}", 1)), "_a2": F.upper(tx.extract(product, rf"(?iU)\b{tx.ATC}\b")),
    })
    values = {
        "strength": lambda x: F.coalesce("_s1", x["strength_1"], "_s2", x["strength_2"]),
        "dosage_form": lambda x: _label(F.least(F.col("_form"), x["form_rank"]), tx.DOSAGE_FORMS),
        "route": lambda x: _label(F.least(F.col("_route"), x["route_rank"]), tx.ROUTES),
        "atc_code": lambda x: F.coalesce("_a1", x["atc_1"], "_a2", x["atc_2"]),
        "pack_size": lambda x: x["pack_size"],
        "therapeutic_category": lambda x: x["therapeutic_category"],
        "manufacturer_email": lambda x: x["email"],
        "manufacturer_phone": lambda x: x["phone"],
    }
    own = {f: non_empty(opt(rows, f)) for f in (*values, *MAKER, "company")}
    needed = ["strength", "dosage_form", "pack_size", "therapeutic_category"]
    places = F.array(*[F.when(own[f].isNotNull(), 0).otherwise(_first_at(F.col("_docs"), values[f])) for f in needed])
    complete_at = F.when(~F.exists(places, lambda p: p.isNull()), F.array_max(places))
    read = staged.withColumn("_stop", complete_at).withColumn(
        "_docs", F.filter("_docs", lambda x: F.col("_stop").isNull() | (x["pos"] <= F.col("_stop")))
    )
    filled = {f: F.coalesce(own[f], _first_of(F.col("_docs"), v)) for f, v in values.items()}
    company_key = F.lower(text(clean_block(opt(rows, "company"))))

    def step(acc: Column, x: Column) -> Column:
        name = text(acc["name"])
        replace = x["maker"].isNotNull() & ((name == "") | (F.lower(text(clean_block(name))) == company_key))
        new_name = F.when(replace, x["maker"]).otherwise(acc["name"])
        new_source = F.when(replace, F.lit("Regulatory document")).otherwise(acc["source"])
        new_country = F.coalesce(acc["country"], x["maker_country"])
        copy = F.lower(text(clean_block(text(new_name)))) == company_key
        return F.struct(
            F.when(~copy, new_name).alias("name"), F.when(~copy, new_country).alias("country"),
            F.when(~copy, new_source).alias("source"),
        )

    start = F.struct(
        own["manufacturer_name"].alias("name"), own["manufacturer_country"].alias("country"),
        own["manufacturer_source"].alias("source"),
    )
    maker = F.when(F.col("_docs").isNull(), start).otherwise(F.aggregate(F.coalesce("_docs", F.array()), start, step))
    out = read.withColumns({**filled, "_m": maker})
    out = out.withColumns({
        "manufacturer_name": F.col("_m.name"), "manufacturer_country": F.col("_m.country"), "manufacturer_source": F.col("_m.source"),
    })
    extra = [c for c in (*values, *MAKER) if c not in rows.columns]
    return out.select(*rows.columns, *extra)


def apply_uk_metadata(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Document metadata by URL order; assessment documents supply links only.

    A manufacturer that merely repeats the holder is replaced, or cleared when nothing better is known.
    """
    present = [f for f in URL_ORDER if f in rows.columns]
    fields = [f for f in UK_FIELDS if f in meta.columns]
    report = opt(rows, "assessment_report_url")
    spread = F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.col(f).alias("doc_url"),
            (F.lit(f == "assessment_report_url") | (
                F.lit(f in ("product_url", "url")) & F.coalesce((opt(rows, "document_type") == "PAR") & (F.col(f) == report), F.lit(False))
            )).alias("is_report"),
        )
        for i, f in enumerate(present)
    ])
    links = rows.select("ord", F.explode(spread).alias("l")).select("ord", "l.*").filter(non_empty("doc_url").isNotNull())
    hits = links.join(meta.select("doc_url", *fields), "doc_url")

    def usable(f: str) -> Column:
        ok = non_empty(f).isNotNull()
        return ok if f in LINK_FIELDS else ok & ~F.col("is_report")

    found = hits.groupBy("ord").agg(*[F.min_by(f, F.when(usable(f), F.col("pos"))).alias(f"_{f}") for f in fields])
    joined = rows.join(found, "ord", "left")
    own = {f: non_empty(clean_block(opt(rows, f))) for f in UK_FIELDS}
    given = {f: F.col(f"_{f}") if f in fields else F.lit(None).cast("string") for f in UK_FIELDS}
    joined = joined.withColumn("company", F.when(own["company"].isNull(), F.coalesce(given["company"], opt(rows, "company"))).otherwise(opt(rows, "company")))
    holder = F.lower(text(clean_block("company")))
    copied = own["manufacturer_name"].isNotNull() & (F.lower(own["manufacturer_name"]) == holder)
    updates = {}
    for f in UK_FIELDS[1:]:
        replace = given[f].isNotNull() & (own[f].isNull() | (copied if f == "manufacturer_name" else F.lit(False)))
        updates[f] = F.when(replace, given[f]).otherwise(opt(rows, f))
    joined = joined.withColumns(updates)
    repeated = F.lower(text(clean_block("manufacturer_name"))) == holder
    joined = joined.withColumns({f: F.when(~repeated, F.col(f)) for f in MAKER})
    extra = [f for f in UK_FIELDS if f not in rows.columns]
    return joined.select(*rows.columns, *extra)


def apply_eu_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the central product page: (page_url, smpc_url, pil_url, assessment_report_url)."""
    page = F.when(opt(rows, "source") == "EMA", F.coalesce(non_empty(opt(rows, "product_url")), non_empty(opt(rows, "url"))))
    renamed = links.select(F.col("page_url").alias("_page"), *[F.col(f).alias(f"_{f}") for f in LINK_FIELDS])
    joined = rows.withColumn("_page", page).join(renamed, "_page", "left")
    kind = F.when(F.col("_smpc_url").isNotNull(), "Product information")
    out = joined.withColumns({
        **{f: F.coalesce(non_empty(opt(rows, f)), F.col(f"_{f}")) for f in LINK_FIELDS},
        "document_type": F.coalesce(non_empty(opt(rows, "document_type")), kind),
    })
    extra = [f for f in (*LINK_FIELDS, "document_type") if f not in rows.columns]
    return out.select(*rows.columns, *extra)


def apply_extractions(rows: DataFrame, extractions: DataFrame) -> DataFrame:
    """Fields an external model read from a row's document fill what is empty, and are marked."""
    keys = [text(opt(rows, c)).alias(f"_k{i}") for i, c in enumerate(EXTRACTION_KEY)]
    names = [f"_k{i}" for i in range(len(keys))]
    given = [c for c in EXTRACTION_FIELDS if c in extractions.columns]
    right = extractions.select(
        *[text(opt(extractions, f"key_{c}")).alias(n) for c, n in zip(EXTRACTION_KEY, names)],
        *[clean_block(c).alias(f"_x_{c}") for c in given],
        *[text(opt(extractions, c)).alias(f"_x_{c}") for c in ("language_detected", "confidence", "evidence")],
    )
    joined = rows.select("*", *keys).join(right, names, "left")
    applied = {c: F.col(f"_x_{c}").isNotNull() & non_empty(opt(rows, EXTRACTION_FIELDS[c])).isNull() for c in given}
    used = F.array_compact(F.array(*[F.when(a, F.lit(EXTRACTION_FIELDS[c])) for c, a in applied.items()]))
    any_used = F.size(used) > 0
    new = {EXTRACTION_FIELDS[c]: F.when(a, F.col(f"_x_{c}")).otherwise(opt(rows, EXTRACTION_FIELDS[c])) for c, a in applied.items()}
    flags = {
        "ai_enriched": F.when(any_used, "true").otherwise(opt(rows, "ai_enriched")),
        "ai_enriched_fields": F.when(any_used, F.array_join(F.array_sort(used), ", ")).otherwise(opt(rows, "ai_enriched_fields")),
        "ai_language_detected": F.when(any_used, F.col("_x_language_detected")).otherwise(opt(rows, "ai_language_detected")),
        "ai_confidence": F.when(any_used, F.col("_x_confidence")).otherwise(opt(rows, "ai_confidence")),
        "ai_evidence": F.when(any_used, F.col("_x_evidence")).otherwise(opt(rows, "ai_evidence")),
    }
    kept = [F.col(c) for c in rows.columns if c not in {**new, **flags}]
    return joined.select(*kept, *[c.alias(n) for n, c in {**new, **flags}.items()])
