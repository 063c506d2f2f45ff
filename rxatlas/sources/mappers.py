"""Connector mappers: landed payload rows -> canonical product rows.

Every mapper is a projection of a raw frame that carries ``query`` (the searched substance) and
``ord``. Absent values are NULL; keep-first steps use ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..dims import literal_list
from ..functions import leaflet as lf
from ..functions import text as tx
from ..functions.base import any_of, clean_block, collapse_ws, filter_computed, let, non_empty, nz, opt, text
from ..functions.english import strip_accents
from ..functions.rows import first_non_blank
from ..operators import contain
from ..operators.identity import keep_first
from ..operators.joins import best_match_join, star_join
from ..operators.search import record_matches
from ..store_paths import stage

EU_BASE = "https://www.ema.europa.eu"
UK_BASE = "https://products.mhra.gov.uk"
HANDOFF = "Official registry search handoff"


def _row(
    df: DataFrame, source: str, country: Column | str, region: str, name: Column | None = None, keep: tuple[str, ...] = (),
    **values: Column | str | None,
) -> DataFrame:
    """Canonical columns; strength, form and pack fall back to the name parsers."""
    product = values.get("product") if name is None else name
    parsed = {
        "strength": tx.extract_strength(product), "dosage_form": tx.extract_dosage_form(product),
        "pack_size": tx.extract_pack_size(product),
    }
    out = {k: (F.lit(v) if isinstance(v, str) or v is None else v) for k, v in values.items()}
    for field, fallback in parsed.items():
        out[field] = F.coalesce(nz(out[field]), fallback) if field in out else fallback
    out |= {"source": F.lit(source), "country": F.lit(country) if isinstance(country, str) else country, "region": F.lit(region)}
    kept = [c for c in ("query", "query_id", "ord", *keep) if c in df.columns]
    return df.select(*kept, *[v.cast("string").alias(k) for k, v in out.items()])


def expand_countries(df: DataFrame, countries: list[str]) -> DataFrame:
    """One row per country of a fixed list: an explode of a constant, so no join."""
    return df.select("*", F.explode(literal_list(countries)).alias("country"))


def from_unified(df: DataFrame) -> DataFrame:
    """M0: the unified product under its canonical names."""
    renames = {
        "active_substance": "substance", "product_name": "product", "marketing_authorisation_holder": "company",
    }
    out = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    product_url, source_url = non_empty(opt(df, "product_url")), non_empty(opt(df, "source_url"))
    return out.withColumns({
        "source_url": F.coalesce(source_url, product_url), "url": F.coalesce(product_url, source_url),
    })


def map_central_eu(df: DataFrame, countries: list[str], source_url: str) -> DataFrame:
    """M1: central products that match the query, once per country."""
    names = [
        "active_substance", "international_non_proprietary_name_common_name",
        "international_non_proprietary_name_inn_common_name", "name_of_medicine",
    ]
    hits = df.filter(record_matches(df, F.col("query"), names))

    def pick(*keys: str) -> Column:
        return F.coalesce(*[F.trim(non_empty(opt(df, k))) for k in keys])

    product = pick("name_of_medicine", "medicine_name", "product_name", "name")
    link = tx.absolute_url(EU_BASE, pick("medicine_url", "url", "product_url", "epar_url"))
    mapped = _row(
        hits, "EMA", F.lit(None).cast("string"), "EU",
        substance=F.coalesce(pick("active_substance"), F.col("query")), product=product,
        company=pick(
            "marketing_authorisation_developer_applicant_holder", "marketing_authorisation_holder_company_name",
            "marketing_authorisation_holder", "applicant", "holder",
        ),
        status=pick("medicine_status", "status"),
        strength=pick("strength", "strengths", "active_substance_strength", "pharmaceutical_strength"),
        dosage_form=pick("pharmaceutical_form", "pharmaceutical_forms", "pharmaceutical_form_human", "dosage_form"),
        registration_number=pick("ema_product_number", "product_number"),
        registration_date=pick("marketing_authorisation_date", "european_commission_decision_date", "authorisation_date"),
        atc_code=pick("atc_code_human", "atc_code"),
        therapeutic_category=pick("pharmacotherapeutic_group_human", "therapeutic_area", "therapeutic_indication"),
        source_url=source_url, product_url=link, url=link, last_checked=pick("last_updated_date", "last_updated"),
    )
    return expand_countries(mapped.drop("country"), countries)


def central_fallback_rows(df: DataFrame) -> DataFrame:
    """Name-only central products (query, product, url, source_url) in thirty countries."""
    mapped = _row(
        df, "EMA", F.lit(None).cast("string"), "EU", substance=F.col("query"), product=F.col("product"),
        status="Authorised", source_url=F.col("source_url"), product_url=F.col("url"), url=F.col("url"),
    )
    return expand_countries(mapped.drop("country"), dims.EU_COUNTRIES + dims.EEA_COUNTRIES)


def map_us_labels(labels: DataFrame, ndc: DataFrame) -> DataFrame:
    """M2: drug labels with their best package record.

    ``labels``: (query, ord, openfda struct of arrays, text arrays); ``ndc``: (query, ord, brand_name,
    brand_name_base, generic_name, labeler_name, dosage_form, listing_expiration_date, packaging,
    active_ingredients).
    """
    def head(path: str) -> Column:
        return non_empty(F.get(F.col(path), F.lit(0)))

    def joined(*fields: str) -> Column:
        parts = [F.array_join(F.filter(F.col(f), lambda v: F.trim(v) != ""), " ") for f in fields if f in labels.columns]
        return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])

    named = labels.withColumns({
        "product": F.coalesce(head("openfda.brand_name"), head("openfda.generic_name")),
        "company": head("openfda.manufacturer_name"), "substance": F.col("query"),
    }).filter(F.col("product").isNotNull())
    matched = best_match_join(named, ndc.withColumn("substance", F.col("query")))
    packs = ndc.select(
        F.col("ord").alias("match_ord"), F.col("labeler_name").alias("_labeler"), F.col("dosage_form").alias("_form"),
        F.col("listing_expiration_date").alias("_expiry"),
        F.array_join(F.filter(F.transform("packaging", lambda p: p["description"]), lambda x: F.coalesce(x, F.lit("")) != ""), "; ").alias("_pack"),
        F.array_join(F.filter(F.transform("active_ingredients", lambda p: p["strength"]), lambda x: F.coalesce(x, F.lit("")) != ""), "; ").alias("_strength"),
    )
    both = matched.join(packs, "match_ord", "left")
    number = head("openfda.application_number")
    purpose = collapse_ws(F.get(F.col("purpose"), F.lit(0))) if "purpose" in labels.columns else F.lit(None).cast("string")
    base = "https://api.fda.gov/drug/label.json?search="
    all_of_query = F.concat(F.lit(base), tx.percent_encode(F.concat(F.lit('openfda.substance_name:"'), "query", F.lit('"'))), F.lit("&limit=25"))
    one = F.concat(F.lit(base), tx.percent_encode(F.concat(F.lit('openfda.application_number:"'), number, F.lit('"'))), F.lit("&limit=10"))
    link = F.coalesce(one, all_of_query)
    mapped = _row(
        both, "FDA", "United States", "US", name=F.col("product"), substance=F.col("query"), product=F.col("product"),
        company=F.coalesce(F.col("company"), non_empty("_labeler")), status="Label available",
        strength=F.coalesce(
            tx.extract_strength(joined("active_ingredient", "spl_product_data_elements", "description")),
            tx.extract_strength("product"), non_empty("_strength"),
        ),
        dosage_form=F.coalesce(
            F.initcap(head("openfda.dosage_form")),
            tx.extract_dosage_form(joined("spl_product_data_elements", "dosage_and_administration", "description")),
            tx.extract_dosage_form("product"), F.initcap(non_empty("_form")),
        ),
        pack_size=F.lit(None).cast("string"), expiry_date=F.col("_expiry"), route=head("openfda.route"),
        therapeutic_category=F.coalesce(purpose, head("openfda.pharm_class_epc")), registration_number=number,
        source_url=all_of_query, product_url=link, url=link, _pack=F.col("_pack"),
    )
    return mapped.withColumn("pack_size", F.nullif("_pack", F.lit(""))).drop("_pack")


def map_uk_index(df: DataFrame) -> DataFrame:
    """M3: UK index records (query, ord, substance_name array, title, product_name, pl_number array,
    metadata_storage_path, doc_type, created, highlights text)."""
    asked = F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda t: t != "")
    names = F.filter(F.transform("substance_name", lambda n: F.trim(n)), lambda n: n != "")
    words = F.split(F.lower(F.concat_ws(" ", F.array_join(names, " "), "title", "product_name")), "[^a-z0-9]+")
    hits = df.filter((F.size(asked) == 0) | (F.size(F.array_except(asked, words)) == 0))
    product = tx.clean_product_name(F.coalesce(non_empty("product_name"), non_empty("title")))
    staged = hits.withColumns({"_names": names, "_product": product}).withColumn(
        "_number", F.coalesce(tx.format_registration(F.get("pl_number", F.lit(0))), tx.extract_registration_number("_product"))
    )
    kind, url = F.upper(F.col("doc_type")), F.col("metadata_storage_path")
    return _row(
        staged, "MHRA", "United Kingdom", "UK", name=F.col("_product"),
        substance=F.coalesce(F.nullif(F.array_join("_names", ", "), F.lit("")), F.col("query")), product=F.col("_product"),
        company=F.nullif(lf.holder_from_highlights("highlights", "_number"), F.lit("")), status="Authorised",
        registration_number=F.col("_number"), registration_date=F.col("created"), document_type=kind,
        source_url=F.concat(F.lit(UK_BASE + "/search/?search="), tx.percent_encode("query"), F.lit("&page=1")),
        product_url=url, url=url, last_checked=F.col("created"), smpc_url=F.when(kind == "SPC", url),
        pil_url=F.when(kind == "PIL", url), assessment_report_url=F.when(kind == "PAR", url),
    )


def _asked(texts: DataFrame, query: str | DataFrame, key: str, value: str, folded) -> DataFrame:
    """(query, key): which keys have a ``value`` that contains a query, both in the form that ``folded`` gives them.

    One query is a filter. Many queries, a frame with a column ``query``, meet the distinct values through the gram index of ``contain``.
    """
    if isinstance(query, str):
        hit = F.contains(folded(text(value)), folded(F.lit(query.strip())))
        return texts.filter(hit).select(F.lit(query).alias("query"), key).distinct()
    asked = query.select("query").distinct().withColumn("_needle", folded(F.trim("query")))
    values = texts.select(key, folded(text(value)).alias("_hay")).distinct()
    hays = stage(values.select("_hay").distinct(), "texts")
    met = contain.containing(hays, ["_hay"], contain.anchored(asked, "_needle", hays, ["_hay"]), "_needle")
    return values.join(met, "_hay").join(asked, "_needle").select("query", key).distinct()


def map_canada(ingredients: DataFrame, products: DataFrame, companies: DataFrame, statuses: DataFrame, query: str | DataFrame) -> DataFrame:
    """M4: four data sets joined on the drug code; field names in any letter case. ``query``: one term, or a frame of them."""
    code = ["drug_code", "drugCode"]
    ing = ingredients.select(first_non_blank(ingredients, code).alias("code"), first_non_blank(ingredients, ["ingredient_name", "ingredientName"]).alias("ingredient"))
    prod = products.select(first_non_blank(products, code).alias("code"), first_non_blank(products, ["brand_name", "brandName"]).alias("product"), "ord")
    comp = companies.select(first_non_blank(companies, code).alias("code"), first_non_blank(companies, ["company_name", "companyName"]).alias("company"), "ord")
    stat = statuses.select(first_non_blank(statuses, code).alias("code"), first_non_blank(statuses, ["status", "status_name", "statusName"]).alias("status"), "ord")
    codes = _asked(ing, query, "code", "ingredient", F.lower)
    kept = prod.filter(F.col("product").isNotNull()).join(codes, "code")
    rows = star_join(kept, ing, comp, stat, "code", F.lit(True))
    page = "https://health-products.canada.ca/dpd-bdpp/index-eng.jsp"
    return _row(
        rows, "Health Canada", "Canada", "CA", substance=F.col("query"), product=F.col("product"),
        company=F.col("company"), status=F.col("status"), registration_number=F.col("code"),
        source_url="https://health-products.canada.ca/api/drug/drugproduct/?lang=en&type=json", product_url=page, url=page,
    )


def map_spain(df: DataFrame) -> DataFrame:
    """M5: the last document of each kind counts; the product page depends on whether there is a summary."""
    def doc(kind: int) -> Column:
        urls = F.transform(
            F.filter("docs", lambda x: x["tipo"] == kind), lambda x: F.coalesce(non_empty(x["url"]), non_empty(x["urlHtml"]))
        )
        return F.try_element_at(urls, F.lit(-1))

    number = F.col("nregistro").cast("string")
    root = "https://cima.aemps.es/cima"
    page = F.when(
        doc(1).isNotNull(), F.concat(F.lit(f"{root}/dochtml/ft/"), number, F.lit("/FT_"), number, F.lit(".html"))
    ).otherwise(F.concat(F.lit(f"{root}/medicamento/"), number))
    return _row(
        df.filter(non_empty("nombre").isNotNull()), "Spain CIMA", "Spain", "EU", substance=F.col("query"), product=F.col("nombre"),
        company=F.coalesce(non_empty("labtitular"), non_empty("labcomercializador")),
        status=F.when(F.coalesce(F.col("comerc"), F.lit(False)), "Marketed").when(F.col("estado").isNotNull(), "Authorised"),
        registration_number=number,
        source_url=F.concat(F.lit(f"{root}/rest/medicamentos?practiv1="), tx.percent_encode("query")),
        product_url=page, url=page, smpc_url=doc(1), pil_url=doc(2),
    )


def grouped_sets(df: DataFrame, keys: list[str], columns: dict[str, str], sep: str = ", ") -> DataFrame:
    """Per key the distinct non-empty values of columns, sorted and joined (``columns``: new name -> column), and the first ``ord``.

    Sets are built map-side first; a key holds the few values that a register gives one product.
    """
    joined = [F.nullif(F.array_join(F.array_sort(F.collect_set(non_empty(c))), sep), F.lit("")).alias(n) for n, c in columns.items()]
    return df.groupBy(*keys).agg(*joined, F.min("ord").alias("ord"))


def map_france(products: DataFrame, compositions: DataFrame, query: str | DataFrame) -> DataFrame:
    """M6: products with a composition that contains the query, without regard to accents (A9, P13). ``query``: one term, or a frame of them."""
    hits = _asked(compositions, query, "cis", "substance", lambda c: F.lower(strip_accents(c)))
    per_code = grouped_sets(compositions.join(hits.select("cis").distinct(), "cis", "left_semi"), ["cis"], {"_names": "substance", "_strengths": "strength"})
    rows = products.drop("ord").join(per_code, "cis").join(hits, "cis")
    page = F.concat(F.lit("https://base-donnees-publique.medicaments.gouv.fr/medicament/"), "cis", F.lit("/extrait"))
    return rows.select(
        "query", "ord", F.coalesce("_names", "query").alias("substance"), "product", "company",
        F.lit("France").alias("country"), F.lit("EU").alias("region"),
        F.coalesce(non_empty("marketing_status"), non_empty("status")).alias("status"), F.col("_strengths").alias("strength"),
        F.col("pharmaceutical_form").alias("dosage_form"), F.col("cis").alias("registration_number"), "registration_date",
        F.lit("France BDPM").alias("source"),
        F.lit("https://www.data.gouv.fr/fr/datasets/base-de-donnees-publique-des-medicaments-base-officielle/").alias("source_url"),
        page.alias("product_url"), page.alias("url"),
    )


def map_belgium(df: DataFrame) -> DataFrame:
    """M7: first of several forms and routes; first document of each kind."""
    def doc(kinds: list[str]) -> Column:
        ok = F.filter("documents", lambda x: F.lower(x["type"]).isin(*kinds) & (F.coalesce(x["url"], F.lit("")) != ""))
        return F.get(ok, F.lit(0))["url"]

    ident = text(opt(df, "id"))
    page = F.concat(F.lit("https://medicinesdatabase.be/human/"), ident)
    return _row(
        df.filter(non_empty("name").isNotNull()), "Belgium FAMHP", "Belgium", "EU",
        substance=F.coalesce(F.nullif(F.array_join("activeSubstanceShort", ", "), F.lit("")), F.col("query")), product=F.col("name"),
        company=F.col("company"), status=F.nullif(F.array_join("availability", ", "), F.lit("")),
        dosage_form=nz(F.get("pharmaceuticalForm", F.lit(0))),
        route=F.coalesce(nz(F.get("routeOfAdministration", F.lit(0))), tx.extract_route("name")),
        registration_number=F.coalesce(non_empty("authorisationNumber"), non_empty(ident)), product_url=page, url=page,
        smpc_url=doc(["skp", "spc"]), pil_url=doc(["bijsluiter", "leaflet", "pil"]), last_checked=F.col("editTS"),
    )


def map_ireland(medicines: DataFrame, details: DataFrame, licenses: DataFrame, companies: DataFrame, ingredients: DataFrame) -> DataFrame:
    """M8: a medicine with its detail page, first licence, company and ingredient names in order.

    ``medicines``/``details``: (id, name, status, company, licenseNumbers, ingredients, publishedAt, …);
    the look-up frames are keyed by ``id``.
    """
    both = medicines.alias("e").join(details.alias("d"), F.col("e.id") == F.col("d.id"), "left")

    def pick(name: str) -> Column:
        parts = [F.col(f"{a}.{name}") for a, f in (("d", details), ("e", medicines)) if name in f.columns]
        is_text = dict(medicines.dtypes).get(name, dict(details.dtypes).get(name)) == "string"
        return F.coalesce(*[non_empty(p) if is_text else p for p in parts]) if parts else F.lit(None).cast("string")

    rows = both.select(
        F.col("e.query").alias("query"), F.col("e.ord").alias("ord"), F.col("e.id").alias("id"), pick("name").alias("product"),
        pick("status").alias("status"), pick("company").alias("_company"), pick("publishedAt").alias("_published"),
        pick("updatedAt").alias("_updated"), F.get(pick("licenseNumbers"), F.lit(0)).alias("_license"), pick("ingredients").alias("_ingredients"),
        pick("spc_file").alias("_file"),
    )
    parts = rows.select("ord", F.posexplode("_ingredients").alias("_pos", "_ing"))
    named = parts.join(ingredients.select(F.col("id").alias("_ing"), non_empty("name").alias("_name")), "_ing").filter("_name IS NOT NULL")
    listed = named.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_list")).select(
        "ord", F.array_join(F.transform("_list", lambda x: x["_name"]), ", ").alias("_substances")
    )
    full = (
        rows.join(listed, "ord", "left")
        .join(licenses.select(F.col("id").alias("_license"), F.col("fullLicenseNumber").alias("_number"), opt(licenses, "frontendUrl").alias("_front")), "_license", "left")
        .join(companies.select(F.col("id").alias("_company"), F.col("name").alias("_owner")), "_company", "left")
    )
    slug = F.array_join(F.split(text(collapse_ws(F.lower("product"))), " "), "-")
    page = F.coalesce(
        non_empty("_front"), F.concat(F.lit("https://www.medicines.ie/medicines/"), slug, F.lit("-"), F.col("id").cast("string"), F.lit("/spc"))
    )
    return _row(
        full, "Ireland medicines.ie", "Ireland", "EU", substance=F.coalesce(F.col("_substances"), F.col("query")), product=F.col("product"),
        company=F.col("_owner"), status=F.col("status"), registration_number=F.col("_number"), registration_date=F.col("_published"),
        source_url="https://www.medicines.ie/", product_url=page, url=page, smpc_url=F.col("_file"), last_checked=F.col("_updated"),
    )


def split_company_country(c: Column) -> tuple[Column, Column]:
    """M9: ``NAME - COUNTRY``, split on the last dash."""
    value = collapse_ws(c)
    has = F.contains(value, F.lit(" - "))
    return (
        F.when(has, nz(F.regexp_extract(value, r"^(.*) - (.*)$", 1))).otherwise(value),
        F.when(has, nz(F.regexp_extract(value, r"^(.*) - (.*)$", 2))),
    )


def map_indonesia(df: DataFrame) -> DataFrame:
    """M9."""
    c = {n: collapse_ws(opt(df, n)) for n in (
        "PRODUCT_NAME", "INGREDIENTS", "STATUS", "PRODUCT_FORM", "PRODUCT_PACKAGE", "PRODUCT_ATC", "PRODUCT_REGISTER",
        "PRODUCT_DATE", "PRODUCT_EXPIRED",
    )}
    hay = F.lower(F.concat_ws(" ", text(c["PRODUCT_NAME"]), text(c["INGREDIENTS"])))
    hits = df.filter(F.contains(hay, F.lower("query")))
    company, _ = split_company_country(opt(df, "REGISTRAR"))
    maker, maker_country = split_company_country(opt(df, "MANUFACTURER_NAME"))
    a, b = non_empty(opt(df, "PRODUCT_ID")), non_empty(opt(df, "APPLICATION_ID"))
    root = "https://cekbpom.pom.go.id"
    page = F.coalesce(F.concat(F.lit(root + "/produk/"), a, F.lit("/"), b, F.lit("/detail")), F.lit(root + "/all-produk"))
    return _row(
        hits, "BPOM Indonesia", "Indonesia", "AS", substance=F.coalesce(c["INGREDIENTS"], F.col("query")), product=c["PRODUCT_NAME"],
        company=company, status=F.coalesce(c["STATUS"], F.lit("Registered")), dosage_form=c["PRODUCT_FORM"],
        pack_size=c["PRODUCT_PACKAGE"], atc_code=c["PRODUCT_ATC"], registration_number=c["PRODUCT_REGISTER"],
        registration_date=c["PRODUCT_DATE"], expiry_date=c["PRODUCT_EXPIRED"], manufacturer_name=maker,
        manufacturer_country=F.coalesce(maker_country, F.lit("Indonesia")), manufacturer_source="BPOM JSON",
        product_url=page, url=page,
    )


def first_attachment(c: Column) -> Column:
    """URL of the first attachment with a path in a JSON list held as text."""
    items = F.from_json(c, "array<struct<duongDanTep string>>")
    paths = F.filter(F.transform(items, lambda x: collapse_ws(x["duongDanTep"])), lambda p: p.isNotNull())
    root = "https://dichvucong.dav.gov.vn/File/GoToViewTaiLieu?url="
    return F.concat(F.lit(root), tx.percent_encode(F.get(paths, F.lit(0))))


def map_vietnam(df: DataFrame) -> DataFrame:
    """Nested structs; withdrawn flag to status; ISO dates cut."""
    def field(path: str) -> Column:
        return collapse_ws(F.col(path))

    active, product = field("thongTinThuocCoBan.hoatChatChinh"), field("tenThuoc")
    hits = df.filter(F.contains(F.lower(F.concat_ws(" ", text(active), text(product))), F.lower("query")))
    root = dims.COUNTRY_REGISTRY_URL["Vietnam"]
    page = F.concat(F.lit(root + "#registration-"), F.col("id").cast("string"))
    docs = "thongTinTaiLieu"
    return _row(
        hits, "DAV Vietnam", "Vietnam", "AS", substance=F.coalesce(active, F.col("query")), product=product,
        company=field("congTyDangKy.tenCongTyDangKy"),
        status=F.when(F.coalesce(F.col("isDaRutSoDangKy"), F.lit(False)), "Withdrawn").otherwise("Registered"),
        strength=field("thongTinThuocCoBan.hamLuong"), dosage_form=field("thongTinThuocCoBan.dangBaoChe"),
        pack_size=field("thongTinThuocCoBan.dongGoi"), registration_number=field("soDangKy"),
        registration_date=tx.iso_date("thongTinDangKyThuoc.ngayCapSoDangKy"), expiry_date=tx.iso_date("thongTinDangKyThuoc.ngayHetHanSoDangKy"),
        manufacturer_name=field("congTySanXuat.tenCongTySanXuat"), manufacturer_country=field("congTySanXuat.nuocSanXuat"),
        pil_url=first_attachment(F.col(f"{docs}.urlHuongDanSuDung")),
        label_url=F.coalesce(first_attachment(F.col(f"{docs}.urlNhan")), first_attachment(F.col(f"{docs}.urlNhanVaHDSD"))),
        source_url=root, product_url=page, url=page,
    )


# Cell positions of registers that list rows without a usable header.
POSITIONAL = {
    "NPRA Malaysia": {"cells": 4, "registration_number": 1, "product": 2, "company": 3, "status": "Registered"},
    "Hong Kong Drug Office": {"cells": 5, "product": 1, "company": 2, "registration_number": 3, "substance": 4, "status": "Registered"},
    "GRLS Russia": {
        "cells": 11, "product": 1, "active_substance": 2, "dosage_form": 3, "company": 4, "manufacturer_name": 4,
        "manufacturer_country": 5, "registration_number": 6, "registration_date": 7, "expiry_date": 8, "status_cell": 10,
        "status": "Registered in GRLS",
    },
}


def map_positional(df: DataFrame, source: str) -> DataFrame:
    """Rows of ``cells`` (array of text) by fixed position; the first cell is a number.

    ``df``: (query, ord, term, cells, page_url). Registers that list the substance are checked for the
    searched term. Keep-first on product, registration number and, for one register, the substance.
    """
    spec = POSITIONAL[source]
    register = {r[0]: r for r in dims.REGIONAL_REGISTERS}[source]
    rows = df.filter((F.size("cells") >= spec["cells"]) & F.rlike(F.get("cells", F.lit(0)), F.lit(r"^\d+$")))

    def cell(name: str) -> Column:
        return collapse_ws(F.get("cells", F.lit(spec[name]))) if name in spec else F.lit(None).cast("string")

    listed = cell("substance") if "substance" in spec else cell("active_substance")
    if source == "NPRA Malaysia":
        rows = rows.filter(cell("product").isNotNull() & cell("registration_number").isNotNull())
    else:
        hay = F.lower(F.concat_ws(" ", text(cell("product")), text(listed)))
        rows = rows.filter(F.contains(hay, F.lower(F.col("term") if "term" in df.columns else F.col("query"))))
    own = {n: cell(n) for n in spec if n not in ("cells", "status", "status_cell", "substance")}
    mapped = _row(
        rows, source, register[1], register[2], name=cell("product"),
        substance=F.coalesce(cell("substance"), F.col("query")), status=F.coalesce(cell("status_cell"), F.lit(spec["status"])),
        source_url=opt(df, "page_url"), product_url=opt(df, "page_url"), url=opt(df, "page_url"), **own,
    )
    keys = [F.col("query"), F.lower(text("product")), F.lower(text(opt(mapped, "active_substance"))), F.lower(text("registration_number"))]
    return keep_first(mapped, keys)


# Words that identify the columns of a register's table.
HEADER_WORDS = {
    "regional": {
        "product": ["product", "trade", "brand", "medicine", "drug", "name"],
        "substance": ["substance", "ingredient", "generic", "scientific"],
        "company": ["company", "holder", "sponsor", "manufacturer", "applicant"],
        "status": ["status", "legal", "registration"],
        "registration_number": ["registration", "reg no", "certificate", "license"],
        "dosage_form": ["dosage", "form"],
    },
    "nz": {
        "substance": ["ingredient", "active"], "product": ["trade", "product", "medicine"],
        "company": ["sponsor", "applicant", "company"], "status": ["status", "situation"],
        "classification": ["classification"], "registration_date": ["approval", "consent"],
    },
}
MRI_NAMES = {
    "product": ["full name", "product", "product name", "description", "name"],
    "substance": ["active substance", "substance"],
    "company": ["mah owner", "mah", "marketing authorisation holder", "holder"],
    "status": ["authorisation status", "status"],
    "dosage_form": ["pharmaceutical form", "authorised dose form"],
    "pack_size": ["pack size"],
    "registration_number": ["ma nr", "ma number", "mrp dcp cp nr", "procedure number"],
    "atc_code": ["atc code"],
    "_country": ["authorisation country", "country", "cms", "rms", "member state"],
}


def _exploded_rows(pages: DataFrame) -> DataFrame:
    """One row per table row of every page, in page order: header, cells and an ``ord`` within the run."""
    kept = [c for c in ("query", "query_id", "ord", "page_url") if c in pages.columns]
    per_table = pages.select(*kept, F.posexplode(lf.tables("html")).alias("_t", "_table"))
    per_row = per_table.select(*kept, "_t", "_table.has_form", "_table.header", F.posexplode("_table.rows").alias("_r", "cells"))
    place = F.struct(F.col("ord").alias("page"), F.col("_t").alias("table_no"), F.col("_r").alias("row_no"))
    return per_row.withColumn("place", place)


def _first_header(words: list[str]) -> Column:
    """Position of the first header that contains any of the words."""
    hit = F.transform("_low", lambda h: any_of([F.contains(h, F.lit(w)) for w in words]))
    return let(F.array_position(hit, True), lambda n: F.when(n > 0, (n - 1).cast("int")))


def map_header_table(pages: DataFrame, source: str, kind: str = "regional") -> DataFrame:
    """Rows of a page's tables, their columns found by words in the header.

    ``pages``: (query, ord, html, page_url). Rows whose product and substance do not contain the query
    are dropped; the first row per (product, number or holder, link) stays.
    """
    words = HEADER_WORDS[kind]
    rows = _exploded_rows(pages).withColumn("_low", F.transform("header", F.lower))
    rows = rows.withColumns({f"_i_{role}": _first_header(w) for role, w in words.items()})
    rows = rows.filter(F.col("_i_product").isNotNull() | F.col("_i_substance").isNotNull())
    if kind == "regional":
        rows = rows.filter(~F.col("has_form"))
        register = {r[0]: r for r in dims.REGIONAL_REGISTERS}[source]
        country, region, base = register[1], register[2], register[3]
        listed = "Listed by regulator source"
    else:
        country, region, base, listed = "New Zealand", "NZ", dims.COUNTRY_SEARCH_URL["New Zealand"], "Listed by Medsafe"

    def cell(role: str) -> Column:
        return nz(F.get("cells", F.col(f"_i_{role}"))["label"]) if role in words else F.lit(None).cast("string")

    link = tx.absolute_url(base, F.get("cells", F.col("_i_product"))["href"])
    staged = rows.withColumns({
        "_product": F.coalesce(cell("product"), cell("substance")), "_active": cell("substance"),
        "_url": F.coalesce(link, F.col("page_url")),
    })
    hay = F.lower(F.concat_ws(" ", text("_product"), text("_active")))
    wanted = F.col("_product").isNotNull() & F.contains(hay, F.lower(F.trim("query")))
    hits = filter_computed(staged, wanted)
    status = F.coalesce(cell("status"), F.lit(listed))
    active = F.col("_active")
    if kind == "nz":
        status = F.concat_ws(" - ", status, cell("classification"))
        active = F.coalesce(active, F.col("query"))
    mapped = _row(
        hits, source, country, region, name=F.col("_product"), keep=("place",), substance=active, product=F.col("_product"),
        company=cell("company"), status=status, dosage_form=cell("dosage_form"), registration_number=cell("registration_number"),
        registration_date=cell("registration_date"), source_url=F.col("page_url"), product_url=F.col("_url"), url=F.col("_url"),
    )
    third = "registration_number" if kind == "regional" else "company"
    keys = [F.col("query"), F.col("ord"), F.lower("product"), F.lower(text(third)), F.lower(text("product_url"))]
    return keep_first(mapped, keys, "place")


def mri_country(c: Column) -> Column:
    """Exact EU name, else the first EU name contained, else the text, else "European Union"."""
    def over(value: Column) -> Column:
        inside = F.filter(literal_list(dims.EU_COUNTRIES), lambda n: F.contains(F.lower(value), F.lower(n)))
        return F.when(dims.one_of(value, dims.EU_COUNTRIES), value).otherwise(
            F.coalesce(F.get(inside, F.lit(0)), F.nullif(value, F.lit("")), F.lit("European Union"))
        )

    return let(text(c), over)


def map_mri(pages: DataFrame) -> DataFrame:
    """M12/M13 for the EU index: named columns, an exact heading before a heading that contains the name."""
    rows = _exploded_rows(pages)
    keys = F.transform("header", lambda h: F.trim(F.translate(F.lower(h), "/-().", "     ")))
    rows = rows.withColumn("_keys", keys).filter(F.size("cells") >= 2)
    cells = F.filter(
        F.arrays_zip(F.slice("_keys", F.lit(1), F.size("cells")).alias("k"), F.transform("cells", lambda x: x["label"]).alias("v")),
        lambda x: (F.coalesce(x["k"], F.lit("")) != ""),
    )
    rows = rows.withColumn("_named", cells)

    def value(role: str) -> Column:
        names = MRI_NAMES[role]

        def pick(test) -> list[Column]:
            return [F.get(F.filter("_named", lambda x: test(x["k"], n) & (x["v"] != "")), F.lit(0))["v"] for n in names]

        exact = pick(lambda k, n: k == F.lit(n))
        loose = F.get(
            F.filter("_named", lambda x: any_of([F.contains(x["k"], F.lit(n)) for n in names]) & (x["v"] != "")), F.lit(0)
        )["v"]
        return F.coalesce(*exact, loose)

    staged = rows.withColumns({f"_v_{r.strip('_')}": value(r) for r in MRI_NAMES})
    hay = F.lower(F.concat_ws(" ", text("_v_product"), text("_v_substance")))
    hits = filter_computed(staged, F.contains(hay, F.lower("query")))
    hrefs = F.filter(F.transform("cells", lambda x: x["href"]), lambda h: h.isNotNull())
    link = F.coalesce(tx.absolute_url(F.col("page_url"), F.get(hrefs, F.lit(0))), F.col("page_url"))
    mapped = _row(
        hits.withColumn("_link", link), "EU MRI Product Index", mri_country(F.col("_v_country")), "EU", name=F.col("_v_product"), keep=("place",),
        substance=F.coalesce(F.col("_v_substance"), F.col("query")), product=F.col("_v_product"), company=F.col("_v_company"),
        status=F.coalesce(F.col("_v_status"), F.lit("Authorised via MRI/MRP/DCP")), dosage_form=F.col("_v_dosage_form"),
        pack_size=F.col("_v_pack_size"), registration_number=F.col("_v_registration_number"), atc_code=F.col("_v_atc_code"),
        source_url=F.col("page_url"), product_url=F.col("_link"), url=F.col("_link"), document_type="MRI Product Index",
    )
    return mapped


def _exploded_links(pages: DataFrame) -> DataFrame:
    kept = [c for c in ("query", "query_id", "ord", "page_url") if c in pages.columns]
    each = pages.select(*kept, F.posexplode(lf.anchors("html")).alias("_pos", "_a"))
    return each.select(*kept, F.struct(F.col("ord").alias("page"), F.col("_pos").alias("pos")).alias("place"), "_a.href", "_a.label")


def map_link_list(pages: DataFrame, source: str, table_rows: DataFrame | None = None) -> DataFrame:
    """Anchors whose text contains the query, first per (text, link); pages with table rows are left out."""
    register = {r[0]: r for r in dims.REGIONAL_REGISTERS}[source]
    if table_rows is not None:
        pages = pages.join(table_rows.select("ord").distinct(), "ord", "left_anti")
    links = _exploded_links(pages)
    hits = links.filter((F.col("label") != "") & F.contains(F.lower("label"), F.lower(F.trim("query"))))
    staged = hits.withColumn("_url", tx.absolute_url(register[3], F.col("href")))
    mapped = _row(
        staged, source, register[1], register[2], name=F.col("label"), keep=("place",), substance=F.col("query"),
        product=F.col("label"), status="Listed by regulator source", source_url=F.col("page_url"), product_url=F.col("_url"), url=F.col("_url"),
    )
    return keep_first(mapped, [F.col("query"), F.col("ord"), F.lower("product"), F.lower(text("url"))], "place")


def map_regional_pages(pages: DataFrame, source: str) -> DataFrame:
    """M12 then M14: table rows where a page yields any, else its links."""
    table_rows = map_header_table(pages, source)
    return table_rows.unionByName(map_link_list(pages, source, table_rows), allowMissingColumns=True)


def map_uk_html(pages: DataFrame) -> DataFrame:
    """Anchors with a registration number in their text."""
    links = _exploded_links(pages).withColumn("_text", tx.clean_product_name("label"))
    staged = links.withColumns({"_number": tx.extract_registration_number("_text"), "_url": tx.absolute_url(UK_BASE, F.col("href"))})
    hits = filter_computed(staged, F.col("_number").isNotNull())
    return hits.select(
        "query", "ord", "place", F.col("query").alias("substance"), F.col("_text").alias("product"),
        F.lit("United Kingdom").alias("country"), F.lit("UK").alias("region"), F.lit("Authorised").alias("status"),
        F.col("_number").alias("registration_number"), tx.document_type_of("_text").alias("document_type"),
        F.lit("MHRA").alias("source"), F.col("page_url").alias("source_url"), F.col("_url").alias("product_url"), F.col("_url").alias("url"),
    )


AU_BASE = "https://www.tga.gov.au"
# Labels of the Australian detail page.
AU_LABELS = {
    "product": ["Product name", "Name"], "company": ["Sponsor", "Sponsor name"],
    "manufacturer_name": ["Manufacturer", "Manufacturer name"], "substance": ["Active ingredient", "Active ingredients"],
    "dosage_form": ["Dosage form", "Form"], "route": ["Route of administration", "Route"],
    "registration_number": ["ARTG ID", "ARTG number", "AUST R", "AUST L"],
    "registration_date": ["Start date", "Effective date", "Registration date"],
}


def map_au_list(pages: DataFrame) -> DataFrame:
    """M16 (list): register anchors with the query in their title: ``Sponsor - Product (number)``."""
    links = _exploded_links(pages).filter(F.contains("href", F.lit("/resources/artg/")))
    staged = links.withColumns({"_title": clean_block("label", " :-"), "_url": tx.absolute_url(AU_BASE, F.col("href"))})
    hits = filter_computed(staged, F.col("_title").isNotNull() & F.contains(F.lower("_title"), F.lower("query")))
    first = keep_first(hits, [F.col("query"), F.col("ord"), F.col("_url")], "place")
    bare = F.regexp_replace("_title", r"\s*\(\d{4,}\)\s*$", "")
    has = F.contains(bare, F.lit(" - "))
    product = F.coalesce(F.when(has, clean_block(F.regexp_extract(bare, r"^.*? - (.*)$", 1), " :-")).otherwise(nz(bare)), F.col("_title"))
    ready = first.withColumn("_product", product)
    return _row(
        ready, "TGA Australia", "Australia", "AU", name=F.col("_product"), keep=("place",), substance=F.col("query"), product=F.col("_product"),
        company=F.when(has, clean_block(F.substring_index(bare, " - ", 1), " :-")), status="Included on ARTG",
        registration_number=tx.extract("_title", r"\((\d{4,})\)\s*$", 1), source_url=F.col("page_url"), product_url=F.col("_url"), url=F.col("_url"),
    )


def _without_tags(html: Column | str) -> Column:
    """Text of a page, a line end for each run of tags."""
    value = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(value, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return lf.unescape(F.regexp_replace(bare, r"(?s)(?:<[^>]+>)++", "\n"))


def map_au_detail(pages: DataFrame) -> DataFrame:
    """M16 (detail): eight labelled fields and two document links per page: (product_url, …)."""
    staged = pages.withColumns({"_lines": lf.joined_lines(_without_tags("html"), " :-"), "_links": lf.doc_links("html", AU_BASE, "au")})
    fields = [lf.text_after_label_line(F.col("_lines"), labels).alias(name) for name, labels in AU_LABELS.items()]
    return staged.select(F.col("page_url").alias("product_url"), *fields, "_links.smpc_url", "_links.pil_url")


def map_text_windows(docs: DataFrame, source: str = "CDSCO India", radius: int = 420) -> DataFrame:
    """Surroundings of every hit of the query in a document, each once per document.

    ``docs``: (query, ord, text, and optionally title, release_date, doc_url). Hits are found by
    splitting the lower-case text at the query; the offsets are running sums over the pieces.
    """
    register = {r[0]: r for r in dims.REGIONAL_REGISTERS}[source]
    hits = docs.filter(F.contains(F.lower("text"), F.lower("query")) & (F.col("query") != ""))
    size = F.length("query")
    quoted = F.concat(F.lit("\\Q"), F.lower("query"), F.lit("\\E"))
    pieces = F.split(F.lower("text"), quoted, -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    offsets = F.aggregate(
        lengths, start,
        lambda acc, n: F.struct((acc["at"] + n + size).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + n)).alias("starts")),
    )["starts"]
    window = F.transform(
        offsets,
        lambda o: collapse_ws(F.substring("text", F.greatest(o - radius, F.lit(0)) + 1, o + size + radius - F.greatest(o - radius, F.lit(0)))),
    )
    # repeats go inside the row of their document, so that no window is shuffled: places in order of text, and then of the document
    placed = F.transform(window, lambda s, i: F.struct(F.lower(s).alias("low"), i.alias("pos"), s.alias("snippet")))
    in_order = F.array_sort(F.filter(placed, lambda x: x["snippet"].isNotNull()))
    own = let(in_order, lambda w: F.filter(w, lambda x, i: (i == 0) | (x["low"] != F.get(w, i - 1)["low"])))
    once = hits.select("*", F.explode(own).alias("_w")).select("*", "_w.pos", "_w.snippet").drop("_w")
    # only documents that come in several rows can repeat each other's windows
    several = stage(hits.groupBy("query", "ord").count().filter("count > 1").select(F.struct("query", "ord").alias("_several")), "several-rows")
    repeated = F.struct("query", "ord") == F.col("_several")
    shared = keep_first(once.join(several, repeated, "left_semi"), [F.col("query"), F.col("ord"), F.lower("snippet")], "pos")
    first = once.join(several, repeated, "left_anti").unionByName(shared)
    return _row(
        first, source, register[1], register[2], name=F.col("snippet"), keep=("pos",), substance=F.col("query"), product=F.col("snippet"),
        status="Listed in CDSCO approval PDF", registration_date=opt(docs, "release_date"), document_type="CDSCO approval PDF",
        source_url=register[3], product_url=opt(docs, "doc_url"), url=opt(docs, "doc_url"),
    )


def handoff_row(queries: DataFrame, source: str, results: DataFrame | None = None) -> DataFrame:
    """A registry link for every query without a result of the source."""
    special = {
        "TGA Australia": ("Australia", "AU", "ARTG lookup for {q}", "Open official TGA ARTG registry - direct live parser unavailable or no exact match",
                          "https://www.tga.gov.au/resources/artg?keywords={raw}"),
        "Medsafe New Zealand": ("New Zealand", "NZ", "{q} official New Zealand registry search",
                                "Open official Medsafe registry - direct live parser unavailable or no exact match", "https://www.medsafe.govt.nz/DbSearch/?ingredient={enc}"),
        "EU MRI Product Index": ("European Union", "EU", "{q} official EU MRI Product Index search",
                                 "Open official EU MRI Product Index - service unavailable or JavaScript search requires browser parsing",
                                 "https://mri-production.cts-mrp.eu/product-search?search={enc}"),
    }
    if source in special:
        country, region, product, status, url = special[source]
    else:
        _, country, region, url = {r[0]: r for r in dims.REGIONAL_REGISTERS}[source]
        product = f"{{q}} official {country} registry search"
        status = f"Open official {source} registry - direct live parser unavailable or no exact match"
        if source == "NMPA China":
            status = "Official NMPA China registry handoff - live product parser not implemented yet"
    asked = queries.withColumn("_q", nz("query")).filter("_q IS NOT NULL")
    if results is not None:
        asked = asked.join(results.select("query").distinct(), "query", "left_anti")
    q = F.col("_q")

    def filled(template: str) -> Column:
        out = F.lit(template)
        for name, value in (("{q}", q), ("{raw}", q), ("{enc}", tx.percent_encode(q))):
            if name in template:
                out = F.replace(out, F.lit(name), value)
        return out

    link = filled(url)
    return _row(
        asked, source, country, region, name=q, substance=q, product=filled(product), status=status, document_type=HANDOFF,
        source_url=link, product_url=link, url=link, connector_mode="manual_registry",
    )


def map_eu_page(pages: DataFrame) -> DataFrame:
    """A central product page: (page_url, title, text, links array) -> product row."""
    phrase = "contains the active substance"
    at = F.locate(phrase, F.col("text"))
    sentence = F.substring_index(F.substring("text", at, F.length("text")), ".", 1)

    def link(kind: str) -> Column:
        ok = F.filter("links", lambda u: F.contains(u, F.lit(kind)) & F.contains(u, F.lit("_en.pdf")))
        return F.try_element_at(ok, F.lit(-1))

    t = F.col("text")
    return pages.select(
        "ord", F.when(at > 0, nz(F.replace(sentence, F.lit(phrase), F.lit("")))).alias("substance"),
        nz(F.substring_index("title", "|", 1)).alias("product"), lf.after_phrase_line(t, "Marketing authorisation holder").alias("company"),
        F.lit("European Union").alias("country"), F.lit("EU").alias("region"),
        F.when(F.contains(t, F.lit("This medicine is authorised for use in the European Union")), "Authorised").alias("status"),
        lf.after_phrase_line(t, "Anatomical therapeutic chemical (ATC) code").alias("atc_code"),
        lf.after_phrase_line(t, "Marketing authorisation issued").alias("registration_date"),
        link("product-information").alias("smpc_url"), link("package-leaflet").alias("pil_url"), link("assessment-report").alias("assessment_report_url"),
        F.lit("EMA").alias("source"), F.col("page_url").alias("product_url"), F.col("page_url").alias("source_url"),
    )


def map_uk_page(pages: DataFrame) -> DataFrame:
    """A UK product page: the "Active substances:" line and the title."""
    line = F.regexp_extract("text", r"(?m)^(.*Active substances:.*)$", 1)
    return pages.select(
        "ord", nz(F.replace(line, F.lit("Active substances:"), F.lit(""))).alias("substance"), nz("title").alias("product"),
        F.lit("United Kingdom").alias("country"), F.lit("Authorised").alias("status"), F.col("page_url").alias("product_url"),
        F.lit("MHRA").alias("source"),
    )


def detail_by_key_text(c: Column | str) -> tuple[Column, Column]:
    """(registration date, status) of a Hong Kong detail page's text."""
    date = collapse_ws(tx.extract(c, r"(?i)Date of Registration[#\s:]*\n?\s*([^\n]+)", 1))
    kind = collapse_ws(tx.extract(c, r"(?i)Legal Classification\s*:\s*\n?\s*([^\n]+)", 1))
    return date, F.concat(F.lit("Registered - "), kind)


