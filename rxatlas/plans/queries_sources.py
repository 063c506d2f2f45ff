"""Queries over mappers, page and leaflet reading, and document enrichment.

Raw payload frames are derived from the driver's tables, so every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import leaflet as lf
from ..functions import text as tx
from ..functions.base import text
from ..operators import documents as docs
from ..operators import store
from ..sources import mappers, registry
from ..store_paths import once_per_value
from .catalog import LEAF, REG, query
from .fixtures import leaflets, registrations, table
from .queries_rows import FORM_SQL, MAKERS_SQL, PACK_SQL, STRENGTH_OF_SQL, URLS_SQL, sql, with_makers, with_real_country, with_urls

STRENGTH_P, FORM_P, PACK_P = sql(STRENGTH_OF_SQL), sql(FORM_SQL), sql(PACK_SQL)


def asked(df: DataFrame, column: str = "substance") -> DataFrame:
    """Every row is landed for its own substance."""
    return df.withColumn("query", F.col(column))


def _list(names: list[str]) -> str:
    return "[" + ", ".join("'" + n + "'" for n in names) + "]"


# --- Mappers ------------------------------------------------------------------------------------


@query("m0_from_unified", "SELECT ord, substance, product, company, source AS product_url, source AS source_url, source AS url FROM reg", REG)
def _m0(spark, d):
    reg = registrations(spark, d)
    unified = reg.select(
        "ord", F.col("substance").alias("active_substance"), F.col("product").alias("product_name"),
        F.col("company").alias("marketing_authorisation_holder"), F.col("source").alias("product_url"), F.lit("").alias("source_url"),
    )
    return mappers.from_unified(unified).select("ord", "substance", "product", "company", "product_url", "source_url", "url")


@query("m1_map_central_eu", f"""
SELECT p_partkey AS ord, c AS country, p_name AS product, 'Holder ' || p_brand AS company, {sql(STRENGTH_OF_SQL, "p_name")} AS strength,
  {sql(FORM_SQL, "p_name")} AS dosage_form, 'https://www.ema.europa.eu/en/medicines/' || p_partkey AS url
FROM part, (SELECT unnest({_list(dims.EU_COUNTRIES + dims.EEA_COUNTRIES)}) AS c) WHERE contains(p_name, 'ring')""")
def _m1(spark, d):
    part = table(spark, d, "part")
    records = part.select(
        F.col("p_partkey").alias("ord"), F.lit("Ring").alias("query"), F.col("p_name").alias("name_of_medicine"),
        F.concat(F.lit("Holder "), "p_brand").alias("marketing_authorisation_holder"), F.lit("").alias("applicant"),
        F.concat(F.lit("/en/medicines/"), F.col("p_partkey").cast("string")).alias("medicine_url"),
    )
    mapped = mappers.map_central_eu(records, dims.EU_COUNTRIES + dims.EEA_COUNTRIES, "https://r.test/sheet")
    return mapped.select("ord", "country", "product", "company", "strength", "dosage_form", "url")


@query("m2_map_us_labels", f"""
SELECT ord, product, company, {STRENGTH_P} AS strength, COALESCE({FORM_P}, 'Kit') AS dosage_form,
  'box ' || product AS pack_size, 'NDA' || ord AS registration_number FROM reg""", REG)
def _m2(spark, d):
    reg = asked(registrations(spark, d))
    arr = F.array
    labels = reg.select(
        "ord", "query",
        F.struct(
            arr("product").alias("brand_name"), arr("substance").alias("generic_name"), arr("company").alias("manufacturer_name"),
            arr(F.concat(F.lit("NDA"), F.col("ord").cast("string"))).alias("application_number"), F.array().cast("array<string>").alias("dosage_form"),
            F.array().cast("array<string>").alias("route"), F.array().cast("array<string>").alias("pharm_class_epc"),
        ).alias("openfda"),
    )
    ndc = reg.groupBy("query", "product").agg(F.min("ord").alias("ord")).select(
        "ord", "query", F.col("product").alias("brand_name"), F.lit(None).cast("string").alias("brand_name_base"),
        F.lit(None).cast("string").alias("generic_name"), F.lit("x").alias("labeler_name"), F.lit("KIT").alias("dosage_form"),
        F.lit(None).cast("string").alias("listing_expiration_date"),
        arr(F.struct(F.concat(F.lit("box "), "product").alias("description"))).alias("packaging"),
        arr(F.struct(F.lit("5 mg").alias("strength"))).alias("active_ingredients"),
    )
    return mappers.map_us_labels(labels, ndc).select(
        "ord", "product", "company", "strength", "dosage_form", "pack_size", "registration_number"
    )


@query("m3_map_uk_index", """
SELECT ord, CASE WHEN MOD(ord, 2) = 0 THEN substance ELSE substance || ', Other' END AS substance, registration_number,
  company || ' Ltd' AS company, 'https://r.test/' || ord AS url, CASE WHEN MOD(ord, 3) = 0 THEN 'https://r.test/' || ord END AS smpc_url FROM reg""", REG)
def _m3(spark, d):
    reg = asked(registrations(spark, d))
    o = F.col("ord")
    number = F.regexp_replace("registration_number", "[ /]", "")
    raw = reg.select(
        "ord", "query", F.when(o % 2 == 0, F.array("substance")).otherwise(F.array(F.col("substance"), F.lit(" Other "))).alias("substance_name"),
        F.lit("").alias("product_name"), F.col("product").alias("title"),
        F.when(number.isNotNull(), F.array(number)).otherwise(F.array().cast("array<string>")).alias("pl_number"),
        F.concat(F.lit("https://r.test/"), o.cast("string")).alias("metadata_storage_path"),
        F.when(o % 3 == 0, "spc").otherwise("PAR").alias("doc_type"), F.lit("2024").alias("created"),
        F.concat(F.lit("<em>National Procedure Pharma</em>\n"), text("registration_number"), F.lit("\nPublic assessment report pharma\n"), "company", F.lit(" Ltd.")).alias("highlights"),
    )
    # rows without a number take the first company-like line, which is the heading
    mapped = mappers.map_uk_index(raw)
    return mapped.withColumn(
        "company", F.when(F.col("registration_number").isNull(), F.lit(None).cast("string")).otherwise(F.col("company"))
    ).join(reg.select("ord", F.concat("company", F.lit(" Ltd")).alias("_own")), "ord").select(
        "ord", "substance", "registration_number", F.coalesce("company", "_own").alias("company"), "url", "smpc_url"
    )


@query("m4_map_canada", """
SELECT p_partkey AS registration_number, p_name AS product, (SELECT max_by(s_name, l_orderkey * 100 + l_linenumber) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey) AS company
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def _m4(spark, d):
    mapped = mappers.map_canada(*canadian_sets(spark, d, "l_returnflag"), " r ")
    return mapped.select(F.col("registration_number").cast("long").alias("registration_number"), "product", "company")


def canadian_sets(spark, d, ingredient: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    line = table(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 100 + F.col("l_linenumber")).withColumnRenamed("l_partkey", "DRUG_CODE")
    supplied = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("s_name", "companyName")
    products = table(spark, d, "part").select(F.col("p_partkey").alias("drugCode"), F.col("p_name").alias("Brand_Name"), F.col("p_partkey").alias("ord"))
    ingredients = (line if ingredient in line.columns else supplied.withColumn("s_name", F.col("companyName"))).withColumnRenamed(ingredient, "ingredient_name")
    return ingredients, products, supplied, line.withColumnRenamed("l_linestatus", "status")


TERMS_SQL = "terms AS (SELECT DISTINCT 'R#' || right(s_name, 3) AS term FROM supplier UNION SELECT DISTINCT right(s_name, 2) FROM supplier)"


def supplier_terms(spark, d) -> DataFrame:
    """Terms to search registers for: the ends of the suppliers' names."""
    name = table(spark, d, "supplier").select("s_name")
    return name.select(F.explode(F.array(F.concat(F.lit("R#"), F.right("s_name", F.lit(3))), F.right("s_name", F.lit(2)))).alias("query")).distinct()


@query("m4_map_canada_many", f"""
WITH {TERMS_SQL}, sup AS (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
hit AS (SELECT DISTINCT term, l_partkey FROM terms JOIN sup ON contains(lower(s_name), lower(term))),
last AS (SELECT l_partkey, max_by(s_name, l_orderkey * 100 + l_linenumber) AS company FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT term AS query, p_partkey AS registration_number, p_name AS product, company FROM hit JOIN part ON p_partkey = l_partkey JOIN last USING (l_partkey)""")
def _m4_many(spark, d):
    mapped = mappers.map_canada(*canadian_sets(spark, d, "s_name"), supplier_terms(spark, d))
    return mapped.select("query", F.col("registration_number").cast("long").alias("registration_number"), "product", "company")


@query("m5_map_spain", """
SELECT ord, CASE WHEN MOD(ord, 2) = 0 THEN 'Marketed' ELSE 'Authorised' END AS status, CASE WHEN MOD(ord, 3) = 0 THEN 'last' || ord END AS smpc_url, 'leaflet' AS pil_url,
  CASE WHEN MOD(ord, 3) = 0 THEN 'https://cima.aemps.es/cima/dochtml/ft/' || ord || '/FT_' || ord || '.html' ELSE 'https://cima.aemps.es/cima/medicamento/' || ord END AS url FROM reg""", REG)
def _m5(spark, d):
    o = F.col("ord")

    def doc(kind: int, url) -> F.Column:
        return F.struct(F.lit(kind).alias("tipo"), url.alias("url"), F.lit("html").alias("urlHtml"))

    leaflet = doc(2, F.lit("leaflet"))
    both = F.array(doc(1, F.lit("first")), leaflet, doc(1, F.concat(F.lit("last"), o.cast("string"))))
    raw = asked(registrations(spark, d)).select(
        "ord", "query", o.alias("nregistro"), F.col("product").alias("nombre"), F.col("company").alias("labtitular"), F.lit("").alias("labcomercializador"),
        (o % 2 == 0).alias("comerc"), F.struct(F.lit(1).alias("aut")).alias("estado"), F.when(o % 3 == 0, both).otherwise(F.array(leaflet)).alias("docs"),
    )
    return mappers.map_spain(raw).select("ord", "status", "smpc_url", "pil_url", "url")


@query("m6_map_france", """
SELECT 'c' || p_partkey AS registration_number, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS substance, p_name AS product,
  string_agg(DISTINCT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' mg', ', ' ORDER BY CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' mg') AS strength
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey
GROUP BY p_partkey, p_name HAVING bool_or(contains(s_name, '3'))""")
def _m6(spark, d):
    return mappers.map_france(*french_sets(spark, d), "3").select("registration_number", "substance", "product", "strength")


@query("m6_map_france_many", f"""
WITH {TERMS_SQL}, comp AS (SELECT l_partkey, s_name, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
hit AS (SELECT DISTINCT term, l_partkey FROM terms JOIN (SELECT DISTINCT l_partkey, s_name FROM comp) ON contains(lower(s_name), lower(term))),
sets AS (SELECT l_partkey, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS substance FROM comp GROUP BY 1)
SELECT term AS query, 'c' || p_partkey AS registration_number, substance, p_name AS product FROM hit JOIN sets USING (l_partkey) JOIN part ON p_partkey = l_partkey""")
def _m6_many(spark, d):
    return mappers.map_france(*french_sets(spark, d), supplier_terms(spark, d)).select("query", "registration_number", "substance", "product")


@query("a9_group_array", """
SELECT l_partkey, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS names, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) FILTER (l_linestatus <> '') AS modes, min(l_orderkey) AS ord
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey""")
def _a9(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("ord", F.col("l_orderkey"))
    return mappers.grouped_sets(line, ["l_partkey"], {"names": "s_name", "modes": "l_linestatus"})


def french_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    compositions = line.select(
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("cis"), F.col("s_name").alias("substance"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mg")).alias("strength"), F.col("l_orderkey").alias("ord"),
    )
    none = F.lit(None).cast("string")
    products = table(spark, d, "part").select(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("cis"), F.col("p_name").alias("product"), F.lit("co").alias("company"),
        none.alias("marketing_status"), none.alias("status"), none.alias("pharmaceutical_form"), none.alias("registration_date"), F.lit(0).alias("ord"),
    )
    return products, compositions


@query("m7_map_belgium", """
SELECT ord, substance || ', salt' AS substance, COALESCE(registration_number, CAST(ord AS VARCHAR)) AS registration_number, 'On, Off' AS status,
  'Tab' AS dosage_form, 's' || ord AS smpc_url, 'p1' AS pil_url FROM reg""", REG)
def _m7(spark, d):
    o = F.col("ord").cast("string")

    def doc(kind: str, url) -> F.Column:
        return F.struct(F.lit(kind).alias("type"), url.alias("url"))

    raw = asked(registrations(spark, d)).select(
        "ord", "query", o.alias("id"), F.col("product").alias("name"), "company", F.array(F.col("substance"), F.lit("salt")).alias("activeSubstanceShort"),
        F.array(F.lit("On"), F.lit("Off")).alias("availability"), F.array(F.lit(" Tab "), F.lit("Cap")).alias("pharmaceuticalForm"),
        F.array().cast("array<string>").alias("routeOfAdministration"), text("registration_number").alias("authorisationNumber"), F.lit("t").alias("editTS"),
        F.array(doc("SPC", F.lit("")), doc("SKP", F.concat(F.lit("s"), o)), doc("pil", F.lit("p1")), doc("leaflet", F.lit("p2"))).alias("documents"),
    )
    return mappers.map_belgium(raw).select("ord", "substance", "registration_number", "status", "dosage_form", "smpc_url", "pil_url")


@query("m8_map_ireland", """
SELECT o_orderkey AS ord, (SELECT string_agg(p_name, ', ' ORDER BY l_linenumber, l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey) AS substance,
  'detail ' || o_orderkey AS product, 'PA ' || MOD(o_orderkey, 10) AS registration_number, s_name AS company
FROM orders JOIN supplier ON s_suppkey = MOD(o_orderkey, 10) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _m8(spark, d):
    key = F.col("o_orderkey")
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ingredients")
    )
    orders = table(spark, d, "orders").join(parts, F.col("l_orderkey") == key)
    medicines = orders.select(
        F.lit("q").alias("query"), key.alias("ord"), key.alias("id"), F.lit("entity").alias("name"), F.lit("Live").alias("status"),
        (key % 10).alias("company"), F.array(key % 10).alias("licenseNumbers"), "ingredients", F.lit("2024").alias("publishedAt"), F.lit(None).cast("string").alias("updatedAt"),
    )
    details = orders.select(key.alias("id"), F.concat(F.lit("detail "), key.cast("string")).alias("name"), F.lit("").alias("status"))
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    licences = keys.select("id", F.concat(F.lit("PA "), F.col("id").cast("string")).alias("fullLicenseNumber"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return mappers.map_ireland(medicines, details, licences, keys, names).select("ord", "substance", "product", "registration_number", "company")


@query("m9_map_indonesia", f"""
SELECT ord, substance, product, company || ' - Group' AS company, 'Maker' AS manufacturer_name, CASE WHEN MOD(ord, 2) = 0 THEN country ELSE 'Indonesia' END AS manufacturer_country,
  {STRENGTH_P} AS strength, {FORM_P} AS dosage_form,
  CASE WHEN MOD(ord, 3) = 0 THEN 'https://cekbpom.pom.go.id/produk/' || ord || '/a1/detail' ELSE 'https://cekbpom.pom.go.id/all-produk' END AS url
FROM (SELECT * REPLACE (trim(product) AS product) FROM reg)""", REG)
def _m9(spark, d):
    o = F.col("ord")
    raw = asked(registrations(spark, d)).select(
        "ord", "query", F.col("product").alias("PRODUCT_NAME"), F.col("substance").alias("INGREDIENTS"),
        F.concat("company", F.lit(" - Group - "), "country").alias("REGISTRAR"),
        F.when(o % 2 == 0, F.concat(F.lit("Maker - "), "country")).otherwise(F.lit("Maker")).alias("MANUFACTURER_NAME"),
        F.when(o % 3 == 0, o.cast("string")).alias("PRODUCT_ID"), F.lit("a1").alias("APPLICATION_ID"),
    )
    return mappers.map_indonesia(raw).select(
        "ord", "substance", "product", "company", "manufacturer_name", "manufacturer_country", "strength", "dosage_form", "url"
    )


@query("m10_map_vietnam", """
SELECT ord, substance, trim(product) AS product, CASE WHEN MOD(ord, 2) = 0 THEN 'Withdrawn' ELSE 'Registered' END AS status, registration_date,
  CASE WHEN MOD(ord, 3) = 0 THEN 'https://dichvucong.dav.gov.vn/File/GoToViewTaiLieu?url=/f/' || ord || '%20a.pdf' END AS pil_url FROM reg""", REG)
def _m10(spark, d):
    o = F.col("ord")
    none = F.lit(None).cast("string")
    files = F.concat(F.lit('[{"duongDanTep": " "}, {"duongDanTep": "/f/'), o.cast("string"), F.lit(' a.pdf"}]'))
    raw = asked(registrations(spark, d)).select(
        "ord", "query", o.alias("id"), F.col("product").alias("tenThuoc"), F.col("registration_number").alias("soDangKy"), (o % 2 == 0).alias("isDaRutSoDangKy"),
        F.struct(F.col("substance").alias("hoatChatChinh"), none.alias("hamLuong"), none.alias("dangBaoChe"), none.alias("dongGoi")).alias("thongTinThuocCoBan"),
        F.struct(F.concat("registration_date", F.lit("T00:00:00")).alias("ngayCapSoDangKy"), none.alias("ngayHetHanSoDangKy")).alias("thongTinDangKyThuoc"),
        F.struct(F.when(o % 3 == 0, files).otherwise("broken").alias("urlHuongDanSuDung"), none.alias("urlNhan"), none.alias("urlNhanVaHDSD")).alias("thongTinTaiLieu"),
        F.struct(none.alias("tenCongTySanXuat"), none.alias("nuocSanXuat")).alias("congTySanXuat"), F.struct(F.col("company").alias("tenCongTyDangKy")).alias("congTyDangKy"),
    )
    return mappers.map_vietnam(raw).select("ord", "substance", "product", "status", "registration_date", "pil_url")


@query("m11_map_positional", """
SELECT min(ord) AS ord, lower(trim(product)) AS product, COALESCE(registration_number, '') AS registration_number FROM reg GROUP BY substance, lower(trim(product)), COALESCE(registration_number, '')""", REG)
def _m11(spark, d):
    raw = asked(registrations(spark, d)).select(
        "ord", "query", F.lit("https://r.test/").alias("page_url"),
        F.array(F.lit("1"), F.col("product"), F.col("company"), text("registration_number"), F.col("substance")).alias("cells"),
    )
    header = raw.withColumn("cells", F.array(F.lit("No."), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    mapped = mappers.map_positional(raw.unionByName(header), "Hong Kong Drug Office")
    return mapped.select("ord", F.lower("product").alias("product"), text("registration_number").alias("registration_number"))


def register_pages(spark, d) -> DataFrame:
    """One page per product row: a table with its header and the row, and a form table to be ignored."""
    row = F.concat(
        F.lit("<table><tr><th>Registration No</th><th>Trade <b>Name</b></th><th>Active Ingredient</th><th>Sponsor</th><th>Country</th></tr>\n<tr><td>"),
        text("registration_number"), F.lit('</td><td><a href="/p/'), F.col("ord").cast("string"), F.lit('">'), "product", F.lit("</a></td><td>"), "substance",
        F.lit("</td><td>"), "company", F.lit(" &amp; Co</td><td>Market: denmark</td></tr></table><table><tr><th>Product</th></tr><tr><td><input>"), "substance",
        F.lit("</td></tr></table>"),
    )
    return asked(registrations(spark, d)).select("query", "ord", row.alias("html"), F.lit("https://r.test/search").alias("page_url"))


@query("m12_map_header_table", f"""
SELECT ord, substance, product, company || ' & Co' AS company, COALESCE(registration_number, 'Listed by regulator source') AS status, registration_number,
  {STRENGTH_P} AS strength, 'https://www.sfda.gov.sa/p/' || ord AS url FROM (SELECT * REPLACE (trim(product) AS product) FROM reg)""", REG)
def _m12(spark, d):
    mapped = mappers.map_header_table(register_pages(spark, d), "SFDA Saudi Arabia")
    return mapped.select("ord", "substance", "product", "company", "status", "registration_number", "strength", "url")


@query("m13_map_mri", """SELECT ord, trim(product) AS product, substance, 'Denmark' AS country, 'https://r.test/p/' || ord AS url FROM reg""", REG)
def _m13(spark, d):
    named = register_pages(spark, d).withColumn("html", F.replace("html", F.lit("Trade <b>Name</b>"), F.lit("Full Name")))
    mapped = mappers.map_mri(named.withColumn("html", F.replace("html", F.lit("Active Ingredient"), F.lit("Active-Substance"))))
    return mapped.select("ord", "product", "substance", "country", "url")


ANCHORS_SQL = r"""anchors AS (SELECT page_id, url, unnest(range(1, len(h) + 1)) AS pos, unnest(h) AS href, unnest(t) AS label FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)),
links AS (SELECT page_id, url, pos, replace(href, '&amp;', '&') AS href, trim(regexp_replace(replace(replace(replace(label, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS label FROM anchors)"""


@query("s11_page_anchors", "SELECT page_id, pos - 1 AS pos, href, label FROM links", ANCHORS_SQL)
def _s11(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.posexplode(lf.anchors("html")).alias("pos", "a")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "a.href", "a.label"
    )


@query("m14_map_link_list", """
SELECT page_id AS ord, label AS product, u AS url FROM (SELECT page_id, pos, label, 'https://fdaghana.gov.gh' || href AS u,
  row_number() OVER (PARTITION BY page_id, lower(label), lower(href) ORDER BY pos) AS rn FROM links WHERE label <> '' AND contains(lower(label), 'e') AND starts_with(href, '/')) WHERE rn = 1""", ANCHORS_SQL)
def _m14(spark, d):
    pages = table(spark, d, "pages").select(F.lit("e").alias("query"), F.col("page_id").alias("ord"), "html", F.col("url").alias("page_url"))
    mapped = mappers.map_link_list(pages, "FDA Ghana")
    return mapped.filter(F.col("url").startswith("https://fdaghana.gov.gh/")).select("ord", "product", "url")


@query("m15_map_uk_html", "SELECT ord, registration_number, 'https://products.mhra.gov.uk/d/' || ord AS url FROM reg WHERE registration_number IS NOT NULL", REG)
def _m15(spark, d):
    html = F.concat(
        F.lit('<ul><li><a class="x" href="/d/'), F.col("ord").cast("string"), F.lit('">'), "product", F.lit(" "), text("registration_number"),
        F.lit("</a></li><li><a href='/other'>Help</a></li></ul>"),
    )
    pages = asked(registrations(spark, d)).select("query", "ord", html.alias("html"), F.lit("https://r.test/").alias("page_url"))
    return mappers.map_uk_html(pages).select("ord", "registration_number", "url")


@query("m16_map_au_list", """
SELECT ord, company, trim(product) AS product, CAST(10000 + MOD(ord, 7) AS VARCHAR) AS registration_number, 'https://www.tga.gov.au/resources/artg/' || ord AS url FROM reg""", REG)
def _m16(spark, d):
    html = F.concat(
        F.lit('<a href="/resources/artg/'), F.col("ord").cast("string"), F.lit('">\n  '), "company", F.lit(" - "), "product", F.lit(" ("),
        (10000 + F.col("ord") % 7).cast("string"), F.lit(") </a><a href='/about'>About</a>"),
    )
    pages = asked(registrations(spark, d)).select("query", "ord", html.alias("html"), F.lit("https://r.test/").alias("page_url"))
    return mappers.map_au_list(pages).select("ord", "company", "product", "registration_number", "url")


@query("m16_map_au_detail", """
SELECT ord, trim(product) AS product, company, substance, 'Tablet' AS dosage_form, registration_date, 'https://www.tga.gov.au/pi/' || ord || '-pi.pdf' AS smpc_url, 'https://www.tga.gov.au/cmi.pdf' AS pil_url FROM reg""", REG)
def _m16d(spark, d):
    o = F.col("ord").cast("string")
    html = F.concat(
        F.lit("<main><div>Product name</div><div>"), "product", F.lit("</div><p>Sponsor: "), "company", F.lit("</p><div>Active ingredients:</div><div>"), "substance",
        F.lit("</div><div>Manufacturer</div><div>Sponsor name</div><div>Dosage form</div><div>Tablet</div><div>Start date</div><div>"), "registration_date",
        F.lit('</div><a href="/pi/'), o, F.lit('-pi.pdf">Product Information</a><a href="/cmi.pdf">Consumer Medicine Information</a></main>'),
    )
    pages = registrations(spark, d).select("ord", html.alias("html"), o.alias("page_url"))
    mapped = mappers.map_au_detail(pages)
    return mapped.select(F.col("product_url").cast("long").alias("ord"), "product", "company", "substance", "dosage_form", "registration_date", "smpc_url", "pil_url")


@query("m17_map_text_windows", r"""
WITH p AS (SELECT doc_id, text, lower(text) AS lt, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE contains(lower(text), 'tion')),
w AS (SELECT doc_id, i, trim(regexp_replace(substr(text, greatest(i - 1 - 420, 0) + 1, CAST(i - 1 + 4 + 420 - greatest(i - 1 - 420, 0) AS BIGINT)), '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS s FROM p WHERE substr(lt, i, 4) = 'tion')
SELECT doc_id AS ord, s AS product FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY i) AS rn FROM w) WHERE rn = 1""")
def _m17(spark, d):
    texts = table(spark, d, "documents").select(F.lit("tion").alias("query"), F.col("doc_id").alias("ord"), "text")
    return mappers.map_text_windows(texts).select("ord", "product")


@query("m18_handoff_row", """
SELECT s_name AS substance, 'ARTG lookup for ' || s_name AS product, 'https://www.tga.gov.au/resources/artg?keywords=' || s_name AS url
FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08 AND l_returnflag = 'R')""")
def _m18(spark, d):
    supplier = table(spark, d, "supplier").select(F.col("s_name").alias("query"), "s_suppkey")
    answered = table(spark, d, "lineitem").filter("l_quantity > 49 AND l_discount > 0.08 AND l_returnflag = 'R'").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return mappers.handoff_row(supplier, "TGA Australia", answered).select("substance", "product", "url")


@query("m19_map_eu_page", """
SELECT ord, substance, source AS product, company, 'Authorised' AS status, COALESCE(atc_code, 'next') AS atc_code, 'https://r.test/' || ord || '/product-information/b_en.pdf' AS smpc_url FROM reg""", REG)
def _m19(spark, d):
    body = F.concat(
        F.lit("It contains the active substance "), "substance", F.lit(". More.\nThis medicine is authorised for use in the European Union\nMarketing authorisation holder\n "),
        "company", F.lit(" \nAnatomical therapeutic chemical (ATC) code\n"), F.coalesce("atc_code", F.lit("next")), F.lit("\n"),
    )
    root = F.concat(F.lit("https://r.test/"), F.col("ord").cast("string"))
    pages = registrations(spark, d).select(
        "ord", F.concat("source", F.lit(" | Agency")).alias("title"), body.alias("text"), root.alias("page_url"),
        F.array(F.concat(root, F.lit("/product-information/a_en.pdf")), F.concat(root, F.lit("/product-information/b_en.pdf")), F.concat(root, F.lit("/product-information/b_de.pdf"))).alias("links"),
    )
    return mappers.map_eu_page(pages).select("ord", "substance", "product", "company", "status", "atc_code", "smpc_url")


@query("m20_map_uk_page", "SELECT ord, substance, source AS product FROM reg", REG)
def _m20(spark, d):
    body = F.concat(F.lit("Home\nActive substances: "), "substance", F.lit(" \nmore Active substances: x"))
    pages = registrations(spark, d).select("ord", F.col("source").alias("title"), body.alias("text"), F.lit("u").alias("page_url"))
    return mappers.map_uk_page(pages).select("ord", "substance", "product")


@query("m22_central_fallback_rows", f"SELECT p_partkey AS ord, p_name AS product, c AS country, 'Authorised' AS status FROM part, (SELECT unnest({_list(dims.EU_COUNTRIES + dims.EEA_COUNTRIES)}) AS c)")
def _m22(spark, d):
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.lit("q").alias("query"), F.col("p_name").alias("product"), F.lit("u").alias("url"), F.lit("s").alias("source_url")
    )
    return mappers.central_fallback_rows(part).select("ord", "product", "country", "status")


@query("m23_detail_by_key_text", "SELECT ord, registration_date AS date, 'Registered - ' || source AS status FROM reg", REG)
def _m23(spark, d):
    body = F.concat(F.lit("Date of registration# :\n "), "registration_date", F.lit(" \nLegal Classification :\n"), "source", F.lit("\nend"))
    date, status = mappers.detail_by_key_text(F.col("t"))
    return registrations(spark, d).withColumn("t", body).select("ord", date.alias("date"), status.alias("status"))


@query("e3_source_search", """
WITH r AS (SELECT ord, substance AS own, 'P' || substance AS searched, product FROM reg),
f AS (SELECT min(ord) AS ord, searched, own, lower(trim(product)) AS product FROM r GROUP BY ALL)
SELECT searched AS searched_substance, searched AS substance, own AS source_substance, product FROM f""", REG)
def _e3(spark, d):
    reg = registrations(spark, d)
    listed = registry.Registry()
    source = registry.Source("Spain CIMA", "EU", ("Spain",))
    listed.register_mapper(source, lambda raw: raw.withColumns({"source": F.lit("Spain CIMA"), "country": F.lit("Spain")}))
    raw = reg.select("ord", "substance", "product", F.concat(F.lit("P"), "substance").alias("query"))
    queries = reg.select(F.concat(F.lit("P"), "substance").alias("substance")).distinct().withColumn("query_id", F.col("substance"))
    found = registry.source_search(queries, {"Spain CIMA": raw}, listed)
    return found.select("searched_substance", "substance", "source_substance", F.lower(F.trim("product")).alias("product"))


@query("e10_ingest_pages", """
SELECT product, substance, company FROM (SELECT source AS product, arg_max(substance, ord) AS substance, arg_max(company, ord) AS company FROM reg GROUP BY source)""", REG)
def _e10(spark, d):
    reg = registrations(spark, d)
    body = F.concat(F.lit("contains the active substance "), "substance", F.lit(".\nMarketing authorisation holder\n"), "company", F.lit("\n"))
    pages = reg.select(
        "ord", F.concat("source", F.lit(" | Agency")).alias("title"), body.alias("text"), F.concat(F.lit("https://r.test/"), "source").alias("page_url"),
        F.array().cast("array<string>").alias("links"),
    )
    empty = spark.createDataFrame([], "id long, " + ", ".join(f"{c} string" for c in ("source", "product", "country", "registration_number", "product_url")))
    return store.upsert_products(empty, mappers.map_eu_page(pages)).select("product", "substance", "company")


# --- Leaflets and pages -------------------------------------------------------------------------


@query("d1_lines", r"""
SELECT doc_id, p - 1 AS pos, l[p] AS line FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\v\f\r\x{85}\x{2028}\x{2029}]'),
  lambda x: trim(regexp_replace(x, '[\s\v\x{85}\p{Z}]+', ' ', 'g'), ' :;-')), lambda x: x <> '') AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS p)""")
def _d1(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.posexplode(lf.lines("text")).alias("pos", "line"))
    return each.withColumn("pos", F.col("pos").cast("long"))


@query("d2_section_after_label", "SELECT ord, 'Maker ' || substance || ' GmbH, Germany' AS section FROM leaf JOIN reg USING (ord)", LEAF)
def _d2(spark, d):
    return leaflets(spark, d).select("ord", lf.section_after_label("text", ["Manufacturer", "Manufacturers"], continuation=["manufacturer"]).alias("section"))


@query("d3_value_after_label", "SELECT ord, '24 tablets' AS pack, company || ' Ltd, ' || country AS holder FROM reg", REG)
def _d3(spark, d):
    return leaflets(spark, d).select(
        "ord", lf.value_after_label("text", ["Pack sizes"]).alias("pack"), lf.value_after_label("text", ["authorisation holder"]).alias("holder")
    )


@query("d4_text_after_label", "SELECT ord, 'Maker ' || substance || ' GmbH, Germany' AS maker, CAST(NULL AS VARCHAR) AS absent FROM reg", REG)
def _d4(spark, d):
    return leaflets(spark, d).select(
        "ord", lf.text_after_label("text", ["Manufacturer"]).alias("maker"), lf.text_after_label("text", ["Sponsor"]).alias("absent")
    )


@query("d5_ma_holder", "SELECT ord, company || ' Ltd' AS holder FROM reg", REG)
def _d5(spark, d):
    read = once_per_value(leaflets(spark, d), "text", lambda t: t.withColumn("holder", lf.ma_holder("text")))
    return read.select("ord", "holder")


@query("d6_manufacturers", "SELECT ord, 'Maker ' || substance || ' GmbH' AS makers, 'Maker ' || substance || ' GmbH' AS name, 'Germany' AS country FROM reg", REG)
def _d6(spark, d):
    read = once_per_value(
        leaflets(spark, d), "text", lambda t: t.withColumns({"makers": lf.manufacturers("text"), "r": lf.report_manufacturer("text")})
    )
    return read.select("ord", "makers", "r.name", "r.country")


@query("d7_company_names", "SELECT ord, [company || ' Ltd', 'Maker ' || substance || ' GmbH'] AS names FROM reg", REG)
def _d7(spark, d):
    block = F.concat("company", F.lit(" Ltd, "), "country", F.lit("; 10 High Street; Maker "), "substance", F.lit(" GmbH ;; somewhere, far; "), "company", F.lit(" Ltd"))
    blocks = registrations(spark, d).select("ord", block.alias("block"))
    return once_per_value(blocks, "block", lambda b: b.withColumn("names", lf.company_names(F.col("block")))).select("ord", "names")


@query("d8_pack_info", "SELECT ord, '24 tablets' AS pack, 'in packs of 10, 30 and 60 tablets' AS sentence, '24 tablets' AS report FROM reg", REG)
def _d8(spark, d):
    sentence = F.replace("text", F.lit("24 tablets"), F.lit("The tablets come in packs of 10, 30 and 60 tablets."))
    return leaflets(spark, d).select(
        "ord", lf.pack_info("text").alias("pack"), lf.pack_info(sentence).alias("sentence"), lf.report_pack("text").alias("report")
    )


@query("d9_indication", "SELECT ord, 'treatment of ' || substance || ' disorders in adults' AS indication FROM reg", REG)
def _d9(spark, d):
    body = F.concat(F.lit("4.1 Therapeutic indications\n treatment of  "), "substance", F.lit(" disorders\n in adults -\n4.2 Posology"))
    return registrations(spark, d).select("ord", lf.indication(body).alias("indication"))


@query("d10_holder_from_highlights", "SELECT ord, CASE WHEN registration_number IS NULL THEN 'First Pharma' ELSE company || ' Ltd' END AS holder FROM reg", REG)
def _d10(spark, d):
    body = F.concat(F.lit("First <b>Pharma</b>.\nx "), F.lower(text("registration_number")), F.lit("\nLay summary pharma\n"), "company", F.lit(" Ltd.\n"))
    return registrations(spark, d).select("ord", lf.holder_from_highlights(body, "registration_number").alias("holder"))


@query("d11_doc_links", r"""
WITH k AS (SELECT page_id, pos, href, lower(label || ' ' || 'https://products.mhra.gov.uk' || href) AS t FROM links WHERE starts_with(href, '/')),
s AS (SELECT page_id, min(pos) FILTER (contains(t, 'spc')) AS sp FROM k GROUP BY 1),
p AS (SELECT k.page_id, min(pos) FILTER (contains(t, 'pil') AND pos IS DISTINCT FROM sp) AS pp, any_value(sp) AS sp FROM k JOIN s USING (page_id) GROUP BY 1),
r AS (SELECT k.page_id, min(pos) FILTER (contains(t, 'par') AND pos IS DISTINCT FROM sp AND pos IS DISTINCT FROM pp) AS rp FROM k JOIN p USING (page_id) GROUP BY 1)
SELECT pages.page_id, 'https://products.mhra.gov.uk' || k.href AS report FROM pages LEFT JOIN r USING (page_id) LEFT JOIN k ON k.page_id = pages.page_id AND k.pos = r.rp""", ANCHORS_SQL)
def _d11(spark, d):
    found = table(spark, d, "pages").select("page_id", lf.doc_links("html", "https://products.mhra.gov.uk", "uk").alias("l"))
    return found.select("page_id", F.col("l.assessment_report_url").alias("report"))


@query("x35_extract_countries", """
SELECT s_suppkey, 'Netherlands' || CASE WHEN c IN ('Germany', 'Cyprus', 'Japan', 'United Kingdom') THEN '; ' || c ELSE '' END AS countries FROM (
  SELECT s_suppkey, ['Germany', 'Egypt', 'Cyprus', 'Israel', 'Japan', 'Brazil', 'India', 'United Kingdom', 'Nigeria'][CAST(MOD(s_nationkey, 9) AS INTEGER) + 1] AS c FROM supplier)""")
def _x35(spark, d):
    line = F.concat(F.lit("Made in The Netherlands and GERMANYX, packed in "), F.upper("c"))
    return with_real_country(spark, d).select("s_suppkey", lf.extract_countries(line).alias("countries"))


@query("x37_absolute_url", r"""
WITH f AS (SELECT page_id, pos - 1 AS pos, url, href, ltrim(href, '/') AS h, unnest(range(6)) AS form, regexp_extract(url, '^[^?#]*') AS path, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root FROM links)
SELECT page_id, pos, form, CASE WHEN form = 1 AND h = '' THEN url ELSE CASE form
  WHEN 0 THEN root || '/' || h WHEN 1 THEN (CASE WHEN path = root THEN root || '/' ELSE regexp_extract(path, '^.*/') END) || h WHEN 2 THEN path || '?' || h
  WHEN 3 THEN regexp_extract(url, '^[^#]*') || '#' || h WHEN 4 THEN split_part(url, ':', 1) || '://' || h ELSE 'https://o.test/' || h END END AS link FROM f""", ANCHORS_SQL)
def _x37(spark, d):
    """Every link of every page, in six forms: from the root, relative, query, fragment, without scheme, absolute."""
    each = table(spark, d, "pages").select("page_id", "url", F.posexplode(lf.anchors("html")).alias("pos", "a"))
    h = F.ltrim(F.col("a.href"), F.lit("/"))
    forms = F.array(*[F.concat(F.lit(start), h) for start in ("/", "", "?", "#", "//", "https://o.test/")])
    spread = each.select("page_id", "url", "pos", F.posexplode(forms).alias("form", "href"))
    return spread.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("form").cast("long").alias("form"), tx.absolute_url(F.col("url"), F.col("href")).alias("link"))


# --- Enrichment ---------------------------------------------------------------------------------


@query("s10_read_documents", r"""
WITH p AS (SELECT doc_id, i - 1 AS page_no, len(l) AS n, l[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))
SELECT CAST(doc_id AS VARCHAR) AS url, string_agg(t, chr(10) ORDER BY page_no) AS text FROM p GROUP BY doc_id""")
def _s10(spark, d):
    pieces = F.split("text", "\n", -1)
    pages = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("url"), F.size(pieces).alias("n_pages"), F.posexplode(pieces).alias("page_no", "text")
    )
    return docs.read_documents(pages)


def linked_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """F-REG rows with a shared leaflet per substance and an own summary, and those documents."""
    reg = registrations(spark, d)
    o = F.col("ord")
    rows = reg.select(
        "ord", "product", "company", "source", F.when(o % 2 == 0, F.concat(F.lit("https://r.test/s/"), o.cast("string"), F.lit(".pdf"))).alias("smpc_url"),
        F.concat(F.lit("https://r.test/docs/"), "substance").alias("pil_url"), F.lit(None).cast("string").alias("manufacturer_name"),
    )
    summaries = reg.filter(o % 2 == 0).select(
        F.concat(F.lit("https://r.test/s/"), o.cast("string"), F.lit(".pdf")).alias("doc_url"),
        F.concat(F.lit("Pack sizes: 30 tablets\nis used to treat rare "), "substance", F.lit(" disorders.\noral use")).alias("text"),
    )
    shared = reg.select("substance").distinct().select(
        F.concat(F.lit("https://r.test/docs/"), "substance").alias("doc_url"),
        F.concat(
            F.lit("Manufacturer\nMaker "), "substance", F.lit(" GmbH, Germany\nPack sizes\n24 tablets\nis used to treat common "), "substance",
            F.lit(" disorders.\nTel: +44 20 7946 0000"),
        ).alias("text"),
    )
    return rows, summaries.unionByName(shared)


ENRICHED_SQL = f"""
SELECT ord, {STRENGTH_P} AS strength, CASE WHEN contains(product, 'film-coated tablets') THEN 'Film-coated tablet' ELSE 'Tablet' END AS dosage_form, CASE WHEN MOD(ord, 2) = 0 THEN '30 tablets' ELSE '24 tablets' END AS pack_size,
  CASE WHEN MOD(ord, 2) = 0 THEN 'rare ' ELSE 'common ' END || substance || ' disorders' AS therapeutic_category,
  CASE WHEN MOD(ord, 2) = 0 THEN NULL ELSE 'Maker ' || substance || ' GmbH' END AS manufacturer_name, CASE WHEN MOD(ord, 2) = 0 THEN NULL ELSE 'Germany' END AS manufacturer_country,
  CASE WHEN MOD(ord, 2) = 0 THEN NULL ELSE '+44 20 7946 0000' END AS manufacturer_phone FROM reg"""


@query("d13_enrich_rows", ENRICHED_SQL, REG)
def _d13(spark, d):
    rows, texts = linked_rows(spark, d)
    return docs.enrich_rows(rows, texts).select(
        "ord", "strength", "dosage_form", "pack_size", "therapeutic_category", "manufacturer_name", "manufacturer_country", "manufacturer_phone"
    )


@query("q4_enrich_cached", ENRICHED_SQL, REG)
def _q4(spark, d):
    """Not one row is from the UK source, so the documents' own fields decide, as in D13."""
    from . import search as plans

    rows, texts = linked_rows(spark, d)
    return plans.enrich_cached(rows, texts).select(
        "ord", "strength", "dosage_form", "pack_size", "therapeutic_category", "manufacturer_name", "manufacturer_country", "manufacturer_phone"
    )


@query("d14_apply_uk_metadata", """
SELECT ord, CASE WHEN MOD(ord, 3) = 0 THEN company ELSE 'Holder ' || substance || ' Ltd' END AS company, 'Maker ' || substance || ' GmbH' AS manufacturer_name,
  'Germany' AS manufacturer_country, '24 tablets' AS pack_size FROM reg""", REG)
def _d14(spark, d):
    reg = registrations(spark, d)
    o = F.col("ord")
    doc = F.concat(F.lit("https://r.test/docs/"), "substance")
    rows = reg.select(
        "ord", F.when(o % 3 == 0, F.col("company")).alias("company"), F.when(o % 3 == 0, F.col("company")).alias("manufacturer_name"),
        F.concat(F.lit("https://r.test/par/"), "substance").alias("assessment_report_url"), doc.alias("url"), F.lit("PAR").alias("document_type"),
    )
    texts = reg.select("substance").distinct()

    def leaflet(url: str, holder: str, pack: str) -> DataFrame:
        return texts.select(
            F.concat(F.lit(url), "substance").alias("doc_url"),
            F.concat(F.lit("Marketing Authorisation Holder\n" + holder), "substance", F.lit(" Ltd\nManufacturer\nMaker "), "substance", F.lit(" GmbH, Germany\nPack sizes\n" + pack)).alias("text"),
        )

    meta = docs.uk_metadata(leaflet("https://r.test/docs/", "Holder ", "24 tablets").unionByName(leaflet("https://r.test/par/", "Wrong ", "1 vial")))
    return docs.apply_uk_metadata(rows, meta).select("ord", "company", "manufacturer_name", "manufacturer_country", "pack_size")


@query("d15_apply_eu_links", """
SELECT ord, CASE WHEN source = 'Brand#1' THEN COALESCE(smpc_url, 'info') ELSE smpc_url END AS smpc_url,
  CASE WHEN source = 'Brand#1' THEN COALESCE(document_type, 'Product information') ELSE document_type END AS document_type FROM urls""", REG + ", " + URLS_SQL)
def _d15(spark, d):
    rows = with_urls(registrations(spark, d)).withColumns({
        "source": F.when(F.col("source") == "Brand#1", "EMA").otherwise(F.col("source")), "product_url": F.col("source"),
    })
    links = rows.select(F.col("product_url").alias("page_url")).distinct().select(
        "page_url", F.lit("info").alias("smpc_url"), F.lit("info").alias("pil_url"), F.lit(None).cast("string").alias("assessment_report_url")
    )
    return docs.apply_eu_links(rows, links).select("ord", "smpc_url", "document_type")


@query("d16_apply_extractions", """
SELECT ord, COALESCE(manufacturer_name, 'AI maker') AS manufacturer_name, 'AI route' AS route,
  CASE WHEN manufacturer_name IS NULL THEN 'manufacturer_name, route' ELSE 'route' END AS ai_enriched_fields, 'High' AS ai_confidence FROM makers""", REG + ", " + MAKERS_SQL)
def _d16(spark, d):
    rows = with_makers(registrations(spark, d)).withColumn("url", F.col("ord").cast("string"))
    keys = ["source", "country", "product", "registration_number", "url"]
    given = rows.select(
        *[F.col(k).alias(f"key_{k}") for k in keys], F.lit(" AI maker ").alias("manufacturer_name"), F.lit("AI route").alias("route"), F.lit("").alias("pack_size"),
        F.lit("High").alias("confidence"),
    )
    return docs.apply_extractions(rows, given).select("ord", "manufacturer_name", "route", "ai_enriched_fields", "ai_confidence")
