"""Queries over search predicates, query joins, scope algebra, joins and the search functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims

from ..operators import coverage, joins, scope, search
from ..store_paths import stage, stage_path
from . import search as plans
from .catalog import REG, query
from .fixtures import registrations, table
from .queries_rows import (
    ATC_CATEGORY_SQL, FORM_SQL, PACK_SQL, PICKED, REGION_SQL, RESULT_KEY_SQL, ROUTE_SQL, STRENGTH_OF_SQL,
    URLS_SQL, full_rows, medicinal, sql, with_real_country, with_urls,
)

# F-QRY: (query_id, substance)
WANTED = [
    ("q0", "gear"), ("q1", "gizmo"), ("q2", "rod"), ("q3", "ring"), ("q4", "widget"), ("q5", "anvil"), ("q6", "plate"),
    ("q7", "bolt"), ("q8", "small ring"), ("q9", "rin"), ("q10", ""),
]
QRY = "qry AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}')" for i, s in WANTED) + ") t(query_id, substance))"


def wanted(spark) -> DataFrame:
    return spark.createDataFrame(WANTED, "query_id string, substance string")


def staged_wanted(spark) -> DataFrame:
    """The queries as rows of known size: joined by shuffle, eight substances would bring all products into eight tasks."""
    return stage(wanted(spark), "wanted")


def asked(spark) -> DataFrame:
    return wanted(spark).withColumnRenamed("substance", "query_substance")


HIT = "(contains(lower(reg.substance), q.substance) OR contains(lower(reg.product), q.substance))"


# --- Predicates ---------------------------------------------------------------------------------


@query("p1_search_store", "SELECT ord FROM reg WHERE substance ILIKE '%r_n%' OR product ILIKE '%r_n%'", REG)
def _p1(spark, d):
    return search.search_store(registrations(spark, d), "r_N", like=True, ascii_only=True).select("ord")


@query("p1_search_store_contains", "SELECT ord FROM reg WHERE contains(lower(product), 'small ring') OR contains(lower(substance), 'small ring')", REG)
def _p1b(spark, d):
    return search.search_store(registrations(spark, d), "Small Ring").select("ord")


@query("p2_matches_all_tokens", "SELECT ord FROM reg WHERE list_has_all(string_split_regex(lower(product), '[^a-z0-9]+'), ['tablets', 'ring'])", REG)
def _p2(spark, d):
    return registrations(spark, d).filter(search.matches_all_tokens("product", F.lit("Ring, tablets"))).select("ord")


@query("p3_relevant_to_substance", """
WITH t AS (SELECT ord, source, substance, CASE WHEN MOD(ord, 3) = 0 THEN substance || ' (' || product || ')' ELSE source END AS product,
   CASE WHEN MOD(ord, 2) = 0 THEN 'small ring' ELSE 'ring' END AS q FROM reg),
k AS (SELECT *, string_split(q, ' ') AS qt, string_split_regex(lower(product), '[^a-z0-9]+') AS pt,
   list_transform(regexp_extract_all(product, '\\(([^)]{3,120})\\)', 1), lambda g: string_split_regex(lower(g), '[^a-z0-9]+')) AS gs,
   string_split_regex(lower(substance), '[^a-z0-9]+') AS st FROM t)
SELECT ord, CASE WHEN list_has_all(pt, qt) THEN TRUE WHEN len(gs) > 0 THEN len(list_filter(gs, lambda g: list_has_all(g, qt))) > 0
  WHEN list_has_all(st, qt) THEN TRUE WHEN len(qt) > 1 THEN FALSE WHEN source = 'Brand#1' THEN FALSE ELSE TRUE END AS relevant FROM k""", REG)
def _p3(spark, d):
    o = F.col("ord")
    reg = registrations(spark, d)
    df = reg.select(
        "ord", F.when(F.col("source") == "Brand#1", "MHRA").otherwise(F.col("source")).alias("source"),
        F.col("substance").alias("source_substance"),
        F.when(o % 3 == 0, F.concat("substance", F.lit(" ("), "product", F.lit(")"))).otherwise(F.col("source")).alias("product"),
    )
    asked_for = F.when(o % 2 == 0, "small ring").otherwise("ring")
    return df.select("ord", search.relevant_to_substance(df, asked_for).alias("relevant"))


@query("p4_filter_rows", f"""
WITH n AS (SELECT *, COALESCE({sql(FORM_SQL)}, 'Not supplied by regulator') AS form, COALESCE({sql(STRENGTH_OF_SQL)}, 'Not supplied by regulator') AS strength,
  COALESCE({sql(ATC_CATEGORY_SQL, 'atc_code')}, 'Not supplied by regulator') AS category, COALESCE({sql(PACK_SQL)}, 'Pending document enrichment') AS pack FROM reg)
SELECT ord FROM n WHERE contains(lower(form), 'tablet') AND contains(lower(category), 'supplied') AND contains(lower(pack), 'pending')
  AND region = 'ASIA' AND contains(lower(strength), '1')
  AND (contains(lower(product), 'ring') OR contains(lower(substance), 'ring'))""", REG)
def _p4(spark, d):
    reg = registrations(spark, d).withColumn("source_url", F.lit("https://r.test/s"))
    return coverage.filter_rows(reg, {
        "dosage_form_filter": "Tablet", "therapeutic_category_filter": "supplied", "pack_size_filter": " pending ",
        "strength_filter": "1", "region": "ASIA", "table_search": "RING", "country": "",
    }).select("ord")


def placeholders(spark, d) -> DataFrame:
    """F-REG where some rows look like registry placeholders."""
    reg = registrations(spark, d)
    s = F.col("source")
    return reg.withColumns({
        "document_type": F.when(s == "Brand#1", "EU national Lookup Fallback").when(s == "Brand#2", "Official registry search handoff"),
        "connector_mode": F.when(s == "Brand#3", "manual_registry"),
        "product": F.when(s == "Brand#4", F.concat("product", F.lit(" Regulator Lookup "))).otherwise(F.col("product")),
        "source": F.when((s == "Brand#1") & (F.col("region") == "ASIA"), "Asia Generic Registry Lookup").otherwise(s),
    })


@query("p5_is_lookup_fallback", "SELECT ord, source IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AND NOT (source = 'Brand#1' AND region = 'ASIA') AS fallback FROM reg", REG)
def _p5(spark, d):
    df = placeholders(spark, d)
    return df.select("ord", search.is_lookup_fallback(df).alias("fallback"))


@query("p6_matches_selected_sources", """
SELECT s_suppkey, (c IN ('Germany', 'Cyprus', 'India')) OR s_name = 'Supplier#000000004' AS selected
FROM (SELECT s_suppkey, s_name, CASE MOD(s_nationkey, 9) WHEN 0 THEN 'Germany' WHEN 2 THEN 'Cyprus' WHEN 6 THEN 'India' ELSE 'x' END AS c FROM supplier)""")
def _p6(spark, d):
    df = with_real_country(spark, d).select("s_suppkey", F.col("c").alias("country"), F.col("s_name").alias("source"))
    chosen = [" EMA", "cdsco india", "supplier#000000004"]
    return df.select("s_suppkey", search.matches_selected_sources(df, chosen).alias("selected"))


@query("p7_suppress_generic", """
WITH g AS (SELECT ord, country, CASE WHEN MOD(ord, 2) = 0 OR country IN (SELECT n_name FROM nation WHERE n_nationkey < 10)
  THEN 'Global Generic Registry Lookup' ELSE source END AS source FROM reg)
SELECT ord FROM g WHERE NOT (source = 'Global Generic Registry Lookup' AND country IN (SELECT country FROM g WHERE source <> 'Global Generic Registry Lookup'))""", REG)
def _p7(spark, d):
    few = table(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_name").alias("country"), F.lit(True).alias("few"))
    reg = registrations(spark, d).join(few, "country", "left")
    generic = (F.col("ord") % 2 == 0) | F.col("few").isNotNull()
    rows = reg.withColumn("source", F.when(generic, "Global Generic Registry Lookup").otherwise(F.col("source")))
    return search.suppress_generic(rows).select("ord")


@query("p8_drop_generic", "SELECT ord FROM reg WHERE NOT (source = 'Brand#1' AND region = 'ASIA')", REG)
def _p8(spark, d):
    return search.drop_generic(placeholders(spark, d)).select("ord")


@query("p9_drop_without_product", "SELECT ord FROM reg WHERE source <> 'Brand#7'", REG)
def _p9(spark, d):
    from ..operators.identity import drop_without_product

    reg = registrations(spark, d)
    return drop_without_product(reg.withColumn("product", F.when(F.col("source") != "Brand#7", F.col("product")))).select("ord")


@query("p10_drop_manual_for_export", "SELECT ord FROM reg WHERE source NOT IN ('Brand#2', 'Brand#3')", REG)
def _p10(spark, d):
    return search.drop_manual_for_export(placeholders(spark, d)).select("ord")


@query("p11_record_matches", "SELECT ord FROM reg WHERE contains(lower(substance), 'ring') OR contains(lower(company), 'ring') OR contains(lower(product), 'ring')", REG)
def _p11(spark, d):
    df = registrations(spark, d)
    return df.filter(search.record_matches(df, " Ring ", ["substance", "company", "product", "absent"])).select("ord")


@query("p12_record_matches_tokens", "SELECT ord FROM reg WHERE list_has_all(string_split_regex(lower(substance || ' ' || product), '[^a-z0-9]+'), ['ring', 'mg'])", REG)
def _p12(spark, d):
    df = registrations(spark, d)
    return df.filter(search.record_matches_tokens(df, "RING mg", ["substance", "title", "product"])).select("ord")


@query("p13_accent_insensitive_contains", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'ete')")
def _p13(spark, d):
    return table(spark, d, "documents").filter(search.accent_insensitive_contains("text", "été")).select("doc_id")


@query("p14_split_manual_rows", "SELECT ord, source = 'Brand#3' AS manual FROM reg", REG)
def _p14(spark, d):
    df = placeholders(spark, d)
    return df.select("ord", search.is_manual(df).alias("manual"))


@query("p15_fuzzy_token_query", """
WITH w AS (SELECT ord, list_filter(string_split_regex(lower(product), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM reg),
s AS (SELECT ord, CASE WHEN list_contains(ws, 'rung') THEN 4 WHEN len(list_filter(ws, lambda x: levenshtein(x, 'rung') <= 1)) > 0 THEN 1 ELSE 0 END AS a,
  CASE WHEN list_contains(ws, 'tablets') THEN 4 WHEN len(list_filter(ws, lambda x: levenshtein(x, 'tablets') <= 1)) > 0 THEN 1 ELSE 0 END AS b FROM w)
SELECT ord, a + b AS fuzzy_score FROM s WHERE a > 0 AND b > 0""", REG)
def _p15(spark, d):
    return search.fuzzy_token_query(registrations(spark, d), "product", "rung tablets").select("ord", "fuzzy_score")


@query("p16_column_filters", "SELECT ord FROM reg WHERE contains(lower(company), '00007') AND contains(lower(product), 'mg')", REG)
def _p16(spark, d):
    return search.column_filters(registrations(spark, d), {"company": " 00007 ", "product": "MG", "country": "  "}).select("ord")


# --- Queries and products -----------------------------------------------------------------------


@query("j1_expand_synonyms", """
WITH m AS (SELECT s_suppkey, CASE MOD(s_suppkey, 5) WHEN 0 THEN 'Paracetamol' WHEN 1 THEN 'Lidocaine+Prilocaine' WHEN 2 THEN 'Prilocaine and lidocaine'
    WHEN 3 THEN 'acetaminophen' ELSE s_name END AS substance FROM supplier),
t(key, pos, term) AS (VALUES ('paracetamol', 1, 'acetaminophen'), ('acetaminophen', 1, 'paracetamol'),
  ('lidocaine+prilocaine', 1, 'prilocaine lidocaine'), ('lidocaine+prilocaine', 2, 'prilocaine+lidocaine'),
  ('lidocaine+prilocaine', 3, 'lidocaine and prilocaine'), ('lidocaine+prilocaine', 4, 'lidocaine'), ('lidocaine+prilocaine', 5, 'prilocaine'),
  ('lidocaine+prilocaine', 6, 'lidocaine prilocaine'),
  ('prilocaine and lidocaine', 1, 'lidocaine prilocaine'), ('prilocaine and lidocaine', 2, 'lidocaine+prilocaine'),
  ('prilocaine and lidocaine', 3, 'prilocaine+lidocaine'), ('prilocaine and lidocaine', 4, 'lidocaine and prilocaine'),
  ('prilocaine and lidocaine', 5, 'lidocaine'), ('prilocaine and lidocaine', 6, 'prilocaine'))
SELECT s_suppkey, substance AS term FROM m UNION ALL SELECT s_suppkey, term FROM m JOIN t ON t.key = lower(substance)""")
def _j1(spark, d):
    k = F.col("s_suppkey") % 5
    name = (
        F.when(k == 0, "Paracetamol").when(k == 1, "Lidocaine+Prilocaine").when(k == 2, "Prilocaine and lidocaine")
        .when(k == 3, "acetaminophen").otherwise(F.col("s_name"))
    )
    return search.expand_synonyms(table(spark, d, "supplier").withColumn("substance", name)).select("s_suppkey", "term")


@query("p15_fuzzy_search_many", """
WITH fq AS (SELECT DISTINCT 'x' || substance AS query_id, substr(substance, 1, 1) || substr(substance, 3) AS a, split_part(product, ' ', 1) || 'z' AS b FROM reg),
t AS (SELECT query_id || ' ' || b AS query_id, unnest(list_distinct([a, b])) AS token FROM fq),
n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1),
w AS (SELECT DISTINCT ord, unnest(list_filter(string_split_regex(lower(product), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM reg),
m AS (SELECT token, word, CASE WHEN token = word THEN 4 ELSE 1 END AS s FROM (SELECT DISTINCT token FROM t) JOIN (SELECT DISTINCT word FROM w) ON levenshtein(token, word) <= 1),
b AS (SELECT t.query_id, w.ord, t.token, max(s) AS s FROM w JOIN m USING (word) JOIN t USING (token) GROUP BY ALL)
SELECT query_id, ord, CAST(sum(s) AS INT) AS fuzzy_score FROM b JOIN n USING (query_id) GROUP BY query_id, ord, n.n HAVING count(*) = n.n""", REG)
def _p15_many(spark, d):
    """Every substance and first word of a product, each misspelt by one letter, against all products."""
    reg = registrations(spark, d)
    s = F.col("substance")
    cut = F.concat(F.substring(s, 1, 1), F.substring(s, 3, 1000))
    typed = F.concat(F.split_part("product", F.lit(" "), F.lit(1)), F.lit("z"))
    queries = reg.select(F.concat(F.lit("x"), s, F.lit(" "), typed).alias("query_id"), F.concat(cut, F.lit(" "), typed).alias("query_substance")).distinct()
    return search.fuzzy_search_many(queries, reg, "product")


@query("j2_search_many", f"SELECT q.query_id, reg.ord FROM qry q JOIN reg ON {HIT}", REG + ", " + QRY)
def _j2(spark, d):
    return search.search_many(asked(spark), registrations(spark, d)).select("query_id", "ord")


@query("j2_search_many_tokens", """
WITH w AS (SELECT ord, string_split_regex(lower(substance || ' ' || product), '[^a-z0-9]+') AS ws FROM reg)
SELECT query_id, ord FROM qry JOIN w ON list_has_all(ws, string_split(substance, ' ')) WHERE substance <> ''""", REG + ", " + QRY)
def _j2t(spark, d):
    return search.search_many(asked(spark), registrations(spark, d), mode="token").select("query_id", "ord")


@query("j2_search_suppliers", """
SELECT s_name AS query_id, r.ord FROM supplier JOIN reg r ON contains(lower(r.substance), lower(s_name)) OR contains(lower(r.product), lower(s_name))""",
       REG.replace("p.p_name, ' ', CAST(p.p_size", "p.p_name, ' ', lower(s.s_name), ' ', CAST(p.p_size"))
def _j2s(spark, d):
    """As many queries as there are suppliers: the anchor join without a list of literals."""
    names = table(spark, d, "supplier").select(F.col("s_name").alias("query_id"), F.col("s_name").alias("query_substance"))
    reg = registrations(spark, d)
    named = reg.withColumn("product", F.concat("product", F.lit(" "), F.lower("company")))
    return search.search_many(names, named).select("query_id", "ord")


@query("j14_expand_local_terms", """
SELECT ord, p - 1 AS term_pos, t[p] AS term FROM (SELECT ord, CASE WHEN substance = 'gear' THEN ['Метформин', 'Metformin']
  WHEN substance = 'gizmo' THEN ['Парацетамол', 'Paracetamol'] WHEN substance = 'rod' THEN ['Lidocaine+Prilocaine'] WHEN substance = 'widget' THEN ['quetiapine fumarate']
  WHEN substance = 'anvil' THEN ['Prilocaine and lidocaine'] ELSE [substance] END AS t FROM reg), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS p)""", REG)
def _j14(spark, d):
    reg = medicinal(registrations(spark, d)).select("ord", "substance")
    return search.expand_local_terms(reg).select("ord", F.col("term_pos").cast("long").alias("term_pos"), "term")


@query("m21_stamp_query", "SELECT ord, substance AS source_substance, source AS searched_substance, source AS substance FROM reg", REG)
def _m21(spark, d):
    return search.stamp_query(registrations(spark, d).select("ord", "substance", "source"), "source").drop("source")


# --- Joins --------------------------------------------------------------------------------------


@query("j3_expand_countries", f"SELECT p_partkey, c AS country FROM part, (SELECT unnest([{', '.join(repr(c) for c in dims.EU_COUNTRIES)}]) AS c)")
def _j3(spark, d):
    from ..sources.mappers import expand_countries

    return expand_countries(table(spark, d, "part").select("p_partkey"), dims.EU_COUNTRIES)


GAPS = [
    ("g1", "ring", "", "EU", ""), ("g2", "bolt", "", "ALL", ""), ("g3", "plate", "", "AF", ""), ("g4", "gear", "Brazil", "", ""),
    ("g5", "nothing", "Kenya", "", ""), ("g6", "nothing", "", "JP", ""), ("g7", "nothing", "", "RU", ""), ("g8", "rod", "", "AS", "EMA"),
]
GAP_QRY = "gq AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(repr(x) for x in g)})" for g in GAPS) + ") t(query_id, substance, country, region, source))"


def real_countries(reg: DataFrame, spark, d) -> DataFrame:
    """F-REG with a real country and its region instead of the driver's names."""
    from ..functions.links import country_region

    names = ["Germany", "Egypt", "Cyprus", "Israel", "Japan", "Brazil", "India", "United Kingdom", "Nigeria"]
    named = reg.withColumn("country", F.get(F.array(*[F.lit(n) for n in names]), F.length("company") % 2 + (F.col("ord") % 8).cast("int")))
    return named.withColumn("region", country_region("country"))


REAL_REG = f"""real AS (SELECT * EXCLUDE (country, region), c AS country, {REGION_SQL} AS region FROM (SELECT *,
  ['Germany', 'Egypt', 'Cyprus', 'Israel', 'Japan', 'Brazil', 'India', 'United Kingdom', 'Nigeria'][CAST(MOD(length(company), 2) + MOD(ord, 8) AS INTEGER) + 1] AS c FROM reg))"""


def _list(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


@query("j4_country_gap_rows", f"""
WITH hits AS (SELECT q.query_id, r.country, r.region FROM gq q JOIN real r ON contains(lower(r.product), q.substance)),
sc AS (SELECT query_id, substance, region AS scope, unnest(CASE region WHEN 'EU' THEN {_list(dims.EU_COUNTRIES)} WHEN 'ALL' THEN {_list(dims.all_countries())}
    WHEN 'AF' THEN {_list(dims.AFRICA_COUNTRIES)} WHEN 'AS' THEN {_list(dims.ASIA_COUNTRIES)} WHEN 'JP' THEN ['Japan'] WHEN 'RU' THEN [] ELSE [country] END) AS c
  FROM gq WHERE source = ''),
gap AS (SELECT * FROM sc WHERE CASE WHEN scope = 'ALL' THEN NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = sc.query_id AND h.country = sc.c)
  WHEN scope IN ('EU', 'AF', 'AS') THEN NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = sc.query_id AND h.country = sc.c AND h.region = sc.scope)
  ELSE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = sc.query_id) END)
SELECT query_id, c AS country, substance || ' ' || c || ' generic regulatory registry lookup' AS product,
  CASE WHEN scope IN ('ALL', 'AF') THEN scope ELSE {REGION_SQL} END AS region,
  CASE scope WHEN 'ALL' THEN 'Global Generic Registry Lookup' WHEN 'AF' THEN 'Africa Generic Registry Lookup' WHEN 'EU' THEN 'EU National Registry'
    WHEN 'JP' THEN 'Regulatory Registry Lookup' ELSE CASE c WHEN 'Kenya' THEN 'Africa Generic Registry Lookup' ELSE 'Regulatory Registry Lookup' END END AS source
FROM gap""", REG + ", " + REAL_REG + ", " + GAP_QRY)
def _j4(spark, d):
    queries = spark.createDataFrame(GAPS, "query_id string, substance string, country string, region string, source string")
    reg = real_countries(registrations(spark, d), spark, d)
    hits = search.search_few([(g[0], g[1]) for g in GAPS], reg.withColumn("substance", F.lit(""))).select("query_id", "country", "region")
    return coverage.country_gap_rows(queries, hits).select("query_id", "country", "product", "region", "source")


@query("j5_star_join", """
SELECT p_partkey, p_name, (SELECT max_by(s_name, l_orderkey * 100 + l_linenumber) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey) AS company,
  (SELECT max_by(l_returnflag, l_orderkey * 100 + l_linenumber) FROM lineitem WHERE l_partkey = p_partkey) AS status
FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def _j5(spark, d):
    line = table(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    line = line.withColumnRenamed("l_partkey", "p_partkey")
    supplied = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joins.star_join(
        table(spark, d, "part").select("p_partkey", "p_name"), line, supplied.withColumnRenamed("s_name", "company"),
        line.withColumnRenamed("l_returnflag", "status"), "p_partkey", F.col("l_quantity") > 45,
    )


@query("j6_best_match_join", r"""
WITH l AS (SELECT min(ord) AS ord, substance, split_part(product, ' ', 1) || ' ' || substance AS product, company FROM reg GROUP BY ALL),
n AS (SELECT min(ord) AS ord, substance, source AS brand_name, split_part(product, ' ', 1) AS generic_name, company || ' Inc' AS labeler FROM reg GROUP BY ALL),
lk AS (SELECT *, regexp_replace(lower(product), '[^a-z0-9]+', '', 'g') AS pk, regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') AS ck FROM l),
nk AS (SELECT *, regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS k1, regexp_replace(lower(generic_name || substance), '[^a-z0-9]+', '', 'g') AS k2,
   regexp_replace(lower(generic_name), '[^a-z0-9]+', '', 'g') AS k3, regexp_replace(lower(labeler), '[^a-z0-9]+', '', 'g') AS bk FROM n),
s AS (SELECT lk.ord, nk.ord AS rec, CASE WHEN pk IN (k1, k3) OR (nk.brand_name < 'Brand#2' AND pk = k2) THEN 100
    WHEN contains(pk, k1) OR contains(k1, pk) OR contains(pk, k3) OR contains(k3, pk) OR (nk.brand_name < 'Brand#2' AND (contains(pk, k2) OR contains(k2, pk))) THEN 70 ELSE 0 END
    + CASE WHEN contains(ck, bk) OR contains(bk, ck) THEN 25 ELSE 0 END AS score FROM lk JOIN nk USING (substance)),
b AS (SELECT ord, max(score) AS match_score, max_by(rec, (score, -rec)) AS match_ord FROM s WHERE score > 0 GROUP BY ord)
SELECT l.ord, b.match_ord, b.match_score FROM l LEFT JOIN b USING (ord)""", REG)
def _j6(spark, d):
    reg = registrations(spark, d)
    word = F.split_part("product", F.lit(" "), F.lit(1))
    left = reg.groupBy("substance", F.concat(word, F.lit(" "), "substance").alias("product"), "company").agg(F.min("ord").alias("ord"))
    ndc = reg.groupBy(
        "substance", F.col("source").alias("brand_name"), word.alias("generic_name"), F.concat("company", F.lit(" Inc")).alias("labeler_name")
    ).agg(F.min("ord").alias("ord"))
    base = F.when(F.col("brand_name") < "Brand#2", F.concat("generic_name", F.lit(" "), "substance"))
    found = joins.best_match_join(left, ndc.withColumn("brand_name_base", base))
    return found.select("ord", "match_ord", "match_score")


@query("j7_attach_by_url", """
WITH docs AS (SELECT url AS doc_url, max(CASE WHEN MOD(ord, 3) > 0 THEN 'H' || url END) AS company, max(CASE WHEN contains(url, 'pil') THEN 'K' || url END) AS pack
  FROM (SELECT ord, unnest([smpc_url, pil_url, assessment_report_url, product_url]) AS url FROM urls) WHERE url IS NOT NULL GROUP BY url)
SELECT ord, COALESCE(a.company, b.company, c.company, e.company) AS doc_company, COALESCE(a.pack, b.pack, c.pack, e.pack) AS doc_pack
FROM urls u LEFT JOIN docs a ON a.doc_url = u.smpc_url LEFT JOIN docs b ON b.doc_url = u.pil_url
LEFT JOIN docs c ON c.doc_url = u.assessment_report_url LEFT JOIN docs e ON e.doc_url = u.product_url""", REG + ", " + URLS_SQL)
def _j7(spark, d):
    rows = with_urls(registrations(spark, d))
    url = F.explode(F.array("smpc_url", "pil_url", "assessment_report_url", "product_url"))
    docs = rows.select("ord", url.alias("doc_url")).filter("doc_url IS NOT NULL").groupBy("doc_url").agg(
        F.max(F.when(F.col("ord") % 3 > 0, F.concat(F.lit("H"), "doc_url"))).alias("company"),
        F.max(F.when(F.col("doc_url").contains("pil"), F.concat(F.lit("K"), "doc_url"))).alias("pack"),
    )
    return joins.attach_by_url(rows, docs, ["company", "pack"]).select("ord", "doc_company", "doc_pack")


@query("j8_merge_detail", f"""
SELECT ord, COALESCE(CASE WHEN MOD(ord, 2) = 0 THEN company END, 'Detail ' || source) AS company, {sql(STRENGTH_OF_SQL)} AS strength,
  {sql(FORM_SQL)} AS dosage_form, {sql(PACK_SQL)} AS pack_size FROM reg""", REG)
def _j8(spark, d):
    reg = registrations(spark, d)
    rows = reg.select(
        "ord", "product", F.when(F.col("ord") % 2 == 0, F.col("company")).alias("company"),
        F.concat(F.lit("https://r.test/"), "source").alias("product_url"), F.lit(None).cast("string").alias("strength"),
    )
    detail = reg.select(
        F.concat(F.lit("https://r.test/"), "source").alias("product_url"), F.concat(F.lit("Detail "), "source").alias("company")
    ).distinct()
    return joins.merge_detail(rows, detail).select("ord", "company", "strength", "dosage_form", "pack_size")


@query("j9_lookup_country_by_company", """
SELECT s_suppkey, CASE MOD(s_suppkey, 3) WHEN 0 THEN 'Germany' WHEN 1 THEN 'United Kingdom' ELSE n_name END AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _j9(spark, d):
    k = F.col("s_suppkey") % 3
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    company = F.when(k == 0, "Roche Registration GmbH").when(k == 1, "Pfizer Limited").otherwise(F.col("s_name"))
    rows = named.select("s_suppkey", company.alias("company"), F.col("n_name").alias("country"))
    return scope.lookup_country_by_company(rows).select("s_suppkey", "country")


@query("j13_setdefault_links", """
SELECT ord, CASE WHEN MOD(ord, 3) = 0 THEN '' WHEN MOD(ord, 3) = 1 THEN 'own' ELSE 'link ' || source END AS smpc_url, 'pil ' || source AS pil_url FROM reg""", REG)
def _j13(spark, d):
    reg = registrations(spark, d)
    rows = reg.select("ord", F.col("source").alias("query_id"), F.when(F.col("ord") % 3 == 0, "").when(F.col("ord") % 3 == 1, "own").alias("smpc_url"))
    links = reg.select(
        F.col("source").alias("query_id"), F.concat(F.lit("link "), "source").alias("smpc_url"), F.concat(F.lit("pil "), "source").alias("pil_url")
    ).distinct()
    return scope.setdefault_links(rows, links).select("ord", "smpc_url", "pil_url")


# --- Scope algebra ------------------------------------------------------------------------------


@query("u1_union_sources", "SELECT ord, company, CAST(NULL AS VARCHAR) AS atc_code FROM reg UNION ALL SELECT ord, NULL, atc_code FROM reg", REG)
def _u1(spark, d):
    reg = registrations(spark, d)
    return scope.union_sources(reg.select("ord", "company"), reg.select("ord", "atc_code"))


@query("u2_parse_sources", f"""
SELECT s_suppkey, CASE MOD(s_suppkey, 3) WHEN 0 THEN [s_name] WHEN 1 THEN list_concat(['EMA', 'france bdpm'], {_list([s for s in dims.EU_NATIONAL_SOURCES if s != 'France BDPM'])})
  ELSE list_concat(['eu national', s_name], {_list(dims.EU_NATIONAL_SOURCES)}) END AS sources FROM supplier""")
def _u2(spark, d):
    k = F.col("s_suppkey") % 3
    given = (
        F.when(k == 0, F.array(F.lit(" "), F.concat(F.lit(" "), "s_name", F.lit(" "))))
        .when(k == 1, F.array(F.lit("EMA"), F.lit("france bdpm"))).otherwise(F.array(F.lit("eu national"), F.col("s_name")))
    )
    return table(spark, d, "supplier").select("s_suppkey", scope.parse_sources(given).alias("sources"))


SCOPES = [
    # country, region, source, sources -> expected
    ("", "", "X", ["FDA"], ["X"]), ("", "EU", "", ["EMA", "FDA"], ["EMA", *dims.EU_NATIONAL_SOURCES]), ("", "UK", "", ["mhra", "FDA"], ["mhra"]),
    ("", "US", "", ["FDA", "FDA Orange Book"], ["FDA"]), ("", "AU", "", ["FDA"], ["TGA Australia"]), ("", "AF", "", ["FDA"], [dims.LOOKUP_ONLY]),
    ("", "ALL", "", ["FDA", "zzz"], ["FDA"]), ("China", "", "", ["FDA", "France BDPM"], ["NMPA China"]), ("Kenya", "", "", ["FDA"], [dims.LOOKUP_ONLY]),
    ("Brazil", "", "", ["FDA"], ["FDA"]), ("", "CH", "", ["FDA"], ["FDA", "Swissmedic"]), ("India", "", "", ["CDSCO India"], ["CDSCO India"]),
    ("Germany", "", "", ["MHRA", "EMA", "Spain CIMA"], ["EMA", "EU MRI Product Index"]),
]


def scoped_suppliers(spark, d) -> DataFrame:
    """Each supplier asks with one of the scopes above, by key."""
    cases = spark.createDataFrame(
        [(i, *row[:4]) for i, row in enumerate(SCOPES)], "i long, country string, region string, source string, sources array<string>"
    )
    return table(spark, d, "supplier").join(cases, F.col("s_suppkey") % len(SCOPES) == F.col("i"))


@query("u3_scope_sources", f"""
SELECT s_suppkey, CASE MOD(s_suppkey, {len(SCOPES)}) {' '.join(f'WHEN {i} THEN {_list(row[4])}' for i, row in enumerate(SCOPES))} END AS scoped FROM supplier""")
def _u3(spark, d):
    df = scoped_suppliers(spark, d)
    return df.select("s_suppkey", scope.scope_sources(F.col("sources"), F.col("country"), F.col("region"), F.col("source")).alias("scoped"))


@query("u4_merged_options", """
SELECT source AS name FROM (SELECT DISTINCT source FROM reg WHERE source NOT IN ('Brand#1', 'Brand#2')) UNION ALL SELECT unnest(['BRAND#1', 'Other', 'brand#2'])""", REG)
def _u4(spark, d):
    names = registrations(spark, d).groupBy(F.col("source").alias("name")).agg(F.min("ord").alias("pos"))
    fixed = spark.createDataFrame([(" BRAND#1", 0), ("Other", 1), ("brand#2", 2), ("  ", 3)], "name string, pos long")
    return scope.merged_options(names, fixed, "name").select("name")


@query("u6_skip_in_mode", "SELECT source, CASE WHEN source = 'Spain CIMA' THEN 'queued' ELSE 'skipped' END AS status FROM (SELECT DISTINCT CASE source WHEN 'Brand#1' THEN 'Spain CIMA' ELSE source END AS source FROM reg)", REG)
def _u6(spark, d):
    source = F.col("source")
    names = registrations(spark, d).select(F.when(source == "Brand#1", "Spain CIMA").otherwise(source).alias("source")).distinct()
    return scope.skip_in_mode(names, "fast")


@query("u7_select_live_sources", """
SELECT s_suppkey, CASE MOD(s_suppkey, 4) WHEN 0 THEN ['FDA', 'MHRA'] WHEN 1 THEN ['FDA'] WHEN 2 THEN ['MHRA'] ELSE ['FDA', 'FDA Orange Book', 'FDA Purple Book', 'Spain CIMA'] END AS live_sources,
  MOD(s_suppkey, 4) <> 2 AS effective_live FROM supplier""")
def _u7(spark, d):
    k = F.col("s_suppkey") % 4
    asked_for = table(spark, d, "supplier").select(
        "s_suppkey", F.lit(True).alias("live"), F.when(k == 0, "full").otherwise("fast").alias("mode"),
        F.when(k == 2, "United Kingdom").otherwise("").alias("country"), F.lit("").alias("region"), F.lit("").alias("source"),
        F.when(k == 3, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("FDA")))
        .otherwise(F.array(F.lit("FDA"), F.lit("MHRA"))).alias("sources"),
    )
    return scope.select_live_sources(asked_for).select("s_suppkey", "live_sources", "effective_live")


@query("u8_delete_where", "SELECT ord FROM reg WHERE (atc_code <> 'A10BA02' OR atc_code IS NULL) AND source NOT IN (SELECT p_brand FROM part WHERE p_retailprice < 901)", REG)
def _u8(spark, d):
    reg = scope.delete_where(registrations(spark, d), F.col("atc_code") == "A10BA02")
    brands = table(spark, d, "part").filter("p_retailprice < 901").select(F.col("p_brand").alias("source"))
    return scope.delete_keys(reg, brands, ["source"]).select("ord")


@query("u9_update_where", "SELECT ord, CASE WHEN region = 'ASIA' THEN 'Asia' ELSE country END AS country, country AS region FROM reg", REG)
def _u9(spark, d):
    reg = scope.update_where(registrations(spark, d), F.col("region") == "ASIA", {"country": F.lit("Asia")})
    original = registrations(spark, d).select("ord", F.col("country").alias("region"))
    return reg.select("ord", "country").join(original, "ord")


# --- Search functions ---------------------------------------------------------------------------

SEARCHES = [
    # query_id, substance, sources, country, region, source, table_search, sort_by, sort_dir, page, page_size
    ("s1", "ring", [], "", "", "", "", "product", "desc", 2, 50), ("s2", "small ring", PICKED, "", "", "", "", "", "asc", 1, 20),
    ("s3", "bolt", [], "", "", "Brand#9", "capsule", "ma_holder", "asc", 1, 200), ("s4", "rin", [], "", "AS", "", "", "country", "asc", 3, 10),
    ("s5", "gear", [], "Brazil", "", "", "", "company", "desc", 1, 50), ("s6", "", [], "", "", "", "tablet", "status", "asc", 7, 100),
]
SEARCH_DDL = (
    "query_id string, substance string, sources array<string>, country string, region string, source string, table_search string, "
    "sort_by string, sort_dir string, page long, page_size long"
)


def searches(spark) -> DataFrame:
    return spark.createDataFrame(SEARCHES, SEARCH_DDL)


SEARCH_SQL = f"""
q AS (SELECT * FROM (VALUES ('s1', 'ring', '', '', '', ''), ('s2', 'small ring', '', '', '', ''), ('s3', 'bolt', '', '', 'Brand#9', 'capsule'),
   ('s4', 'rin', '', 'AS', '', ''), ('s5', 'gear', 'Brazil', '', '', ''), ('s6', '', '', '', '', 'tablet')) t(query_id, substance, country, region, source, table_search)),
hits AS (SELECT q.query_id, q.substance AS asked, q.country AS fc, q.region AS fr, q.source AS fs, q.table_search AS ft, r.* FROM q
   JOIN real r ON contains(lower(r.substance), q.substance) OR contains(lower(r.product), q.substance)
   WHERE CASE q.query_id WHEN 's2' THEN lower(r.source) IN ('brand#9', 'brand#4', 'brand#11') WHEN 's3' THEN r.source = 'Brand#9'
     WHEN 's4' THEN FALSE WHEN 's5' THEN TRUE ELSE TRUE END),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {RESULT_KEY_SQL} ORDER BY ord) AS rn FROM hits) WHERE rn = 1),
filled AS (SELECT * REPLACE (COALESCE(atc_code, first_value(atc_code IGNORE NULLS) OVER (PARTITION BY query_id, lower(trim(substance)) ORDER BY ord
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS atc_code) FROM firsts),
kept AS (SELECT query_id, ord, substance, product, country, region, source, atc_code FROM filled
  WHERE (asked <> 'small ring' OR list_has_all(string_split_regex(lower(product), '[^a-z0-9]+'), ['small', 'ring']))
    AND (fc = '' OR country = fc) AND (fr = '' OR region = fr) AND (fs = '' OR source = fs)
    AND (ft = '' OR contains(lower(product), ft) OR contains(lower({sql(FORM_SQL)}), ft))),
gaps AS (SELECT 's4' AS query_id, unnest({_list(dims.ASIA_COUNTRIES)}) AS country)"""


@query("e1_search", f"""
SELECT query_id, source, product, country, region, atc_code FROM kept UNION ALL
SELECT query_id, 'Asia Generic Registry Lookup', 'rin ' || country || ' generic regulatory registry lookup', country, 'AS', NULL FROM gaps""",
       REG + ", " + REAL_REG + "," + SEARCH_SQL)
def _e1(spark, d):
    reg = real_countries(registrations(spark, d), spark, d)
    return plans.search_sorted(searches(spark), reg).select("query_id", "source", "product", "country", "region", "atc_code")


@query("e2_saved_search", f"""
WITH one AS (SELECT * FROM (SELECT q.query_id, reg.*, row_number() OVER (PARTITION BY q.query_id, {RESULT_KEY_SQL.replace('trim(', 'trim(reg.').replace('trim(reg.COALESCE(registration_number', 'trim(COALESCE(reg.registration_number')} ORDER BY reg.ord) AS rn
  FROM qry q JOIN reg ON {HIT}) WHERE rn = 1)
SELECT query_id, ord, COALESCE(atc_code, first_value(atc_code IGNORE NULLS) OVER (PARTITION BY query_id, lower(trim(substance)) ORDER BY ord
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS atc_code FROM one""", REG + ", " + QRY)
def _e2(spark, d):
    return plans.saved_search(wanted(spark), registrations(spark, d)).select("query_id", "ord", "atc_code")


@query("e2_saved_search_live", f"""
WITH one AS (SELECT * FROM (SELECT q.query_id, reg.*, row_number() OVER (PARTITION BY q.query_id, {RESULT_KEY_SQL.replace('trim(', 'trim(reg.').replace('trim(reg.COALESCE(registration_number', 'trim(COALESCE(reg.registration_number')} ORDER BY reg.ord) AS rn
  FROM qry q JOIN reg ON {HIT}) WHERE rn = 1),
live AS (SELECT q.query_id, v.source, q.substance, reg.ord FROM qry q JOIN reg ON reg.substance = q.substance CROSS JOIN (VALUES ('NPRA Malaysia'), ('Spain CIMA'), ('TGA Australia')) v(source)),
both_kinds AS (SELECT query_id, source, substance, atc_code, 'cached' AS origin, 0 AS late, ord FROM one UNION ALL SELECT query_id, source, substance, NULL, 'live', 1, ord FROM live),
filled AS (SELECT query_id, source, origin, COALESCE(atc_code, first_value(atc_code IGNORE NULLS) OVER (PARTITION BY query_id, lower(trim(substance)) ORDER BY late, ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS atc_code FROM both_kinds)
SELECT query_id, source, origin, atc_code, count(*) AS n FROM filled GROUP BY ALL""", REG + ", " + QRY)
def _e2_live(spark, d):
    from ..sources import registry

    reg = registrations(spark, d).withColumn("query", F.col("substance"))
    o = F.col("ord").cast("string")
    raw = {
        "Spain CIMA": reg.select(
            "ord", "query", o.alias("nregistro"), F.col("product").alias("nombre"), F.col("company").alias("labtitular"), F.lit("").alias("labcomercializador"),
            F.lit(True).alias("comerc"), F.struct(F.lit(1).alias("aut")).alias("estado"),
            F.array().cast("array<struct<tipo:int,url:string,urlHtml:string>>").alias("docs")),
        "TGA Australia": reg.select(
            "ord", "query", F.concat(F.lit('<a href="/resources/artg/'), o, F.lit('">'), "company", F.lit(" - "), "product", F.lit(" (12345)</a>")).alias("html"),
            F.lit("https://r.test/").alias("page_url")),
        "NPRA Malaysia": reg.select("ord", "query", F.col("query").alias("term"), F.array(F.lit("1"), F.concat(F.lit("N"), o), "product", "company").alias("cells"), F.lit("https://r.test/").alias("page_url")),
    }
    live = registry.source_search(wanted(spark), raw, registry.Registry())
    rows = plans.saved_search(wanted(spark), registrations(spark, d), live)
    return rows.groupBy("query_id", "source", "origin", "atc_code").agg(F.count("*").alias("n"))


@query("e4_result_page")
def _e4(spark, d):
    reg = real_countries(registrations(spark, d), spark, d)
    return plans.result_page(searches(spark), plans.search_rows(searches(spark), reg))["rows"]


@query("e4_counts_by_source", f"""
SELECT query_id, source, count(*) AS count FROM (SELECT query_id, source FROM kept UNION ALL SELECT query_id, 'Asia Generic Registry Lookup' FROM gaps) GROUP BY ALL""",
       REG + ", " + REAL_REG + "," + SEARCH_SQL)
def _e4c(spark, d):
    reg = real_countries(registrations(spark, d), spark, d)
    return plans.result_page(searches(spark), plans.search_rows(searches(spark), reg))["by_source"]


@query("e5_export")
def _e5(spark, d):
    rows = full_rows(spark, d).join(staged_wanted(spark), "substance")
    return plans.export(wanted(spark), rows, F.lit("2024-01-01T00:00:00"))


EXPORTED_SQL = """
ex AS (SELECT q.query_id, q.substance AS asked, reg.* FROM qry q JOIN reg ON reg.substance = q.substance)"""


def exported(spark, d, whole: bool = True) -> dict:
    rows = registrations(spark, d).join(staged_wanted(spark), "substance")
    return plans.export_all(wanted(spark), rows, stage_path(spark, "exports"), F.lit("2024-01-01T00:00:00"), whole)


@query("e5_export_provenance", """
SELECT q.query_id, q.substance AS "Query", '2024-01-01T00:00:00' AS "Generated At", count(ex.ord) AS "Record Count",
  COALESCE(string_agg(DISTINCT source, ', ' ORDER BY source), 'Not available') AS "Sources", CASE WHEN count(ex.ord) > 0 THEN 'Records found' ELSE 'No records found' END AS "Status"
FROM qry q LEFT JOIN ex USING (query_id) GROUP BY q.query_id, q.substance""", REG + ", " + QRY + "," + EXPORTED_SQL)
def _e5_provenance(spark, d):
    return exported(spark, d)["provenance"]


@query("e5_export_coverage", f"""
SELECT query_id, source AS "Source", count(*) AS "Records", count({sql(STRENGTH_OF_SQL)}) || '/' || count(*) AS "Strength",
  count({sql(FORM_SQL)}) || '/' || count(*) AS "Dosage Form", count({sql(ROUTE_SQL)}) || '/' || count(*) AS "Route",
  count({sql(PACK_SQL)}) || '/' || count(*) AS "Pack Size", count(atc_code) || '/' || count(*) AS "ATC Code",
  (CASE WHEN query_id IN (SELECT query_id FROM ex WHERE atc_code IS NOT NULL) THEN count(*) ELSE 0 END) || '/' || count(*) AS "Therapeutic Category",
  '0/' || count(*) AS "SMPC URL", '0/' || count(*) AS "PIL URL", '0/' || count(*) AS "Assessment Report", '0/' || count(*) AS "Expiry Date" FROM ex GROUP BY query_id, source""",
       REG + ", " + QRY + "," + EXPORTED_SQL)
def _e5_coverage(spark, d):
    return exported(spark, d)["coverage"]


@query("e5_export_sheet", f"""
SELECT query_id, ord, country AS "Country", region AS "Region", substance AS "Molecule", COALESCE(registration_number, 'Not available') AS "Registration Number", registration_date AS "Registration Date",
  COALESCE({sql(FORM_SQL)}, 'Not supplied by regulator') AS "Dosage Form", COALESCE(atc_code, 'Not supplied by regulator') AS "ATC Code", source AS "Source", '2024-01-01T00:00:00' AS "Last Checked" FROM ex""",
       REG + ", " + QRY + "," + EXPORTED_SQL)
def _e5_sheet(spark, d):
    out = exported(spark, d)
    return out["sheet"].select(
        "query_id", "ord", "Country", "Region", "Molecule", "Registration Number", "Registration Date", "Dosage Form", "ATC Code", "Source", "Last Checked")


@query("e7_data_health", """
SELECT sample, (SELECT count(*) FROM m WHERE contains(lower(s), sample) OR contains(lower(product), sample)) AS records, (SELECT count(*) FROM m) AS total
FROM (SELECT unnest(['metformin', 'paracetamol', 'dapagliflozin', 'quetiapine', 'mirabegron']) AS sample)""",
       REG + ", m AS (SELECT product, CASE substance WHEN 'gear' THEN 'Metformin' WHEN 'gizmo' THEN 'Paracetamol' WHEN 'widget' THEN 'quetiapine fumarate' ELSE substance END AS s FROM reg)")
def _e7(spark, d):
    return plans.data_health(medicinal(registrations(spark, d)))


@query("e8_products_list", "SELECT product, substance, company, country, region, source, registration_date FROM reg", REG)
def _e8(spark, d):
    return plans.products_list(registrations(spark, d))


