"""Queries over text parsers, row rules, identity, ordering, coverage and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import base, company, english, links, rows, text
from ..operators import coverage, identity, ordering, quality
from .catalog import LEAF, REG, query
from .fixtures import leaflets, registrations, table

STRENGTH = r"\d+(?:\.\d+)?\s*(?:mg|mcg|micrograms?|g|kg|ml|l|iu|units?|%)\b(?:\s*/\s*\d*(?:\.\d+)?\s*(?:mg|mcg|micrograms?|g|kg|ml|l|iu|units?))?"
STRENGTH_SQL = rf"(?i){STRENGTH}(?:\s*\+\s*{STRENGTH})*"
FORM_SQL = """CASE
  WHEN regexp_matches({c}, '(?i)\\bsuspension\\b') THEN 'Suspension'
  WHEN regexp_matches({c}, '(?i)\\bprolonged[- ]release tablets?\\b') THEN 'Prolonged-release tablet'
  WHEN regexp_matches({c}, '(?i)\\bmodified[- ]release tablets?\\b') THEN 'Modified-release tablet'
  WHEN regexp_matches({c}, '(?i)\\bfilm[- ]coated tablets?\\b') THEN 'Film-coated tablet'
  WHEN regexp_matches({c}, '(?i)\\bcomprimidos?\\b') THEN 'Tablet'
  WHEN regexp_matches({c}, '(?i)\\borodispersible tablets?\\b') THEN 'Orodispersible tablet'
  WHEN regexp_matches({c}, '(?i)\\btablets?\\b') THEN 'Tablet'
  WHEN regexp_matches({c}, '(?i)\\bcapsules?\\b') THEN 'Capsule'
  WHEN regexp_matches({c}, '(?i)\\boral solution\\b') THEN 'Oral solution'
  WHEN regexp_matches({c}, '(?i)\\boral suspension\\b') THEN 'Oral suspension'
  WHEN regexp_matches({c}, '(?i)\\b(solution for )?injection\\b') THEN 'Solution for injection'
  WHEN regexp_matches({c}, '(?i)\\bcream\\b') THEN 'Cream'
  WHEN regexp_matches({c}, '(?i)\\bointment\\b') THEN 'Ointment'
  WHEN regexp_matches({c}, '(?i)\\bgel\\b') THEN 'Gel'
  WHEN regexp_matches({c}, '(?i)\\bpatch(?:es)?\\b') THEN 'Patch'
  WHEN regexp_matches({c}, '(?i)\\bspray\\b') THEN 'Spray'
  WHEN regexp_matches({c}, '(?i)\\bdrops?\\b') THEN 'Drops'
  WHEN regexp_matches({c}, '(?i)\\bsyrup\\b') THEN 'Syrup'
  WHEN regexp_matches({c}, '(?i)\\bpowder\\b') THEN 'Powder' END"""
PACK_SQL = r"""NULLIF(regexp_replace(COALESCE(
  NULLIF(regexp_extract({c}, '(?i)\b\d+\s*(?:x\s*)?\d*\s*(?:tablets?|capsules?|caplets?|patch(?:es)?|sachets?|vials?|ampoules?|bottles?|blisters?|syringes?)\b'), ''),
  regexp_extract({c}, '(?i)\b\d+(?:\.\d+)?\s*(?:ml|mL|g)\b\s*(?:in\s*)?(?:bottle|vial|tube|sachet|ampoule)?')), '\s+', ' ', 'g'), '')"""
ROUTE_SQL = r"""CASE WHEN regexp_matches({c}, '(?i)\boral\b|\bby mouth\b') THEN 'Oral'
  WHEN regexp_matches({c}, '(?i)\bintravenous\b|\biv\b') THEN 'Intravenous'
  WHEN regexp_matches({c}, '(?i)\bsubcutaneous\b|\bsc\b') THEN 'Subcutaneous'
  WHEN regexp_matches({c}, '(?i)\btopical\b|\bcutaneous\b') THEN 'Topical'
  WHEN regexp_matches({c}, '(?i)\bophthalmic\b|\beye\b') THEN 'Ophthalmic'
  WHEN regexp_matches({c}, '(?i)\bnasal\b') THEN 'Nasal'
  WHEN regexp_matches({c}, '(?i)\binhalation\b') THEN 'Inhalation'
  WHEN regexp_matches({c}, '(?i)\brectal\b') THEN 'Rectal' END"""
KEY_SQL = r"""regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))),
  '\b(?:limited|ltd|plc|inc|llc|gmbh|bv|b v|b\.v|sa|s a|s\.a|ag|kft|pty|pvt|private|company|co)\b', '', 'g'), '[^a-z0-9]+', '', 'g')"""
ATC_CATEGORY_SQL = """CASE WHEN starts_with({c}, 'A10') THEN 'Antidiabetic' WHEN starts_with({c}, 'A02') THEN 'Acid disorder medicine'
  WHEN starts_with({c}, 'B01') THEN 'Antithrombotic' WHEN starts_with({c}, 'J01') THEN 'Antibiotic'
  WHEN starts_with({c}, 'M01') THEN 'Anti-inflammatory' WHEN starts_with({c}, 'N02') THEN 'Analgesic'
  WHEN starts_with({c}, 'N05') THEN 'Antipsychotic / sedative' WHEN starts_with({c}, 'N06') THEN 'Psychoanaleptic'
  WHEN starts_with({c}, 'R03') THEN 'Respiratory medicine' WHEN starts_with({c}, 'C') THEN 'Cardiovascular'
  WHEN starts_with({c}, 'L') THEN 'Oncology / immunology' END"""
STRENGTH_OF_SQL = """NULLIF(trim(COALESCE(
   list_filter(regexp_extract_all({c}, '%s'), lambda m: regexp_matches(m, '(?i)\\b(?:mg|mcg|micrograms?|g|iu|units?|%%)\\b'))[1],
   regexp_extract_all({c}, '%s')[1])), '')""" % (STRENGTH_SQL, STRENGTH_SQL)


def sql(template: str, column: str = "product") -> str:
    return template.replace("{c}", column)


# --- Text parsers -------------------------------------------------------------------------------


@query("x1_collapse_ws", r"SELECT doc_id, NULLIF(trim(regexp_replace(text, '[\s\v\x{85}\p{Z}]+', ' ', 'g')), '') AS collapsed FROM documents")
def _x1(spark, d):
    return table(spark, d, "documents").select("doc_id", base.collapse_ws("text").alias("collapsed"))


@query("x2_clean_product_name")
def _x2(spark, d):
    reg = registrations(spark, d)
    noisy = F.concat("product", F.lit(" "), "product", F.lit(" - SmPC.pdf"))
    return reg.select("ord", text.clean_product_name(noisy).alias("name"))


@query("x3_first_value", """
SELECT ord, COALESCE(NULLIF(trim(registration_number), ''), NULLIF(trim(atc_code), ''), trim(product)) AS first_value,
       COALESCE(NULLIF(trim(registration_number), ''), 'Not available') AS shown FROM reg""", REG)
def _x3(spark, d):
    reg = registrations(spark, d)
    return reg.select(
        "ord", base.first_value("registration_number", "atc_code", "product").alias("first_value"),
        base.display_value("registration_number").alias("shown"),
    )


@query("x5_extract_strength", f"SELECT ord, {sql(STRENGTH_OF_SQL)} AS strength FROM reg", REG)
def _x5(spark, d):
    return registrations(spark, d).select("ord", text.extract_strength("product").alias("strength"))


@query("x6_extract_dosage_form", f"SELECT ord, {sql(FORM_SQL)} AS dosage_form FROM reg", REG)
def _x6(spark, d):
    return registrations(spark, d).select("ord", text.extract_dosage_form("product").alias("dosage_form"))


@query("x7_extract_registration_number", r"""
SELECT ord, NULLIF(upper(regexp_extract(concat(product, ' - ', lower(registration_number)),
  '(?i)\b(?:PLGB|PLNI|PL|THRGB|THRNI|THR|NRGB|NRNI|NR)\s*\d+/\d+(?:-\d+)?\b')), '') AS number FROM reg""", REG)
def _x7(spark, d):
    line = F.concat("product", F.lit(" - "), base.text(F.lower("registration_number")))
    return registrations(spark, d).select("ord", text.extract_registration_number(line).alias("number"))


@query("x8_extract_pack_size", f"SELECT ord, {sql(PACK_SQL, 'text')} AS pack_size FROM leaf", LEAF)
def _x8(spark, d):
    return leaflets(spark, d).select("ord", text.extract_pack_size("text").alias("pack_size"))


@query("x9_extract_route", f"SELECT ord, {sql(ROUTE_SQL)} AS route FROM reg", REG)
def _x9(spark, d):
    return registrations(spark, d).select("ord", text.extract_route("product").alias("route"))


@query("x10_extract_atc_code", r"""
SELECT ord, NULLIF(upper(COALESCE(
  NULLIF(regexp_extract(t, '(?i)(?:ATC\s*code|Anatomical\s+therapeutic\s+chemical\s*\(ATC\)\s*code)\s*[:\-\n\r ]+([A-Z]\d{2}[A-Z]{1,2}\d{0,2})', 1), ''),
  regexp_extract(t, '(?i)\b[A-Z]\d{2}[A-Z]{1,2}\d{0,2}\b'))), '') AS atc
FROM (SELECT ord, concat(product, ' B01AC06 ATC code: ', atc_code) AS t FROM reg)""", REG)
def _x10(spark, d):
    line = F.concat("product", F.lit(" B01AC06 ATC code: "), base.text("atc_code"))
    return registrations(spark, d).select("ord", text.extract_atc_code(line).alias("atc"))


@query("x11_format_registration", r"""
SELECT ord, regexp_replace(NULLIF(regexp_replace(upper(replace(registration_number, '/', '')), '[ _-]', '', 'g'), ''),
  '^(PLGB|PLNI|PLPI|PL|THRGB|THRNI|THR|NRGB|NRNI|NR)(\d{5})(\d{4})$', '\1 \2/\3') AS number FROM reg""", REG)
def _x11(spark, d):
    compact = F.replace(F.col("registration_number"), F.lit("/"), F.lit(""))
    return registrations(spark, d).select("ord", text.format_registration(compact).alias("number"))


@query("x12_simple_parsers", r"""
SELECT ord, NULLIF(regexp_extract(product, '(?i)\d+\s*(MG|MCG|G|ML)(?:/\d+\s*(MG|MCG|G|ML))?'), '') AS strength,
  CASE WHEN contains(upper(product), 'ORAL SOLUTION') THEN 'ORAL SOLUTION'
       WHEN contains(upper(product), 'ORAL SUSPENSION') THEN 'ORAL SUSPENSION'
       WHEN contains(upper(product), 'FILM-COATED TABLET') THEN 'FILM-COATED TABLET'
       WHEN contains(upper(product), 'TABLETS') THEN 'TABLETS' WHEN contains(upper(product), 'TABLET') THEN 'TABLET'
       WHEN contains(upper(product), 'CAPSULES') THEN 'CAPSULES' WHEN contains(upper(product), 'CAPSULE') THEN 'CAPSULE'
       WHEN contains(upper(product), 'CREAM') THEN 'CREAM' END AS form,
  NULLIF(regexp_extract(registration_number, 'PL\s*\d+/\d+'), '') AS pl FROM reg""", REG)
def _x12(spark, d):
    return registrations(spark, d).select(
        "ord", text.simple_strength("product").alias("strength"), text.simple_form("product").alias("form"),
        text.simple_pl("registration_number").alias("pl"),
    )


@query("x13_company_key", f"SELECT s_suppkey, {KEY_SQL.replace('{c}', 's_name')} AS key, {KEY_SQL.replace('{c}', chr(39) + 'The ' + chr(39) + ' || s_name || ' + chr(39) + ' Pharma Pvt. Ltd' + chr(39))} AS long_key FROM supplier")
def _x13(spark, d):
    longer = F.concat(F.lit("The "), F.col("s_name"), F.lit(" Pharma Pvt. Ltd"))
    return table(spark, d, "supplier").select(
        "s_suppkey", company.company_key("s_name").alias("key"), company.company_key(longer).alias("long_key")
    )


@query("x14_same_company", f"""
WITH k AS (SELECT ord, {KEY_SQL.replace('{c}', 'company')} AS a, {KEY_SQL.replace('{c}', "concat(company, ' Gmbh')")} AS b,
                  {KEY_SQL.replace('{c}', "concat('Maker ', substance)")} AS m FROM reg)
SELECT ord, (a <> '' AND b <> '' AND (starts_with(a, b) OR starts_with(b, a))) AS same,
       (a <> '' AND m <> '' AND (starts_with(a, m) OR starts_with(m, a))) AS maker FROM k""", REG)
def _x14(spark, d):
    return registrations(spark, d).select(
        "ord", company.same_company("company", F.concat("company", F.lit(" Gmbh"))).alias("same"),
        company.same_company("company", F.concat(F.lit("Maker "), "substance")).alias("maker"),
    )


@query("x15_normalize_key", "SELECT ord, regexp_replace(lower(product), '[^a-z0-9]+', '', 'g') AS key FROM reg", REG)
def _x15(spark, d):
    return registrations(spark, d).select("ord", text.normalize_key("product").alias("key"))


@query("x16_category_from_atc", f"SELECT ord, {sql(ATC_CATEGORY_SQL, 'atc_code')} AS category FROM reg", REG)
def _x16(spark, d):
    return registrations(spark, d).select("ord", text.category_from_atc("atc_code").alias("category"))


MOLECULE_SQL = """CASE substance WHEN 'gear' THEN 'Metformin' WHEN 'gizmo' THEN 'Paracetamol' WHEN 'rod' THEN 'Lidocaine+Prilocaine'
  WHEN 'widget' THEN 'quetiapine fumarate' WHEN 'anvil' THEN 'Prilocaine and lidocaine' ELSE substance END"""


def medicinal(reg: DataFrame) -> DataFrame:
    """F-REG with five of the substance names replaced by known molecules."""
    s = F.col("substance")
    name = (
        F.when(s == "gear", "Metformin").when(s == "gizmo", "Paracetamol").when(s == "rod", "Lidocaine+Prilocaine")
        .when(s == "widget", "quetiapine fumarate").when(s == "anvil", "Prilocaine and lidocaine").otherwise(s)
    )
    return reg.withColumn("substance", name)


SUBSTANCE_CATEGORY_SQL = """CASE WHEN contains(x, 'metformin') THEN 'Antidiabetic' WHEN contains(x, 'paracetamol') THEN 'Analgesic / antipyretic'
  WHEN contains(x, 'quetiapine') THEN 'Antipsychotic' WHEN contains(x, 'prilocaine') THEN 'Local anaesthetic'
  WHEN contains(x, 'lidocaine') THEN 'Local anaesthetic' END"""


@query("x17_category_from_substance", f"""
SELECT ord, {SUBSTANCE_CATEGORY_SQL} AS category
FROM (SELECT ord, lower(replace({MOLECULE_SQL}, '+', ' ')) AS x FROM reg)""", REG)
def _x17(spark, d):
    return medicinal(registrations(spark, d)).select("ord", text.category_from_substance("substance").alias("category"))


@query("x18_short_category", r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS v FROM documents),
c AS (SELECT doc_id, v, lower(v) AS lv, trim(regexp_extract(v, '^[^.;:]*')) AS clause FROM t)
SELECT doc_id, CASE WHEN length(v) <= 48 AND NOT regexp_matches(v, '[.;:]') THEN NULLIF(v, '') ELSE COALESCE(
  CASE WHEN regexp_matches(lv, '\bdiabet') THEN 'Antidiabetic'
    WHEN regexp_matches(lv, '\bhypertension|\bhigh blood pressure|\bantihypertensive') THEN 'Antihypertensive'
    WHEN regexp_matches(lv, '\bcholesterol|\blipid|\bstatin') THEN 'Lipid-lowering'
    WHEN regexp_matches(lv, '\bpain|\banalgesi|\bantipyretic|\bfever') THEN 'Analgesic / antipyretic'
    WHEN regexp_matches(lv, '\binflamm') THEN 'Anti-inflammatory'
    WHEN regexp_matches(lv, '\bantibacterial|\bantibiotic') THEN 'Antibiotic'
    WHEN regexp_matches(lv, '\bpsychosis|\bschizophrenia|\bbipolar|\bantipsychotic') THEN 'Antipsychotic'
    WHEN regexp_matches(lv, '\boveractive bladder|\burinary urgency|\burolog') THEN 'Overactive bladder medicine'
    WHEN regexp_matches(lv, '\bglaucoma|\bintraocular pressure') THEN 'Glaucoma medicine'
    WHEN regexp_matches(lv, '\blocal anaesthetic|\blocal anesthetic|\banaesthesia|\banesthesia') THEN 'Local anaesthetic'
    WHEN regexp_matches(lv, '\bcancer|\boncology|\bneoplasm') THEN 'Oncology medicine'
    WHEN regexp_matches(lv, '\basthma|\bcopd|\bbronchodilator|\brespiratory') THEN 'Respiratory medicine'
    WHEN regexp_matches(lv, '\bthromb|\bcoagul|\bplatelet') THEN 'Antithrombotic' END,
  NULLIF(trim(left(array_to_string(string_split(clause, ' ')[1:6], ' '), 48)), '')) END AS category
FROM c""")
def _x18(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", text.short_category("text", none, none).alias("category"))


LATIN, CYRILLIC_KEYS = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввшуз"
BACK = {"х": "kh", "ц": "ts", "ш": "sh", "я": "ya"}


@query("x19_transliterate_cyrillic", f"""
SELECT ord, translate(replace(replace(replace(replace(t, 'х', 'kh'), 'ц', 'ts'), 'ш', 'sh'), 'я', 'ya'),
  'абдефгийклмнопрстувз', 'abdefgiyklmnoprstuvz') AS latin
FROM (SELECT ord, translate(product, '{LATIN}', '{CYRILLIC_KEYS}') AS t FROM reg)""", REG)
def _x19(spark, d):
    local = F.translate("product", LATIN, CYRILLIC_KEYS)
    return registrations(spark, d).select("ord", english.transliterate_cyrillic(local).alias("latin"))


@query("x20_translate_phrases", """
SELECT ord, replace(concat(substance, ' ', CASE WHEN contains(product, 'tablets') THEN 'tablets'
  WHEN contains(product, 'capsules') THEN 'capsules' ELSE 'solution' END, ' film-coated'), '  ', ' ') AS english FROM reg""", REG)
def _x20(spark, d):
    p = F.col("product")
    local = F.concat(
        "substance", F.lit(" "),
        F.when(p.contains("tablets"), "Таблетки").when(p.contains("capsules"), "капсулы").otherwise("РАСТВОР"),
        F.lit(" пленочной оболочкой"),
    )
    return registrations(spark, d).select("ord", english.translate_phrases(local).alias("english"))


@query("x21_english_text")
def _x21(spark, d):
    return table(spark, d, "documents").select("doc_id", english.english_text("text").alias("english"))


@query("x22_english_row", """
SELECT ord, source, substance, trim(product) AS product, company, CASE WHEN contains(product, 'capsules') THEN 'capsule' ELSE dosage END AS dosage_form
FROM (SELECT *, CASE WHEN contains(product, 'tablets') THEN 'tablets prolonged-release' ELSE 'cream' END AS dosage FROM reg)""", REG)
def _x22(spark, d):
    p = F.col("product")
    form = (
        F.when(p.contains("capsules"), "Капсула").when(p.contains("tablets"), "таблетки пролонгированного высвобождения")
        .otherwise("КРЕМ")
    )
    reg = registrations(spark, d).select("ord", "source", "substance", "product", "company").withColumn("dosage_form", form)
    return english.english_row(reg)


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


REGION_SQL = f"""CASE WHEN c IN ({_in(dims.EU_COUNTRIES)}) THEN 'EU' WHEN c = 'United Kingdom' THEN 'UK' WHEN c = 'United States' THEN 'US'
  WHEN c = 'Canada' THEN 'CA' WHEN c = 'Australia' THEN 'AU' WHEN c = 'New Zealand' THEN 'NZ'
  WHEN c IN ({_in(dims.AFRICA_COUNTRIES)}) THEN 'AF' WHEN c IN ({_in(dims.MIDDLE_EAST_COUNTRIES)}) THEN 'ME'
  WHEN c = 'Switzerland' THEN 'CH' WHEN c = 'Japan' THEN 'JP' WHEN c = 'Russia' THEN 'RU'
  WHEN c IN ({_in(dims.ASIA_COUNTRIES)}) THEN 'AS' ELSE 'Global' END"""
REAL_COUNTRY_SQL = """CASE MOD(n_nationkey, 9) WHEN 0 THEN 'Germany' WHEN 1 THEN 'Egypt' WHEN 2 THEN 'Cyprus' WHEN 3 THEN 'Israel'
  WHEN 4 THEN 'Japan' WHEN 5 THEN 'Brazil' WHEN 6 THEN 'India' WHEN 7 THEN 'United Kingdom' ELSE 'Nigeria' END"""


def with_real_country(spark, d) -> DataFrame:
    """Suppliers with a real country chosen by their nation."""
    names = ["Germany", "Egypt", "Cyprus", "Israel", "Japan", "Brazil", "India", "United Kingdom", "Nigeria"]
    supplier = table(spark, d, "supplier")
    return supplier.withColumn("c", F.get(F.array(*[F.lit(n) for n in names]), F.col("s_nationkey") % 9))


@query("x23_country_region", f"SELECT s_suppkey, c, {REGION_SQL} AS region FROM (SELECT s_suppkey, {REAL_COUNTRY_SQL.replace('n_nationkey', 's_nationkey')} AS c FROM supplier)")
def _x23(spark, d):
    return with_real_country(spark, d).select("s_suppkey", "c", links.country_region("c").alias("region"))


@query("x24_region_for_country", """
SELECT ord, CASE lower(trim(country)) WHEN 'united kingdom' THEN 'UK' WHEN 'uk' THEN 'UK' WHEN 'united states' THEN 'US'
  WHEN 'usa' THEN 'US' WHEN 'us' THEN 'US' WHEN 'canada' THEN 'CA' WHEN 'european union' THEN 'EU' WHEN 'eu' THEN 'EU' END AS region,
  CASE WHEN region = 'AMERICA' THEN 'US' WHEN region = 'EUROPE' THEN 'EU' END AS alias_region FROM reg""", REG)
def _x24(spark, d):
    alias = F.when(F.col("region") == "AMERICA", " USA ").when(F.col("region") == "EUROPE", "European Union")
    return registrations(spark, d).select(
        "ord", links.region_for_country("country").alias("region"), links.region_for_country(alias).alias("alias_region")
    )


@query("x25_lookup_url", f"""
SELECT s_suppkey, CASE c WHEN 'Germany' THEN 'https://www.ema.europa.eu/en/search?search_api_fulltext=' || q
  WHEN 'Cyprus' THEN 'https://www.ema.europa.eu/en/search?search_api_fulltext=' || q
  WHEN 'United Kingdom' THEN 'https://products.mhra.gov.uk/search/?search=' || q || '&page=1'
  WHEN 'Brazil' THEN 'https://www.google.com/search?q=Brazil%20medicine%20register%20' || q
  WHEN 'Egypt' THEN 'https://edaegypt.gov.eg/' WHEN 'Israel' THEN 'https://israeldrugs.health.gov.il/'
  WHEN 'Japan' THEN 'https://www.pmda.go.jp/files/000278243.pdf'
  WHEN 'India' THEN 'https://cdsco.gov.in/opencms/opencms/en/Approval_new/FDC-New-Drugs-Marketing/'
  ELSE 'https://registration.nafdac.gov.ng/' END AS url
FROM (SELECT s_suppkey, {REAL_COUNTRY_SQL.replace('n_nationkey', 's_nationkey')} AS c,
             replace(replace(s_name, ' ', '%20'), '#', '%23') AS q FROM supplier)""")
def _x25(spark, d):
    return with_real_country(spark, d).select("s_suppkey", links.lookup_url("s_name", "c").alias("url"))


URLS_SQL = """urls AS (SELECT ord, source, CASE WHEN MOD(ord, 3) = 0 THEN 'https://r.test/P/' || ord || '/' END AS product_url,
  CASE WHEN MOD(ord, 2) = 0 THEN 'https://r.test/p/' || ord END AS smpc_url,
  CASE WHEN MOD(ord, 5) < 3 THEN 'https://r.test/pil/' || MOD(ord, 7) END AS pil_url,
  CASE WHEN MOD(ord, 7) < 4 THEN 'https://r.test/pil/' || MOD(ord, 5) END AS assessment_report_url,
  'https://r.test/s' AS source_url, CASE MOD(ord, 4) WHEN 0 THEN 'spc' WHEN 1 THEN 'PAR' END AS document_type FROM reg)"""


def with_urls(reg: DataFrame) -> DataFrame:
    """F-REG with link columns, present on some rows and sometimes equal to each other."""
    o = F.col("ord")

    def link(path, key):
        return F.concat(F.lit("https://r.test/" + path), key.cast("string"))

    return reg.withColumns({
        "product_url": F.when(o % 3 == 0, F.concat(link("P/", o), F.lit("/"))),
        "smpc_url": F.when(o % 2 == 0, link("p/", o)),
        "pil_url": F.when(o % 5 < 3, link("pil/", o % 7)),
        "assessment_report_url": F.when(o % 7 < 4, link("pil/", o % 5)),
        "source_url": F.lit("https://r.test/s"),
        "document_type": F.when(o % 4 == 0, "spc").when(o % 4 == 1, "PAR"),
    })


@query("x26_distinct_url", """
SELECT ord, CASE WHEN COALESCE(lower(rtrim(product_url, '/')) IN (lower(rtrim(COALESCE(smpc_url, ''), '/')), lower(rtrim(COALESCE(pil_url, ''), '/'))), FALSE)
  THEN NULL ELSE product_url END AS url FROM urls""", REG + ", " + URLS_SQL)
def _x26(spark, d):
    df = with_urls(registrations(spark, d))
    return df.select("ord", links.distinct_url(F.col("product_url"), F.col("smpc_url"), F.col("pil_url")).alias("url"))


DOC_LINKS_SQL = """
s AS (SELECT *, COALESCE(smpc_url, CASE WHEN upper(document_type) IN ('SPC', 'SMPC') THEN product_url END) AS smpc,
        lower(rtrim(product_url, '/')) AS pk, lower(rtrim(pil_url, '/')) AS lk, lower(rtrim(assessment_report_url, '/')) AS ak FROM urls),
p AS (SELECT *, CASE WHEN lk = COALESCE(lower(rtrim(smpc, '/')), '') THEN NULL ELSE pil_url END AS pil FROM s),
a AS (SELECT *, CASE WHEN ak IN (COALESCE(lower(rtrim(smpc, '/')), ''), COALESCE(lk, '')) THEN NULL ELSE assessment_report_url END AS report,
        CASE WHEN ak IN (COALESCE(lower(rtrim(smpc, '/')), ''), COALESCE(lower(rtrim(pil, '/')), '')) THEN NULL ELSE assessment_report_url END AS report2,
        CASE WHEN pk IN (COALESCE(lower(rtrim(smpc_url, '/')), ''), COALESCE(lk, ''), COALESCE(ak, '')) THEN NULL ELSE product_url END AS own FROM p)"""


@query("x27_document_urls", """
SELECT ord, COALESCE(own, source_url) AS details, smpc, pil, COALESCE(pil, report2) AS pil_or_report, report FROM a""",
       REG + ", " + URLS_SQL + ", " + DOC_LINKS_SQL.strip())
def _x27(spark, d):
    df = with_urls(registrations(spark, d))
    return df.select(
        "ord", links.product_details_url(df).alias("details"), links.smpc_url(df).alias("smpc"),
        links.pil_url(df).alias("pil"), links.pil_or_assessment_url(df).alias("pil_or_report"),
        links.assessment_url(df).alias("report"),
    )


@query("x31_infer_document_type", """
SELECT ord, COALESCE(document_type, CASE WHEN smpc_url IS NOT NULL THEN 'SPC' WHEN pil_url IS NOT NULL THEN 'PIL'
  WHEN assessment_report_url IS NOT NULL THEN 'Assessment report' END) AS kind FROM urls""", REG + ", " + URLS_SQL)
def _x31(spark, d):
    df = with_urls(registrations(spark, d))
    return df.select("ord", links.infer_document_type(df).alias("kind"))


@query("x4_missing_reason", """
SELECT ord, CASE WHEN source = 'Brand#1' THEN 'Product record not extracted' ELSE 'Pending document enrichment' END AS pack_size,
  CASE WHEN source = 'Brand#1' THEN 'Product record not extracted' WHEN source = 'Brand#2' THEN 'Not applicable for this source'
       ELSE 'Pending document enrichment' END AS smpc_url,
  COALESCE(atc_code, CASE WHEN source = 'Brand#1' THEN 'Product record not extracted' ELSE 'Not supplied by regulator' END) AS atc_code
FROM reg""", REG)
def _x4(spark, d):
    df = registrations(spark, d).withColumns({
        "source_url": F.lit("https://r.test/s"),
        "connector_mode": F.when(F.col("source") == "Brand#1", "manual_registry"),
        "source": F.when(F.col("source") == "Brand#2", "Health Canada").otherwise(F.col("source")),
    })
    return df.select(
        "ord", links.field_value(df, "pack_size", F.lit(None).cast("string")).alias("pack_size"),
        links.field_value(df, "smpc_url", F.lit("  ")).alias("smpc_url"),
        links.field_value(df, "atc_code", F.col("atc_code")).alias("atc_code"),
    )


MAKERS_SQL = """makers AS (SELECT ord, company, country, CASE MOD(ord, 4) WHEN 0 THEN company || ' Ltd'
  WHEN 1 THEN company || ' Ltd; Maker ' || substance WHEN 2 THEN 'Maker ' || substance || ' GmbH ;' END AS manufacturer_name,
  CASE WHEN MOD(ord, 3) = 0 THEN country ELSE 'Germany' END AS manufacturer_country,
  CASE WHEN MOD(ord, 5) = 0 THEN 'leaflet' END AS manufacturer_source,
  CASE WHEN MOD(ord, 2) = 0 THEN company || ' Inc' ELSE 'Trader ' || substance END AS sponsor, substance FROM reg)"""


def with_makers(reg: DataFrame) -> DataFrame:
    """F-REG with manufacturer and sponsor columns."""
    o = F.col("ord")
    maker = F.concat(F.lit("Maker "), "substance")
    return reg.withColumns({
        "manufacturer_name": F.when(o % 4 == 0, F.concat("company", F.lit(" Ltd")))
        .when(o % 4 == 1, F.concat("company", F.lit(" Ltd; "), maker)).when(o % 4 == 2, F.concat(maker, F.lit(" GmbH ;"))),
        "manufacturer_country": F.when(o % 3 == 0, F.col("country")).otherwise("Germany"),
        "manufacturer_source": F.when(o % 5 == 0, "leaflet"),
        "sponsor": F.when(o % 2 == 0, F.concat("company", F.lit(" Inc"))).otherwise(F.concat(F.lit("Trader "), "substance")),
    })


MAKER_NAME_SQL = "CASE MOD(ord, 4) WHEN 1 THEN 'Maker ' || substance WHEN 2 THEN 'Maker ' || substance || ' GmbH' END"


@query("x28_manufacturer_name", f"SELECT ord, {MAKER_NAME_SQL} AS maker FROM makers", REG + ", " + MAKERS_SQL)
def _x28(spark, d):
    df = with_makers(registrations(spark, d))
    return df.select("ord", company.manufacturer_name(df).alias("maker"))


@query("x29_company_display", "SELECT ord, CASE WHEN MOD(ord, 2) = 1 THEN 'Trader ' || substance END AS company FROM makers", REG + ", " + MAKERS_SQL)
def _x29(spark, d):
    df = with_makers(registrations(spark, d))
    return df.select("ord", company.company_display(df).alias("company"))


MAKER_COUNTRY_SQL = """CASE WHEN MOD(ord, 4) IN (1, 2) AND NOT (lower(manufacturer_country) = lower(country) AND manufacturer_source IS NULL)
  THEN manufacturer_country END"""


@query("x30_manufacturer_country", f"SELECT ord, {MAKER_COUNTRY_SQL} AS maker_country FROM makers", REG + ", " + MAKERS_SQL)
def _x30(spark, d):
    df = with_makers(registrations(spark, d))
    return df.select("ord", company.manufacturer_country(df).alias("maker_country"))


@query("x32_iso_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _x32(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "events").select("event_id", text.iso_date(stamp).alias("day"))


@query("x33_size_kb", """SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE CAST(n_chars AS INTEGER) END AS kb FROM documents""")
def _x33(spark, d):
    label = F.concat(F.col("n_chars").cast("string"), F.when(F.col("lang") == "en", " MB").otherwise(" kb"))
    return table(spark, d, "documents").select("doc_id", text.size_kb(label).alias("kb"))


@query("x34_email_phone", r"""
SELECT doc_id, NULLIF(regexp_extract(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), '') AS email,
  NULLIF(trim(regexp_replace(regexp_extract(text, '(?i)(?:Tel(?:ephone)?|Phone|Contact)[:\s]+(\+?\d[\d\s()./-]{6,}\d)', 1), '\s+', ' ', 'g')), '') AS phone
FROM documents""")
def _x34(spark, d):
    return table(spark, d, "documents").select("doc_id", text.find_email("text").alias("email"), text.find_phone("text").alias("phone"))


@query("x36_company_and_address_like", r"""
SELECT doc_id, regexp_matches(text, '(?i)\b(?:ltd|limited|plc|gmbh|kft|s\.?a\.?|b\.?v\.?|inc|llc|pharma|pharmaceuticals?|laboratories|company)\b') AS company_like,
  regexp_matches(text, '(?i)^(?:\d+|[a-z]?-?\d{3,}|floor\b|flat\b|unit\b|suite\b|building\b|street\b|road\b|avenue\b|lane\b|drive\b)') AS address_like
FROM documents""")
def _x36(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.company_like("text").alias("company_like"), text.address_like("text").alias("address_like")
    )


@query("x38_parse_row_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def _x38(spark, d):
    from ..operators.jobs import parse_row_json

    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    events = table(spark, d, "events").withColumn("row_json", broken)
    return parse_row_json(events, "k bigint").select("event_id", "row.k")


@query("x41_strip_html", r"""
SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<[^>]+>', '', 'g'), '\r\n|[\n\v\f\r]'),
  lambda x: trim(x, ' ' || chr(9) || chr(160))), lambda x: x <> ''), chr(10)) AS plain FROM pages""")
def _x41(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("plain"))


@query("x43_document_type_of", """
SELECT doc_id, CASE WHEN contains(t, 'spc') OR contains(t, 'summary of product characteristics') THEN 'SPC'
  WHEN contains(t, 'pil') OR contains(t, 'patient information leaflet') THEN 'PIL' WHEN contains(t, 'par') THEN 'PAR' END AS kind
FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def _x43(spark, d):
    return table(spark, d, "documents").select("doc_id", text.document_type_of("text").alias("kind"))


@query("x44_loose_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def _x44(spark, d):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Answer: "), "props", F.lit(" done."))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_element_at(text.loose_json(wrapped), F.lit("k")).alias("k"))


# --- Row projections ----------------------------------------------------------------------------

FULL_SQL = REG + ", " + URLS_SQL + ", " + DOC_LINKS_SQL.strip() + ", " + MAKERS_SQL + f""",
full_rows AS (SELECT r.*, a.product_url, a.smpc_url, a.pil_url, a.assessment_report_url, a.source_url, a.document_type,
    a.smpc, a.pil, a.report, a.report2, COALESCE(a.own, a.source_url) AS details, m.manufacturer_country, m.manufacturer_source,
    {MAKER_NAME_SQL.replace('ord', 'm.ord').replace('substance', 'm.substance')} AS maker,
    CASE WHEN MOD(m.ord, 4) IN (1, 2) AND NOT (lower(m.manufacturer_country) = lower(m.country) AND m.manufacturer_source IS NULL)
      THEN m.manufacturer_country END AS maker_country,
    CASE WHEN MOD(m.ord, 2) = 1 THEN 'Trader ' || m.substance END AS trader,
    trim(r.product) AS clean,
    {sql(STRENGTH_OF_SQL, 'r.product')} AS strength, {sql(FORM_SQL, 'r.product')} AS form, {sql(PACK_SQL, 'r.product')} AS pack,
    {sql(ROUTE_SQL, 'r.product')} AS route, {sql(ATC_CATEGORY_SQL, 'r.atc_code')} AS category
  FROM reg r JOIN a USING (ord) JOIN makers m USING (ord))"""


def full_rows(spark, d) -> DataFrame:
    """F-REG with links, manufacturers and sponsors."""
    return with_makers(with_urls(registrations(spark, d)))


@query("x39_display_row", """
SELECT ord, substance AS molecule, clean AS product, COALESCE(strength, 'Not supplied by regulator') AS strength,
  COALESCE(form, 'Not supplied by regulator') AS dosage_form, COALESCE(pack, 'Pending document enrichment') AS pack_size,
  COALESCE(atc_code, 'Not supplied by regulator') AS atc_code, COALESCE(category, 'Not supplied by regulator') AS therapeutic_category,
  COALESCE(trader, 'Not supplied by regulator') AS company, company AS ma_holder,
  COALESCE(maker, 'Pending document enrichment') AS manufacturer_name,
  COALESCE(maker_country, 'Pending document enrichment') AS manufacturer_country, 'Not available' AS registration_status,
  COALESCE(registration_number, 'Not available') AS registration_number, registration_date, country, region, source,
  details AS product_details_url, smpc AS smpc_url, pil AS pil_url, COALESCE(pil, report) AS pil_assessment_url,
  report AS assessment_report_url FROM full_rows""", FULL_SQL)
def _x39(spark, d):
    return rows.display_row(full_rows(spark, d))


QUALITY_SQL = """
lab AS (SELECT *, list_filter([CASE WHEN strength IS NULL THEN 'Strength' END, CASE WHEN form IS NULL THEN 'Dosage Form' END,
    CASE WHEN pack IS NULL THEN 'Pack Size' END, CASE WHEN company IS NULL THEN 'MA Holder' END,
    CASE WHEN maker IS NULL THEN 'Manufacturer Name' END, CASE WHEN maker_country IS NULL THEN 'Manufacturer Country' END,
    CASE WHEN registration_number IS NULL THEN 'Registration Number' END, CASE WHEN registration_date IS NULL THEN 'Registration Date' END,
    CASE WHEN details IS NULL THEN 'Product Details URL' END, CASE WHEN smpc IS NULL THEN 'SmPC URL' END,
    CASE WHEN pil IS NULL THEN 'PIL URL' END, CASE WHEN report IS NULL THEN 'Assessment Report URL' END],
    lambda x: x IS NOT NULL) AS missing, (smpc IS NOT NULL OR pil IS NOT NULL OR report IS NOT NULL) AS has_doc FROM full_rows),
qual AS (SELECT *, CASE WHEN len(missing) <= 3 THEN 'High' WHEN len(missing) <= 7 THEN 'Medium' ELSE 'Low' END AS data_confidence,
    CASE WHEN has_doc AND (list_contains(missing, 'Manufacturer Name') OR list_contains(missing, 'Pack Size')
           OR list_contains(missing, 'SmPC URL') OR list_contains(missing, 'PIL URL'))
         THEN 'Document parser enriched; AI review recommended for missing fields' WHEN has_doc THEN 'Document/parser enriched'
         WHEN len(missing) > 0 THEN 'Connector result; AI enrichment recommended' ELSE 'Connector result verified' END AS enrichment_status,
    CASE WHEN len(missing) = 0 THEN 'None' ELSE array_to_string(missing, ', ') END AS missing_fields,
    CASE WHEN len(missing) = 0 THEN '' ELSE 'Run AI/PDF extraction for: ' || array_to_string(missing[1:6], ', ') END AS ai_next_action FROM lab)"""


@query("q1_missing_fields", "SELECT ord, missing FROM lab", FULL_SQL + "," + QUALITY_SQL)
def _q1(spark, d):
    return quality.missing_fields(full_rows(spark, d)).select("ord", "missing")


@query("q2_quality", "SELECT ord, data_confidence, enrichment_status, missing_fields, ai_next_action FROM qual", FULL_SQL + "," + QUALITY_SQL)
def _q2(spark, d):
    names = ["data_confidence", "enrichment_status", "missing_fields", "ai_next_action"]
    return quality.attach_quality(full_rows(spark, d)).select("ord", *names)


@query("q3_attach_quality", """
SELECT ord, CASE WHEN MOD(ord, 2) = 0 THEN 'Checked' ELSE data_confidence END AS data_confidence, missing_fields FROM qual""", FULL_SQL + "," + QUALITY_SQL)
def _q3(spark, d):
    df = full_rows(spark, d).withColumn("data_confidence", F.when(F.col("ord") % 2 == 0, "Checked"))
    return quality.attach_quality(df).select("ord", "data_confidence", "missing_fields")


@query("x40_export_row", """
WITH n AS (SELECT *, COALESCE(report, 'Pending document enrichment') AS rep FROM qual)
SELECT ord, country AS "Country", region AS "Region", clean AS "Product Name", COALESCE(trader, 'Not available') AS "Company",
  clean AS "Brand Name", substance AS "Molecule", substance AS "Molecule (Active Ingredient(s))",
  COALESCE(strength, 'Not supplied by regulator') AS "Strength", COALESCE(form, 'Not supplied by regulator') AS "Dosage Form",
  COALESCE(route, 'Not available') AS "Route", COALESCE(pack, 'Pending document enrichment') AS "Pack Size",
  COALESCE(atc_code, 'Not supplied by regulator') AS "ATC Code", COALESCE(category, 'Antidiabetic') AS "Therapeutic Category",
  company AS "MA Holder Name", COALESCE(maker, 'Pending document enrichment') AS "Manufacturer Name",
  COALESCE(maker_country, 'Pending document enrichment') AS "Manufacturer Country", 'Not available' AS "Registration Status",
  COALESCE(registration_number, 'Not available') AS "Registration Number", registration_date AS "Registration Date",
  'Not available' AS "Expiry Date", details AS "Product Details", 'Not available' AS "PDF URL",
  COALESCE(smpc, 'Pending document enrichment') AS "SMPC URL", COALESCE(pil_url, 'Pending document enrichment') AS "PIL URL",
  COALESCE(pil, report2, 'Not available') AS "PIL / Assessment Report", rep AS "Assessment Report URL", details AS "Manufacturer Website",
  'Not available' AS "Manufacturer Contact Us Phone Number", 'Not available' AS "Manufacturer Contact Us Email ID",
  'Not available' AS "Box Artwork", 'Not available' AS "Foil Artwork", COALESCE(pil, report2, 'Not available') AS "Insert / PIL artwork",
  COALESCE(smpc, 'Not available') AS "SMPC", source AS "Source", source_url AS "Source URL",
  COALESCE(document_type, CASE WHEN smpc_url IS NOT NULL THEN 'SPC' WHEN pil_url IS NOT NULL THEN 'PIL'
    WHEN assessment_report_url IS NOT NULL THEN 'Assessment report' END, 'Not available') AS "Document Type",
  data_confidence AS "Data Confidence", enrichment_status AS "Enrichment Status", missing_fields AS "Missing Fields",
  COALESCE(NULLIF(ai_next_action, ''), 'Not available') AS "AI Next Action", '2024-01-01T00:00:00' AS "Last Checked" FROM n""",
       FULL_SQL + "," + QUALITY_SQL)
def _x40(spark, d):
    return rows.export_row(
        full_rows(spark, d), F.lit("query"), F.lit("Antidiabetic"), F.lit("2024-01-01T00:00:00")
    )


# --- Identity -----------------------------------------------------------------------------------

RESULT_KEY_SQL = "lower(trim(source)), lower(trim(product)), lower(trim(country)), lower(trim(COALESCE(registration_number, '')))"
REG_COLUMNS = "ord, substance, product, company, country, region, source, registration_number, registration_date, atc_code"


@query("g1_dedupe_keep_first", f"""
SELECT {REG_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY {RESULT_KEY_SQL} ORDER BY ord) AS rn FROM reg) WHERE rn = 1""", REG)
def _g1(spark, d):
    return identity.dedupe_keep_first(registrations(spark, d))


@query("g2_dedupe_by_url_key", """
SELECT ord, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(product), lower(country), lower(COALESCE(registration_number, '')), url ORDER BY ord) AS rn
  FROM (SELECT *, 'https://r.test/' || substance AS url FROM reg) WHERE product <> '') WHERE rn = 1""", REG)
def _g2(spark, d):
    reg = registrations(spark, d).withColumn("url", F.concat(F.lit("https://R.test/"), "substance"))
    return identity.dedupe_by_url_key(reg).select("ord", F.lower("url").alias("url"))


@query("g3_merge_cached_live", f"""
WITH cached AS (SELECT ord, source, product, country, registration_number, atc_code, CAST(NULL AS VARCHAR) AS strength FROM reg),
live AS (SELECT ord - 50 AS ord, CASE WHEN contains(product, 'oral') THEN 'Live' ELSE source END AS source, product, country,
    registration_number, 'N05AX' AS atc_code, CASE WHEN MOD(ord, 2) = 0 THEN 'S' || ord END AS strength FROM reg),
c AS (SELECT *, {RESULT_KEY_SQL.replace("lower(trim(source))", "lower(trim(source)) AS k1").replace("lower(trim(product))", "lower(trim(product)) AS k2").replace("lower(trim(country))", "lower(trim(country)) AS k3").replace("lower(trim(COALESCE(registration_number, '')))", "lower(trim(COALESCE(registration_number, ''))) AS k4")} FROM cached),
l AS (SELECT *, lower(trim(source)) AS k1, lower(trim(product)) AS k2, lower(trim(country)) AS k3, lower(trim(COALESCE(registration_number, ''))) AS k4 FROM live),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3, k4 ORDER BY ord) AS rn FROM c) WHERE rn = 1),
l1 AS (SELECT k1, k2, k3, k4, min(ord) AS ord, min_by(atc_code, CASE WHEN atc_code IS NOT NULL THEN ord END) AS atc_code,
    min_by(strength, CASE WHEN strength IS NOT NULL THEN ord END) AS strength FROM l GROUP BY ALL)
SELECT COALESCE(c1.ord, l1.ord + 4611686018427387904) AS ord, CASE WHEN c1.ord IS NULL THEN 'live' ELSE 'cached' END AS origin,
  COALESCE(c1.atc_code, l1.atc_code) AS atc_code, l1.strength FROM c1 FULL JOIN l1 USING (k1, k2, k3, k4)""", REG)
def _g3(spark, d):
    reg = registrations(spark, d).select("ord", "source", "product", "country", "registration_number", "atc_code")
    live = reg.withColumns({
        "ord": F.col("ord") - 50,  # overlaps the cached numbers
        "source": F.when(F.col("product").contains("oral"), "Live").otherwise(F.col("source")),
        "atc_code": F.lit("N05AX"),
        "strength": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("S"), F.col("ord").cast("string"))),
    })
    return identity.merge_cached_live(reg, live).select("ord", "origin", "atc_code", "strength")


@query("g4_propagate_by_molecule", """
SELECT ord, COALESCE(atc_code, first_value(atc_code IGNORE NULLS) OVER (PARTITION BY lower(trim(substance)) ORDER BY ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS atc_code FROM reg""", REG)
def _g4(spark, d):
    return identity.propagate_by_molecule(registrations(spark, d)).select("ord", "atc_code")


@query("g5_merge_by_registration", """
SELECT ord, COALESCE(smpc_url, CASE WHEN reg IS NOT NULL THEN first_value(smpc_url IGNORE NULLS) OVER w END) AS smpc_url,
  COALESCE(pil_url, CASE WHEN reg IS NOT NULL THEN first_value(pil_url IGNORE NULLS) OVER w END) AS pil_url
FROM (SELECT u.ord, u.smpc_url, u.pil_url, left(r.registration_number, 7) AS reg FROM urls u JOIN reg r USING (ord))
WINDOW w AS (PARTITION BY reg ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", REG + ", " + URLS_SQL)
def _g5(spark, d):
    df = with_urls(registrations(spark, d)).withColumn("registration_number", F.substring("registration_number", 1, 7))
    return identity.merge_by_registration(df).select("ord", "smpc_url", "pil_url")


@query("g6_dedupe_uk", """
SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY COALESCE(registration_number, ''), COALESCE(document_type, '') ORDER BY ord) AS rn
  FROM (SELECT u.ord, r.registration_number, u.document_type FROM urls u JOIN reg r USING (ord))) WHERE rn = 1""", REG + ", " + URLS_SQL)
def _g6(spark, d):
    return identity.dedupe_uk(with_urls(registrations(spark, d))).select("ord")


# --- Counts and coverage ------------------------------------------------------------------------


@query("a1_count_by", "SELECT COALESCE(atc_code, 'Unknown') AS atc_code, country, count(*) AS count FROM reg GROUP BY ALL", REG)
def _a1(spark, d):
    return coverage.count_by(registrations(spark, d), "atc_code", ("country",))


@query("a2_coverage_by_source", f"""
SELECT source AS "Source", count(*) AS "Records", count({sql(STRENGTH_OF_SQL)}) || '/' || count(*) AS "Strength",
  count({sql(FORM_SQL)}) || '/' || count(*) AS "Dosage Form", count({sql(ROUTE_SQL)}) || '/' || count(*) AS "Route",
  count({sql(PACK_SQL)}) || '/' || count(*) AS "Pack Size", count(atc_code) || '/' || count(*) AS "ATC Code",
  count(*) || '/' || count(*) AS "Therapeutic Category", '0/' || count(*) AS "SMPC URL", '0/' || count(*) AS "PIL URL",
  '0/' || count(*) AS "Assessment Report", '0/' || count(*) AS "Expiry Date" FROM reg GROUP BY source""", REG)
def _a2(spark, d):
    return coverage.coverage_by_source(registrations(spark, d))


@query("a3_sample_counts", """
SELECT sample, (SELECT count(*) FROM reg WHERE contains(lower(substance), sample) OR contains(lower(product), sample)) AS records,
  (SELECT count(*) FROM reg) AS total FROM (SELECT unnest(['ring', 'bolt', 'blue', 'metformin']) AS sample)""", REG)
def _a3(spark, d):
    return coverage.sample_counts(registrations(spark, d), ["ring", "bolt", "blue", "metformin"])


@query("a4_default_category", f"""
WITH c AS (SELECT {sql(ATC_CATEGORY_SQL, 'atc_code')} AS cat, ord FROM reg)
SELECT cat AS value FROM c WHERE cat IS NOT NULL GROUP BY cat ORDER BY count(*) DESC, min(ord) LIMIT 1""", REG)
def _a4(spark, d):
    reg = registrations(spark, d)
    return coverage.default_category(reg.withColumn("substance", F.lit(None).cast("string")))


@query("a5_distinct_values", "SELECT DISTINCT country FROM reg WHERE trim(country) <> ''", REG)
def _a5(spark, d):
    return coverage.distinct_values(registrations(spark, d), "country")


@query("a6_country_coverage", f"""
SELECT count(DISTINCT CASE WHEN c IN ({_in(dims.EU_COUNTRIES)}) THEN c END) AS present, 27 AS total,
  count(DISTINCT CASE WHEN c IN ({_in(dims.EU_COUNTRIES)}) THEN c END) = 27 AS complete
FROM (SELECT {REAL_COUNTRY_SQL.replace('n_nationkey', 's_nationkey')} AS c FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)""")
def _a6(spark, d):
    supplied = with_real_country(spark, d).join(table(spark, d, "lineitem").select("l_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return coverage.country_coverage(supplied.select(F.col("c").alias("country"), F.lit("EU").alias("region")))


@query("a10_page_summary", """
SELECT count(*) AS total, count(*) FILTER (source <> 'Brand#3') AS product_rows, count(*) FILTER (source = 'Brand#3') AS registry_rows,
  CASE WHEN count(*) > 50 THEN 51 ELSE 0 END AS first_shown, least(count(*), 100) AS last_shown FROM reg""", REG)
def _a10(spark, d):
    reg = registrations(spark, d).withColumn("connector_mode", F.when(F.col("source") == "Brand#3", "manual_registry"))
    return coverage.page_summary(reg, page=2, size=50)


@query("k4_provenance", """
SELECT 'ring' AS "Query", '2024-01-01T00:00:00' AS "Generated At", count(*) AS "Record Count",
  (SELECT string_agg(source, ', ' ORDER BY source) FROM (SELECT DISTINCT source FROM reg)) AS "Sources", 'Records found' AS "Status" FROM reg""", REG)
def _k4(spark, d):
    return coverage.provenance(registrations(spark, d), "ring", F.lit("2024-01-01T00:00:00"))


# --- Ranking and paging -------------------------------------------------------------------------

PICKED = ["Brand#9", "brand#4", "Brand#11"]
RANK_SQL = "CASE lower(source) WHEN 'brand#9' THEN 0 WHEN 'brand#4' THEN 1 WHEN 'brand#11' THEN 2 ELSE 3 END"


@query("w1_first_non_null_over", """
SELECT ord, first_value(atc_code IGNORE NULLS) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_atc FROM reg""", REG)
def _w1(spark, d):
    found = identity.first_in_group(registrations(spark, d), {"source": F.col("source")}, ["atc_code"])
    return found.select("ord", F.col("first_atc_code").alias("first_atc"))


@query("w2_rank_source", f"SELECT ord, {RANK_SQL} AS rank FROM reg", REG)
def _w2(spark, d):
    return registrations(spark, d).select("ord", ordering.rank_source("source", PICKED).alias("rank"))


@query("w3_document_rank", """
SELECT ord FROM (SELECT u.ord, row_number() OVER (PARTITION BY COALESCE(r.registration_number, '') ORDER BY
  CASE WHEN u.smpc_url IS NOT NULL OR u.pil_url IS NOT NULL THEN 0 ELSE 1 END,
  CASE upper(u.document_type) WHEN 'SPC' THEN 0 WHEN 'PIL' THEN 1 WHEN 'PAR' THEN 2 ELSE 9 END, r.product, u.ord) AS rn
  FROM urls u JOIN reg r USING (ord)) WHERE rn = 1""", REG + ", " + URLS_SQL)
def _w3(spark, d):
    return ordering.best_document(with_urls(registrations(spark, d))).select("ord")


@query("w4_page_of_queries", """
WITH q AS (SELECT * FROM (VALUES ('q1', 'ring', 2, 20), ('q2', 'bolt', 999999, 5), ('q3', 'small', 3, 500), ('q4', 'i', 40, 200)) t(query_id, s, page, page_size)),
h AS (SELECT q.query_id, q.page, least(greatest(q.page_size, 10), 200) AS size, reg.ord, reg.product,
        row_number() OVER (PARTITION BY q.query_id ORDER BY lower(reg.product), reg.ord) AS rank, count(*) OVER (PARTITION BY q.query_id) AS n
      FROM q JOIN reg ON contains(lower(reg.substance), q.s) OR contains(lower(reg.product), q.s))
SELECT query_id, ord, rank FROM h WHERE rank > (least(page, ceil(n / size)) - 1) * size AND rank <= least(page, ceil(n / size)) * size""", REG)
def _w4(spark, d):
    from ..operators.search import search_few

    wanted = [("q1", "ring", 2, 20), ("q2", "bolt", 999999, 5), ("q3", "small", 3, 500), ("q4", "i", 40, 200)]
    asked = spark.createDataFrame(wanted, "query_id string, s string, page long, page_size long")
    hits = search_few([(q, s) for q, s, _, _ in wanted], registrations(spark, d).select("ord", "substance", "product"))
    order = [F.lower("product"), F.col("ord")]
    return ordering.page_of_queries(hits, asked, order).select("query_id", "ord", "rank")


@query("w5_order_sources_for_job", """
SELECT source, row_number() OVER (ORDER BY source IN ('MHRA', 'EMA'), lower(source)) AS rank
FROM (SELECT DISTINCT CASE source WHEN 'Brand#1' THEN 'MHRA' WHEN 'Brand#2' THEN 'EMA' ELSE source END AS source FROM reg)""", REG)
def _w5(spark, d):
    source = F.col("source")
    named = F.when(source == "Brand#1", "MHRA").when(source == "Brand#2", "EMA").otherwise(source)
    names = registrations(spark, d).select(named.alias("source")).distinct()
    return ordering.rank_within(names, [], [F.col("source").isin(*dims.SLOW_SOURCES), F.lower("source")])


@query("l1_sort_default", f"""
SELECT ord, row_number() OVER (ORDER BY {RANK_SQL}, country, product, ord) AS rank FROM reg""", REG)
def _l1(spark, d):
    reg = registrations(spark, d).select("ord", "source", "country", "product")
    return ordering.rank_within(reg, [], ordering.default_order(reg, PICKED)).select("ord", "rank")


@query("l2_sort_by", "SELECT ord, row_number() OVER (ORDER BY lower(company) DESC, ord) AS rank FROM reg", REG)
def _l2(spark, d):
    reg = registrations(spark, d).select("ord", "company")
    return ordering.rank_within(reg, [], ordering.sort_order(reg, "ma_holder", "desc")).select("ord", "rank")


@query("l3_top_n", "SELECT source, ord, rank FROM (SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY ord) AS rank FROM reg) WHERE rank <= 25", REG)
def _l3(spark, d):
    reg = registrations(spark, d).select("source", "ord")
    return ordering.top_within(reg, ["source"], [F.col("ord")], 25)


@query("l4_paginate", "SELECT ord FROM reg ORDER BY lower(product), ord LIMIT 200 OFFSET 400", REG)
def _l4(spark, d):
    reg = registrations(spark, d).select("ord", "product")
    return ordering.paginate(reg, [F.lower("product"), F.col("ord")], page=3, size=5000).select("ord")
