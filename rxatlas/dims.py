"""Dimension data: fixed lists and maps of the product domain, and small DataFrames built from them.

Everything here is bounded by construction (at most a few hundred rows), so a dimension may be
broadcast, or folded into an expression, without a size check.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# --- Fixed values: country lists -------------------------------------------------------------

EU_COUNTRIES = [
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech Republic", "Denmark", "Estonia", "Finland",
    "France", "Germany", "Greece", "Hungary", "Ireland", "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta",
    "Netherlands", "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden",
]
EEA_COUNTRIES = ["Norway", "Iceland", "Liechtenstein"]
UK_COUNTRIES = ["United Kingdom"]
AFRICA_COUNTRIES = [
    "Algeria", "Angola", "Benin", "Botswana", "Burkina Faso", "Burundi", "Cabo Verde", "Cameroon",
    "Central African Republic", "Chad", "Comoros", "Democratic Republic of the Congo", "Djibouti", "Egypt",
    "Equatorial Guinea", "Eritrea", "Eswatini", "Ethiopia", "Gabon", "Gambia", "Ghana", "Guinea", "Guinea-Bissau",
    "Ivory Coast", "Kenya", "Lesotho", "Liberia", "Libya", "Madagascar", "Malawi", "Mali", "Mauritania", "Mauritius",
    "Morocco", "Mozambique", "Namibia", "Niger", "Nigeria", "Republic of the Congo", "Rwanda",
    "Sao Tome and Principe", "Senegal", "Seychelles", "Sierra Leone", "Somalia", "South Africa", "South Sudan",
    "Sudan", "Tanzania", "Togo", "Tunisia", "Uganda", "Zambia", "Zimbabwe",
]
MIDDLE_EAST_COUNTRIES = [
    "Bahrain", "Cyprus", "Egypt", "Iran", "Iraq", "Israel", "Jordan", "Kuwait", "Lebanon", "Oman", "Palestine",
    "Qatar", "Saudi Arabia", "Syria", "Turkey", "United Arab Emirates", "Yemen",
]
ASIA_COUNTRIES = [
    "Afghanistan", "Armenia", "Azerbaijan", "Bahrain", "Bangladesh", "Bhutan", "Brunei", "Cambodia", "China",
    "Cyprus", "Georgia", "Hong Kong", "India", "Indonesia", "Iran", "Iraq", "Israel", "Japan", "Jordan", "Kazakhstan",
    "Kuwait", "Kyrgyzstan", "Laos", "Lebanon", "Malaysia", "Maldives", "Mongolia", "Myanmar", "Nepal", "North Korea",
    "Oman", "Pakistan", "Palestine", "Philippines", "Qatar", "Saudi Arabia", "Singapore", "South Korea", "Sri Lanka",
    "Syria", "Taiwan", "Tajikistan", "Thailand", "Timor-Leste", "Turkmenistan", "Ukraine", "United Arab Emirates",
    "Uzbekistan", "Vietnam", "Yemen",
]
GLOBAL_COUNTRIES = [
    "Afghanistan", "Albania", "Algeria", "Andorra", "Angola", "Argentina", "Armenia", "Australia", "Austria",
    "Azerbaijan", "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium", "Belize", "Benin", "Bhutan",
    "Bolivia", "Bosnia and Herzegovina", "Botswana", "Brazil", "Brunei", "Bulgaria", "Burkina Faso", "Burundi",
    "Cambodia", "Cameroon", "Canada", "Chile", "China", "Colombia", "Costa Rica", "Croatia", "Cyprus",
    "Czech Republic", "Denmark", "Dominican Republic", "Ecuador", "Egypt", "El Salvador", "Estonia", "Ethiopia",
    "Finland", "France", "Georgia", "Germany", "Ghana", "Greece", "Guatemala", "Honduras", "Hong Kong", "Hungary",
    "Iceland", "India", "Indonesia", "Ireland", "Israel", "Italy", "Japan", "Jordan", "Kazakhstan", "Kenya", "Kuwait",
    "Latvia", "Lebanon", "Lithuania", "Luxembourg", "Malaysia", "Malta", "Mexico", "Morocco", "Netherlands",
    "New Zealand", "Nigeria", "Norway", "Pakistan", "Panama", "Paraguay", "Peru", "Philippines", "Poland", "Portugal",
    "Qatar", "Romania", "Saudi Arabia", "Singapore", "Slovakia", "Slovenia", "South Africa", "South Korea", "Spain",
    "Sri Lanka", "Sweden", "Switzerland", "Taiwan", "Thailand", "Tunisia", "Turkey", "Ukraine",
    "United Arab Emirates", "United Kingdom", "United States", "Uruguay", "Vietnam", "Russia",
]
REGION_OPTIONS = ["ALL", "EU", "UK", "US", "CA", "AU", "NZ", "AF", "ME", "AS", "CH", "JP", "RU"]
SINGLE_COUNTRY_REGIONS = {
    "UK": "United Kingdom", "US": "United States", "CA": "Canada", "AU": "Australia",
    "NZ": "New Zealand", "CH": "Switzerland", "JP": "Japan",
}
REGION_NAMES = {"US": ("United States", "FDA"), "UK": ("United Kingdom", "MHRA"), "EU": ("European Union", "EMA")}
# Countries looked for in leaflet texts; "The Netherlands" is reported as "Netherlands".
DOCUMENT_COUNTRIES = [
    "Australia", "Austria", "Belgium", "Bulgaria", "Canada", "Croatia", "Cyprus", "Czech Republic", "Denmark",
    "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Iceland", "Ireland", "Italy", "Japan", "Latvia",
    "Lithuania", "Luxembourg", "Malta", "Netherlands", "Norway", "Poland", "Portugal", "Romania", "Slovakia",
    "Slovenia", "Spain", "Sweden", "Switzerland", "The Netherlands", "United Kingdom", "United States",
]

MULTI_COUNTRY_REGIONS = {"AF": AFRICA_COUNTRIES, "ME": MIDDLE_EAST_COUNTRIES, "AS": ASIA_COUNTRIES}

# --- Fixed values: connectors ------------------------------------------------------------------

# name, region, countries, supports documents, enabled
CONNECTORS = [
    ("FDA", "US", ["United States"], True, True),
    ("FDA Orange Book", "US", ["United States"], False, True),
    ("FDA Purple Book", "US", ["United States"], False, True),
    ("MHRA", "UK", ["United Kingdom"], True, True),
    ("EMA", "EU", EU_COUNTRIES, True, True),
    ("EU MRI Product Index", "EU", EU_COUNTRIES, True, True),
    ("Health Canada", "CA", ["Canada"], False, True),
    ("TGA Australia", "AU", ["Australia"], True, True),
    ("Medsafe New Zealand", "NZ", ["New Zealand"], True, True),
    ("SAHPRA South Africa", "AF", ["South Africa"], False, True),
    ("FDA Ghana", "AF", ["Ghana"], False, True),
    ("SFDA Saudi Arabia", "ME", ["Saudi Arabia"], False, True),
    ("Israel Drug Registry", "ME", ["Israel"], False, True),
    ("CDSCO India", "AS", ["India"], False, True),
    ("NMPA China", "AS", ["China"], False, True),
    ("BPOM Indonesia", "AS", ["Indonesia"], False, True),
    ("NPRA Malaysia", "AS", ["Malaysia"], False, True),
    ("FDA Philippines", "AS", ["Philippines"], False, True),
    ("HSA Singapore", "AS", ["Singapore"], False, True),
    ("MFDS South Korea", "AS", ["South Korea"], False, True),
    ("Thai FDA", "AS", ["Thailand"], False, True),
    ("DAV Vietnam", "AS", ["Vietnam"], False, True),
    ("Swissmedic", "CH", ["Switzerland"], False, False),
    ("PMDA Japan", "JP", ["Japan"], False, True),
    ("Hong Kong Drug Office", "AS", ["Hong Kong"], False, True),
    ("Belgium FAMHP", "EU", ["Belgium"], True, True),
    ("France BDPM", "EU", ["France"], False, True),
    ("Ireland medicines.ie", "EU", ["Ireland"], True, True),
    ("Spain CIMA", "EU", ["Spain"], True, True),
    ("Cyprus Pharmaceutical Services", "EU", ["Cyprus"], False, True),
    ("Ukraine DRLZ", "EU", ["Ukraine"], False, True),
    ("GRLS Russia", "RU", ["Russia"], False, True),
]

# --- Fixed values: source selection -----------------------------------------------------------

DEFAULT_SOURCES = [
    "EMA", "EU MRI Product Index", "Belgium FAMHP", "France BDPM", "Ireland medicines.ie", "Spain CIMA", "MHRA",
    "FDA", "FDA Orange Book", "FDA Purple Book", "Health Canada", "TGA Australia", "Medsafe New Zealand",
    "SAHPRA South Africa", "FDA Ghana", "SFDA Saudi Arabia", "Israel Drug Registry", "CDSCO India", "NMPA China",
    "BPOM Indonesia", "NPRA Malaysia", "FDA Philippines", "HSA Singapore", "MFDS South Korea", "Thai FDA",
    "DAV Vietnam", "PMDA Japan", "Hong Kong Drug Office", "Cyprus Pharmaceutical Services", "Ukraine DRLZ",
    "GRLS Russia",
]
EU_NATIONAL_SOURCES = [
    "Belgium FAMHP", "EU MRI Product Index", "France BDPM", "Ireland medicines.ie", "Spain CIMA",
    "Cyprus Pharmaceutical Services", "Ukraine DRLZ",
]
FAST_SOURCES = ["FDA", "FDA Orange Book", "FDA Purple Book", "Spain CIMA"]
SLOW_SOURCES = [
    "GRLS Russia", "TGA Australia", "Medsafe New Zealand", "MHRA", "EMA", "EU MRI Product Index", "Belgium FAMHP",
    "Ireland medicines.ie",
]
SLOW_COUNTRY_DEFAULTS = SLOW_SOURCES + ["CDSCO India"]
SINGLE_TERM_SOURCES = ["cdsco india", "hong kong drug office"]
DOCUMENT_SKIP_SOURCES = ["BPOM Indonesia", "DAV Vietnam", "NPRA Malaysia"]
REGION_LIVE_SOURCES = {
    "AF": ["SAHPRA South Africa", "FDA Ghana"],
    "ME": ["SFDA Saudi Arabia", "Israel Drug Registry"],
    "AS": [
        "CDSCO India", "NMPA China", "BPOM Indonesia", "NPRA Malaysia", "FDA Philippines", "HSA Singapore",
        "MFDS South Korea", "Thai FDA", "DAV Vietnam", "PMDA Japan", "Hong Kong Drug Office", "Israel Drug Registry",
        "SFDA Saudi Arabia",
    ],
    "EU": EU_NATIONAL_SOURCES,
    "US": ["FDA", "FDA Orange Book", "FDA Purple Book"],
    "RU": ["GRLS Russia"],
}
COUNTRY_DEFAULT_SOURCE = {
    "Australia": "TGA Australia", "Canada": "Health Canada", "Japan": "PMDA Japan",
    "Hong Kong": "Hong Kong Drug Office", "New Zealand": "Medsafe New Zealand", "Ghana": "FDA Ghana",
    "China": "NMPA China", "India": "CDSCO India", "Indonesia": "BPOM Indonesia",
    "Israel": "Israel Drug Registry", "Malaysia": "NPRA Malaysia", "Philippines": "FDA Philippines",
    "Saudi Arabia": "SFDA Saudi Arabia", "Singapore": "HSA Singapore",
    "South Africa": "SAHPRA South Africa", "South Korea": "MFDS South Korea", "Thailand": "Thai FDA",
    "Vietnam": "DAV Vietnam", "Switzerland": "Swissmedic", "United Kingdom": "MHRA",
    "United States": "FDA", "Ukraine": "Ukraine DRLZ", "Russia": "GRLS Russia",
    "Cyprus": "Cyprus Pharmaceutical Services",
}
REGION_DEFAULT_SOURCE = {
    "AU": "TGA Australia", "CA": "Health Canada", "CH": "Swissmedic", "JP": "PMDA Japan",
    "NZ": "Medsafe New Zealand", "UK": "MHRA", "US": "FDA", "RU": "GRLS Russia",
}
LOOKUP_SOURCES = {
    "EU": ("EU National Registry", "EU national lookup fallback"),
    "AF": ("Africa Generic Registry Lookup", "Generic Africa registry lookup fallback"),
    "ME": ("Middle East Generic Registry Lookup", "Generic Middle East registry lookup fallback"),
    "AS": ("Asia Generic Registry Lookup", "Generic Asia registry lookup fallback"),
    "ALL": ("Global Generic Registry Lookup", "Generic global registry lookup fallback"),
    "": ("Regulatory Registry Lookup", "Country registry lookup fallback"),
}
GENERIC_SOURCES = [source for source, _ in LOOKUP_SOURCES.values()]
LOOKUP_ONLY = "__regional_lookup_only__"
LOOKUP_STATUS = "Country-specific live connector unavailable or no direct match - verify national register"

# --- Fixed values: registry search pages ------------------------------------------------------
# {q} stands for the percent-encoded substance.

COUNTRY_REGISTRY_URL = {
    "Egypt": "https://edaegypt.gov.eg/",
    "Ghana": "https://fdaghana.gov.gh/product-register/",
    "Kenya": "https://products.pharmacyboardkenya.org/",
    "Nigeria": "https://registration.nafdac.gov.ng/",
    "South Africa": "https://www.sahpra.org.za/registered-health-products/",
    "Saudi Arabia": "https://www.sfda.gov.sa/en/drugs-list",
    "United Arab Emirates": "https://mohap.gov.ae/en/services/registered-medical-product-directory",
    "Israel": "https://israeldrugs.health.gov.il/",
    "Jordan": "https://www.jfda.jo/",
    "Qatar": "https://www.moph.gov.qa/",
    "China": "https://english.nmpa.gov.cn/database.html",
    "India": "https://cdsco.gov.in/opencms/opencms/en/Approval_new/FDC-New-Drugs-Marketing/",
    "Indonesia": "https://cekbpom.pom.go.id/",
    "Malaysia": "https://www.npra.gov.my/index.php/my/consumers-2/maklumat/carian-produk-berdaftar-bernotifikasi.html",
    "Philippines": "https://verification.fda.gov.ph/drug_productslist.php",
    "Singapore": "https://eservice.hsa.gov.sg/prism/common/enquirepublic/SearchDRBProduct.do?action=load",
    "South Korea": "https://nedrug.mfds.go.kr/",
    "Thailand": "https://pertento.fda.moph.go.th/FDA_SEARCH_DRUG/SEARCH_DRUG/FRM_SEARCH_DRUG.aspx",
    "Vietnam": "https://dichvucong.dav.gov.vn/congbothuoc/index",
    "Japan": "https://www.pmda.go.jp/files/000278243.pdf",
    "Hong Kong": "https://www.drugoffice.gov.hk/eps/do/en/consumer/search_drug_database2.html",
    "Ukraine": "http://www.drlz.com.ua/ibp/ddsite.nsf/all/shlist?opendocument",
    "Russia": "https://grls.rosminzdrav.ru/grls.aspx",
    "Cyprus": "https://www.phs.moh.gov.cy/human-search/home.xhtml?lang=en",
}
COUNTRY_SEARCH_URL = {
    "EU": "https://www.ema.europa.eu/en/search?search_api_fulltext={q}",
    "United Kingdom": "https://products.mhra.gov.uk/search/?search={q}&page=1",
    "United States": "https://api.fda.gov/drug/label.json?search=openfda.substance_name:{q}",
    "Canada": "https://health-products.canada.ca/dpd-bdpp/index-eng.jsp",
    "Australia": "https://www.tga.gov.au/resources/artg?keywords={q}",
    "New Zealand": "https://www.medsafe.govt.nz/DbSearch/",
    "Switzerland": "https://www.swissmedic.ch/swissmedic/en/home/services/listen_neu.html",
}
OTHER_SEARCH_URL = "https://www.google.com/search?q="

# Regional registers read as pages or lists: source | country | region | search page.
REGIONAL_REGISTERS = [
    ("SAHPRA South Africa", "South Africa", "AF", COUNTRY_REGISTRY_URL["South Africa"]),
    ("SFDA Saudi Arabia", "Saudi Arabia", "ME", COUNTRY_REGISTRY_URL["Saudi Arabia"]),
    ("FDA Ghana", "Ghana", "AF", COUNTRY_REGISTRY_URL["Ghana"]),
    ("CDSCO India", "India", "AS", COUNTRY_REGISTRY_URL["India"]),
    ("NMPA China", "China", "AS", COUNTRY_REGISTRY_URL["China"]),
    ("BPOM Indonesia", "Indonesia", "AS", COUNTRY_REGISTRY_URL["Indonesia"]),
    ("NPRA Malaysia", "Malaysia", "AS", COUNTRY_REGISTRY_URL["Malaysia"]),
    ("FDA Philippines", "Philippines", "AS", COUNTRY_REGISTRY_URL["Philippines"]),
    ("HSA Singapore", "Singapore", "AS", COUNTRY_REGISTRY_URL["Singapore"]),
    ("MFDS South Korea", "South Korea", "AS", COUNTRY_REGISTRY_URL["South Korea"]),
    ("Thai FDA", "Thailand", "AS", COUNTRY_REGISTRY_URL["Thailand"]),
    ("DAV Vietnam", "Vietnam", "AS", COUNTRY_REGISTRY_URL["Vietnam"]),
    ("Israel Drug Registry", "Israel", "ME", COUNTRY_REGISTRY_URL["Israel"]),
    ("PMDA Japan", "Japan", "JP", COUNTRY_REGISTRY_URL["Japan"]),
    ("Ukraine DRLZ", "Ukraine", "EU", COUNTRY_REGISTRY_URL["Ukraine"]),
    ("GRLS Russia", "Russia", "RU", COUNTRY_REGISTRY_URL["Russia"]),
    ("Cyprus Pharmaceutical Services", "Cyprus", "EU", COUNTRY_REGISTRY_URL["Cyprus"]),
    ("Hong Kong Drug Office", "Hong Kong", "AS", COUNTRY_REGISTRY_URL["Hong Kong"]),
    ("FDA Orange Book", "United States", "US", "https://www.accessdata.fda.gov/scripts/cder/ob/index.cfm"),
    ("FDA Purple Book", "United States", "US", "https://purplebooksearch.fda.gov/"),
]

# --- Fixed values: synonyms and local names ---------------------------------------------------

SYNONYMS = {
    "paracetamol": ["acetaminophen"],
    "acetaminophen": ["paracetamol"],
    "lidocaine prilocaine": [
        "prilocaine lidocaine", "lidocaine+prilocaine", "prilocaine+lidocaine", "lidocaine and prilocaine",
        "lidocaine", "prilocaine",
    ],
    "prilocaine lidocaine": [
        "lidocaine prilocaine", "lidocaine+prilocaine", "prilocaine+lidocaine", "lidocaine and prilocaine",
        "lidocaine", "prilocaine",
    ],
    "lidocaine+prilocaine": [
        "lidocaine prilocaine", "prilocaine lidocaine", "prilocaine+lidocaine", "lidocaine and prilocaine",
        "lidocaine", "prilocaine",
    ],
    "prilocaine+lidocaine": [
        "prilocaine lidocaine", "lidocaine prilocaine", "lidocaine+prilocaine", "lidocaine and prilocaine",
        "lidocaine", "prilocaine",
    ],
}
RUSSIAN_NAMES = {
    "atorvastatin": "Аторвастатин", "enalapril": "Эналаприл", "ibuprofen": "Ибупрофен",
    "lidocaine": "Лидокаин", "metformin": "Метформин", "mirabegron": "Мирабегрон",
    "paracetamol": "Парацетамол", "prilocaine": "Прилокаин", "quetiapine": "Кветиапин",
    "solifenacin": "Солифенацин", "tafluprost": "Тафлупрост",
}

# --- Fixed values: companies and their countries ----------------------------------------------

COMPANY_COUNTRY = {
    "AstraZeneca AB": "Sweden", "AstraZeneca UK Limited": "United Kingdom",
    "Mylan Pharmaceuticals Limited": "United Kingdom", "Biotest Pharma GmbH": "Germany",
    "Boehringer Ingelheim International GmbH": "Germany", "Novartis Europharm Limited": "Ireland",
    "Roche Registration GmbH": "Germany", "UCB Pharma S.A.": "Belgium", "Novo Nordisk A/S": "Denmark",
    "Sanofi-Aventis Groupe": "France", "Norgine B.V.": "Netherlands",
    "Chiesi Farmaceutici S.p.A.": "Italy", "Almirall S.A.": "Spain", "Sandoz GmbH": "Austria",
    "Orion Corporation": "Finland", "Zentiva k.s.": "Czech Republic", "Gedeon Richter Plc.": "Hungary",
    "Polpharma S.A.": "Poland", "GlaxoSmithKline UK Limited": "United Kingdom",
    "Pfizer Limited": "United Kingdom",
}

# --- Fixed values: connector status (name | tier | mode | status | notes) ---------------------

CONNECTOR_STATUS = [
    ("FDA", "core", "live_api", "ready",
     "OpenFDA label/NDC APIs. Returns product records when OpenFDA has matching substance metadata."),
    ("MHRA", "core", "live_api_pdf", "ready",
     "MHRA API plus SmPC/PIL/PAR URL merge and PDF metadata extraction."),
    ("EMA", "core", "dataset_html_pdf", "ready",
     "EMA medicine data plus product page/document enrichment."),
    ("EU MRI Product Index", "eu_national", "live_html_or_registry", "partial",
     "HMA MRI Product Index for MRP/DCP products. Current official service may return 503; connector parses "
     "table rows when available and otherwise provides official registry handoff."),
    ("Health Canada", "core", "live_api", "ready",
     "Health Canada DPD API. Some document fields may require later deep extraction."),
    ("TGA Australia", "core", "live_html_or_registry", "partial",
     "ARTG page is slow/intermittent from this environment. No hardcoded product fallback; manual registry "
     "row when blocked."),
    ("Medsafe New Zealand", "core", "form_or_registry", "partial",
     "Medsafe app shell is reachable, but direct result extraction is unstable. Manual registry row when no "
     "product rows are parsed."),
    ("Hong Kong Drug Office", "core", "live_form_detail", "ready",
     "Official form search and product detail extraction for product, holder, registration number/date."),
    ("NMPA China", "asia_national", "official_registry_handoff", "manual_parser_needed",
     "English NMPA database page is a registry landing page, not a direct active-substance product search "
     "API. Needs Chinese NMPA database/browser connector before live product rows can be trusted."),
    ("GRLS Russia", "core", "browser_registry", "ready_with_browser_permission",
     "Official GRLS browser flow returns real product rows. FastAPI must run with browser-launch permission."),
    ("Belgium FAMHP", "eu_national", "live_html", "partial",
     "EU national connector; coverage depends on regulator page search behavior."),
    ("France BDPM", "eu_national", "live_html", "partial",
     "EU national connector; coverage depends on regulator page search behavior."),
    ("Ireland medicines.ie", "eu_national", "live_html_documents", "partial",
     "EU national connector with document links where available."),
    ("Spain CIMA", "eu_national", "live_api", "ready", "CIMA API connector for Spain."),
]


# --- Derived maps -----------------------------------------------------------------------------


def connectors() -> list[tuple[str, str, list[str], bool, bool]]:
    return CONNECTORS


@cache
def source_countries() -> dict[str, list[str]]:
    """Lower-case source name -> countries it serves (the central sources also serve "European Union")."""
    served = {name.lower(): list(countries) for name, _, countries, _, _ in connectors()}
    served["ema"] = EU_COUNTRIES + EEA_COUNTRIES + ["European Union"]
    served["eu mri product index"] = EU_COUNTRIES + ["European Union"]
    del served["swissmedic"]
    return served


@cache
def all_countries() -> list[str]:
    """Union of every country list, in case-insensitive order."""
    union = {*EU_COUNTRIES, *GLOBAL_COUNTRIES, *AFRICA_COUNTRIES, *MIDDLE_EAST_COUNTRIES, *ASIA_COUNTRIES}
    return sorted(union, key=str.lower)


@cache
def region_by_country() -> dict[str, str]:
    """X23 as data: later entries win, so lists are applied from the weakest to the strongest."""
    regions = {country: "AS" for country in ASIA_COUNTRIES}
    regions |= {"Switzerland": "CH", "Japan": "JP", "Russia": "RU"}
    regions |= {country: "ME" for country in MIDDLE_EAST_COUNTRIES}
    regions |= {country: "AF" for country in AFRICA_COUNTRIES}
    regions |= {"United Kingdom": "UK", "United States": "US", "Canada": "CA", "Australia": "AU", "New Zealand": "NZ"}
    regions |= {country: "EU" for country in EU_COUNTRIES}
    return regions


def literal_map(mapping: dict) -> Column:
    """A constant map column (folded by the optimizer); list values become arrays."""
    lists = any(isinstance(v, (list, tuple)) for v in mapping.values())
    return F.from_json(F.lit(json.dumps(mapping)), f"map<string,{'array<string>' if lists else 'string'}>")


def literal_list(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def one_of(c: Column, values: list[str]) -> Column:
    """Membership in a constant list; false for NULL."""
    return F.coalesce(F.array_contains(literal_list(values), c), F.lit(False))


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a constant map, NULL when the key is absent."""
    return F.try_element_at(literal_map(mapping), key)


# --- Dimension DataFrames (S12) ---------------------------------------------------------------


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """All dimensions as small DataFrames, keyed by name."""
    frame = spark.createDataFrame
    countries = [(c, region_by_country().get(c, "Global"), i) for i, c in enumerate(all_countries())]
    scope = [("EU", c, i) for i, c in enumerate(EU_COUNTRIES)]
    scope += [("ALL", c, i) for i, c in enumerate(all_countries())]
    for region, members in MULTI_COUNTRY_REGIONS.items():
        scope += [(region, c, i) for i, c in enumerate(members)]
    scope += [(region, c, 0) for region, c in SINGLE_COUNTRY_REGIONS.items()]
    return {
        "country": frame(countries, "country string, region string, pos int"),
        "scope_country": frame(scope, "scope string, country string, pos int"),
        "source": frame(
            [(n, r, c, True, d, e, None, i) for i, (n, r, c, d, e) in enumerate(connectors())],
            "name string, region string, countries array<string>, supports_live_search boolean, "
            "supports_documents boolean, enabled boolean, rate_limit_per_minute int, pos int",
        ),
        "source_country": frame(
            [(s, c) for s, members in source_countries().items() for c in members], "source string, country string"
        ),
        "source_status": frame(
            [(i, *row) for i, row in enumerate(CONNECTOR_STATUS)],
            "pos int, name string, tier string, mode string, status string, notes string",
        ),
        "synonym": frame(
            [(k, t, i) for k, terms in SYNONYMS.items() for i, t in enumerate(terms)],
            "key string, term string, pos int",
        ),
        "local_term": frame(list(RUSSIAN_NAMES.items()), "key string, term string"),
        "company_country": frame(list(COMPANY_COUNTRY.items()), "company string, country string"),
        "register": frame(REGIONAL_REGISTERS, "source string, country string, region string, search_url string"),
        "registry_url": frame(list(COUNTRY_REGISTRY_URL.items()), "country string, url string"),
    }
