"""Parsers, English rendering, categories: expected values as literals."""

from pyspark.sql import functions as F

from rxatlas.functions import english, leaflet, links, text
from rxatlas.functions.company import same_company


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_registration_number(spark):
    assert one(spark, text.extract_registration_number, "Example 5 mg tablets - PLGB 12345/0001") == "PLGB 12345/0001"
    assert one(spark, text.extract_registration_number, "Example syrup PLNI 99999/0002-001") == "PLNI 99999/0002-001"
    assert one(spark, text.format_registration, "plgb_12345-0001") == "PLGB 12345/0001"


def test_strength_and_form(spark):
    name = "DAPAGLIFLOZIN 5 MG FILM-COATED TABLETS - PL 59787/0020"
    assert one(spark, text.extract_strength, name) == "5 MG"
    assert one(spark, text.extract_dosage_form, name) == "Film-coated tablet"
    assert one(spark, text.extract_strength, "24 mg/mL strawberry") == "24 mg/mL"
    assert one(spark, text.extract_strength, "2.5% cream") is None
    assert one(spark, text.extract_strength, "10 ml of 5 mg + 2.5 mg") == "5 mg + 2.5 mg"
    assert one(spark, text.extract_dosage_form, "oral suspension / drops") == "Suspension"


def test_clean_product_name(spark):
    assert one(spark, text.clean_product_name, "Forxiga Forxiga PL 12345/0001") == "Forxiga PL 12345/0001"
    assert one(spark, text.clean_product_name, " Acme  10 mg tablets SmPC - .pdf") == "Acme 10 mg tablets"
    assert one(spark, text.clean_product_name, "one") == "one"
    assert one(spark, text.clean_product_name, "   ") is None


def test_english(spark):
    cases = {
        "Д": "Active", "Бетмига": "Betmiga", "Астеллас Фарма Юроп Б.В.": "Astellas Pharma Europe B.V.",
        "Нидерланды": "Netherlands", "药品": "Local-language registry value: 药品", "été ﬁn": "ete fin", "Щи": "Shchi",
        "таблетки пролонгированного высвобождения": "tablets prolonged-release", "Farma Acme B.V": "Pharma Acme B.V.",
    }
    for raw, expected in cases.items():
        assert one(spark, english.english_text, raw) == expected
    import unicodedata

    hangul = unicodedata.normalize("NFKD", "한국")
    assert one(spark, english.english_text, "한국") == f"Local-language registry value: {hangul}"


def test_category(spark):
    long = "Quetiapine is indicated for the treatment of schizophrenia and bipolar disorder in adults."
    assert one(spark, text.short_category, long, "quetiapine", "") == "Antipsychotic"
    assert one(spark, text.short_category, "", "mirabegron", "") == "Overactive bladder medicine"
    assert one(spark, text.short_category, "", "", "N02BE01") == "Analgesic"
    assert one(spark, text.short_category, "Rare; other", "x", "") == "Rare"


def test_company_and_urls(spark):
    assert one(spark, same_company, "Acme Pharma Ltd", "ACME PHARMA GmbH")
    assert not one(spark, same_company, "Ltd", "Acme")
    base = "https://a.test/x/y?z=1"
    for href, expected in {
        "/p": "https://a.test/p", "q": "https://a.test/x/q", "//b.test/r": "https://b.test/r", "?k=2": "https://a.test/x/y?k=2",
        "http://c.test": "http://c.test", "../u": "https://a.test/u",
    }.items():
        assert one(spark, lambda c: text.absolute_url(base, c), href) == expected
    assert one(spark, lambda q, c: links.lookup_url(q, c), "a b", "Kenya").startswith("https://products.pharmacyboardkenya")
    assert one(spark, lambda q, c: links.lookup_url(q, c), "a b", "Brazil").endswith("Brazil%20medicine%20register%20a%20b")


LEAFLET = """
    Marketing Authorisation Holder
    Mylan Ltd, Potters Bar, United Kingdom

    Manufacturer
    Merckle GmbH, Ludwig-Merckle-Strasse 3, Germany
    Mylan Hungary Kft, Mylan utca 1, Hungary
    McDermott Laboratories Ltd, Dublin, Ireland

    Contents of the pack
    The tablets are available in packs of 10, 30 and 60 tablets.
"""


def test_leaflet_with_three_makers(spark):
    assert one(spark, leaflet.ma_holder, LEAFLET) == "Mylan Ltd"
    makers = one(spark, leaflet.manufacturers, LEAFLET)
    assert "Merckle GmbH" in makers and "Mylan Hungary Kft" in makers
    blocks = one(spark, lambda c: leaflet.extract_countries(F.get(leaflet.manufacturer_blocks(c), F.lit(0))), LEAFLET)
    assert blocks == "Germany; Hungary; Ireland"
    assert "packs of 10, 30 and 60 tablets" in one(spark, leaflet.pack_info, LEAFLET)


def test_leaflet_plain(spark):
    leaf = "Marketing Authorisation Holder\nExample Pharma Ltd\n10 High Street\n\nManufacturer responsible for batch release\n" \
        "Example Manufacturing Ltd\nIndustrial Estate\n\nPack sizes\n24 tablets\n"
    assert one(spark, leaflet.ma_holder, leaf) == "Example Pharma Ltd"
    assert one(spark, leaflet.manufacturers, leaf) == "Example Manufacturing Ltd"
    assert one(spark, leaflet.pack_info, leaf) == "24 tablets"


def test_document_links(spark):
    html = '<a href="/docs/example-spc.pdf">Summary of Product Characteristics</a><a href="/docs/example-pil.pdf">Patient Information Leaflet</a>'
    found = one(spark, lambda c: leaflet.doc_links(c, "https://products.mhra.gov.uk", "uk"), html)
    assert found["smpc_url"] == "https://products.mhra.gov.uk/docs/example-spc.pdf"
    assert found["pil_url"] == "https://products.mhra.gov.uk/docs/example-pil.pdf"


def test_character_references(spark):
    assert one(spark, leaflet.inner_text, "M&eacute;dicament &#8211; caf&#xE9; &#150; a&b &bogus; &amp;lt; &nbsp;x &#x1F600;") == "Médicament – café – a&b &bogus; &lt; x \U0001F600"


def test_tables_inside_tables(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><table><tr><td>x</td></tr><tr><td>y</td></tr></table></td></tr><tr><td>2</td><td>z</td></tr></table>"
    found = one(spark, leaflet.tables, html)
    assert [[c["label"] for c in row] for row in found[1]["rows"]] == [["1", ""], ["2", "z"]]
    assert [[c["label"] for c in row] for row in found[0]["rows"]] == [["y"]]


def test_spanish_film_coated(spark):
    assert one(spark, text.extract_dosage_form, "comprimidos recubiertos con película") == "Film-coated tablet"
