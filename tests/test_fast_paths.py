"""Values that take the short way through the text rules are those the full rules give, and nothing is computed twice."""

from pyspark.sql import functions as F

from rxatlas.functions import base, company, english, leaflet, text
from rxatlas.operators import quality
from rxatlas.sources import mappers
from rxatlas.store_paths import once_per_value

NAMES = [
    None, "", " ", "large ring 5 mg tablets", "large ring 5 mg ", " ring", "a  b", "a\tb", "ring\x1c", "\x1dring", "Ring Ring 5 mg", "ring 5 mg ring 5 mg",
    "film-coated coated tablet", "Aspirin Aspirin.pdf", "SmPC - Ring", "paracetamol 5 mg", "PIL: ring", "a---- ----b", "abcd-efgh -efgh x", "x foo-bar foo-bar",
    "- - ring", "ring - -", "B.V B.V.", "Astra Farma Yurop", "Комприм", "café  crème", "Kg Kg", "ſuspension", "suspension/drops", "Comprimidos recubiertos con película",
    "eye drop", "iv bag", "5 x 10 tablets", "patches", "oral solution", "a_b a_b", "ring.", "ring ", "ABCDEF abcdef", "one two one two three",
]


def test_short_ways_give_the_full_rules(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "product string")
    old_ladder = F.coalesce(*[F.when(F.rlike("product", F.lit(f"(?iU){p}")), F.lit(n)) for n, p in text.DOSAGE_FORMS])
    old_route = F.coalesce(*[F.when(F.rlike("product", F.lit(f"(?iU){p}")), F.lit(n)) for n, p in text.ROUTES])
    full_ws = F.nullif(F.trim(F.regexp_replace("product", r"(?U)\s+", " ")), F.lit(""))
    pairs = [
        (base.collapse_ws("product"), full_ws),
        (text.clean_product_name("product"), text._clean_any_name(full_ws)),
        (text.extract_dosage_form("product"), old_ladder),
        (text.extract_route("product"), old_route),
        (F.col("english"), english.english_text("product")),
    ]
    both = english.english_row(df.withColumn("raw", F.col("product"))).select(F.col("raw").alias("product"), F.col("product").alias("english"))
    got = both.select("product", *[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]).collect()
    wrong = [(r[0], r[i].a, r[i].b) for r in got for i in range(1, len(pairs) + 1) if r[i].a != r[i].b]
    assert not wrong
    assert len(got) == len(NAMES)


def test_makers_without_the_holder(spark):
    rows = [("Acme Ltd", "Acme GmbH", None), ("Acme", "Acme; Bolt Co", "Bolt Co"), ("Acme", "; ;", "; ;"), ("Acme", "Bolt; Cog; Acme plc", "Bolt; Cog"), ("AB", "A; B", "B"), (None, "Acme", "Acme")]
    df = spark.createDataFrame([(c, m) for c, m, _ in rows], "company string, manufacturer_name string")
    assert [r.x for r in df.select(company.manufacturer_name(df).alias("x")).collect()] == [m for *_, m in rows]


def test_filled_fields_are_computed_once(spark):
    df = spark.createDataFrame([("ring 5 mg tablets", "Acme")], "product string, company string")
    plan = quality.with_values(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PLGB|PLNI") == 1


def test_leaflets_and_tables_are_read_once(spark):
    df = spark.createDataFrame([("Manufacturer\nBolt GmbH, Germany",)], "t string")

    def times(value, pattern):
        return df.select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString().count(pattern)

    assert times(leaflet.ma_holder("t"), "(?iU)^(?:marketing authorisation holder") == 1
    assert times(leaflet.report_manufacturer("t")["country"], r"\bGermany\b") <= 6  # two ways for each of three places
    assert times(leaflet.company_names(F.col("t")), "ltd|limited") == 1
    assert times(leaflet.tables("t"), "(?is)<tr") == 1
    assert times(text.absolute_url("https://r.test/", F.col("t")), "trim(t") == 1
    assert times(text.extract_strength("t"), "regexp_extract_all") == 1


def test_tables_of_odd_pages(spark):
    pages = ["<TABLE><tr><td>out<table><tr><th>A</th></tr><tr><td>in</td></tr></table></td></tr><tr><td><a href='/x'>y</a> &amp; z</td></tr></TABLE>",
             "<table><tr><td>" + "<b>x</b> " * 50000 + "</td></tr><tr><td>last</td></tr></table>", "<table><tr><td>open", "<tablex></table>"]
    got = [r.t for r in spark.createDataFrame([(p,) for p in pages], "h string").select(leaflet.tables("h").alias("t")).collect()]
    assert [[(t.header, [[tuple(c) for c in row] for row in t.rows]) for t in ts] for ts in (got[0], got[2], got[3])] == [
        [(["A"], [[("in", None)]]), (["out"], [[("y & z", "/x")]])], [], []]
    assert [[c.label for c in row] for row in got[1][0].rows] == [["last"]]


def test_values_are_derived_once_for_each_distinct_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "a", "b", None, ""])], "n int, t string")
    reads = spark.sparkContext.accumulator(0)

    def derive(texts):
        assert [c for c in texts.columns] == ["t"]
        reads.add(texts.count())
        return texts.withColumn("x", F.concat(F.coalesce("t", F.lit("none")), F.lit("!")))

    got = {r.n: (r.t, r.x) for r in once_per_value(df, "t", derive).collect()}
    assert reads.value == 4
    assert got == {0: ("a", "a!"), 1: (None, "none!"), 2: ("a", "a!"), 3: ("b", "b!"), 4: (None, "none!"), 5: ("", "!")}


def test_windows_stay_in_their_row(spark):
    rows = [("tion", 1, "Option one. " + "x" * 900 + " OPTION ONE."), ("tion", 2, "a tion"), ("tion", 2, "A TION"), ("tion", None, "ation"), ("tion", 3, "none"), ("", 4, "tion")]
    docs = spark.createDataFrame(rows + [("tion", 5, ("tion " + "y" * 1000 + " ") * 3)], "query string, ord int, text string")
    out = mappers.map_text_windows(docs)
    got = sorted((r.ord or 0, r.pos) for r in out.collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 0), (5, 0), (5, 1)]
    # a window is not shuffled unless its document comes in several rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("min_by(") and "left_anti" in plan.lower().replace("leftanti", "left_anti")


def test_absent_columns_cost_nothing_and_names_are_read_once(spark):
    """rules over absent columns fold to a constant; the sheet's and the quality columns share what a clean name tells."""
    from rxatlas.functions.base import nz
    from rxatlas.functions.rows import export_row

    def optimized(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    absent = optimized(spark.range(3).select(nz(F.lit(None).cast("string")).alias("x")))
    assert "lambda" not in absent and "null AS x" in absent
    names = ["small ring 12 mg capsules", "Ring 5 mg film-coated tablets, 24 tablets", "PL 12345/0001 ring ring 7 mcg", "ring.pdf 3 g tube", "  ", None]
    rows = spark.createDataFrame([(i, n, "5 ml" if i == 3 else None) for i, n in enumerate(names)], "ord long, product string, strength string")
    assert "_name_strength" in optimized(export_row(rows))
    got = {r["ord"]: r for r in export_row(rows).collect()}
    assert [got[i]["Strength"] for i in range(4)] == ["12 mg", "5 mg", "7 mcg", "5 ml"]
    assert got[1]["Dosage Form"] == "Film-coated tablet" and got[1]["Pack Size"] == "24 tablets" and got[2]["Registration Number"] == "PL 12345/0001"
    assert got[4]["Missing Fields"] == got[5]["Missing Fields"] and got[5]["Missing Fields"].startswith("Strength, Dosage Form, Pack Size")


def test_labels_share_the_lines_of_a_page(spark):
    """Every label of a page split and cleaned its lines again; now they are cleaned once and a label is found by one pattern."""
    df = spark.createDataFrame([("<div>Sponsor</div>",)], "html string").withColumn("page_url", F.col("html"))
    plan = mappers.map_au_detail(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", \\R, -1") <= 1

    texts = [
        None, "", "Name", "Name\nName", "Name:\n - \nProduct name: \nName: x", "name: a : b \n", "- Name -\n- y - \r\n\r\n z", "NAME\n\n  \x0b two\tb  c", "Name café",
        "x\nName\nproduct NAME\nlast", "Names\nName : q\nw", "Name\x85:-\x85 v ", "Name" + "-" * 3000 + "\n" + "- " * 3000 + "\nend", "a\nName:", "Name:b\\n$1 c",
    ]
    def by_lines(c):
        def value(rows, i):
            rest = base.clean_block(F.substring(F.get(rows, i), F.length(F.regexp_extract(F.get(rows, i), pattern, 0)) + 1, F.length(F.get(rows, i))), " :-")
            after = F.get(rows, i + 1)
            return leaflet._left(F.coalesce(rest, F.when(~leaflet._plain_label(after).isin("product name", "name"), after)), None)

        def over(rows):
            places = F.filter(F.transform(rows, lambda x, i: F.when(F.rlike(x, F.lit(pattern)), i)), lambda i: i.isNotNull())
            return leaflet._first(F.transform(places, lambda i: value(rows, i)))

        pattern = leaflet._label_pattern(["Product name", "Name"])
        return base.let(leaflet.lines(c, " :-"), over)

    told = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", leaflet.text_after_label("t", ["Product name", "Name"]).alias("a"), by_lines("t").alias("b"),
        leaflet.joined_lines("t", " :-").alias("c"), F.array_join(leaflet.lines("t", " :-"), "\n").alias("d"),
        leaflet.stripped_lines(F.col("t"), " \t").alias("e"),
        F.array_join(F.filter(F.transform(F.split("t", r"\R"), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != ""), "\n").alias("f"),
    ).collect()
    assert [r for r in told if (r.a, r.c, r.e) != (r.b, r.d, r.f)] == [] and [r.a for r in told][3:6] == [None, "Name: x", "a : b"]


def test_rows_that_share_a_key_with_none_are_not_shuffled(spark, monkeypatch):
    """Wide rows went through a shuffle to be de-duplicated and through another to meet a handful of search terms."""
    from rxatlas.operators import identity
    from rxatlas.sources import registry

    rows = [(i, f"q{i % 3}", "S", f"p{i // 2 if i < 12 else i}", None if i % 5 else "", "n", f"u{i % 2 if i < 6 else 0}") for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, query_id string, source string, product string, country string, registration_number string, url string").repartition(7)
    same = df.unionByName(df.withColumn("ord", F.col("ord") + 1000))
    live = df.filter("ord % 4 = 0").withColumn("company", F.lit("Acme"))

    def told(frame):
        return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))

    def split(bits, frame):
        monkeypatch.setattr(identity, "BUCKETS", bits)
        return identity.by_recurrence(frame.withColumn("_k", F.xxhash64("product")))

    for frame in (df, same, df.limit(0)):  # few keys recur, all do, none is there
        first = told(identity.dedupe_keep_first(frame))
        for bits in (7, 25):  # keys share their bits with others, or not
            monkeypatch.setattr(identity, "BUCKETS", bits)
            assert told(identity.dedupe_keep_first(frame, kept=True)) == first
    merged = [(monkeypatch.setattr(identity, "RECURRING", n), told(identity.merge_cached_live(df, live)))[1] for n in (1, 10**6)]
    assert merged[0] == merged[1]
    monkeypatch.setattr(identity, "RECURRING", 10)
    several, alone = split(25, df)
    assert (several.count(), alone.count()) == (12, 288) and split(25, same)[1] is None

    queries = spark.createDataFrame([("a", "ring")], "query_id string, substance string")
    raw = spark.range(50).select(F.col("id").alias("ord"), F.lit("ring").alias("query"), F.lit("ring").alias("substance"), F.concat(F.lit("ring "), "id").alias("product"))
    known = registry.Registry([registry.Source("S", "EU", ("Spain",), False, True, mapper=lambda f: f.withColumn("source", F.lit("S")))])
    plan = registry.source_search(queries, {"S": raw}, known)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
