"""Identity, search, scope, store and quality on small inline tables."""

import pytest
from pyspark.sql import functions as F

from rxatlas import dims
from rxatlas.functions import links
from rxatlas.operators import coverage, identity, jobs, joins, ordering, quality, scope, search, store
from rxatlas.sources import mappers, readers, registry


def frame(spark, rows, extra=()):
    names = sorted({k for r in rows for k in r} | set(extra))
    data = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord long, " + ", ".join(f"{n} string" for n in names))


def test_dimensions():
    assert (len(dims.AFRICA_COUNTRIES), len(dims.MIDDLE_EAST_COUNTRIES), len(dims.connectors())) == (54, 17, 32)
    assert sum(1 for c in dims.connectors() if c[4]) == 31
    assert len(dims.all_countries()) >= 100


def test_relevance_of_combinations(spark):
    df = frame(spark, [
        {"source": "FDA", "product": "Prilocaine topical cream", "source_substance": "prilocaine"},
        {"source": "FDA", "product": "Lidocaine and Prilocaine cream", "source_substance": "lidocaine prilocaine"},
    ])
    got = df.orderBy("ord").select(search.relevant_to_substance(df, F.lit("Prilocaine+Lidocaine")).alias("x")).collect()
    assert [r.x for r in got] == [False, True]


def test_suppress_generic(spark):
    df = frame(spark, [
        {"country": "India", "source": "CDSCO India", "product": "p"},
        {"country": "India", "source": "Asia Generic Registry Lookup", "product": "q"},
    ])
    assert [r.source for r in search.suppress_generic(df).collect()] == ["CDSCO India"]


def test_field_availability(spark):
    df = frame(spark, [{"source": "FDA", "pil_url": None}, {"source": "MHRA", "pil_url": "https://example.test/pil.pdf"}])
    got = df.orderBy("ord").select(links.field_value(df, "smpc_url", F.lit(None).cast("string")).alias("a"), links.field_value(df, "manufacturer_name", F.lit(None).cast("string")).alias("b")).collect()
    assert got[0].a == links.NOT_APPLICABLE and got[1].b == links.PENDING


def test_merge_fills_and_appends(spark):
    cached = frame(spark, [{"source": "A", "product": "p", "status": None}, {"source": "A", "product": "P ", "status": "dup"}])
    live = frame(spark, [{"source": "a", "product": "p", "status": "live"}, {"source": "B", "product": "n", "status": None}, {"source": "b", "product": "N", "status": "later"}])
    got = {r.product: (r.status, r.origin) for r in identity.merge_cached_live(cached.withColumn("ord", F.col("ord") + 100), live).collect()}
    assert got == {"p": ("live", "cached"), "n": ("later", "live")}


def test_keep_first_is_stable_and_idempotent(spark):
    df = spark.range(2000).select(F.col("id").alias("ord"), (F.col("id") % 7).cast("string").alias("product"))
    once = identity.dedupe_keep_first(df.repartition(13))
    assert sorted(r.ord for r in once.collect()) == list(range(7))
    assert identity.dedupe_keep_first(once).count() == 7


def test_rank_within_matches_row_number(spark):
    df = spark.range(5000).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(50)).alias("v"))
    got = ordering.rank_within(df, ["g"], [F.col("v"), F.col("ord")])
    from pyspark.sql import Window

    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "ord")))
    assert got.select("ord", "rank").exceptAll(want.select("ord", "rank")).count() == 0


def test_search_many_uses_all_anchors(spark):
    products = spark.range(600).select(F.col("id").alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("substance"), F.lit("x").alias("product"))
    queries = products.select(F.col("ord").cast("string").alias("query_id"), F.upper("substance").alias("query_substance"))
    got = {(r.query_id, r.ord) for r in search.search_many(queries, products).select("query_id", "ord").collect()}
    want = {(str(q), p) for q in range(600) for p in range(600) if f"n{q}" in f"n{p}"}
    assert got == want


def test_country_gaps(spark):
    q = spark.createDataFrame([("a", "atorvastatin", "", "AF", ""), ("b", "atorvastatin", "", "ME", ""), ("c", "atorvastatin", "", "ALL", ""), ("d", "atorvastatin", "Greece", "", "")],
                              "query_id string, substance string, country string, region string, source string")
    none = spark.createDataFrame([], "query_id string, country string, region string")
    got = {r.query_id: r["count"] for r in coverage.country_gap_rows(q, none).groupBy("query_id").count().collect()}
    assert got == {"a": 54, "b": 17, "c": len(dims.all_countries()), "d": 1}
    row = coverage.country_gap_rows(q, none).filter("query_id = 'd'").first()
    assert (row.source, row.document_type) == ("EU National Registry", "EU national lookup fallback")


def test_scope(spark):
    q = spark.createDataFrame([(["CDSCO India"], "India"), (["FDA", "Hong Kong Drug Office", "France BDPM", "Spain CIMA"], "China")], "sources array<string>, country string")
    blank = F.lit("")
    got = [r.s for r in q.select(scope.scope_sources(F.col("sources"), F.col("country"), blank, blank).alias("s")).collect()]
    assert got == [["CDSCO India"], ["NMPA China"]]


def test_quality(spark):
    full = {
        "product": "Example 10 mg tablets", "company": "Example Holder Ltd", "country": "United Kingdom", "source": "MHRA", "registration_number": "PL 12345/0001",
        "registration_date": "1 Jan 2024", "manufacturer_name": "Example Manufacturer Ltd", "manufacturer_country": "Germany", "pack_size": "28 tablets",
        "product_url": "https://example.test/product", "smpc_url": "https://example.test/spc.pdf", "pil_url": "https://example.test/pil.pdf",
        "assessment_report_url": "https://example.test/par.pdf",
    }
    manual = {"connector_mode": "manual_registry", "product": "x", "country": "y", "source": "z"}
    poor = {"product": "Example 5 mg tablets", "country": "Canada", "source": "Health Canada"}
    got = quality.attach_quality(frame(spark, [full, manual, poor])).orderBy("ord").collect()
    assert (got[0].data_confidence, got[0].missing_fields) == ("High", "None")
    assert got[1].data_confidence == "Needs manual review"
    assert all(label in got[2].missing_fields for label in ("MA Holder", "Manufacturer Name", "SmPC URL"))


def test_upsert_twice_is_once(spark):
    empty = spark.createDataFrame([], "id long, source string, product string, country string, registration_number string, product_url string")
    batch = frame(spark, [{"source": "A", "product": "p", "country": "c", "registration_number": "1"}, {"source": "A", "product": "q", "country": "c"}])
    once = store.upsert_products(empty, batch, F.lit("now"))
    twice = store.upsert_products(once, batch, F.lit("now"))
    assert once.exceptAll(twice).count() == 0 and twice.count() == 2


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.read_store(spark, path).count() == 0
    assert store.write_version(spark.range(3), path) == 1
    assert store.write_version(spark.range(5), path) == 2
    assert store.read_store(spark, path).count() == 5


def test_best_match_against_brute_force(spark):
    import re

    left = [("s", f"Acme {i} mg", f"Firm{i % 3} Ltd") for i in range(12)]
    cand = [("s", f"Acme {i}" if i % 2 else f"Acme {i} mg", None, "gen" if i % 3 else "", f"firm{i % 4}") for i in range(10)]
    ldf = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "ord long, substance string, product string, company string")
    cdf = spark.createDataFrame([(i, *r) for i, r in enumerate(cand)], "ord long, substance string, brand_name string, brand_name_base string, generic_name string, labeler_name string")
    key = lambda x: re.sub("[^a-z0-9]+", "", (x or "").lower())
    want = {}
    for i, (_, product, company) in enumerate(left):
        best, score = None, 0
        for j, (_, a, b, c, lab) in enumerate(cand):
            names = [key(n) for n in (a, b, c) if n]
            s = 100 if key(product) in names else 70 if any(key(product) in n or n in key(product) for n in names) else 0
            s += 25 if key(lab) in key(company) or key(company) in key(lab) else 0
            if s > score:
                best, score = j, s
        want[i] = best
    assert {r.ord: r.match_ord for r in joins.best_match_join(ldf, cdf).collect()} == want


def test_jobs(spark):
    df = spark.createDataFrame([("GRLS Russia",), ("FDA",), ("Health Canada",)], "source string")
    assert [r.source for r in ordering.order_sources_for_job(df).collect()] == ["FDA", "Health Canada", "GRLS Russia"]
    assert {r.source: r.status for r in scope.skip_in_mode(df, "fast").collect()}["GRLS Russia"] == "skipped"
    assert {r.status for r in scope.skip_in_mode(df, "full").collect()} == {"queued"}
    rows = spark.createDataFrame([("{\"a\": 1}",), ("{broken",)], "row_json string")
    assert jobs.parse_row_json(rows, "a int").count() == 1


PAGE = """<table><tr><th>Product Name</th><th>Active Ingredient</th><th>Company</th><th>Registration No</th><th>Status</th></tr>
<tr><td><a href="/product/1">Atorvastatin Example 20 mg tablet</a></td><td>atorvastatin calcium</td><td>Example Holder</td><td>REG-123</td><td>Registered</td></tr></table>"""


def test_regional_table(spark):
    pages = spark.createDataFrame([("atorvastatin", 1, PAGE, "https://www.sfda.gov.sa/en/drugs-list")], "query string, ord long, html string, page_url string")
    row = mappers.map_regional_pages(pages, "SFDA Saudi Arabia").first()
    assert (row.source, row.region, row.company, row.registration_number, row.strength, row.dosage_form) == (
        "SFDA Saudi Arabia", "ME", "Example Holder", "REG-123", "20 mg", "Tablet")


def test_nz_table_and_handoff(spark):
    html = PAGE.replace("Product Name", "Trade Name").replace("Active Ingredient", "Ingredient").replace("Company", "Sponsor").replace("Registration No", "Classification")
    pages = spark.createDataFrame([("atorvastatin", 1, html, "https://n.test/")], "query string, ord long, html string, page_url string")
    assert mappers.map_header_table(pages, "Medsafe New Zealand", "nz").first().status == "Registered - REG-123"
    row = mappers.handoff_row(spark.createDataFrame([("metformin",)], "query string"), "NMPA China").first()
    assert row.connector_mode == "manual_registry" and "parser" in row.status


def test_readers(spark, tmp_path):
    (tmp_path / "seed.jsonl").write_text('{"product": "p", "source": "s"}\n\n{"product": "q", "company": " "}\n')
    assert [(r.product, r.company) for r in readers.read_seed(spark, str(tmp_path / "seed.jsonl")).orderBy("ord").collect()] == [("p", None), ("q", None)]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p_100.json").write_text('{"result": {"items": [{"a": "3"}]}}')
    (pages / "p_0.json").write_text('{"result": {"items": [{"a": "1"}, {"a": "2"}]}}')
    assert [r.a for r in readers.read_paged(spark, str(pages), "result.items", "a string").orderBy("ord").collect()] == ["1", "2", "3"]
    (tmp_path / "sheet.csv").write_text('junk\nx,y\nCategory,Name of medicine,Status / now (x):\nHuman,"A, b",ok\n,,\n')
    row = readers.read_with_preamble(spark, str(tmp_path / "sheet.csv")).collect()
    assert len(row) == 1 and (row[0].name_of_medicine, row[0].status_now_x) == ("A, b", "ok")
    line = "\t".join(["1", "Prod\x80", *["f"] * 8, " Labo é ", "x"])
    (tmp_path / "cis.txt").write_bytes((line + "\nshort\tline\n").encode("latin-1"))
    got = readers.read_bdpm_products(spark, str(tmp_path / "cis.txt")).collect()
    assert len(got) == 1 and (got[0].product, got[0].company) == ("Prod€", "Labo é")


def test_readers_keep_file_order(spark, tmp_path):
    many = tmp_path / "many"
    many.mkdir()
    (many / "a.jsonl").write_text('{"product": "first", "source": "s"}\n')
    (many / "b.jsonl").write_text("".join(f'{{"product": "p{i:04d}", "source": "s"}}\n' for i in range(5000)))
    got = [r.product for r in readers.read_seed(spark, str(many)).orderBy("ord").collect()]
    assert got == ["first", *(f"p{i:04d}" for i in range(5000))]
    sheets = tmp_path / "sheets"
    sheets.mkdir()
    (sheets / "a.csv").write_text("junk\nCategory,Name\nHuman,A\n")
    (sheets / "b.csv").write_text("x\ny\nz\nCategory,Name\n" + "".join(f"Human,B{i}\n" for i in range(3000)))
    assert [r.name for r in readers.read_with_preamble(spark, str(sheets)).orderBy("ord").collect()] == ["A", *(f"B{i}" for i in range(3000))]
    lines = tmp_path / "cis"
    lines.mkdir()
    for name, product in (("a", "old"), ("b", "new")):
        (lines / f"{name}.txt").write_text("\n".join("\t".join([str(i), product, *["f"] * 10]) for i in range(1 if name == "b" else 400)) + "\n")
    assert {r.cis: r["product"] for r in readers.read_bdpm_products(spark, str(lines)).filter("cis < 2").collect()} == {"0": "new", "1": "old"}
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "x.json").write_text('{"items": [{"a": "1"}]}')
    (plain / "y.json").write_text('{"items": [{"a": "2"}, {"a": "3"}]}')
    rows = readers.read_json_array(spark, str(plain), "items", "a string").orderBy("ord").collect()
    assert [r.a for r in rows] == ["1", "2", "3"] and len({r.ord for r in rows}) == 3


def saved_one_by_one(stored, batch):
    """{id: (source, product, country, number, url, status)}: the plain rule, one row after the other."""
    rows = {r[0]: r[1:] for r in stored}
    top = max(rows, default=0)
    for o, *key, reg, url, status in sorted(batch, key=lambda r: r[0]):
        same = [i for i, r in rows.items() if [x or "" for x in r[:3]] == [x or "" for x in key]]
        hits = [i for i in same if (reg and rows[i][3] == reg) or (url and rows[i][4] == url) or (not reg and not url)]
        rows[min(hits, default=top + 1 + o)] = (*key, reg, url, status)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_upsert_is_saving_one_by_one(spark, seed):
    """Rows of one batch chain through each other: each takes over the number and URL that later ones meet."""
    import random

    rnd = random.Random(seed)

    def row():
        return (rnd.choice(["A", "B", None]), rnd.choice(["p", "q", ""]), rnd.choice(["c", None]), rnd.choice([None, "", "1", "2", "3", "4"]), rnd.choice([None, "u", "v", "w", ""]))

    stored = [(10 + 3 * i, *row(), "old") for i in range(25)]
    batch = [(7 * i, *row(), f"s{i}") for i in range(140)]
    ddl = "source string, product string, country string, registration_number string, product_url string, status string"
    got = store.upsert_products(spark.createDataFrame(stored, f"id long, {ddl}"), spark.createDataFrame(batch, f"ord long, {ddl}"), F.lit("now"))
    columns = ["source", "product", "country", "registration_number", "product_url", "status"]
    found = {r[0]: tuple(x or "" for x in r[1:]) for r in got.select("id", *columns).collect()}
    assert found == {i: tuple(x or "" for x in r) for i, r in saved_one_by_one(stored, batch).items()}


def _one_by_one_rows():
    """(stored, batch, ddl) of two sources with rows that meet each other, by number, by URL and with neither."""
    import random

    rnd = random.Random(11)

    def row():
        return (rnd.choice(["A", "B"]), "p", "c", rnd.choice([None, "1", "2", "3"]), rnd.choice([None, "u", "v"]))

    ddl = "source string, product string, country string, registration_number string, product_url string, status string"
    return [(10 + 3 * i, *row(), "old") for i in range(20)], [(7 * i, *row(), f"s{i}") for i in range(60)], ddl


def _saved(spark, stored, batch, ddl):
    got = store.upsert_products(spark.createDataFrame(stored, f"id long, {ddl}"), spark.createDataFrame(batch, f"ord long, {ddl}"), F.lit("now"))
    columns = ["source", "product", "country", "registration_number", "product_url", "status"]
    return {r[0]: tuple(x or "" for x in r[1:]) for r in got.select("id", *columns).collect()}


def test_upsert_of_small_groups_needs_no_components(spark, monkeypatch):
    """the rounds over shared numbers and URLs shuffle every row many times; small groups are ordered as they are."""

    def never(members):
        raise AssertionError("components were looked for")

    monkeypatch.setattr(store, "_components", never)
    stored, batch, ddl = _one_by_one_rows()
    assert _saved(spark, stored, batch, ddl) == {i: tuple(x or "" for x in r) for i, r in saved_one_by_one(stored, batch).items()}


@pytest.mark.parametrize(("group", "looked_up"), [(0, 10**6), (40, 10**6), (40, 0), (10**6, 0)])
def test_upsert_of_crowded_groups_and_large_batches(spark, monkeypatch, group, looked_up):
    monkeypatch.setattr(store, "GROUP", group)
    monkeypatch.setattr(store, "LOOKED_UP", looked_up)
    stored, batch, ddl = _one_by_one_rows()
    stored += [(500 + i, "C", "p", "c", "1", None, "old") for i in range(3)]
    batch += [(1000 + i, "A", "q", "c", None, None, f"t{i}") for i in range(3)]
    assert _saved(spark, stored, batch, ddl) == {i: tuple(x or "" for x in r) for i, r in saved_one_by_one(stored, batch).items()}


def test_stored_table_writes_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "s")
    ddl = "ord long, source string, product string, country string, registration_number string, status string"
    first = spark.createDataFrame([(i, "S", f"product {i}", "c", str(i), "old") for i in range(20000)], ddl)
    assert store.upsert_store(spark, path, first) == 1
    batch = spark.createDataFrame([(0, "S", "product 7", "c", "7", "new"), (1, "S", "added", "c", None, "new")], ddl)
    assert store.upsert_store(spark, path, batch) == 2

    def size(version):
        return sum(f.stat().st_size for f in (tmp_path / "s" / f"v={version}").rglob("*.parquet"))

    assert size(2) < size(1) / 8
    rows = store.read_store(spark, path)
    assert rows.count() == 20001 and rows.select("id").distinct().count() == 20001
    assert sorted(r["product"] for r in rows.filter("status = 'new'").collect()) == ["added", "product 7"]
    # the version before is still there, and a repeated job writes its own version again
    assert store.read_store(spark, path, before=2).filter("status = 'new'").count() == 0
    assert store.upsert_store(spark, path, batch, number=2) == 2
    rows = store.read_store(spark, path)
    assert rows.count() == 20001
    # whole versions and buckets go together
    assert store.write_version(rows.filter("status = 'new'"), path) == 3 and store.read_store(spark, path).count() == 2
    assert store.upsert_store(spark, path, batch.filter("ord = 1")) == 4 and store.read_store(spark, path).count() == 2


def test_contained_names_meet_through_their_rarest_run(spark):
    """Names that share all but a number: each forms a handful of candidates, not one with every other name."""
    from rxatlas.operators import contain

    names = spark.range(300).select(F.lit("metformin").alias("scope"), F.concat(F.lit("metformin"), "id", F.lit("mg")).alias("o"))
    asked = names.withColumnRenamed("o", "i")
    anchors = contain.anchored(asked, "i", names, ["o"], ["scope"])
    meetings = contain._offers(names, ["o"], contain.Asked(anchors, "_gram")).join(anchors, ["scope", "_gram"])
    assert meetings.groupBy("i").count().agg(F.max("count")).first()[0] <= 5
    got = {(r.o, r.i) for r in contain.containing(names, ["o"], anchors, "i", ["scope"]).collect()}
    assert got == {(f"metformin{n}mg",) * 2 for n in range(300)}


def test_containment_against_brute_force(spark):
    import random

    from rxatlas.operators import contain

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abé😀\n") for _ in range(rnd.randrange(9))) for _ in range(150)]
    rows = spark.createDataFrame([(rnd.choice("xy"), t) for t in texts] + [("x", None)], "g string, t string")
    asked = rows.withColumnRenamed("t", "i")
    met = contain.containing(rows.distinct(), ["t"], contain.anchored(asked, "i", rows.distinct(), ["t"], ["g"]), "i", ["g"]).collect()
    pairs = [(r.g, r.t, r.i) for r in met]
    data = {(r.g, r.t) for r in rows.collect() if r.t is not None}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(g, t, i) for g, t in data for h, i in data if g == h and i in t}


def test_documents_after_a_complete_url_are_not_read(spark):
    """A row that is complete stops at its first URL, whether or not that one has a document."""
    from rxatlas.operators import documents

    rows = frame(spark, [
        {"source": "X", "product": "p", "strength": "5 mg", "dosage_form": "Tablet", "pack_size": "10 tablets", "therapeutic_category": "C", "smpc_url": "https://e.test/absent.pdf", "pil_url": "https://e.test/there.pdf"},
        {"source": "X", "product": "p", "strength": "5 mg", "dosage_form": "Tablet", "pack_size": "10 tablets", "therapeutic_category": "C", "smpc_url": "https://e.test/there.pdf", "pil_url": None},
        {"source": "X", "product": "p", "strength": None, "dosage_form": "Tablet", "pack_size": "10 tablets", "therapeutic_category": "C", "smpc_url": "https://e.test/absent.pdf", "pil_url": "https://e.test/there.pdf"},
    ], extra=["manufacturer_email", "atc_code"])
    docs = spark.createDataFrame([("https://e.test/there.pdf", "Contact: maker@e.test\nEach tablet contains 20 mg of it\n")], "doc_url string, text string")
    got = {r.ord: (r.manufacturer_email, r.strength) for r in documents.enrich_rows(rows, docs).collect()}
    assert got == {0: (None, "5 mg"), 1: ("maker@e.test", "5 mg"), 2: ("maker@e.test", "20 mg")}


def test_order_of_raw_rows_has_a_bound(spark):
    source = registry.Source("S", "", (), False, True, mapper=lambda df: df)
    known = registry.Registry([source])
    queries = spark.createDataFrame([("q", "ring")], "query_id string, substance string")

    def searched(number):
        raw = spark.createDataFrame([(number, "ring", "ring", "p", "S")], "ord long, query string, substance string, product string, source string")
        return registry.source_search(queries, {"S": raw}, known).select("ord").collect()

    assert searched((1 << 48) - 1)[0].ord == (1 << 48) - 1
    with pytest.raises(Exception, match="stay below"):
        searched(1 << 48)


def test_registry(spark):
    known = registry.Registry()
    assert known.by_name(" fda ").name == "FDA" and known.by_name("x") is None
    assert len(known.enabled()) == 31 and known.metadata(spark).count() == 32


@pytest.mark.parametrize(("rows", "expected"), [
    ([("R1", "a"), (None, "b")], [("b", None)]),
    ([(None, "a"), ("R1", "b"), (None, "c")], [("b", "R1"), ("c", None)]),
    ([("R1", "a"), ("R2", "b"), (None, "c"), ("R2", "d")], [("c", None), ("d", "R2")]),
])
def test_rows_with_neither_number_nor_url_meet_the_first(spark, rows, expected):
    batch = spark.createDataFrame([(i, "s", "p", "c", r, st) for i, (r, st) in enumerate(rows)], "ord long, source string, product string, country string, registration_number string, status string")
    empty = spark.createDataFrame([], "id long, source string, product string, country string, registration_number string, product_url string")
    got = store.upsert_products(empty, batch).select("status", "registration_number").collect()
    assert sorted((r.status, r.registration_number) for r in got) == expected


def test_search_reads_each_distinct_text_once(spark, monkeypatch):
    """names recur from product to product; the gram index read them once for each row."""
    from rxatlas.operators import contain, search

    rows, plain = [], contain.anchored

    def counted(asked, needle, texts, *rest):
        rows.append(texts.count())
        return plain(asked, needle, texts, *rest)

    monkeypatch.setattr(contain, "anchored", counted)
    products = spark.createDataFrame([(i, "Gear", f"Gear {i % 2}") for i in range(40)] + [(40, None, "gear box"), (41, "rod", None)], "ord long, substance string, product string")
    queries = spark.createDataFrame([("q", "GEAR"), ("r", "r 1"), ("s", ""), ("t", "none")], "query_id string, query_substance string")
    got = sorted((r.query_id, r.ord) for r in search.search_many(queries, products).collect())
    assert got == sorted([("q", i) for i in range(41)] + [("r", i) for i in range(1, 40, 2)] + [("s", i) for i in range(42)])
    assert rows == [4]


@pytest.mark.parametrize("share", [0, 10**9])
def test_merge_with_few_and_many_recurring_keys(spark, monkeypatch, share):
    """rows whose key does not recur are not aggregated, with the same result."""
    monkeypatch.setattr(identity, "RECURRING", share)
    ddl = "query_id string, ord long, source string, product string, country string, company string"
    cached = [("q", 5, "S", "a", "c", ""), ("q", 3, "S", "b", "c", "Own"), ("q", 4, "s", "B", "c", "Later"), ("r", 1, "S", "a", None, None)]
    live = [("q", 1, "S", "A ", "c", ""), ("q", 2, "S", "a", "c", "Two"), ("q", 3, "S", "a", "c", "Three"), ("q", 9, "S", "new", "c", ""), ("r", 8, "S", "b", "c", "Z")]
    extra = spark.createDataFrame(live, ddl).withColumn("pil_url", F.concat(F.lit("u"), F.col("ord").cast("string")))
    got = identity.merge_cached_live(spark.createDataFrame(cached, ddl), extra)
    late = identity.LIVE_ORD
    assert sorted(tuple(r) for r in got.select("query_id", "ord", "origin", "product", F.coalesce("company", F.lit("~")), F.coalesce("pil_url", F.lit("~"))).collect()) == sorted([
        ("q", 5, "cached", "a", "Two", "u1"), ("q", 3, "cached", "b", "Own", "~"), ("r", 1, "cached", "a", "~", "~"),
        ("q", late + 9, "live", "new", "~", "u9"), ("r", late + 8, "live", "b", "Z", "u8")])


def test_keys_are_told_apart_by_their_parts(spark):
    """rows are grouped by a digest of the key."""
    pairs = [("a", "bc"), ("ab", "c"), ("", "abc"), (None, "abc"), ("abc", None), ("abc", ""), (None, None), ("", ""), ("-", ""), ("1:a", "b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs * 2)], "ord long, x string, y string")
    got = identity.keep_first(df, [F.col("x"), F.col("y")])
    assert sorted(r.ord for r in got.collect()) == list(range(len(pairs)))
    assert "_k0" not in got._jdf.queryExecution().optimizedPlan().toString()
