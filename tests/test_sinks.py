"""Files written and read back: export sheet, legacy table, demonstration rows."""

from pyspark.sql import functions as F

from rxatlas.functions.rows import EXPORT_COLUMNS, export_row
from rxatlas.operators import store
from rxatlas.sources import readers


def test_export_sheet_round_trip(spark, tmp_path):
    ddl = "ord long, substance string, product string, country string, source string, url string"
    rows = spark.createDataFrame([(1, "Dapagliflozin", "Forxiga 10 mg film-coated tablets", "United Kingdom", "MHRA", "https://example.test/doc")], ddl)
    store.write_export(export_row(rows, F.lit("Dapagliflozin"), generated_at=F.lit("now")), str(tmp_path / "x"))
    back = spark.read.option("header", True).csv(str(tmp_path / "x"))
    assert back.columns == EXPORT_COLUMNS and len(EXPORT_COLUMNS) == 41
    row = back.first()
    assert (row["Region"], row["Strength"], row["Dosage Form"], row["Source"]) == ("UK", "10 mg", "Film-coated tablet", "MHRA")


def test_whole_export_and_pages(spark, tmp_path):
    from rxatlas.plans import search as plans

    queries = spark.createDataFrame([("a", "Ring / x", 2, 10), ("b", "none", 1, 10)], "query_id string, substance string, page long, page_size long")
    rows = [(i, "a", "Ring", f"Ring {i:02d} 10 mg tablets", "Spain", "MHRA" if i % 2 else "FDA", "manual_registry" if i == 3 else None) for i in range(25)]
    frame = spark.createDataFrame(rows, "ord long, query_id string, substance string, product string, country string, source string, connector_mode string")
    out = plans.export_all(queries, frame, str(tmp_path / "x"), F.lit("now"))
    said = {r["query_id"]: (r["Query"], r["Record Count"], r["Sources"], r["Status"]) for r in out["provenance"].collect()}
    assert said == {"a": ("Ring / x", 25, "FDA, MHRA", "Records found"), "b": ("none", 0, "Not available", "No records found")}
    # the manual registry row counts as a record and is no row of the sheet
    assert out["written"] == 24 and out["sheet"].count() == 24
    back = spark.read.option("header", True).csv(str(tmp_path / "x" / "file=Ring_x_a"))
    assert back.columns == EXPORT_COLUMNS and back.count() == 24
    assert {(r["query_id"], r["Source"], r["Records"], r["Strength"]) for r in out["coverage"].collect()} == {("a", "FDA", 13, "13/13"), ("a", "MHRA", 12, "12/12")}
    page = plans.export_all(queries, frame, str(tmp_path / "y"), F.lit("now"), whole=False)
    assert sorted(r["ord"] for r in page["sheet"].collect()) == list(range(10, 20))


def test_job_reports_replay(spark, tmp_path):
    """Three batches with a failed, a timed out, a running and a silent source; a repeated batch changes nothing."""
    from rxatlas.operators import jobs
    from rxatlas.plans import search as plans
    from rxatlas.streaming import streams

    ddl = "job_id string, source string, ord long, ts timestamp, status string, records int, error string, elapsed_seconds double, product string, country string, registration_number string, url string"

    def report(o, job, source, status, error=None, records=0, product=None):
        import datetime as dt

        return (job, source, o, dt.datetime(2024, 1, 1, 0, o), status, records, error, 1.0, product, "x", None, None)

    batches = [
        [report(1, "j", "A", "running"), report(2, "j", "B", "running"), report(3, "k", "A", "running")],
        [report(4, "j", "A", "ended", None, 2), report(4, "j", "A", "ended", product="p"), report(5, "j", "A", "ended", product="q"), report(6, "j", "B", "ended", "HTTP 500")],
        [report(7, "j", "C", "ended", "timeout"), report(8, "j", "A", "ended", product="p"), report(9, "k", None, "ended", "no disk")],
    ]
    path, sink = str(tmp_path / "jobs"), streams.job_sink(str(tmp_path / "jobs"))
    started = spark.createDataFrame([(j, s, "queued", "") for j in "jkm" for s in "ABC"], "job_id string, source string, status string, error string")

    def state():
        run, results, health = plans.job_status(spark, path, started)
        rows = [tuple(r) for r in jobs.job_results(results, "source string, product string").select("job_id", "source", "product").collect()]
        progress = {(r.job_id, r.source): (r.status, r.error) for r in run["progress"].collect()}
        return {r.job_id: (r.status, r.record_count, r.started_at and r.started_at.minute, r.finished_at and r.finished_at.minute) for r in run["jobs"].collect()}, rows, progress, sorted((r.source, r.last_status) for r in health.collect())

    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, ddl), i)
    once = state()
    by_job, rows, progress, health = once
    assert by_job == {"j": ("done", 2, 1, 7), "k": ("failed", 0, 3, 9), "m": ("queued", 0, None, None)}
    assert rows == [("j", "A", "p"), ("j", "A", "q")] and health == [("A", "done"), ("B", "failed"), ("C", "timeout")]
    assert progress["j", "B"] == ("failed", "HTTP 500") and progress["k", "A"] == ("failed", "no disk") and progress["m", "C"] == ("queued", "")
    for i in (1, 2):
        sink(spark.createDataFrame(batches[i], ddl), i)
    assert state() == once


def test_state_of_a_job_goes_when_its_sources_have_ended(spark, tmp_path):
    import datetime as dt

    from rxatlas.operators import jobs
    from rxatlas.streaming import streams

    ddl = "job_id string, source string, status string, records int, ts timestamp, ord long"
    folder = str(tmp_path / "in")
    for part in range(2):  # the second part ends every source of all jobs but one
        rows = [(f"j{j}", s, "running" if part == 0 else "done", j, dt.datetime(2024, 1, 1, part), 10 * j + part) for j in range(20) for s in "AB" if not (part and j == 7 and s == "B")]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)
    out, sizes = str(tmp_path / "out"), []

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    query = streams.stream_progress(events).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(sink).start()
    assert query.awaitTermination(120)
    sizes = [p["stateOperators"][0]["customMetrics"] for p in query.recentProgress if p["stateOperators"]]
    last = jobs.merged_progress(spark.read.parquet(out))
    assert {(r.job_id, r.source): r.status for r in last.collect()} == {(f"j{j}", s): "running" if (j, s) == (7, "B") else "done" for j in range(20) for s in "AB"}
    assert sizes
    known = spark.read.format("statestore").option("stateVarName", "sources").load(str(tmp_path / "c"))
    assert {r["key"]["job_id"] for r in known.select("key").collect()} == {"j7"}


def test_legacy_table_and_demo(spark, tmp_path):
    empty = store.read_store(spark, str(tmp_path / "none"))
    demo = store.demo_data(empty)
    assert demo.count() == 6
    store.export_table(demo.select("substance", "product", "company", "country", "status", "source"), str(tmp_path / "t"))
    back = readers.read_legacy_medicines(spark, str(tmp_path / "t"))
    assert back.count() == 6 and {r.region for r in demo.select("region").collect()} == {None, "UK"}


def test_export_files_are_compressed(spark, tmp_path):
    """41 columns of text repeat from row to row: as plain text the files of an export took twenty times the disk."""
    from rxatlas.plans import search as plans

    queries = spark.createDataFrame([("a", "Ring"), ("b", "Bolt")], "query_id string, substance string")
    rows = [(i, "ab"[i % 2], ["Ring", "Bolt"][i % 2], f"Ring {i}, 10 mg \"tablets\"", "Spain", "MHRA") for i in range(2000)]
    frame = spark.createDataFrame(rows, "ord long, query_id string, substance string, product string, country string, source string").coalesce(1)
    before = spark.conf.get(store.OPEN_FILES)
    out = plans.export_all(queries, frame, str(tmp_path / "x"), F.lit("now"))
    files = list((tmp_path / "x").rglob("part-*"))
    assert len(files) == 2 and all(f.name.endswith(".csv.gz") for f in files)
    plain = sum(len(",".join(r)) for r in out["sheet"].select(*EXPORT_COLUMNS).collect())
    assert out["written"] == 2000 and sum(f.stat().st_size for f in files) < plain / 10
    back = {r["Product Name"] for r in spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "x" / "file=Bolt_b")).collect()}
    assert back == {r[3] for r in rows if r[1] == "b"} and spark.conf.get(store.OPEN_FILES) == before


def test_rows_of_a_query_are_not_brought_into_one_task(spark):
    """The exports' joins with the queries and their defaults had sides of unknown size, so all rows of a query met in one task."""
    from rxatlas.plans import search as plans

    queries = spark.createDataFrame([("a", "Ring")], "query_id string, substance string")
    rows = [(i, "a", "Ring", f"Ring {i} 10 mg tablets", "Spain", "MHRA", "A10BA02") for i in range(5)]
    frame = spark.createDataFrame(rows, "ord long, query_id string, substance string, product string, country string, source string, atc_code string")
    sheet = plans.export(queries, frame, F.lit("now"))
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert {r["Therapeutic Category"] for r in sheet.collect()} == {"Antidiabetic"}
