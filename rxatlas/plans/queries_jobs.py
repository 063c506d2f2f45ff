"""Queries over the store, search jobs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.company import strip_holder_manufacturers
from ..operators import jobs, store
from ..store_paths import stage_path
from ..streaming import streams
from . import search as plans
from .catalog import EVT, REG, query
from .fixtures import events_as_jobs, health_events, registrations, table
from .queries_rows import MAKERS_SQL, with_makers
from .queries_search import placeholders

SEED_KEY = "source, product, country, COALESCE(registration_number, '')"


@query("s2_read_store", "SELECT ord, product FROM reg", REG)
def _s2(spark, d):
    return registrations(spark, d).orderBy("product", "ord").select("ord", "product")


@query("k1_seed_if_sparse", f"""
WITH st AS (SELECT * FROM reg WHERE ord IN (SELECT min(ord) FROM reg GROUP BY source, product)),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SEED_KEY} ORDER BY ord) AS rn FROM reg) WHERE rn = 1)
SELECT 'sparse' AS store, ord FROM st UNION ALL SELECT 'sparse', ord FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source = f.source AND st.product = f.product
  AND st.country = f.country AND COALESCE(st.registration_number, '') = COALESCE(f.registration_number, ''))
UNION ALL SELECT 'full', ord FROM st""", REG)
def _k1(spark, d):
    """The store has the first registration of every product; the seed has all of them."""
    reg = registrations(spark, d)
    firsts = reg.groupBy("source", "product").agg(F.min("ord").alias("ord")).select("ord")
    some = reg.join(firsts, "ord", "left_semi")
    rows = some.count()
    sparse = store.seed_if_sparse(some, reg, minimum_rows=rows + 1).select(F.lit("sparse").alias("store"), "ord")
    return sparse.unionByName(store.seed_if_sparse(some, reg, minimum_rows=rows).select(F.lit("full").alias("store"), "ord"))


#: rows saved one by one: per (source, product, country) the stored rows are a list that each incoming row updates or extends.
#: Reads ``st`` (id, ...) and ``b`` (ord, ...); gives id, product, registration_number and status
ONE_BY_ONE = """
bn AS (SELECT ord, source, product, country, COALESCE(registration_number, '') AS rn, COALESCE(product_url, '') AS u,
   row_number() OVER (PARTITION BY source, product, country ORDER BY ord) AS k FROM b),
s0 AS (SELECT source, product, country, list({'id': id, 'rn': COALESCE(registration_number, ''), 'u': COALESCE(product_url, ''), 'ord': CAST(NULL AS BIGINT)} ORDER BY id) AS rows FROM st GROUP BY ALL),
g AS (SELECT DISTINCT source, product, country FROM (SELECT source, product, country FROM st UNION ALL SELECT source, product, country FROM b)),
x(source, product, country, k, rows) AS (
  SELECT g.source, g.product, g.country, CAST(0 AS BIGINT), COALESCE(s0.rows, []) FROM g LEFT JOIN s0 USING (source, product, country)
  UNION ALL
  SELECT source, product, country, k, CASE WHEN hit IS NULL THEN list_append(rows, {'id': (SELECT max(id) FROM st) + 1 + ord, 'rn': rn, 'u': u, 'ord': ord})
    ELSE list_transform(rows, lambda r: CASE WHEN r.id = hit THEN {'id': r.id, 'rn': rn, 'u': u, 'ord': ord} ELSE r END) END
  FROM (SELECT x.source, x.product, x.country, bn.k, x.rows, bn.ord, bn.rn, bn.u,
      list_min(list_transform(list_filter(x.rows, lambda r: (bn.rn <> '' AND r.rn = bn.rn) OR (bn.u <> '' AND r.u = bn.u) OR (bn.rn = '' AND bn.u = '')), lambda r: r.id)) AS hit
    FROM x JOIN bn ON x.source = bn.source AND x.product = bn.product AND x.country = bn.country AND bn.k = x.k + 1)),
fin AS (SELECT source, product, country, arg_max(rows, k) AS rows FROM x GROUP BY ALL),
saved AS (SELECT product, unnest(rows) AS r FROM fin)
SELECT r.id AS id, product, nullif(r.rn, '') AS registration_number, CASE WHEN r.ord IS NULL THEN 'stored' ELSE 'new' END AS status FROM saved"""


@query("k2_upsert_products", f"""
WITH RECURSIVE st AS (SELECT ord AS id, source, product, country, registration_number, 'https://r.test/' || ord AS product_url FROM reg),
b AS (SELECT ord, source, product || CASE WHEN MOD(ord, 4) = 3 THEN ' new' ELSE '' END AS product, country,
   CASE WHEN MOD(ord, 3) = 0 THEN registration_number END AS registration_number,
   CASE WHEN MOD(ord, 3) = 1 THEN 'https://r.test/' || ord END AS product_url FROM reg), {ONE_BY_ONE}""", REG)
def _k2(spark, d):
    reg = registrations(spark, d).select("ord", "source", "product", "country", "registration_number")
    o = F.col("ord")
    url = F.concat(F.lit("https://r.test/"), o.cast("string"))
    current = reg.withColumnRenamed("ord", "id").withColumns({"product_url": F.concat(F.lit("https://r.test/"), F.col("id").cast("string")), "status": F.lit("stored")})
    batch = reg.withColumns({
        "product": F.when(o % 4 == 3, F.concat("product", F.lit(" new"))).otherwise(F.col("product")),
        "registration_number": F.when(o % 3 == 0, F.col("registration_number")),
        "product_url": F.when(o % 3 == 1, url), "status": F.lit("new"),
    })
    return store.upsert_products(current, batch).select("id", "product", "registration_number", "status")


@query("k2_upsert_chains", f"""
WITH RECURSIVE named AS (SELECT ord, source, split_part(product, ' ', 1) || ' ' || substance AS product, country, registration_number, ord // 100000 AS part FROM reg),
st AS (SELECT ord AS id, source, product, country, registration_number, CAST(NULL AS VARCHAR) AS product_url FROM named),
v AS (SELECT *, unnest([0, 1]) AS v FROM named),
b AS (SELECT ord * 2 + v AS ord, source, product, country, CASE WHEN v = 0 THEN registration_number WHEN MOD(ord, 4) IN (1, 3) THEN 'N' || MOD(ord, 7) END AS registration_number,
   CASE WHEN v = 0 THEN 'u' || MOD(part, 11) WHEN MOD(ord, 4) > 1 THEN 'u' || MOD(ord, 13) END AS product_url FROM v), {ONE_BY_ONE}""", REG)
def _k2_chains(spark, d):
    """Products named by two words only: rows of a batch meet each other and the store through numbers and URLs that earlier ones of them set."""
    reg = registrations(spark, d)
    o, v, part = F.col("ord"), F.col("v"), F.floor(F.col("ord") / 100000)
    named = reg.select("ord", "source", F.concat(F.split_part("product", F.lit(" "), F.lit(1)), F.lit(" "), "substance").alias("product"), "country", "registration_number")
    current = named.withColumnRenamed("ord", "id").withColumns({"status": F.lit("stored"), "product_url": F.lit(None).cast("string")})

    def name(prefix, number, by):
        return F.concat(F.lit(prefix), (number % by).cast("string"))

    rows = named.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    batch = rows.select(
        (o * 2 + v).alias("ord"), "source", "product", "country", F.lit("new").alias("status"),
        F.when(v == 0, F.col("registration_number")).when((o % 4).isin(1, 3), name("N", o, 7)).alias("registration_number"),
        F.when(v == 0, name("u", part, 11)).when(o % 4 > 1, name("u", o, 13)).alias("product_url"),
    )
    return store.upsert_products(current, batch).select("id", "product", "registration_number", "status")


@query("k5_purge_lookup_rows", "SELECT ord FROM reg WHERE source NOT IN ('Brand#1', 'Brand#4')", REG)
def _k5(spark, d):
    return store.purge_lookup_rows(placeholders(spark, d)).select("ord")


@query("k8_safe_filename", "SELECT ord, COALESCE(NULLIF(trim(regexp_replace(trim(product), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'export') AS name FROM reg", REG)
def _k8(spark, d):
    return registrations(spark, d).select("ord", store.safe_filename("product").alias("name"))


@query("d17_strip_holder_manufacturers", """
SELECT ord, CASE MOD(ord, 4) WHEN 1 THEN 'Maker ' || substance WHEN 2 THEN 'Maker ' || substance || ' GmbH ;' END AS manufacturer_name,
  CASE WHEN MOD(ord, 4) <> 0 THEN manufacturer_country END AS manufacturer_country, CASE WHEN MOD(ord, 4) <> 0 THEN manufacturer_source END AS manufacturer_source FROM makers""",
       REG + ", " + MAKERS_SQL)
def _d17(spark, d):
    return strip_holder_manufacturers(with_makers(registrations(spark, d))).select(
        "ord", "manufacturer_name", "manufacturer_country", "manufacturer_source"
    )


# --- Jobs ---------------------------------------------------------------------------------------


@query("k6_save_progress", "SELECT job_id, source, max_by(status, ord) AS status, max_by(COALESCE(records, 0), ord) AS records FROM evt GROUP BY ALL", EVT)
def _k6(spark, d):
    return jobs.save_progress(health_events(spark, d)).select("job_id", "source", "status", "records")


@query("k7_save_job_results", """
WITH r AS (SELECT ord, job_id, source, status AS product FROM evt)
SELECT min(ord) AS ord, job_id, source, product FROM r WHERE (job_id, source, product) NOT IN (SELECT (job_id, source, product) FROM r WHERE product = 'queued')
GROUP BY ALL""", EVT)
def _k7(spark, d):
    rows = health_events(spark, d).select("ord", "job_id", "source", F.col("status").alias("product"))
    blank = F.lit("")
    full = rows.withColumns({"country": blank, "registration_number": blank, "url": blank})
    return jobs.save_job_results(full.filter("product = 'queued'"), full).select("ord", "job_id", "source", "product")


HEALTH_SQL = """SELECT source, max_by(status, (ts, ord)) AS last_status, max_by(COALESCE(records, 0), (ts, ord)) AS last_records,
  round(max_by(elapsed_seconds, (ts, ord)), 2) AS last_elapsed_seconds FROM evt GROUP BY source"""


@query("a7_latest_health", HEALTH_SQL, EVT)
def _a7(spark, d):
    return jobs.latest_health(health_events(spark, d)).select("source", "last_status", "last_records", "last_elapsed_seconds")


def job_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, progress, results) out of F-EVT."""
    events = health_events(spark, d)
    table_of_jobs = events.groupBy("job_id").agg(F.min("ts").alias("created_at"), F.max_by("status", "ord").alias("status"))
    return table_of_jobs, jobs.save_progress(events), events.filter("status = 'done'").select("job_id", "source")


@query("a8_job_summary", """
WITH p AS (SELECT job_id, source, max_by(status, ord) AS status, max_by(COALESCE(records, 0), ord) AS records FROM evt GROUP BY ALL),
l AS (SELECT job_id, string_agg(source || ':' || status || ':' || records, ',' ORDER BY source) AS progress FROM p GROUP BY job_id)
SELECT job_id, max_by(status, ord) AS status, count(*) FILTER (status = 'done') AS record_count, any_value(progress) AS progress FROM evt JOIN l USING (job_id) GROUP BY job_id""", EVT)
def _a8(spark, d):
    table_of_jobs, progress, results = job_tables(spark, d)
    summary = jobs.job_summary(table_of_jobs, progress, results)
    entry = F.transform("progress", lambda p: F.concat_ws(":", p["source"], p["status"], p["records"].cast("string")))
    return summary.select("job_id", "status", "record_count", F.array_join(entry, ",").alias("progress"))


@query("j12_jobs_with_counts", "SELECT job_id, count(*) FILTER (status = 'done') AS record_count FROM evt GROUP BY job_id", EVT)
def _j12(spark, d):
    table_of_jobs, _, results = job_tables(spark, d)
    return jobs.jobs_with_counts(table_of_jobs, results).select("job_id", "record_count")


@query("l5_top_jobs", """
SELECT job_id, count(*) FILTER (status = 'done') AS record_count FROM evt GROUP BY job_id ORDER BY min(ts) DESC, job_id LIMIT 25""", EVT)
def _l5(spark, d):
    table_of_jobs, _, results = job_tables(spark, d)
    return jobs.recent_jobs(table_of_jobs, results).select("job_id", "record_count")


@query("j10_status_with_metadata", """
SELECT s.ord, CASE s.source WHEN 'source1' THEN 'US' WHEN 'source2' THEN 'CH' ELSE '' END AS region, s.source IN ('source1') AS enabled FROM evt s""", EVT)
def _j10(spark, d):
    from ..operators.scope import status_with_metadata

    s = F.col("source")
    name = F.when(s == "source1", "FDA").when(s == "source2", "Swissmedic").otherwise(s)
    status = health_events(spark, d).select("ord", name.alias("name"))
    return status_with_metadata(status, dims.dims(spark)["source"]).select("ord", "region", "enabled")


@query("j11_status_with_health", """
SELECT e.ord, COALESCE(h.last_status, 'not checked') AS last_status FROM evt e LEFT JOIN (
  SELECT source, max_by(status, (ts, ord)) AS last_status FROM evt WHERE status <> 'queued' AND source <> 'source3' GROUP BY source) h ON h.source = e.source""", EVT)
def _j11(spark, d):
    from ..operators.scope import status_with_health

    events = health_events(spark, d)
    health = jobs.latest_health(events.filter("status <> 'queued' AND source <> 'source3'"))
    return status_with_health(events.select("ord", F.col("source").alias("name")), health).select("ord", "last_status")


@query("e9_connector_health", """
WITH n AS (SELECT CASE source WHEN 'source1' THEN 'FDA' WHEN 'source2' THEN 'EMA' ELSE source END AS name, max_by(status, (ts, ord)) AS st FROM evt GROUP BY source)
SELECT c.name, COALESCE(n.st, 'not checked') AS last_status FROM (SELECT unnest(['FDA', 'MHRA', 'EMA', 'EU MRI Product Index', 'Health Canada', 'TGA Australia',
  'Medsafe New Zealand', 'Hong Kong Drug Office', 'NMPA China', 'GRLS Russia', 'Belgium FAMHP', 'France BDPM', 'Ireland medicines.ie', 'Spain CIMA']) AS name) c LEFT JOIN n USING (name)""", EVT)
def _e9(spark, d):
    s = F.col("source")
    named = health_events(spark, d).withColumn("source", F.when(s == "source1", "FDA").when(s == "source2", "EMA").otherwise(s))
    return plans.connector_health(spark, jobs.latest_health(named)).select("name", "last_status")


@query("e6_start_jobs", """
SELECT job_id, source, CASE WHEN source = 'FDA' THEN 'queued' ELSE 'skipped' END AS status
FROM (SELECT DISTINCT job_id, CASE source WHEN 'source1' THEN 'FDA' WHEN 'source2' THEN 'EMA' ELSE source END AS source FROM evt)""", EVT)
def _e6(spark, d):
    s = F.col("source")
    named = health_events(spark, d).select("job_id", F.when(s == "source1", "FDA").when(s == "source2", "EMA").otherwise(s).alias("source"))
    asked = named.groupBy("job_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return jobs.start_jobs(asked).select("job_id", "source", "status")


@query("t6_classify_outcome", "SELECT ord, CASE status WHEN 'timeout' THEN 'timeout' WHEN 'failed' THEN 'failed' ELSE 'done' END AS outcome FROM evt", EVT)
def _t6(spark, d):
    error = F.when(F.col("status") == "timeout", "timeout").when(F.col("status") == "failed", "HTTP 500")
    return health_events(spark, d).select("ord", jobs.classify_outcome(error).alias("outcome"))


# --- Streams ------------------------------------------------------------------------------------

PROGRESS_SQL = """SELECT job_id, source, max_by(status, (ts, ord)) AS status, max_by(COALESCE(records, 0), (ts, ord)) AS records,
  strftime(min(ts) FILTER (status = 'running'), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(max(ts) FILTER (status IN ('done', 'failed', 'timeout', 'skipped')), '%Y-%m-%d %H:%M:%S') AS finished_at FROM evt GROUP BY job_id, source"""


def landed_events(spark, d, parts: int = 4) -> str:
    """The events table as files of ascending time, one for each micro-batch to come."""
    events, folder = table(spark, d, "events"), stage_path(spark, "events")
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if span["low"] is None:
        events.write.parquet(folder)
        return folder
    step = max(((span["high"] - span["low"]) / parts).total_seconds() * 1e6, 1.0)
    passed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(span["low"]).cast("timestamp"))
    part = F.least(F.floor(passed / step), F.lit(parts - 1))
    for i in range(parts):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def event_stream(spark, d, parts: int = 4) -> DataFrame:
    return events_as_jobs(streams.read_events(spark, landed_events(spark, d, parts), max_files=1))


@query("t1_stream_results", """
SELECT job_id, source, status AS product FROM evt GROUP BY ALL""", EVT)
def _t1(spark, d):
    """Four micro-batches in order of time: repeats beyond the watermark are left to the sink."""
    stored = stage_path(spark, "results")
    blank = F.lit("")
    rows = event_stream(spark, d).withColumn("product", F.col("status")).withColumns(
        {"country": blank, "registration_number": blank, "url": blank}
    )
    streams.drain(streams.stream_results(rows, "1 hour"), "append", streams.append_new(stored), name="results")
    return spark.read.parquet(stored).select("job_id", "source", "product")


@query("t2_stream_progress", PROGRESS_SQL, EVT)
def _t2(spark, d):
    updates = streams.drain(streams.stream_progress(event_stream(spark, d)), "update", name="progress")
    last = jobs.merged_progress(updates)
    stamps = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "finished_at")}
    return last.withColumns(stamps)


@query("t3_stream_job_status", """
WITH p AS (SELECT job_id, source, max_by(status, (ts, ord)) AS status, max_by(COALESCE(records, 0), (ts, ord)) AS records FROM evt GROUP BY job_id, source)
SELECT job_id, CASE WHEN count(*) FILTER (status NOT IN ('done', 'failed', 'timeout', 'skipped')) = 0 THEN 'done' ELSE 'running' END AS status,
  COALESCE(sum(records) FILTER (status = 'done'), 0) AS record_count FROM p GROUP BY job_id""", EVT)
def _t3(spark, d):
    updates = streams.drain(streams.stream_progress(event_stream(spark, d)), "update", name="status")
    return jobs.job_state(jobs.merged_progress(updates)).select("job_id", "status", "record_count")


@query("t4_stream_health", HEALTH_SQL, EVT)
def _t4(spark, d):
    updates = streams.drain(streams.stream_health(event_stream(spark, d)), "update", name="health")
    return jobs.latest_health(updates).select("source", "last_status", "last_records", "last_elapsed_seconds")


@query("t5_stream_upsert", """
SELECT source, product, max_by(status, ord) AS status, max_by(registration_number, ord) AS registration_number FROM (
  SELECT ord, source, 'job ' || job_id AS product, status, 'R' || records AS registration_number FROM evt)
GROUP BY source, product, registration_number""", EVT)
def _t5(spark, d):
    rows = event_stream(spark, d, 2).select(
        "ord", "source", F.concat(F.lit("job "), "job_id").alias("product"), "status",
        F.concat(F.lit("R"), F.col("records").cast("string")).alias("registration_number"),
    )
    path = stage_path(spark, "products")
    streams.drain(rows, "append", streams.upsert_into(path), name="upsert")
    return store.read_store(spark, path).select("source", "product", "status", "registration_number")




JOB_REPORTS_SQL = """
rep AS (SELECT ord, job_id, source, ts, status, CASE status WHEN 'timeout' THEN 'timeout' WHEN 'failed' THEN 'HTTP 500' ELSE '' END AS error, COALESCE(records, 0) AS records,
  status = 'failed' AND MOD(ord, 61) = 0 AS crashed FROM evt WHERE source <> 'source7'),
crash AS (SELECT job_id, min(ts) AS ts FROM rep WHERE crashed GROUP BY job_id),
began AS (SELECT job_id, source, CASE WHEN source = 'source6' THEN 'skipped' ELSE 'queued' END AS first_status FROM (SELECT DISTINCT job_id FROM evt) CROSS JOIN (SELECT 'source' || unnest(range(8)) AS source)),
last AS (SELECT job_id, source, max_by(status, (ts, ord)) AS status, max_by(records, (ts, ord)) AS records, min(ts) FILTER (status = 'running') AS started_at,
  max(ts) FILTER (status IN ('done', 'timeout', 'failed')) AS finished_at FROM rep WHERE NOT crashed GROUP BY ALL),
prog AS (SELECT b.job_id, b.source, c.ts AS crash_ts, started_at, COALESCE(l.status, first_status) AS said, COALESCE(records, 0) AS records, finished_at,
  CASE WHEN c.ts IS NOT NULL AND COALESCE(l.status, first_status) IN ('queued', 'running') THEN 'failed' ELSE COALESCE(l.status, first_status) END AS status
  FROM began b LEFT JOIN last l USING (job_id, source) LEFT JOIN crash c USING (job_id))"""


def job_reports(spark, d) -> DataFrame:
    """F-EVT as reports: a done source also hands in a row; some failures end the whole job; one source never reports."""
    events = event_stream(spark, d).filter("source <> 'source7'")
    error = F.when(F.col("status") == "timeout", "timeout").when(F.col("status") == "failed", "HTTP 500")
    crashed = (F.col("status") == "failed") & (F.col("ord") % 61 == 0)
    ended = F.col("status").isin("done", "timeout", "failed")
    blank = F.lit(None).cast("string")
    report = F.struct(F.when(crashed, blank).otherwise(F.col("source")).alias("source"), F.when(ended, "ended").otherwise(F.col("status")).alias("status"), error.alias("error"), blank.alias("product"))
    found = F.struct("source", F.col("status").alias("status"), blank.alias("error"), F.concat(F.lit("record "), F.col("records").cast("string")).alias("product"))
    rows = events.select("job_id", "ord", "ts", "records", "elapsed_seconds", F.explode(F.when(F.col("status") == "done", F.array(report, found)).otherwise(F.array(report))).alias("r"))
    return rows.select("job_id", "ord", "ts", "records", "elapsed_seconds", "r.*").withColumns({"country": F.lit("x"), "registration_number": blank, "url": blank})


def run_jobs(spark, d) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(jobs and progress, results, health) of the events' jobs, over four micro-batches."""
    path = stage_path(spark, "jobs")
    streams.drain(job_reports(spark, d), "append", streams.job_sink(path), name="jobs")
    asked = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id")).distinct()
    sources = asked.withColumn("source", F.explode(F.array(*[F.lit(f"source{i}") for i in range(8)])))
    started = sources.withColumns({"status": F.when(F.col("source") == "source6", "skipped").otherwise("queued"), "error": F.lit("")})
    return plans.job_status(spark, path, started)


@query("e6_job_run", """
WITH """ + JOB_REPORTS_SQL.strip() + """,
r AS (SELECT job_id, count(DISTINCT (source, records)) AS record_count FROM evt WHERE source <> 'source7' AND status = 'done' AND records IS NOT NULL GROUP BY job_id)
SELECT job_id, CASE WHEN any_value(crash_ts) IS NOT NULL THEN 'failed' WHEN count(*) FILTER (status IN ('queued', 'running')) = 0 THEN 'done'
  WHEN count(*) FILTER (status IN ('running', 'done', 'failed', 'timeout')) > 0 THEN 'running' ELSE 'queued' END AS status,
  strftime(min(started_at), '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(CASE WHEN any_value(crash_ts) IS NOT NULL THEN any_value(crash_ts) WHEN count(*) FILTER (status IN ('queued', 'running')) = 0 THEN max(finished_at) END, '%Y-%m-%d %H:%M:%S') AS finished_at,
  COALESCE(any_value(r.record_count), 0) AS record_count FROM prog LEFT JOIN r USING (job_id) GROUP BY job_id""", EVT)
def _e6_run(spark, d):
    """Jobs of eight sources each: one is skipped, one never reports, others fail or time out, and some jobs crash."""
    out, _, _ = run_jobs(spark, d)
    stamps = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "finished_at")}
    return out["jobs"].withColumns(stamps).select("job_id", "status", "started_at", "finished_at", "record_count")


@query("e6_job_progress", """
WITH """ + JOB_REPORTS_SQL.strip() + """
SELECT job_id, source, status, records, CASE WHEN status = 'timeout' THEN 'timeout' WHEN status = 'failed' THEN 'HTTP 500' ELSE '' END AS error FROM prog""", EVT)
def _e6_progress(spark, d):
    return run_jobs(spark, d)[0]["progress"].select("job_id", "source", "status", "records", "error")


@query("e6_job_results", """
SELECT job_id, min(ord) AS ord, source, 'record ' || records AS product FROM evt WHERE source <> 'source7' AND status = 'done' AND records IS NOT NULL GROUP BY job_id, source, records""", EVT)
def _e6_results(spark, d):
    results = run_jobs(spark, d)[1]
    return jobs.job_results(results, "source string, product string").select("job_id", "ord", "source", "product")
