"""Search jobs: progress, results, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import opt, text
from .identity import keep_first
from .scope import skip_in_mode

TERMINAL = ["done", "failed", "timeout", "skipped"]
SKIP_NOTE = "Skipped in fast mode. Use Full Background Search for this source."
RESULT_KEY = ["source", "product", "country", "registration_number", "url"]


def parse_row_json(df: DataFrame, schema: str, column: str = "row_json") -> DataFrame:
    """Stored rows back as a struct ``row``; rows whose JSON is broken are skipped."""
    strict = F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = df.withColumn("row", strict)
    return parsed.filter(F.col("row").isNotNull() & F.col("row._broken").isNull()).withColumn(
        "row", F.col("row").dropFields("_broken")
    )


def save_jobs(jobs: DataFrame) -> DataFrame:
    """K6: the last saved state per job."""
    return keep_first(jobs, [F.col("job_id")], last=True)


def save_progress(progress: DataFrame) -> DataFrame:
    """K6: the last saved state per (job, source), ``records`` as a number."""
    counted = progress.withColumn("records", F.coalesce(F.col("records").cast("int"), F.lit(0)))
    return keep_first(counted, [F.col("job_id"), F.col("source")], last=True)


def save_job_results(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """K7: rows to append: not yet stored for their job under the exact five-part key, first one wins.

    ``stored``: (job_id, five key columns); ``rows``: the same plus ``ord`` and anything else, which
    goes into ``row_json`` as a whole.
    """
    keyed = rows.select(
        "job_id", "ord", *[text(opt(rows, c)).alias(c) for c in RESULT_KEY],
        F.to_json(F.struct(*[c for c in rows.columns if c not in ("job_id", "ord")])).alias("row_json"),
    )
    fresh = keep_first(keyed, [F.col(c) for c in ("job_id", *RESULT_KEY)])
    known = stored.select("job_id", *[text(c).alias(c) for c in RESULT_KEY])
    return fresh.join(known, ["job_id", *RESULT_KEY], "left_anti")


def latest_health(events: DataFrame) -> DataFrame:
    """Last event per source."""
    latest = keep_first(events, [F.col("source")], F.struct("ts", "ord"), last=True)
    return latest.select(
        "source", F.col("status").alias("last_status"), F.coalesce("records", F.lit(0)).alias("last_records"),
        F.round(F.coalesce("elapsed_seconds", F.lit(0.0)), 2).alias("last_elapsed_seconds"),
        text(opt(events, "error")).alias("last_error"), F.col("ts").alias("last_checked"),
    )


def jobs_with_counts(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """+ record_count per job; only counts are joined."""
    counts = results.groupBy("job_id").agg(F.count("*").alias("record_count"))
    return jobs.join(counts, "job_id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))


def recent_jobs(jobs: DataFrame, results: DataFrame, limit: int = 25) -> DataFrame:
    """J12 + L5: the newest jobs with their counts; the limit comes before the join."""
    from .ordering import top_jobs

    return top_jobs(jobs_with_counts(top_jobs(jobs, limit), results), limit)


def job_summary(jobs: DataFrame, progress: DataFrame, results: DataFrame) -> DataFrame:
    """A job with its record count and its progress list by source (one entry per source: bounded)."""
    entry = F.struct("source", "status", "records")
    listed = progress.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("progress"))
    return jobs_with_counts(jobs, results).join(listed, "job_id", "left")


def start_jobs(queries: DataFrame, mode: str = "fast") -> DataFrame:
    """(job_id, sources array) -> initial progress rows in execution order."""
    from .. import dims

    progress = queries.select("job_id", F.explode("sources").alias("source"))
    staged = skip_in_mode(progress, mode).withColumn("slow", dims.one_of(F.col("source"), dims.SLOW_SOURCES))
    note = F.when(F.col("status") == "skipped", SKIP_NOTE).otherwise("")
    return staged.withColumn("error", note).orderBy("job_id", "slow", F.lower("source"))


def classify_outcome(error: Column | str) -> Column:
    """Done without an error, timeout or failed with one."""
    message = text(error)
    return F.when(message == "", "done").when(message == "timeout", "timeout").otherwise("failed")


def progress_state(events: DataFrame) -> DataFrame:
    """T2 as a batch: per (job, source) the last status, the first start and the last end."""
    running, ended = F.col("status") == "running", F.col("status").isin(*TERMINAL)
    last = F.max_by(F.struct("status", "records"), F.struct("ts", "ord"))
    return events.groupBy("job_id", "source").agg(
        last.alias("_last"), F.min(F.when(running, F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"),
    ).select(
        "job_id", "source", F.col("_last.status").alias("status"), F.coalesce("_last.records", F.lit(0)).alias("records"),
        "started_at", "finished_at",
    )


def partial_progress(events: DataFrame) -> DataFrame:
    """T2's state as rows that ``merged_progress`` can put together: (job_id, source, status, records, error, ts, ord, started_at, finished_at)."""
    running, ended = F.col("status") == "running", F.col("status").isin(*TERMINAL)
    last = F.max_by(F.struct("status", F.coalesce("records", F.lit(0)).alias("records"), text(opt(events, "error")).alias("error"), "ts", "ord"), F.struct("ts", "ord"))
    return events.groupBy("job_id", "source").agg(
        last.alias("_last"), F.min(F.when(running, F.col("ts"))).alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("finished_at"),
    ).select("job_id", "source", "_last.*", "started_at", "finished_at")


def merged_progress(partials: DataFrame) -> DataFrame:
    """Progress per (job, source) from partial rows in any order and number: last status, first start, last end."""
    columns = ["status", "records", *(["error"] if "error" in partials.columns else [])]
    return partials.groupBy("job_id", "source").agg(
        F.max_by(F.struct(*columns), F.struct("ts", "ord")).alias("_last"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
    ).select("job_id", "source", "_last.*", "started_at", "finished_at")


def job_run(started: DataFrame, progress: DataFrame, results: DataFrame, crashes: DataFrame | None = None) -> dict[str, DataFrame]:
    """``jobs`` and ``progress`` of started jobs, from what their sources have reported so far.

    ``started``: (job_id, source, status, error) of ``start_jobs``; ``progress``: merged; ``results``: (job_id, …); ``crashes``: (job_id,
    crash: struct(ts, error)). A source that has not reported keeps its first status. A job that crashed is failed, and so
    are its sources that had not ended. A job is done when all its sources have ended, running once one has started, queued before.
    """
    reported = progress.select("job_id", "source", *[F.col(c).alias(f"_{c}") for c in ("status", "records", "error", "started_at", "finished_at")])
    rows = started.select("job_id", "source", "status", "error").join(reported, ["job_id", "source"], "left")
    if crashes is None:
        rows = rows.withColumn("crash", F.lit(None).cast("struct<ts:timestamp,error:string>"))
    else:
        rows = rows.join(crashes.select("job_id", "crash"), "job_id", "left")
    said = F.coalesce("_status", "status")
    lost = F.col("crash").isNotNull() & said.isin("queued", "running")
    rows = rows.select(
        "job_id", "source", F.when(lost, "failed").otherwise(said).alias("status"), F.coalesce("_records", F.lit(0)).alias("records"),
        F.when(lost, F.col("crash.error")).otherwise(F.coalesce("_error", "error")).alias("error"),
        F.col("_started_at").alias("started_at"), F.when(lost, F.col("crash.ts")).otherwise(F.col("_finished_at")).alias("finished_at"), "crash",
    )
    open_sources = F.count_if(~F.col("status").isin(*TERMINAL))
    begun = F.count_if(F.col("status").isin("running", "done", "failed", "timeout"))
    crash = F.min("crash")
    by_job = rows.groupBy("job_id").agg(
        F.when(crash.isNotNull(), "failed").when(open_sources == 0, "done").when(begun > 0, "running").otherwise("queued").alias("status"),
        F.min("started_at").alias("started_at"),
        F.when(crash.isNotNull(), crash["ts"]).when(open_sources == 0, F.max("finished_at")).alias("finished_at"),
    )
    return {"jobs": jobs_with_counts(by_job, results), "progress": rows.drop("crash")}


def job_results(results: DataFrame, schema: str) -> DataFrame:
    """The stored rows of every job in the order they arrived, each once under its five-part key, as columns."""
    first = keep_first(results, [F.col(c) for c in ("job_id", *RESULT_KEY)])
    return parse_row_json(first, schema).select("job_id", "ord", "row.*").orderBy("job_id", "ord")


def job_state(progress: DataFrame) -> DataFrame:
    """A job runs until every source has ended; its records are those of the finished sources."""
    open_sources = F.count_if(~F.col("status").isin(*TERMINAL))
    return progress.groupBy("job_id").agg(
        F.when(open_sources == 0, "done").otherwise("running").alias("status"),
        F.sum(F.when(F.col("status") == "done", F.col("records")).otherwise(0)).alias("record_count"),
        F.when(open_sources == 0, F.max("finished_at")).alias("finished_at"),
    )
