"""Structured Streaming variants of the search job.

State ends: repeats are remembered within a watermark, a job's progress until all its sources have ended; health is one row per
connector. What a state has given out before it ended is not lost: updates are partial results, which
``jobs.merged_progress`` and ``jobs.latest_health`` put together in any order. Checkpoints go to the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.base import lower_trim
from ..operators import identity, jobs, store
from ..store_paths import stage, stage_path

EVENT_DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
KEY = ["source", "product", "country", "registration_number", "url"]


def read_events(spark: SparkSession, folder: str, glob: str = "*.parquet", max_files: int = 100) -> DataFrame:
    """Event files as a stream."""
    return (
        spark.readStream.schema(EVENT_DDL).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files).parquet(folder)
    )


def stream_results(rows: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First row per job and five-part key; repeats within the watermark are dropped by the state store.

    Repeats older than the watermark are left to ``append_new`` at the sink, which knows the history.
    """
    keyed = rows.withColumns({f"_k{i}": lower_trim(c) for i, c in enumerate(KEY)})
    unique = keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id", *[f"_k{i}" for i in range(len(KEY))]])
    return unique.drop(*[f"_k{i}" for i in range(len(KEY))])


def append_new(path: str):
    """T1 sink: rows whose key is not stored yet, appended; a repeated batch id rewrites only its own part."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["job_id", *KEY]
        if store.path_exists(spark, path):
            known = spark.read.parquet(path).filter(F.col("batch_id") < batch_id).select(*columns)
        else:
            known = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        fresh = jobs.save_job_results(known, batch)
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink


_PROGRESS = "source string, status string, records int, at bigint, ord bigint, started bigint, finished bigint"


def _merged(old: tuple, new: tuple) -> tuple:
    """(status, records, at, ord, started, finished): the later status, the first start and the last end."""
    last = max(old, new, key=lambda p: (p[2], p[3]))
    started = [p[4] for p in (old, new) if p[4] is not None]
    finished = [p[5] for p in (old, new) if p[5] is not None]
    return (*last[:4], min(started, default=None), max(finished, default=None))


class _JobProgress(StatefulProcessor):
    """The sources of a job by name; all of them go when every one has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "source string", _PROGRESS.removeprefix("source string, "))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found: dict[str, tuple] = {}
        for frame in rows:
            for source, status, records, at, order in zip(*(frame[c].tolist() for c in ("source", "status", "records", "at", "ord")), strict=True):
                new = (status, int(records), at, order, at if status == "running" else None, at if status in jobs.TERMINAL else None)
                found[source] = _merged(found[source], new) if source in found else new
        known = {k[0]: tuple(v) for k, v in self.sources.iterator()}
        now = {s: _merged(known[s], p) if s in known else p for s, p in found.items()}
        if all(p[0] in jobs.TERMINAL for p in {**known, **now}.values()):
            self.sources.clear()
        else:
            for source, progress in now.items():
                self.sources.updateValue((source,), progress)
        out = pd.DataFrame([(key[0], s, *p) for s, p in now.items()], columns=["job_id", "source", "status", "records", "at", "ord", "started", "finished"])
        yield out.astype({"started": "Int64", "finished": "Int64"})

    def close(self) -> None:
        pass


def _keeping_state(spark: SparkSession) -> None:
    """Named states need the state store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_progress(events: DataFrame) -> DataFrame:
    """Partial progress per (job, source) for update mode; ``jobs.merged_progress`` of all updates is the progress.

    The state of a job goes when all the sources that have reported have ended; rows that come later open it anew.
    """
    _keeping_state(events.sparkSession)
    rows = events.select("job_id", "source", "status", F.coalesce("records", F.lit(0)).alias("records"), F.unix_micros("ts").alias("at"), "ord")
    out = rows.groupBy("job_id").transformWithStateInPandas(_JobProgress(), f"job_id string, {_PROGRESS}", "Update", "None")
    return out.select(
        "job_id", "source", "status", "records", F.timestamp_micros("at").alias("ts"), "ord",
        F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("finished").alias("finished_at"))


def stream_health(events: DataFrame) -> DataFrame:
    """T4: the newest event per source for update mode; one small state per connector, of which there is a fixed list.

    ``jobs.latest_health`` of all updates is the health.
    """
    last = F.max_by(F.struct("status", "records", "elapsed_seconds", "ts", "ord"), F.struct("ts", "ord"))
    return events.groupBy("source").agg(last.alias("_last")).select("source", "_last.*")


def job_sink(path: str):
    """E6 sink: what the sources of search jobs report, written as three tables that are keyed by the batch.

    Incoming rows: (job_id, source, ord, ts, status, records, error, elapsed_seconds) and, for rows a source found, the product columns.
    A report's status is queued, running or ended; the error of an ended one tells done from timeout and failed (T6). A report without
    a source ends the job itself as failed. Every table's part of a batch is overwritten as a whole, so a repeated batch changes
    nothing; ``jobs.job_tables`` puts the parts together.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = stage(batch, "reports")
        outcome = F.when(F.col("status") == "ended", jobs.classify_outcome("error")).otherwise(F.col("status"))
        reports = batch.filter("product IS NULL").withColumn("status", outcome)

        def write(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")

        write(jobs.partial_progress(reports.filter("source IS NOT NULL")), "progress")
        write(reports.filter("source IS NULL").groupBy("job_id").agg(F.min_by(F.struct("ts", "error"), F.struct("ts", "ord")).alias("crash")), "crashes")
        ended = reports.filter(F.col("source").isNotNull() & F.col("status").isin(*jobs.TERMINAL))
        write(identity.keep_first(ended, [F.col("source")], F.struct("ts", "ord"), last=True).drop("product"), "health")
        columns = ["job_id", *KEY]
        known = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
        if store.path_exists(spark, f"{path}/results"):
            known = spark.read.parquet(f"{path}/results").filter(F.col("batch_id") < batch_id).select(*columns)
        reported = ["status", "records", "error", "elapsed_seconds", "ts"]
        write(jobs.save_job_results(known, batch.filter("product IS NOT NULL").drop(*reported)), "results")

    return sink


def upsert_into(path: str):
    """T5 sink: every micro-batch upserted into the product store as a version of its own, which holds the buckets it touches.

    The first batch notes the version it started from; a batch's version follows from its id, so a repeated batch
    reads what it read before and rewrites its own version.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, noted = batch.sparkSession, f"{path}/_stream_start"
        if not store.path_exists(spark, noted):
            newest = max(store.versions(spark, path), default=0)
            spark.createDataFrame([(newest, batch_id)], "version long, batch_id long").coalesce(1).write.parquet(noted)
        start = spark.read.parquet(noted).first()
        number = start["version"] + 1 + batch_id - start["batch_id"]
        store.upsert_store(spark, path, batch, number)

    return sink


def drain(frame: DataFrame, mode: str, sink=None, name: str = "drained") -> DataFrame | None:
    """Runs a stream over all available input and returns its last output (or None with a sink).

    In update mode a key's last emitted row is its final one: rows carry their batch id, and the
    newest per key is up to the caller.
    """
    spark = frame.sparkSession
    checkpoint, out = stage_path(spark, f"{name}-state"), stage_path(spark, f"{name}-out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    query = (
        frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink or keep).start()
    )
    query.awaitTermination()
    return None if sink else spark.read.parquet(out).drop("part")


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final row per key of a drained update stream."""
    from ..operators.identity import keep_first

    return keep_first(updates, [F.col(k) for k in keys], "_batch", last=True).drop("_batch")
