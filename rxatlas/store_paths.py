"""Where a job may keep intermediate results so that they survive a lost executor."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, materialised in the shared folder with their partitioning."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Inside, a session setting has another value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def without_leftovers(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Inside, a finished write takes its shuffle files with it: what was written is read back, never computed again from them."""
    return setting(spark, SHUFFLES_GO, "true")


def once_per_value(df: DataFrame, column: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The frame with what ``derive`` adds to its column ``column``, computed once for each distinct value of it.

    Names and leaflets recur from row to row, and reading them costs more than a join. ``df`` is read twice, so callers stage it where
    that is dear. The values are staged, so that the planner knows their size and broadcasts them only if they are few.
    """
    known = stage(derive(df.select(column).distinct()), "values").withColumnRenamed(column, "_value")
    return df.join(known, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: computed once, and a lost executor does not undo them."""
    path = stage_path(df.sparkSession, name)
    with without_leftovers(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
