"""What the corpus operators share: reading columns by name, staging, registering queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store_paths import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the DuckDB statement it is checked against."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lost executors do not undo it, later
    branches do not compute it again, and values that tasks made up (row keys) stay what they are."""
    return stage(df, name)


def dropped(*superseded: DataFrame | None) -> None:
    """Frees the disk of staged tables that later ones replace."""
    for df in superseded:
        for folder in {f.rsplit("/", 1)[0] for f in (df.inputFiles() if df is not None else [])}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_keys() -> Iterator[int]:
    """Numbers no other task gives; stage the frame that carries them before it is read twice."""
    base = TaskContext.get().partitionId() << 36
    while True:
        yield base
        base += 1


def key_range(counter: Iterator[int], n: int) -> pa.Array:
    return pa.array([next(counter) for _ in range(n)], pa.int64())


KEY_BITS = 22


def by_key_table(df: DataFrame, column: str, keys: DataFrame, key_column: str, present: bool = True) -> DataFrame:
    """Rows whose ``column`` may be one of the keys, or with ``present=False`` the rest, which surely is not.

    A table of 2**KEY_BITS hash buckets, whose size does not depend on the data, decides without a shuffle. What it lets
    through wrongly is for a join to drop."""
    bits = np.zeros(1 << KEY_BITS, bool)
    bucket = F.pmod(F.xxhash64(key_column), F.lit(1 << KEY_BITS)).cast("int")
    bits[keys.select(bucket.alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    marked = df.withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(1 << KEY_BITS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(table[batch.column("_bucket").to_numpy(zero_copy_only=False)] == present))

    return marked.mapInArrow(run, marked.schema).drop("_bucket")


def without_keys(df: DataFrame, column: str, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``column`` is among the keys of ``dropped`` (one column of that name); only rows
    that may be among them are shuffled."""
    dropped = staged(dropped, "dropped-keys")
    maybe = by_key_table(df, column, dropped, column)
    other = dropped.withColumnRenamed(column, "_dropped")
    left = maybe.join(other, F.col(column).eqNullSafe(F.col("_dropped")), "left_anti")
    return by_key_table(df, column, dropped, column, present=False).unionByName(left)
