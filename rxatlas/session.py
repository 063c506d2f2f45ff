"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def settings(shuffle_partitions: int | None = None) -> dict[str, str]:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # text parsing is bound by CPU, not by bytes: small shuffle partitions still deserve a core each
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        # the JVM does not compile methods above 8000 bytecodes: such stages run faster without whole-stage code
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.legacy.javaCharsets": "true",  # windows-1252 payload files
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return conf


def local_session(cpus: int | str = 8, name: str = "rxatlas", memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings(int(cpus) if str(cpus).isdigit() else 8).items():
        builder = builder.config(key, value)
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
    return builder.getOrCreate()
