"""Product-shaped tables derived by Spark from the driver's Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import nz


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-REG: one product row per (part, supplier) that occurs in ``lineitem``; blanks are NULL."""
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    pairs = lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("first_ship"))
    joined = (
        pairs.join(part, pairs.l_partkey == part.p_partkey)
        .join(supplier, pairs.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    form = (
        F.when(F.col("p_type") == "ECONOMY", "film-coated tablets").when(F.col("p_type") == "SMALL", "capsules")
        .when(F.col("p_type") == "LARGE", "oral solution").when(F.col("p_type") == "STANDARD", "cream")
        .when(F.col("p_type") == "PROMO", "tablets").otherwise("")
    )
    part_no, supplier_no = F.col("p_partkey").cast("string"), F.col("s_suppkey").cast("string")
    number = F.concat(F.lit("PL "), F.lpad(part_no, 5, "0"), F.lit("/"), F.lpad(supplier_no, 4, "0"))
    code = F.when(F.col("p_partkey") % 5 == 0, "A10BA02").when(F.col("p_partkey") % 5 == 1, "N02BE01").when(
        F.col("p_partkey") % 5 == 2, "C09AA02"
    )
    return joined.select(
        (F.col("p_partkey") * 100000 + F.col("s_suppkey")).alias("ord"),
        F.expr("substr(p_name, instr(p_name, ' ') + 1)").alias("substance"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg "), form).alias("product"),
        F.col("s_name").alias("company"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.col("p_brand").alias("source"),
        F.when(F.col("p_partkey") % 4 != 0, number).alias("registration_number"),
        F.col("first_ship").cast("string").alias("registration_date"),
        code.alias("atc_code"),
    )


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EVT: job, progress and health events."""
    return events_as_jobs(table(spark, sf_dir, "events"))


def events_as_jobs(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "purchase", "done")
        .when(kind == "click", "timeout").otherwise("failed")
    )
    return events.select(
        F.col("event_id").alias("ord"),
        F.col("user_id").cast("string").alias("job_id"),
        F.concat(F.lit("source"), (F.col("event_id") % 8).cast("string")).alias("source"),
        status.alias("status"),
        nz(F.regexp_extract("props", "[0-9]+", 0)).cast("int").alias("records"),
        F.col("value").alias("elapsed_seconds"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def leaflets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-LEAF: one leaflet text with known answers per product row."""
    reg = registrations(spark, sf_dir)
    line = F.lit("\n")
    return reg.select(
        "ord",
        F.concat(
            F.lit("Marketing Authorisation Holder"), line, F.col("company"), F.lit(" Ltd, "), F.col("country"), line,
            F.lit("Manufacturer"), line, F.lit("Maker "), F.col("substance"), F.lit(" GmbH, Germany"), line,
            F.lit("Pack sizes"), line, F.lit("24 tablets"),
        ).alias("text"),
    )
