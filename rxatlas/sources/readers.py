"""Readers of landed payload files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import cp1252, nz
from ..operators.identity import keep_first
from ..schema import MEDICINE_COLUMNS, PRODUCT_DDL, STORED_COLUMNS, conform

BLANKS = " \t\xa0"
BLOCK_BITS = 28  # rows of a file block; numbers of up to a million blocks stay below 2**48
PAGE_BITS = 24  # rows of a page


def in_file_order(raw: DataFrame) -> DataFrame:
    """``raw``, straight from a file source, with ``_file`` and ``ord``: the place by file name, then place in the file.

    A file is read in blocks, each by one task, in order. Blocks (a row each) are ranked by file and start; rows count
    from the first row id of their block. Increasing, not consecutive.
    """
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    blocks = rows.groupBy("_file", "_start").agg(F.min("_row").alias("_first"))
    ranked = blocks.withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_start")))
    placed = rows.join(ranked, ["_file", "_start"])
    return placed.withColumn("ord", F.shiftleft(F.col("_rank").cast("bigint"), BLOCK_BITS) + F.col("_row") - F.col("_first")).drop("_start", "_row", "_first", "_rank")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines product seed; blank lines are skipped, absent columns NULL, broken lines set aside.

    ``ord`` is the place by file name and line: increasing, not consecutive.
    """
    raw = spark.read.schema(f"{PRODUCT_DDL}, _corrupt_record string").option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    ).json(path)
    ordered = in_file_order(raw)
    good = ordered.filter(F.col("_corrupt_record").isNull() & F.coalesce(*STORED_COLUMNS).isNotNull())
    return conform(good.drop("_corrupt_record", "_file"))


def read_legacy_medicines(spark: SparkSession, path: str) -> DataFrame:
    """S3: the six-column legacy table from CSV, as product rows."""
    ddl = ", ".join(f"{c} string" for c in MEDICINE_COLUMNS)
    rows = spark.read.option("header", True).schema(ddl).csv(path)
    return conform(in_file_order(rows).drop("_file"))


def read_json_array(spark: SparkSession, path: str, field: str, record_ddl: str) -> DataFrame:
    """Records of a payload object's array (``field`` may be dotted), with their place as ``ord``.

    Every file is one payload; ``ord`` orders by file name, then position.
    """
    schema = f"array<struct<{record_ddl}>>"
    *outer, leaf = field.split(".")
    for part in [leaf, *reversed(outer)][:-1] if outer else []:
        schema = f"struct<`{part}`: {schema}>"
    payload = spark.read.schema(f"`{outer[0] if outer else leaf}` {schema}").option("multiLine", True).json(path)
    located = payload.select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.col(field)).alias("_pos", "_r"))
    # a payload is a page of a search: the number in its file name orders it, then the name
    files = located.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy(page_number(F.col("_file")), "_file")))
    return located.join(files, "_file").select((F.shiftleft(F.col("_rank").cast("bigint"), PAGE_BITS) + F.col("_pos")).alias("ord"), "_r.*")


def page_number(file: Column) -> Column:
    """Number at the end of a file name (page or offset), 0 when there is none."""
    return F.coalesce(nz(F.regexp_extract(file, r"(\d+)\D*$", 1)).try_cast("bigint"), F.lit(0).cast("bigint"))


def read_paged(spark: SparkSession, path: str, field: str, record_ddl: str) -> DataFrame:
    """A folder of pages re-assembled in page order, whatever order they were written in."""
    return read_json_array(spark, path, field, record_ddl)


def header_key(name: str) -> str:
    """A sheet heading as a column name."""
    key = name.lower().replace("\n", " ").replace(" / ", " ").replace("/", " ")
    return re.sub(r"[():]", "", key).replace("-", "_").replace(" ", "_")


def read_with_preamble(spark: SparkSession, path: str, marker: str = "Category", sep: str = ",") -> DataFrame:
    """Sheets with junk above their header, whose first cell is ``marker``.

    The columns are those of the first header line (a look at one row); each file's data stand below its own first header.
    """
    lines = in_file_order(spark.read.text(path))
    first_cell = F.trim(F.split("value", f"[{sep}]").getItem(0), F.lit(' "'))
    head = lines.filter(first_cell == marker).orderBy("ord").select("ord", "value").first()
    if head is None:
        return spark.createDataFrame([], "ord long")
    names = [header_key(h.strip()) for h in _split_csv(head["value"], sep)]
    schema = T.StructType([T.StructField(n or f"_unnamed_{i}", T.StringType()) for i, n in enumerate(names)])
    heads = lines.filter(first_cell == marker).groupBy("_file").agg(F.min("ord").alias("_head"))
    body = lines.join(heads, "_file").filter((F.col("ord") > F.col("_head")) & (F.trim(F.translate("value", f'{sep}"', "")) != "") & (first_cell != marker))
    rows = body.select("ord", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r"))
    return rows.select("ord", *[F.trim(F.col(f"r.{n}")).alias(n) for n in names if n])


def _split_csv(line: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=sep))


def _bdpm(spark: SparkSession, path: str, fields: dict[str, int], minimum: int) -> DataFrame:
    """Headerless tab-separated windows-1252 lines; short lines dropped, cells trimmed.

    The text source reads UTF-8, so lines are taken as bytes-preserving Latin-1 by the CSV source and
    the sixteen or so characters in which windows-1252 differs are mapped.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("sep", "\x01").option("quote", "").schema("line string").csv(path)
    cells = F.split(cp1252(F.col("line")), "\t", -1)
    rows = in_file_order(raw).select("ord", cells.alias("c")).filter(F.size("c") >= minimum)
    return rows.select("ord", *[F.trim(F.get("c", F.lit(i)), F.lit(BLANKS)).alias(n) for n, i in fields.items()])


def read_bdpm_products(spark: SparkSession, path: str) -> DataFrame:
    """French products; the last line per code wins."""
    fields = {
        "cis": 0, "product": 1, "pharmaceutical_form": 2, "route": 3, "status": 4, "procedure": 5,
        "marketing_status": 6, "registration_date": 7, "company": 10,
    }
    return keep_first(_bdpm(spark, path, fields, 12), [F.col("cis")], last=True)


def read_bdpm_compositions(spark: SparkSession, path: str) -> DataFrame:
    """French compositions, several lines per code."""
    fields = {"cis": 0, "form": 1, "substance_code": 2, "substance": 3, "strength": 4, "reference": 5, "role": 6}
    return _bdpm(spark, path, fields, 8)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed regulator pages (page_id, url, html)."""
    return spark.read.parquet(path)
