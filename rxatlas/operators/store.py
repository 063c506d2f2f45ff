"""The product store (K1, K2, K5, K8, K9, S2): Parquet with copy-on-write versions.

A store is a folder of numbered versions; a version is whole, or holds the buckets that changed, and readers take the newest of
each bucket. Operators are plain DataFrame -> DataFrame functions; only ``write_version``, ``upsert_store`` and the readers touch
files.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.base import non_empty, opt, text
from ..functions.company import strip_holder_manufacturers
from ..functions.links import region_for_country
from ..schema import STORED_COLUMNS
from ..store_paths import setting, stage
from .identity import keep_first

IDENTITY = ["source", "product", "country", "registration_number"]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, path)
    return fs.exists(folder)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, oldest first."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def read_store(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Newest version of the store, or the newest before a number; an absent store is empty."""
    return read_buckets(spark, path, before=before)


BUCKETS = 64  # of a store, by source, product and country; fixed for its lifetime


def bucket_of(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*[text(opt(df, c)) for c in ("source", "product", "country")]), F.lit(BUCKETS)).cast("int")


def _layers(spark: SparkSession, path: str, before: int | None) -> tuple[int | None, dict[int, int]]:
    """(newest whole version, {bucket: newest later version that has it})."""
    fs, _ = _fs(spark, path)
    newest: dict[int, int] = {}
    for number in reversed([v for v in versions(spark, path) if before is None or v < before]):
        names = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number}"))]
        found = [int(n[7:]) for n in names if n.startswith("bucket=")]
        if not found:
            return number, newest
        for b in found:
            newest.setdefault(b, number)
    return None, newest


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The store as of its newest version, or the newest before a number; with ``only`` the rows of some buckets."""
    whole, newest = _layers(spark, path, before)
    wanted = {b: v for b, v in newest.items() if only is None or b in only}
    parts = [spark.read.parquet(*[f"{path}/v={v}/bucket={b}" for b, v in sorted(wanted.items())])] if wanted else []
    if whole is not None:
        rows = spark.read.parquet(f"{path}/v={whole}")
        here = bucket_of(rows)
        if only is not None:
            rows = rows.filter(here.isin(*only))
        parts.append(rows.filter(~here.isin(*newest)) if newest else rows)
    if not parts:
        ddl = "id long, " + ", ".join(f"{c} string" for c in STORED_COLUMNS)
        return spark.createDataFrame([], ddl)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def upsert_store(spark: SparkSession, path: str, batch: DataFrame, number: int | None = None, now: Column | None = None) -> int:
    """K2 on a stored table: a new version that holds only the buckets the batch touches; the others stay where they are.

    Whoever reads meanwhile sees the version before; a lost or repeated job writes its own version again.
    """
    if number is None:
        number = max(versions(spark, path), default=0) + 1
    batch = stage(batch, "incoming")
    touched = sorted(r["b"] for r in batch.select(bucket_of(batch).alias("b")).distinct().collect())  # at most BUCKETS numbers
    top = read_buckets(spark, path, before=number).agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    rows = upsert_products(read_buckets(spark, path, touched, number), batch, now, top)
    rows = rows.withColumn("bucket", bucket_of(rows)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
    return number


def write_version(df: DataFrame, path: str, partition_by: str | None = None, number: int | None = None) -> int:
    """A new version beside the ones being read; nothing is overwritten, so a lost job leaves the store intact."""
    spark = df.sparkSession
    if number is None:
        number = max(versions(spark, path), default=0) + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/v={number}")
    return number


def purge_lookup_rows(df: DataFrame) -> DataFrame:
    """K5: look-up placeholders do not belong in the store."""
    kind, product = F.lower(text(opt(df, "document_type"))), F.lower(text(opt(df, "product")))
    return df.filter(~(F.contains(kind, F.lit("lookup fallback")) | F.contains(product, F.lit("regulator lookup"))))


def _identity(df: DataFrame) -> list[Column]:
    return [text(opt(df, c)) for c in IDENTITY]


def seed_if_sparse(store: DataFrame, seed: DataFrame, minimum_rows: int) -> DataFrame:
    """K1: seed rows unknown to a store of fewer than ``minimum_rows`` rows, added to it.

    The switch on the store's size is the feature: a full store is left alone. The check reads at most ``minimum_rows``
    rows. ``seed`` carries ``ord``; its own duplicates
    are dropped first-wins because earlier inserts are visible to later ones.
    """
    if store.limit(minimum_rows).count() >= minimum_rows:
        return store
    fresh = keep_first(seed, _identity(seed))
    keys = [F.col(f"_s{i}") == F.col(f"_n{i}") for i in range(len(IDENTITY))]
    known = store.select(*[c.alias(f"_s{i}") for i, c in enumerate(_identity(store))])
    new = fresh.withColumns({f"_n{i}": c for i, c in enumerate(_identity(fresh))})
    condition = keys[0] & keys[1] & keys[2] & keys[3]
    added = new.join(known, condition, "left_anti").select(*fresh.columns)
    return purge_lookup_rows(store.unionByName(with_new_ids(added, store), allowMissingColumns=True))


def with_new_ids(new: DataFrame, store: DataFrame, top: int | None = None) -> DataFrame:
    """Ids after the store's largest, in arrival order; gaps are allowed, uniqueness and order are not given up."""
    if "id" not in store.columns:
        return new
    largest = F.lit(top) if top is not None else store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    return new.withColumn("id", largest + 1 + F.col("ord"))


def prepared_batch(batch: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows as they are stored: holder scrubbed from the manufacturer list, defaults for region, URLs and time."""
    stamp = now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    rows = batch.withColumns({c: F.lit(None).cast("string") for c in STORED_COLUMNS if c not in batch.columns})
    rows = strip_holder_manufacturers(rows)
    url = non_empty(opt(batch, "url"))
    rows = rows.withColumns({
        "region": F.coalesce(non_empty("region"), region_for_country("country")),
        "product_url": F.coalesce(non_empty("product_url"), url),
        "source_url": F.coalesce(non_empty("source_url"), url),
        "last_checked": F.coalesce("last_checked", stamp),
    })
    return rows.select("ord", *STORED_COLUMNS)


def _components(members: DataFrame) -> DataFrame:
    """(node, label): nodes that hang together through keys of ``members`` (node, key) have one label; nodes that share no key
    are left out. Labels are node numbers that only fall; each round passes them on over the keys and then follows them, so chains
    halve."""
    several = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = stage(members.join(several, "key"), "members")
    labels = members.select("node", F.col("node").alias("label")).distinct()
    before = None
    while True:
        by_key = members.join(labels, "node").groupBy("key").agg(F.min("label").alias("label"))
        near = members.join(by_key, "key").groupBy("node").agg(F.min("label").alias("label"))
        ahead = near.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        labels = stage(near.join(ahead, "label", "left").select("node", F.coalesce("ahead", "label").alias("label")), "labels")
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("t")).first()["t"]
        if total == before:
            return labels
        before = total


def _saved_one_by_one(rows: DataFrame) -> DataFrame:
    """(ord, stored, n) for each incoming row: the stored id it updates, or the ``ord`` of the row that inserted what it
    updates (its own for an insertion).

    ``rows``: (label, incoming, n, base, reg, url), rows that can meet each other under one label. Sorted by label, stored rows before incoming ones, they stream past a state of
    the rows' current numbers and URLs; a task holds the state of one label at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, now, at = None, {}, {}

        def lowest(key: tuple) -> tuple | None:
            """The first row that still has a key; rows that lost it are passed over."""
            heap = at.get(key, [])
            while heap and key not in now[heap[0]]:
                heappop(heap)
            return heap[0] if heap else None

        def put(row: tuple, base: int, reg: str, url: str) -> None:
            keys = {(base,), *([(base, "r", reg)] if reg else []), *([(base, "u", url)] if url else [])}
            for key in keys - now.get(row, set()):
                heappush(at.setdefault(key, []), row)
            now[row] = keys

        for batch in batches:
            out = []
            for of, incoming, n, base, reg, url in zip(*(batch.column(c).to_pylist() for c in ("label", "incoming", "n", "base", "reg", "url")), strict=True):
                if of != label:
                    label, now, at = of, {}, {}
                if not incoming:
                    put((0, n), base, reg, url)
                    continue
                asked = [k for k in ((base, "r", reg), (base, "u", url)) if k[2]] or [(base,)]
                found = min((r for r in map(lowest, asked) if r), default=(1, n))
                put(found, base, reg, url)
                out.append((n, found[0] == 0, found[1]))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["ord", "stored", "n"])

    rows = rows.select("label", "incoming", "n", "base", "reg", "url")
    sorted_rows = rows.repartition("label").sortWithinPartitions("label", "incoming", "n")
    return sorted_rows.mapInArrow(run, "ord bigint, stored boolean, n bigint")


LOOKED_UP = 1_000_000  # incoming rows up to which stored rows are first looked up by them; a larger batch meets most of a store
GROUP = 20_000  # rows of one source, product and country that one task orders as they are; more are split by what they share


def upsert_targets(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(ord, stored, n): what each row of a prepared batch updates when the rows are saved one by one in the order of ``ord``.

    A row meets rows of its source, product and country: those with its registration number, those with its product URL, or with neither
    given any of them; the lowest id wins, and the row it updates takes over its number and URL, which later rows
    then meet. Only rows that can meet each other need an order. Up to ``GROUP`` rows of a source, product and country are ordered
    together; where there are more, those that can meet are found as components over shared numbers and URLs
    (rows with neither belong to the first row of their source, product and country), so that a product with very many rows is
    no single group.
    """
    named = F.concat_ws("\x1f", *[F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in ("source", "product", "country")])
    digest = F.sha2(named, 256)

    def shape(df: DataFrame) -> list[Column]:
        halves = [F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint").alias(c) for at, c in ((1, "label"), (17, "base"))]
        return [*halves, text(opt(df, "registration_number")).alias("reg"), text(opt(df, "product_url")).alias("url")]

    new = incoming.select(F.lit(True).alias("incoming"), F.col("ord").cast("bigint").alias("n"), *shape(incoming))
    old = store.select(F.lit(False).alias("incoming"), F.col("id").cast("bigint").alias("n"), *shape(store))
    if incoming.count() <= LOOKED_UP:
        old = old.join(new.select("label").distinct(), "label", "left_semi")
    rows = stage(old.unionByName(new), "upsert-rows")
    crowded = stage(rows.groupBy("label").agg(F.count("*").alias("c")).filter(F.col("c") > GROUP).select("label"), "crowded")
    if crowded.isEmpty():
        return _saved_one_by_one(rows)
    split = _split_by_components(stage(rows.join(crowded, "label", "left_semi"), "crowded-rows"))
    return _saved_one_by_one(rows.join(crowded, "label", "left_anti").unionByName(split))


def _split_by_components(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their component: rows that can meet each other have the same one."""
    rows = rows.withColumn("base", F.xxhash64("label", "base")).drop("label").withColumn("node", F.xxhash64("incoming", "n"))
    keys = [("r", F.col("reg"), F.col("reg") != ""), ("u", F.col("url"), F.col("url") != "")]
    shared = F.array_compact(F.array(*[F.when(given, F.xxhash64("base", F.lit(kind), value)) for kind, value, given in keys]))
    any_key = F.xxhash64("base", F.lit("a"))
    free = rows.filter("incoming AND reg = '' AND url = ''")
    first = rows.join(free.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.min_by("node", F.struct("incoming", "n")).alias("node"))
    members = (
        rows.select("node", F.explode(shared).alias("key"))
        .unionByName(free.select("node", any_key.alias("key")))
        .unionByName(first.select("node", any_key.alias("key")))
    )
    return rows.join(_components(members.distinct()), "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")


def upsert_products(store: DataFrame, batch: DataFrame, now: Column | None = None, top: int | None = None) -> DataFrame:
    """K2: rows of a batch update the store row they identify, or are inserted, as if saved one by one (``upsert_targets``).

    The last row that meets a stored or inserted row is what it becomes. Inserted rows get ids after ``top`` (the store's largest id),
    in arrival order.
    """
    fields = STORED_COLUMNS
    incoming = stage(prepared_batch(batch, now), "batch")
    targets = upsert_targets(store, incoming)
    last = stage(targets.groupBy("stored", "n").agg(F.max("ord").alias("ord")), "targets")
    largest = F.lit(top) if top is not None else store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    saved = incoming.join(last, "ord").withColumn("id", F.when(F.col("stored"), F.col("n")).otherwise(largest + 1 + F.col("n")))
    kept = store.join(last.filter("stored").select(F.col("n").alias("id")), "id", "left_anti").select("id", *[opt(store, f).alias(f) for f in fields])
    return kept.unionByName(saved.select("id", *fields))


def safe_filename(c: Column | str) -> Column:
    """K8: letters, digits, ``_``, ``.`` and ``-`` only; ``export`` when nothing is left."""
    value = F.trim(F.col(c) if isinstance(c, str) else c)
    cleaned = F.trim(F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("export"))


CSV_FILES = {"header": "true", "compression": "gzip"}  # 41 columns repeat their texts from row to row; a workbook is compressed too
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"  # a task's files are written side by side, its rows are not sorted (and spilled) first


def write_export(sheet: DataFrame, path: str, fmt: str = "csv") -> None:
    """K3: the 41-column sheet in its fixed order, one folder per export."""
    from ..functions.rows import EXPORT_COLUMNS

    writer = sheet.select(*EXPORT_COLUMNS).write.mode("overwrite")
    writer.options(**CSV_FILES).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_exports(sheets: DataFrame, path: str, fmt: str = "csv") -> int:
    """K3 for many queries at once: one folder for each file name, in one pass. ``sheets``: (file, 41 columns); returns the rows written,
    counted while they are written."""
    from ..functions.rows import EXPORT_COLUMNS

    written = Observation()
    rows = sheets.select("file", *EXPORT_COLUMNS).observe(written, F.count("*").alias("n"))
    writer = rows.write.mode("overwrite").partitionBy("file").options(**(CSV_FILES if fmt == "csv" else {})).format(fmt)
    with setting(sheets.sparkSession, OPEN_FILES, "64"):
        writer.save(path)
    return written.get["n"]


def export_table(df: DataFrame, path: str) -> None:
    """K9: a table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


# Demonstration rows (substance, product, company, country).
DEMO_ROWS = [
    ("Dapagliflozin", "Forxiga", "AstraZeneca AB", "Sweden"),
    ("Dapagliflozin", "FORXIGA 10MG FILM COATED TABLETS", "AstraZeneca UK Limited", "United Kingdom"),
    ("Dapagliflozin", "Dapagliflozin Viatris", "Viatris", "France"),
    ("Empagliflozin", "Jardiance", "Boehringer Ingelheim International GmbH", "Germany"),
    ("Semaglutide", "Ozempic", "Novo Nordisk A/S", "Denmark"),
    ("Metformin", "Glucophage", "Merck", "Spain"),
]


def demo_data(store: DataFrame) -> DataFrame:
    """The demonstration rows saved into an emptied store."""
    rows = [(i, *r, "Authorised", "Demo") for i, r in enumerate(DEMO_ROWS)]
    ddl = "ord long, substance string, product string, company string, country string, status string, source string"
    return upsert_products(store.limit(0), store.sparkSession.createDataFrame(rows, ddl))
