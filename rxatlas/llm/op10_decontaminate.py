"""Benchmark decontamination by winnowing.

Each text is a sequence of words. A ``window`` of consecutive words that a document shares with an item is a
hit. Fingerprints are hashes of ``k`` words; of every ``window - k + 1`` consecutive ones the smallest is
kept (the last among equals), a choice that depends on the words alone: a shared window therefore holds a
fingerprint that both sides keep. Kept fingerprints of documents meet those of the items in an equi-join, and
each meeting is extended to both sides, word by word, as far as a window that contains the fingerprint can
reach. Documents carry that much context with each fingerprint, so their text is read once and never shuffled.

An item shorter than the window is one window by itself: documents keep every run of that many words
(winnowing with a window of one), for the few lengths that occur.

Before the join, documents drop fingerprints whose hash bucket no item uses. The table of used buckets has
2**22 bits whatever the size of the benchmark; it only thins the join's input and never decides a hit.

Defined results: null or wordless texts have no words and no hits; a null or wordless item is never found;
repeated rows are judged one by one; the copies of an item all count as items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import ALNUM_LOWER, Words, list_array, mix, pieces, row_bounds, runs, signed, text_bytes, window_minima, within

WINDOW = 10
GRAM = 5
BUCKET_BITS = 22

_PRINT = pa.struct([("words", pa.int32()), ("hash", pa.int64()), ("check", pa.int64()), ("pos", pa.int32()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])
_PRINT_SQL = "struct<words:int,hash:bigint,check:bigint,pos:int,before:array<bigint>,after:array<bigint>>"


def _prints(words: Words, lengths: list[int], window: int, k: int, own_short: bool, used: np.ndarray | None):
    """(row, words in the gram, place, hash, check) of the kept fingerprints.

    ``lengths``: short lengths of which every run is kept; ``own_short``: only runs that are a whole row."""
    first, second = words.hashes(1), words.hashes(7)
    found = []
    for n, winnowed in [*((n, False) for n in lengths), (k, True)]:
        gram, check = runs(first, n), runs(second, n)
        if winnowed:
            places = window_minima(gram, window - k + 1)
            places = np.unique(places[within(words.row, window)[: len(places)]])
        else:
            places = np.flatnonzero(within(words.row, n))
        size = window if winnowed else n
        if own_short and not winnowed:
            places = places[words.counts[words.row[places]] == size]
        if used is not None:
            places = places[used[(gram[places] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]]
        found.append((words.row[places], np.full(len(places), size, np.int32), places, gram[places], check[places]))
    return first, [np.concatenate(x) for x in zip(*found, strict=True)]


def _contexts(words: Words, hashes: np.ndarray, size, place, row, reach: int, k: int, window: int):
    """Up to ``reach`` word hashes before (nearest first) and after each kept gram of a full window."""
    left = np.where(size == window, np.minimum(reach, place - words.first[row]), 0)
    right = np.where(size == window, np.minimum(reach, words.first[row + 1] - place - k), 0)

    def take(start: np.ndarray, step: int, counts: np.ndarray) -> pa.Array:
        base = np.cumsum(counts) - counts
        nth = np.arange(int(counts.sum())) - np.repeat(base, counts)
        return list_array(pa.array(signed(hashes[np.repeat(start, counts) + step * nth])), counts)

    return take(place - 1, -1, left), take(place + k, 1, right)


def _frame_prints(batch: pa.RecordBatch, lengths, window, k, own_short, used) -> tuple[pa.Array, np.ndarray]:
    """A list of fingerprints for each row, and the words of each row."""
    words = Words(*text_bytes(batch.column("text")), ALNUM_LOWER)
    if not len(words.starts):
        return pa.array([[]] * batch.num_rows, pa.list_(_PRINT)), words.counts
    hashes, (row, size, place, gram, check) = _prints(words, lengths, window, k, own_short, used)
    order = np.lexsort((place, row))
    row, size, place, gram, check = (x[order] for x in (row, size, place, gram, check))
    before, after = _contexts(words, hashes, size, place, row, window - k, k, window)
    pos = (place - words.first[row]).astype(np.int32)
    prints = pa.StructArray.from_arrays([pa.array(size), pa.array(signed(gram)), pa.array(signed(check)), pa.array(pos), before, after], fields=list(_PRINT))
    return list_array(prints, np.bincount(row, minlength=batch.num_rows)), words.counts


def _rows(df: DataFrame, key: str, text: str, lengths, window, k, own_short, used) -> DataFrame:
    """(row_key, key, n_words, prints) of every row; ``used``: broadcast table of the buckets that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.row_keys()
        table = None if used is None else np.unpackbits(np.frombuffer(used.value, np.uint8)).astype(bool)
        for batch in pieces(batches, "text"):
            prints, counts = _frame_prints(batch, lengths, window, k, own_short, table)
            yield pa.RecordBatch.from_arrays(
                [common.key_range(counter, batch.num_rows), batch.column("id"), pa.array(counts.astype(np.int64)), prints],
                names=["row_key", "id", "n_words", "prints"],
            )

    narrow = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"row_key bigint, id {kind}, n_words bigint, prints array<{_PRINT_SQL}>")


def _common_prefix(a: str, b: str, reach: int) -> Column:
    """How many leading elements of two arrays agree."""
    out: Column = F.lit(reach)
    for i in range(reach - 1, -1, -1):
        same = F.coalesce(F.get(F.col(a), F.lit(i)) == F.get(F.col(b), F.lit(i)), F.lit(False))
        out = F.when(same, out).otherwise(F.lit(i))
    return out


def used_buckets(items: DataFrame) -> bytes:
    """One bit for each hash bucket that an item uses; at most 2**BUCKET_BITS rows reach the driver."""
    bucket = F.shiftrightunsigned(F.col("p.hash"), 64 - BUCKET_BITS)
    bits = np.zeros(1 << BUCKET_BITS, bool)
    rows = items.select(F.explode("prints").alias("p")).select(bucket.cast("int").alias("b")).distinct().toArrow()
    bits[rows.column("b").to_numpy()] = True
    return np.packbits(bits).tobytes()


def hits(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text", window: int = WINDOW, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every document row (``row_key``, key, ``n_words``) and its hits (``row_key``, first word,
    end, item). The spans of a row overlap; their union is exactly the words inside shared windows."""
    spark = docs.sparkSession
    short_item = _rows(items, item_key, item_text, list(range(1, window)), window, k, True, None)
    item_prints = common.staged(short_item.filter(F.size("prints") > 0), "benchmark-prints")
    lengths = sorted(r[0] for r in item_prints.select(F.explode("prints.words")).distinct().collect() if r[0] < window)
    used = spark.sparkContext.broadcast(used_buckets(item_prints))
    rows = common.staged(_rows(docs, doc_key, text, lengths, window, k, False, used), "document-prints")
    left = rows.select("row_key", F.explode("prints").alias("p")).select("row_key", "p.*")
    right = item_prints.select(F.col("id").alias("item"), F.explode("prints").alias("q")).select(
        "item", F.col("q.words").alias("words"), F.col("q.hash").alias("hash"), F.col("q.check").alias("check"), F.col("q.before").alias("item_before"), F.col("q.after").alias("item_after"))
    met = left.join(right, ["words", "hash", "check"])
    reach = window - k
    met = met.withColumn("a", _common_prefix("before", "item_before", reach)).withColumn("b", _common_prefix("after", "item_after", reach))
    full = F.col("words") == window
    spans = met.filter(~full | (F.col("a") + F.col("b") + k >= window)).select(
        "row_key",
        F.when(full, F.col("pos") - F.col("a")).otherwise(F.col("pos")).alias("start"),
        F.when(full, F.col("pos") + k + F.col("b")).otherwise(F.col("pos") + F.col("words")).alias("end"),
        "item",
    )
    return rows.select("row_key", F.col("id").alias(doc_key), "n_words"), spans


def covered(spans: Column) -> Column:
    """Places covered by a sorted array of (start, end)."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["reach"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", **options) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``spans`` (sorted), ``items`` (sorted as strings, distinct)."""
    rows, spans = hits(docs, items, doc_key, item_key, **options)
    grouped = spans.groupBy("row_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    joined = rows.join(grouped, "row_key", "left").drop("row_key")
    return joined.withColumn("n_hit", F.coalesce(covered(F.col("spans")), F.lit(0).cast("bigint"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM items),
dp AS (SELECT rk, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dw AS (SELECT rk, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM dp),
h AS (SELECT rk, i, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
c AS (SELECT rk, count(DISTINCT p) AS n_hit FROM (SELECT rk, unnest(range(i, i + n)) AS p FROM h) GROUP BY rk),
s AS (SELECT rk, count(*) AS n_items, sha256(string_agg(v, ',' ORDER BY v)) AS digest FROM (SELECT DISTINCT rk, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY rk)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rk) LEFT JOIN s USING (rk)
"""


@common.query("op10_benchmark_decontamination", SQL)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
