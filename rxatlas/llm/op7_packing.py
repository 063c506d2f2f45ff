"""Packing into length buckets with the least padding.

Texts are cut into sequences of at most ``max_words`` words. The histogram of sequence lengths has at most that many rows,
whatever the corpus; dynamic programming over it finds the bucket lengths for which padding every sequence to its
bucket's length wastes the least: the best ``k`` buckets for the lengths up to the j-th extend the best ``k - 1`` for those
up to some i < j. Of equal solutions the one with the shorter lower buckets is taken.

Inside a bucket sequences stand in the order of a hash of their key, and a batch takes as many as fit into
``budget`` words when padded. A sequence's place in that order is found without a bucket in one task: keys are dealt into
blocks by the first digits of the hash, blocks are counted, and a place is the block's offset plus the rank inside it.

Defined results: null or wordless texts give no sequence; repeated rows give sequences of their own, in any order
among equals; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .op1_quality import SPACE

MAX_WORDS = 2048
BUCKETS = 16
BUDGET = 16_384
ROWS_PER_BLOCK = 100_000


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The bucket lengths with the least padding, ascending; lengths are distinct and ascending."""
    if not lengths:
        return []
    length = np.array(lengths, np.int64)
    rows = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    words = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) * length)])
    d, k = len(length), min(buckets, len(length))
    best = length * rows[1:] - words[1:]  # one bucket for the first j lengths
    splits = np.zeros((k, d), np.int64)
    far = np.iinfo(np.int64).max // 4
    for nth in range(1, k):
        new = np.full(d, far)
        for j in range(nth, d):
            # the last bucket holds the lengths after the i-th
            i = np.arange(nth, j + 1)
            cost = best[i - 1] + length[j] * (rows[j + 1] - rows[i]) - (words[j + 1] - words[i])
            at = int(cost.argmin())
            new[j], splits[nth, j] = cost[at], i[at]
        best = new
    ends, j = [], d
    for nth in range(k - 1, -1, -1):
        ends.append(int(length[j - 1]))
        j = int(splits[nth, j - 1])
    return ends[::-1]


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(key, piece, first_word, n_words) of every sequence."""
    n = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""))
    counted = docs.select(F.col(key), n.alias("n")).filter("n > 0")
    cut = counted.select(key, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_words).cast("int"))).alias("piece"))
    start = F.col("piece") * max_words
    return cut.select(key, "piece", start.alias("first_word"), F.least(F.col("n") - start, F.lit(max_words)).alias("n_words"))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS, budget: int = BUDGET, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Every sequence with ``bucket`` (its padded length), ``batch`` (numbered from 0 inside the bucket) and ``slot`` (its place in the batch)."""
    rows = common.staged(sequences(docs, key, text, max_words), "sequences")
    histogram = sorted((r["n_words"], r["c"]) for r in rows.groupBy("n_words").agg(F.count("*").alias("c")).collect())
    ends = best_buckets([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    total = sum(h[1] for h in histogram)
    digits = 0
    while total / 16**digits > rows_per_block and digits < 8:
        digits += 1
    bucket = F.element_at(F.filter(F.array(*[F.lit(e) for e in ends] or [F.lit(max_words)]), lambda e: e >= F.col("n_words")), 1)
    order = F.coalesce(F.md5(F.col(key).cast("string")), F.lit(""))
    placed = rows.withColumns({"bucket": bucket, "order_key": order}).withColumn("block", F.substring("order_key", 1, digits))
    sizes = placed.groupBy("bucket", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = sizes.select("bucket", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "block").orderBy("order_key", key, "piece")
    ranked = placed.withColumn("nth", F.row_number().over(inside)).join(offsets, ["bucket", "block"])
    place, size = F.col("offset") + F.col("nth") - 1, F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    return ranked.select(key, "piece", "first_word", "n_words", "bucket", F.floor(place / size).alias("batch"), (place % size).alias("slot"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 2048 + 1)) AS piece FROM w WHERE n > 0),
q AS (SELECT doc_id, piece, piece * 2048 AS first_word, least(n - piece * 2048, 2048) AS n_words FROM s),
h AS (SELECT n_words AS len, count(*) AS c, row_number() OVER (ORDER BY n_words) AS j FROM q GROUP BY n_words),
p AS (SELECT j, len, sum(c) OVER (ORDER BY j) AS rows, sum(c * len) OVER (ORDER BY j) AS words FROM h),
dp(k, j, cost, i) AS (
  SELECT 1, j, CAST(len * rows - words AS HUGEINT), CAST(0 AS BIGINT) FROM p
  UNION ALL
  SELECT dp.k + 1, b.j, min(dp.cost + b.len * (b.rows - a.rows) - (b.words - a.words)),
         arg_min(dp.j, (dp.cost + b.len * (b.rows - a.rows) - (b.words - a.words)) * 10000 + dp.j)
  FROM dp JOIN p a ON a.j = dp.j JOIN p b ON b.j > dp.j WHERE dp.k < 16 GROUP BY dp.k + 1, b.j),
back(k, j) AS (
  SELECT least(16, max(j)), max(j) FROM p
  UNION ALL
  SELECT back.k - 1, dp.i FROM back JOIN dp ON dp.k = back.k AND dp.j = back.j WHERE back.k > 1),
ends AS (SELECT len AS bucket FROM back JOIN p USING (j)),
b AS (SELECT doc_id, piece, first_word, n_words, (SELECT min(bucket) FROM ends WHERE bucket >= n_words) AS bucket FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, piece) - 1 AS place FROM b)
SELECT doc_id, piece, first_word, n_words, bucket, place // greatest(16384 // bucket, 1) AS batch, place % greatest(16384 // bucket, 1) AS slot FROM r
"""


@common.query("op7_packing", SQL)
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
