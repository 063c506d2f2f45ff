"""Spelling variants: words one inserted, deleted or replaced code point apart, and the most frequent near word as their form.

**Asymmetric q-chunks.** A word that asks is cut into two disjoint chunks; one edit leaves a chunk whole, so the other word holds it as
a positional gram, at the same place or shifted by one. Only words as long as the asking one, or longer by one, have
to offer grams (of two words the shorter one asks), so the shift is zero or one to the right. What is left beside the preserved chunk is cut
into two chunks again, one of which the edit preserves too: the key of an entry is everything but one quarter
of the word, with the length and the quarter. The joined pairs are verified by their edit distance.

A pair of equal length meets in one quarter only; a pair of unequal length may meet in neighbouring ones and counts in
the first one in which the words differ. Pairs are added up where they arise, so no word collects its near words.

Following forms, the count at least doubles at each step, so a chain has at most log2 of the largest count many words;
roots are found by doubling (each round joins the table of links with itself).

Counting words is done per batch first, and only sums are shuffled.

Defined results: a null text has no words; a null document id reads as empty text in front of the colon; repeated rows count
again; a run is never longer than its text, however long; ties of a form go to the word that comes first in code-point order.
Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import pieces

LEAST_LENGTH, LEAST_COUNT = 5, 3
HELD_WORDS = 1 << 17  # distinct words after which a task gives out its sums
LONG_TEXT = 1 << 20  # characters from which runs are read one by one
RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str) -> Counter:
    """Runs of letters, lower-cased in A-Z only, with their counts."""
    lowered = text.encode().lower().decode()  # the lower case of bytes is that of ASCII
    return Counter(RUN.findall(lowered) if len(lowered) < LONG_TEXT else (m.group() for m in RUN.finditer(lowered)))


def thinned(key: str, found: Counter) -> Iterator[tuple[str, int]]:
    """The runs of a document, with a code point left out of one in 97, told by a checksum of document and run."""
    begin = zlib.crc32(f"{key}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), begin)
        if h % 97 == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        yield run, n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, thin: bool = False) -> DataFrame:
    """(word, n) over all documents; with ``thin`` the runs are thinned first."""
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in pieces(batches, "text"):
            for name, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = runs(body or "")
                for word, n in thinned(name, found) if thin else found.items():
                    if len(word) >= least_length:
                        held[word] += n
            if len(held) >= HELD_WORDS:
                yield given()
        if held:
            yield given()

    sums = own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= least_count)


def _entries(words: DataFrame, shift: int) -> DataFrame:
    """(key, quarter, word, n, free): everything but one quarter of each word, as of an asking word shorter by ``shift``."""
    length = F.length("word") - shift
    half = F.floor(length / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]

    def part(begin: Column, size: Column) -> Column:
        return F.substring(F.col("word"), (begin + 1).cast("int"), size.cast("int"))

    quarters = []
    for i in range(4):
        before, after = part(F.lit(0), cuts[i]), part(cuts[i + 1] + shift, length - cuts[i + 1])
        key = F.xxhash64(length, F.lit(i), before, after)
        quarters.append(F.struct(key.alias("key"), F.lit(i).alias("quarter"), part(cuts[i], cuts[i + 1] - cuts[i]).alias("free")))
    return words.select("word", "n", F.inline(F.array(*quarters)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each unordered pair once, of distinct words one edit apart."""
    ask = _entries(words, 0)
    offer = ask.withColumn("longer", F.lit(False)).unionByName(_entries(words, 1).withColumn("longer", F.lit(True)))
    other = offer.select("key", "quarter", *[F.col(c).alias(f"other_{c}") for c in ("n", "free", "longer")], F.col("word").alias("other"))
    met = ask.join(other, ["key", "quarter"])
    met = met.filter((F.col("other_longer") | (F.col("word") < F.col("other"))) & ((F.col("quarter") == 3) | (F.col("free") != F.col("other_free"))))
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def _roots(links: DataFrame, largest: int, least: int) -> DataFrame:
    """(word, root) of the words that have a form: chains are followed by doubling."""
    longest = max(1, math.ceil(math.log2(max(largest / max(least, 1), 2))))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        links = common.staged(links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
    return links


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n) in; word, n, ``n_near``, ``form``, ``form_n`` and ``root`` of every word out.

    The form is the near word of largest count, if that is at least ``ratio`` (2 or more) times the word's.
    """
    words = common.staged(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    sides = F.inline(F.array(
        F.struct(F.col("word").alias("word"), F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")).alias("best")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")).alias("best")),
    ))
    near = pairs.select(sides).groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    best_n = -F.col("best.m")
    formed = best_n >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("best.w")).alias("form"), F.when(formed, best_n).alias("form_n"))
    rows = common.staged(rows, "forms")
    bounds = rows.agg(F.max("n").alias("high"), F.min("n").alias("low")).first()
    links = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    return rows.join(_roots(links, bounds["high"] or 1, bounds["low"] or 1), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: crc32 by its table; near words by the strings that are left when the code point at a place is taken out
SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
g AS (SELECT doc_id, r, count(*) AS n FROM found GROUP BY ALL),
h AS (SELECT r, n, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM g, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
ins AS (SELECT DISTINCT p.word AS a, p.n AS na, v.word AS b, v.n AS nb FROM p JOIN v ON p.rest = v.word),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, nb FROM ins UNION ALL SELECT b, a, na FROM ins),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
c AS (SELECT word, word AS cur, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON c.cur = f.word WHERE f.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(cur, depth) AS root FROM c GROUP BY word) USING (word)
"""


@common.query("op13_spelling_variants", SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(common.table(spark, sf_dir, "documents"), thin=True)).select("word", "form", "root", "n", "n_near", "form_n")
