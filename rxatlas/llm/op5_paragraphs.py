"""Near-duplicate paragraphs across documents, found by MinHash bands and removed but for the first of each group.

A paragraph is a line with at least ``least_words`` words, in the query every line with a word; its set holds the distinct
shingles of five words, lower-cased in A-Z, and a line with fewer words is one shingle.
Equal sets are one class. Each class gets MinHash values in bands of ``rows``; the number of bands is the smallest that finds a
pair at the threshold with the wanted probability. Sets so small that one element more or less is below the threshold can only
be similar to equal ones and need no bands. Classes that share a band are compared by their exact Jaccard
similarity (``linking``: pivots first, then every pair between different components), and components of similar
paragraphs keep the one with the smallest (document, line). Most pairs of loosely related
paragraphs end at their parity vectors, before they are formed.

Paragraph texts are read again for the classes that share a band at all; which these are is first thinned by a
table of hash buckets of fixed size, then joined exactly.

Defined results: null, empty and wordless texts have no paragraphs; lines with fewer than ``least_words`` words are kept and
not counted; repeated rows are documents of their own, whose later copies lose their paragraphs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, linking
from .textops import SPACED_LOWER, Words, list_array, mix, order_in_rows, pieces, runs, signed, text_bytes, within

K = 5
SHARE = (80, 100)
LEAST_WORDS = 1  # of the query: every line with a word
ROWS = 2
RECALL = 0.999
PARITY_WORDS = 4
PARITY_COLUMNS = linking.parity_columns(PARITY_WORDS)
FILTER_BITS = 22


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of so many rows with which a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Paragraphs:
    """Lines of a batch of texts with at least so many words: ``doc``, ``line``, word count and distinct shingles."""

    def __init__(self, texts: pa.Array, least_words: int, k: int):
        self.data, bounds = text_bytes(texts)
        breaks = np.flatnonzero(self.data == 10) + 1
        starts = np.unique(np.concatenate([bounds[:-1], breaks[np.isin(breaks, bounds, invert=True)]]))
        starts = starts[starts < len(self.data)] if len(self.data) else starts[:0]
        self.edges = np.append(starts, len(self.data))
        words = Words(self.data, self.edges, SPACED_LOWER)
        long = words.counts >= max(least_words, 1)
        self.of = np.flatnonzero(long)  # lines that count
        nth = np.cumsum(long) - 1
        doc = np.searchsorted(bounds, starts, "right") - 1
        self.doc = doc[self.of]
        self.line = (np.arange(len(starts)) - np.searchsorted(starts, bounds[doc]))[self.of]
        self.words = words.counts[self.of]
        ok = within(words.row, k) & long[words.row[: max(len(words.row) - k + 1, 0)]]
        hashes = words.hashes()
        rows, values = [nth[words.row[: len(ok)][ok]]], [runs(hashes, k)[ok]]
        for n in range(max(least_words, 1), k):  # lines with fewer words
            short = np.flatnonzero(words.counts == n)
            if len(short):
                rows.append(nth[short])
                values.append(runs(hashes, n)[words.first[short]])
        row, value = np.concatenate(rows), np.concatenate(values)
        order = order_in_rows(row, value)
        row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        self.row, self.value = row[new], value[new]
        self.sizes = np.bincount(self.row, minlength=len(self.of))
        self.s1, self.s2 = linking.hash_rows(self.row, self.value, len(self.of))

    def bands(self, bands: int, rows: int) -> np.ndarray:
        """Paragraphs x bands keys."""
        if not len(self.of):
            return np.zeros((0, bands), np.uint64)
        starts = np.cumsum(self.sizes) - self.sizes
        keys = []
        for band in range(bands):
            key = np.full(len(self.of), np.uint64(band + 1))
            for r in range(rows):
                seed = mix(np.array([band * rows + r + 101], np.uint64))[0]
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((self.value ^ seed) * (seed | np.uint64(1)), starts))
            keys.append(key)
        return np.stack(keys, axis=1)

    def parities(self, which: np.ndarray) -> list[np.ndarray]:
        nth = np.full(len(self.of), -1)
        nth[which] = np.arange(len(which))
        mine = nth[self.row] >= 0
        return linking.parities(nth[self.row[mine]], self.value[mine], len(which), PARITY_WORDS)

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[self.edges[i] : self.edges[i + 1]] for i in self.of[which]]


def _described(docs: DataFrame, least_words: int, k: int, share: tuple[int, int], bands: int, rows: int) -> DataFrame:
    num, den = share
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.row_keys()
        for batch in pieces(batches, "text"):
            p = Paragraphs(batch.column("text"), least_words, k)
            several = p.sizes * den >= (p.sizes + 1) * num  # others are only similar to equal sets
            keys = p.bands(bands, rows)[several]
            found = pa.StructArray.from_arrays(
                [pa.array(p.line.astype(np.int32)), pa.array(p.sizes.astype(np.int32)), pa.array(signed(p.s1)), pa.array(signed(p.s2)), list_array(pa.array(signed(keys.reshape(-1))), np.where(several, bands, 0))],
                names=["line", "n", "s1", "s2", "bands"])
            listed = list_array(found, np.bincount(p.doc, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([common.key_range(counter, batch.num_rows), batch.column("id"), listed], names=["row_key", "id", "paragraphs"])

    return docs.mapInArrow(run, f"row_key bigint, id {kind}, paragraphs array<struct<line:int,n:int,s1:bigint,s2:bigint,bands:array<bigint>>>")


def _class_texts(docs: DataFrame, wanted: DataFrame, least_words: int, k: int) -> DataFrame:
    """(id, n, text, parity vector) of the wanted classes (id, n, s1, s2)."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bucket = F.shiftrightunsigned("s1", 64 - FILTER_BITS).cast("int")
    bits[wanted.select(bucket.alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in pieces(batches, "text"):
            p = Paragraphs(batch.column("text"), least_words, k)
            which = np.flatnonzero(table[(p.s1 >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            # copies inside the batch are one
            which = np.sort(which[np.unique(p.s1[which], return_index=True)[1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.sizes[which].astype(np.int32)), pa.array(signed(p.s1[which])), pa.array(signed(p.s2[which])), pa.array(p.texts(which), pa.binary()).cast(pa.string()), *(pa.array(signed(x)) for x in p.parities(which))],
                names=["n", "s1", "s2", "text", *PARITY_COLUMNS])

    found = docs.select("text").mapInArrow(run, "n int, s1 bigint, s2 bigint, text string, " + ", ".join(f"{c} bigint" for c in PARITY_COLUMNS))
    return found.join(wanted, ["n", "s1", "s2"]).select("id", "n", "text", *PARITY_COLUMNS).dropDuplicates(["id"])


def possible(share: tuple[int, int]) -> linking.Condition:
    num, den = share

    def condition(x: str, y: str) -> Column:
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (nx * den >= ny * num) & (ny * den >= nx * num)

    return condition


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = K, k: int = K, share: tuple[int, int] = SHARE, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: the key, ``n_paragraphs``, ``n_removed``, ``removed`` (line numbers from 0) and ``groups``
    (the component of each paragraph that has similar ones)."""
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    bands = bands_for(share[0] / share[1], recall, rows)
    described = common.staged(_described(own, least_words, k, share, bands, rows), "paragraphs")
    flat = described.select("row_key", "id", F.explode("paragraphs").alias("p")).select("row_key", "id", "p.*")
    by = ["n", "s1", "s2"]
    place = F.struct("id", "line", "row_key")
    classes = flat.groupBy(*by).agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    classes = common.staged(classes.withColumn("class_id", F.monotonically_increasing_id()), "paragraph-classes")

    chosen = flat.join(classes, [*by]).filter((F.col("first.row_key") == F.col("row_key")) & (F.col("first.line") == F.col("line")))
    banded = common.staged(chosen.select(F.col("class_id").alias("id"), "n", F.explode("bands").alias("key")), "paragraph-bands")
    several = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    entries = common.staged(banded.join(several, "key"), "paragraph-lists")
    members = entries.select(F.col("id").alias("class_id")).distinct()
    wanted = common.staged(classes.join(members, "class_id").select(F.col("class_id").alias("id"), *by), "paragraph-members")
    texts = common.staged(_class_texts(own, wanted, least_words, k), "paragraph-texts")
    edges = linking.links(entries, texts, SPACED_LOWER, k, share, possible(share), PARITY_WORDS)
    parts = linking.components(edges).withColumnRenamed("id", "class_id")

    labelled = classes.join(parts, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    groups = labelled.groupBy("component").agg(F.min("first").alias("kept"), F.sum("copies").alias("size")).filter("size > 1")
    repeated = labelled.join(groups, "component").select(*by, "component", "kept")
    marked = flat.drop("bands").join(repeated, by)
    first = (F.col("kept.row_key") == F.col("row_key")) & (F.col("kept.line") == F.col("line"))
    by_doc = marked.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.when(~first, F.col("line")))).alias("removed"), F.sort_array(F.collect_set("component")).alias("groups"))
    out = described.select("row_key", "id", F.size("paragraphs").cast("bigint").alias("n_paragraphs")).join(by_doc, "row_key", "left")
    return out.select(
        F.col("id").alias(key), "n_paragraphs", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("groups", F.array().cast("array<bigint>")).alias("groups"))


def without_lines(text: Column, removed: Column) -> Column:
    """A text without some of its lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")


@common.query("op5_paragraph_dedup")
def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(common.table(spark, sf_dir, "documents"), least_words=LEAST_WORDS)
