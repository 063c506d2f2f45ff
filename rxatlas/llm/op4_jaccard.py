"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, as components.

Equal sets are one class from the start. Each class lists the rarest shingles of its set: two sets of similarity t share a
shingle among the first ``n - ceil(t n) + 1`` of both in any common order. Lists of shared shingles then go
through two kinds of skipping:

* by position: an entry carries its place in its set, which bounds what it can still share behind that place; a
  pair of entries is skipped when the bound, or the two set sizes, rule the threshold out. Entries of one list
  are blocked by the size class of their set, so blocks of too different sizes never meet;
* by answers: a set's answers are derived from those of a set highly similar to it (``linking``): sets of one
  component are not compared again, and distances to a common pivot rule others out.

The common order puts what few documents share first. Words and shingles are counted over all documents: a
batch of texts reports those that occur several times in it, the reports are added up, and the ``FREQUENT``
most frequent ones of either kind (a fixed number) are kept. Frequent shingles stand last, by rank; the others stand in
the order of how frequent their words are. The order never decides a result, only the length of the lists.

Shingles are 64-bit hashes of words lower-cased in A-Z; classes are told apart by 128 bits and the size.

Defined results: a text with fewer than ``k`` words is one shingle; null or wordless texts have an empty set and are
their own component; repeated rows are linked like any copies; rows with a null id take part without naming a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, linking
from .textops import SPACED_LOWER, Words, list_array, order_in_rows, pieces, runs, signed, text_bytes, within

K = 3
SHARE = (90, 100)
FREQUENT = 1 << 16
PARITY_WORDS = 16
IN_BATCH = 4  # occurrences in a batch from which a word or shingle is reported


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles, in the order of their counts, and the most frequent words with a score that grows with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), SPACED_LOWER)
            hashes, row = words.hashes(), words.row
            del words
            for size in (k, 1):
                found, counts = np.unique(runs(hashes, size)[within(row, size)], return_counts=True)
                often = counts >= IN_BATCH
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), size, np.int32)), pa.array(signed(found[often])), pa.array(counts[often])], names=["size", "h", "n"])

    counted = common.staged(docs.select("text").mapInArrow(run, "size int, h bigint, n bigint").groupBy("size", "h").agg(F.sum("n").alias("n")), "frequent")
    top = [counted.filter(F.col("size") == size).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow() for size in (k, 1)]
    shingles, words = (t.column("h").to_numpy()[::-1].view(np.uint64) for t in top)
    scores = (16 * np.log2(1 + top[1].column("n").to_numpy()[::-1])).astype(np.int64)
    return shingles, words, scores


def rarest_first(row: np.ndarray, value: np.ndarray, score: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by (row, rank, score, value): sorted by 64 bits that hold rank, score and the start of the value, and
    in the rare batch where these are not enough, by all of them."""
    score = np.minimum(score, 2047)
    key = (rank.astype(np.uint64) << np.uint64(47)) | (score.astype(np.uint64) << np.uint64(36)) | (value >> np.uint64(28))
    by = order_in_rows(row, key)
    if np.any((key[by][1:] == key[by][:-1]) & (row[by][1:] == row[by][:-1])):
        return np.lexsort((value, score, rank, row))
    return by


def described(docs: DataFrame, k: int, share: tuple[int, int], known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(row_key, id, n, s1, s2, prefix): set size, fingerprints and rarest shingles of every (id, text) row."""
    shingles, words, scores = known
    order, by_word = np.argsort(shingles), np.argsort(words)
    shared = docs.sparkSession.sparkContext.broadcast((shingles[order], order.astype(np.int64) + 1, words[by_word], scores[by_word]))
    kind = docs.schema["id"].dataType.simpleString()
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank_of, vocabulary, word_scores = shared.value

        def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(wanted), np.int64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], 0)

        def score_of(hashes: np.ndarray) -> np.ndarray:
            return looked_up(vocabulary, word_scores, runs(hashes, 1))

        counter = common.row_keys()
        for batch in pieces(batches, "text"):
            row, value, score = linking.distinct_shingles(batch.column("text"), SPACED_LOWER, k, score_of)
            s1, s2 = linking.hash_rows(row, value, batch.num_rows)
            by = rarest_first(row, value, score, looked_up(often, rank_of, value))
            row, value = row[by], value[by]
            sizes = np.bincount(row, minlength=batch.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            wanted = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
            kept = place < wanted[row]
            prefix = list_array(pa.array(signed(value[kept])), wanted)
            yield pa.RecordBatch.from_arrays(
                [common.key_range(counter, batch.num_rows), batch.column("id"), pa.array(sizes), pa.array(signed(s1)), pa.array(signed(s2)), prefix],
                names=["row_key", "id", "n", "s1", "s2", "prefix"])

    return docs.mapInArrow(run, f"row_key bigint, id {kind}, n bigint, s1 bigint, s2 bigint, prefix array<bigint>")


def possible(share: tuple[int, int]) -> linking.Condition:
    num, den = share

    def condition(x: str, y: str) -> Column:
        nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
        sizes = (nx * den >= ny * num) & (ny * den >= nx * num)
        # both <= least of what stands from the places on; both / (nx + ny - both) >= num / den
        return sizes & (F.least(nx - px, ny - py) * (num + den) >= (nx + ny) * num)

    return condition


def size_block(n: Column, share: tuple[int, int]) -> Column:
    """Similar sets are in the same block or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(share[1] / share[0])) + 1e-9).cast("int")


def class_texts(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(id, n, text, parity vector): one text for each class, found by the class's least document id and checked by its fingerprints."""
    near = common.by_key_table(docs, "id", classes, "least")
    found = near.join(classes, near.id.eqNullSafe(classes.least)).select("class_id", "text", "n", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, value = linking.distinct_shingles(batch.column("text"), SPACED_LOWER, k)
            s1, s2 = linking.hash_rows(row, value, batch.num_rows)
            same = (np.bincount(row, minlength=batch.num_rows) == batch.column("n").to_numpy()) & (signed(s1) == batch.column("s1").to_numpy()) & (signed(s2) == batch.column("s2").to_numpy())
            vectors = linking.parities(row, value, batch.num_rows, PARITY_WORDS)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class_id", "n", "text")), *(pa.array(signed(v)) for v in vectors)], names=["id", "n", "text", *linking.parity_columns(PARITY_WORDS)])
            yield out.filter(pa.array(same))

    vectors = ", ".join(f"{c} bigint" for c in linking.parity_columns(PARITY_WORDS))
    return found.mapInArrow(run, f"id bigint, n bigint, text string, {vectors}").dropDuplicates(["id"])


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per document: the key, ``n_shingles``, ``class_id`` (rows with equal sets) and ``component_id`` (smallest key)."""
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    rows = common.staged(described(own, k, share, frequent(own, k)), "shingle-sets")
    by = ["n", "s1", "s2"]
    classes = common.staged(rows.groupBy(*by).agg(F.min("row_key").alias("class_id"), F.min("id").alias("least")), "set-classes")

    first = rows.join(classes.select("class_id"), rows.row_key == F.col("class_id"), "left_semi").filter("n > 0")
    exploded = first.select(F.col("row_key").alias("id"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    several = exploded.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    # an entry stands in the size block of its set and, for its partners there, in the next smaller one
    block = size_block(F.col("n"), share)
    listed = exploded.join(several, "token").withColumn("block", F.explode(F.array(block, block - 1)))
    entries = common.staged(listed.select(F.xxhash64("token", "block").alias("key"), "id", "n", "pos"), "shingle-lists")

    # the shingles are in the lists now: what is left of the rows is small
    wide, rows = rows, common.staged(rows.drop("prefix"), "rows")
    common.dropped(wide)
    members = entries.select(F.col("id").alias("class_id")).distinct()
    wanted = common.staged(classes.join(members, "class_id"), "listed-classes")
    texts = common.staged(class_texts(own, wanted, k), "class-texts")
    edges = linking.links(entries, texts, SPACED_LOWER, k, share, possible(share), PARITY_WORDS)
    parts = linking.components(edges).withColumnRenamed("id", "class_id")
    common.dropped(entries, wanted, texts)
    joined = classes.join(parts, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = joined.join(named, "component").select(*by, "class_id", "component_id")
    out = rows.join(labelled, by)
    # nothing links empty sets
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("row_key")).alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(len(w), 3) AS k, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + k - 1], ' ')) AS g FROM p),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
o AS (SELECT doc_id, s.g, row_number() OVER (PARTITION BY doc_id ORDER BY df, s.g) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM s JOIN f ON s.g = f.g),
x AS (SELECT * FROM o WHERE pos <= n - ceil(0.9 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9),
v AS (SELECT c.a, c.b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS i FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b AND sa.g = sb.g GROUP BY c.a, c.b),
e AS (SELECT a, b FROM v WHERE 100 * i >= 90 * (na + nb - i)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN z USING (doc_id) JOIN m ON m.a = d.doc_id
"""


@common.query("op4_ngram_jaccard_join", SQL)
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
