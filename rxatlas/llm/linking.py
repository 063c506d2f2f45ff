"""Groups of similar texts from candidate lists, without forming the pairs inside a group.

A list is all entries with one ``key``; two texts can only be similar if some list holds both. What counts is which
texts hang together, so pairs already known to hang together need no look:

* **pivot rounds.** Each list names a few pivots (dealt by hash, the smallest hash of each part). Every entry is
  compared with the pivots of its lists, and links join texts into components. A group of copies collapses after a few
  rounds; each round is linear in the entries. While the pairs between components are more than ``DENSE`` times the
  entries and each round halves them, rounds take ``MANY`` pivots; lists that are not so dense from the start take one round of ``FEW``;
* **the exact rest.** In every list, entries outside the list's largest component meet the entries of other
  components. Computed answers of the pivots rule pairs out: Jaccard distance is a metric, so two texts whose distances to a
  common pivot differ by more than the threshold cannot be similar. All remaining pairs are compared.

Before the texts of a pair are moved, their parity vectors are compared: bit ``i`` of a set's vector tells whether an odd
number of its elements falls into bucket ``i``. Where two vectors differ, some element of the bucket is in one set only, so the
number of differing bits bounds the symmetric difference from below, and with the sizes the similarity from
above. The bound is exact; pairs it rules out are answered.

Nothing is capped: the rounds only decide how many pairs are left for the second step. A comparison moves
both texts to one task: a pivot's text goes once to each of its sub-groups of ``SUBGROUP`` partners, which
stream past it, so no task holds a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textops import Words, mix, order_in_rows, pieces, runs, text_bytes, within

MANY, FEW = 16, 2  # pivots for each list and round
DENSE, SPARSE = 10, 0.25  # pairs left for each entry
SUBGROUP = 256
MAX_ROUNDS = 12
FOLDED_WORDS = 4  # 64-bit words of the parity vectors that entries carry
HUB = 64  # answers from which a pivot's distances are used to rule pairs out

Sets = list[np.ndarray]
Condition = Callable[[str, str], Column]


def shingle_sets(texts: pa.Array, table, k: int) -> Sets:
    """The sorted distinct hashes of each text's runs of k words; shorter texts are one run, wordless ones empty."""
    return split_rows(*distinct_shingles(texts, table, k), len(texts))


def distinct_shingles(texts: pa.Array, table, k: int, score_of: Callable[[np.ndarray], np.ndarray] | None = None):
    """(row, hash), sorted and distinct; with ``score_of``, a number for each word hash, also the sum over each shingle's words."""
    words = Words(*text_bytes(texts), table)
    hashes = words.hashes()
    scores = score_of(hashes) if score_of else np.zeros(len(hashes), np.int64)
    whole = within(words.row, k)
    rows, found = [words.row[: len(whole)][whole]], [runs(hashes, k)[whole]]
    sums = [sum(scores[j : j + len(whole)] for j in range(k))[whole]] if len(whole) else [scores[:0]]
    for n in range(1, k):  # rows with fewer words
        short = np.flatnonzero(words.counts == n)
        if len(short):
            rows.append(short)
            found.append(runs(hashes, n)[words.first[short]])
            sums.append(sum(scores[words.first[short] + j] for j in range(n)))
    row, value, score = np.concatenate(rows), np.concatenate(found), np.concatenate(sums)
    order = order_in_rows(row, value)
    row, value, score = row[order], value[order], score[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return (row[new], value[new], score[new]) if score_of else (row[new], value[new])


def split_rows(row: np.ndarray, value: np.ndarray, n: int) -> Sets:
    return np.split(value, np.searchsorted(row, np.arange(1, n))) if n else []


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


def compared(pairs: DataFrame, texts: DataFrame, table, k: int) -> DataFrame:
    """(a, b, both, size_a, size_b): sizes of the two sets and of what they share, for distinct pairs (a, b)."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / SUBGROUP).cast("int").alias("parts"))
    salted = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    # texts are what weighs: they are sorted and merged at every size, never gathered for a broadcast
    salted = salted.hint("merge")
    of_b = salted.join(texts, salted.b == texts.id).select("a", "part", F.lit(1).alias("role"), "b", "text")
    of_a = salted.select("a", "part").distinct().hint("merge").join(texts, F.col("a") == texts.id).select("a", "part", F.lit(0).alias("role"), F.lit(None).cast("bigint").alias("b"), "text")
    streamed = of_a.unionByName(of_b).repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"), table, k)
            role = batch.column("role").to_numpy()
            both = np.zeros(batch.num_rows, np.int64)
            size_a = np.zeros(batch.num_rows, np.int64)
            for i, own in enumerate(sets):
                if role[i] == 0:
                    pivot = own
                else:
                    both[i], size_a[i] = overlap(pivot, own), len(pivot)
            sizes = np.array([len(s) for s in sets], np.int64)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both), pa.array(size_a), pa.array(sizes)], names=["a", "b", "both", "size_a", "size_b"])
            yield out.filter(pa.array(role == 1))

    return streamed.mapInArrow(run, "a bigint, b bigint, both bigint, size_a bigint, size_b bigint")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): the smallest id each linked id hangs together with, by alternating large and small stars.

    With ``rounds`` it stops early; ids with one label then do hang together, but others may as well."""
    links = common.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before, done = None, 0
    while rounds is None or done < rounds:
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = common.staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        done += 1
        if rounds is not None:
            continue
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every id points at one it hangs together with; the centre of a star at itself
    pointers = links.unionByName(links.select(F.col("v").alias("u"), "v"))
    return pointers.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("component", F.col("id"))
    joined = entries.join(labels, "id", "left")
    return joined.withColumn("component", F.coalesce("component", "id"))


def _left(entries: DataFrame) -> tuple[int, int]:
    """(pairs between different components over all lists, entries of lists that have such pairs)."""
    sizes = entries.groupBy("key", "component").agg(F.count("*").cast("double").alias("n"))
    lists = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("parts")).filter("parts > 1")
    found = lists.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    return found[0], found[1]


def _pivot_pairs(entries: DataFrame, seed: int, pivots_of_list: int, possible: Condition) -> DataFrame:
    who = F.struct("id", *[c for c in entries.columns if c not in ("key", "id")])
    draw = F.xxhash64(F.lit(seed), "id")
    several = entries.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
    live = entries.join(several, "key")
    pivots = live.groupBy("key", F.pmod(draw, F.lit(pivots_of_list)).alias("part")).agg(F.min_by(who, draw).alias("q")).select("key", "q")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.q.component")) & possible("x", "y.q")
    return live.alias("x").join(pivots.alias("y"), on).select(F.col("y.q.id").alias("p"), F.col("x.id").alias("m"))


def _folded(texts: DataFrame, words: int) -> tuple[DataFrame, int]:
    """(id, parity vector of fewer buckets): buckets are merged by folding the vector."""
    fewer = math.gcd(words, FOLDED_WORDS)
    folded = [reduce(lambda a, b: a.bitwiseXOR(b), [F.col(f"parity_{j}") for j in range(i, words, fewer)]).alias(f"parity_{i}") for i in range(fewer)]
    return texts.select("id", *folded), fewer


def _rest_pairs(entries: DataFrame, answers: DataFrame, texts: DataFrame, words: int, share: tuple[int, int], possible: Condition) -> DataFrame:
    sizes = entries.groupBy("key", "component").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    hubs = answers.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= HUB).drop("n")
    near = answers.filter("distance IS NOT NULL").join(hubs, "a").select(F.col("b").alias("id"), F.struct("a", "distance").alias("k"))
    known = near.groupBy("id").agg(F.collect_list("k").alias("known"))
    vectors, fewer = _folded(texts, words)
    kept = [c for c in entries.columns if not c.startswith("parity_")]
    live = entries.select(kept).join(lists, "key").join(known, "id", "left").join(vectors, "id")
    most = 1 - share[0] / share[1]
    outside = live.filter("component <> main")

    def apart(x: Column, y: Column) -> Column:
        return F.exists(x, lambda k: F.exists(y, lambda o: (k["a"] == o["a"]) & (F.abs(k["distance"] - o["distance"]) > most + 1e-9)))

    ruled_out = F.coalesce(apart(F.col("x.known"), F.col("y.known")), F.lit(False))
    # a pair of two outside entries is met from both sides: take one
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & once & possible("x", "y") & close("x", "y", fewer, share) & ~ruled_out
    return outside.alias("x").join(live.alias("y"), on).select(F.col("x.id").alias("p"), F.col("y.id").alias("m"))


def links(entries: DataFrame, texts: DataFrame, table, k: int, share: tuple[int, int], possible: Condition, words: int) -> DataFrame:
    """Edges (a, b) whose components are those of all similar pairs that share a list.

    ``entries``: staged (key, id, ...); ``texts``: staged (id, n, text, parity columns of ``words``); similar: share[1] *
    common >= share[0] * union; ``possible(x, y)``: a condition on the entry columns of two aliases that every similar
    pair of one list meets."""
    num, den = share
    spark = entries.sparkSession
    answers = spark.createDataFrame([], "a bigint, b bigint, distance double, similar boolean")
    labels = None

    def answer(pairs: DataFrame, name: str) -> DataFrame:
        # the pivot is the side that streams past least often: keep it as a
        unordered = pairs.filter("p <> m").groupBy(F.least("p", "m").alias("l"), F.greatest("p", "m").alias("g")).agg(F.min("p").alias("a"))
        fresh = unordered.select("a", F.when(F.col("a") == F.col("l"), F.col("g")).otherwise(F.col("l")).alias("b"), "l", "g")
        seen = answers.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("g")).distinct()
        untried = fresh.join(seen, ["l", "g"], "left_anti").select("a", "b")
        vectors = texts.drop("text")
        with_a = untried.hint("merge").join(vectors.alias("x"), F.col("a") == F.col("x.id"))
        judgeable = with_a.hint("merge").join(vectors.alias("y"), F.col("b") == F.col("y.id")).select("a", "b", close("x", "y", words, share).alias("open"))
        tried = common.staged(judgeable, f"{name}-pairs")
        new = tried.filter("open").drop("open")
        union = F.col("size_a") + F.col("size_b") - F.col("both")
        judged = compared(new, texts.select("id", "text"), table, k).select("a", "b", (1 - F.col("both") / union).alias("distance"), (den * F.col("both") >= num * union).alias("similar"))
        ruled_out = tried.filter("NOT open").select("a", "b", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("similar"))
        out = common.staged(judged.unionByName(ruled_out), f"{name}-answers")
        common.dropped(tried)
        return out

    last, dense, current = float("inf"), True, _labelled(entries, None)
    for nth in range(MAX_ROUNDS + 1):
        if labels is not None:
            replaced = current if nth > 1 else None
            current = common.staged(_labelled(entries, labels), "entries")
            common.dropped(replaced)
        pairs_left, in_lists = _left(current)
        was, dense = dense, DENSE * in_lists < pairs_left <= 0.5 * last
        if not was or pairs_left <= SPARSE * in_lists or nth == MAX_ROUNDS or nth and not dense:
            break
        last = pairs_left
        pairs = _pivot_pairs(current, nth, MANY if dense else FEW, possible)
        answers = answers.unionByName(answer(pairs, f"round-{nth}"))
        labels = components(answers.filter("similar"), rounds=2)
    if pairs_left == 0:
        return answers.filter("similar").select("a", "b")
    rest = answer(_rest_pairs(current, answers, texts, words, share, possible), "rest")
    return answers.unionByName(rest).filter("similar").select("a", "b")


def parities(row: np.ndarray, value: np.ndarray, n: int, words: int) -> list[np.ndarray]:
    """The parity vectors of n sets, 64 bits in each array."""
    bucket = (mix(value ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.int64) % (64 * words)
    counts = np.bincount(row * (64 * words) + bucket, minlength=n * 64 * words).reshape(n, words, 64)
    bits = (counts & 1).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    packed = np.bitwise_or.reduce(bits, axis=2) if n else np.zeros((0, words), np.uint64)
    return [np.ascontiguousarray(packed[:, w]) for w in range(words)]


def parity_columns(words: int) -> list[str]:
    return [f"parity_{i}" for i in range(words)]


def close(x: str, y: str, words: int, share: tuple[int, int]) -> Column:
    """Whether sizes ``n`` and parity vectors of two aliases allow the similarity."""
    num, den = share
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in parity_columns(words)), F.lit(0))
    # both <= (nx + ny - differ) / 2, and both * (num + den) >= (nx + ny) * num is needed
    return (nx + ny - differ) * (num + den) >= 2 * (nx + ny) * num


def hash_rows(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set, whatever the order of its elements."""
    ends = np.searchsorted(row, np.arange(n + 1))
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))])
        out.append(total[ends[1:]] - total[ends[:-1]])
    return out[0], out[1]
