"""Repeated substrings: every byte covered by a ``length``-byte string that also starts somewhere else.

A suffix array brings equal prefixes next to each other. Only the first ``length`` bytes of a suffix matter here, and of most
suffixes it is plain that nothing equals them, so the difference-cover construction is carried out sparsely:

1. **Sample.** A cover picks positions by content: in every window of ``COVER`` consecutive grams (``GRAM`` bytes
   each) the one with the smallest hash, the last among equals. Like a difference cover it holds, for two equal
   strings of ``length`` bytes, a position at the same offset in both; unlike positions modulo a number it picks about
   one position in eighty and needs no alignment.
2. **Sorted triples.** A sampled position answers for the strings for which it is the picked one, a run of starts. Its
   triple is what stands to its left up to the first of them, its gram, and what stands to its right up to the
   end of the last. Triples get names, equal ones the same.
3. **Recursion on names.** A gram that occurs once settles its strings: all are unique. A triple that occurs twice settles
   them too: all are repeated. Only grams with several different triples go on, one of each.
4. **Remaining suffixes.** The strings of the triples left are ordered by (gram, offset from the sampled position,
   name), and neighbours are compared: equal ones are repeated.

Repeated starts become spans per text. Texts are told apart by a 128-bit name, so copies share their spans, and
only texts with spans travel to meet them. Names are 64-bit hashes, compared together with the gram's, so 128
bits decide an equality.

The strings of one gram meet in a task up to ``GROUP`` triples; grams with more meet string by string in an
aggregate. Both give the same result.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; a text's removal depends on
all rows, repeated rows included (two equal rows repeat each other).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import byte_table, digests, mix, pieces, prefix_hash, range_hash, signed, text_bytes

LENGTH = 200
GRAM = 40
COVER = 160  # grams in a window: GRAM + COVER - 1 bytes, at most LENGTH
GROUP = 1 << 15
FILTER_BITS = 23
_PLACE = np.uint64((1 << 31) - 1)


def _filter_table(frame: DataFrame, column: str) -> bytes:
    """A table of 2**FILTER_BITS hash buckets, whatever the number of rows; wrong passes are sorted out by joins."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bucket = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS).cast("int")
    bits[frame.select(bucket.alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    return np.packbits(bits).tobytes()


def _passes(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = (names >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


class Cover:
    """The sampled positions of a batch of texts: arrays ``at``, ``low``, ``high`` (first and last start answered for)."""

    def __init__(self, texts: pa.Array, length: int = LENGTH, gram: int = GRAM, cover: int = COVER):
        self.data, self.bounds = text_bytes(texts)
        n = len(self.data)
        self.prefix = prefix_hash(byte_table(3)[self.data])
        self.length, self.gram = length, gram
        self.at = self.low = self.high = np.zeros(0, np.int64)
        windows = n - gram + 1 - cover + 1
        if windows <= 0:
            return
        starts = np.arange(n - gram + 1)
        grams = range_hash(self.prefix, starts, starts + gram)
        # smallest hash, then the last place: one number to take minima of
        least = (grams & ~_PLACE) | (_PLACE - starts.astype(np.uint64))
        width = 1
        while 2 * width <= cover:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < cover:
            least = np.minimum(least[: windows], least[cover - width : cover - width + windows])
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        begins = np.flatnonzero(np.arange(windows) + length <= ends[:windows])
        if not len(begins):
            return
        picked = (_PLACE - (least[begins] & _PLACE)).astype(np.int64)
        new = np.ones(len(begins), bool)
        new[1:] = (picked[1:] != picked[:-1]) | (begins[1:] != begins[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.low = picked[first], begins[first]
        self.high = begins[np.append(first[1:], len(begins)) - 1]
        self.grams = mix(grams[self.at])  # minima are small numbers: spread them again

    def triples(self) -> np.ndarray:
        """A name for each position's triple."""
        shape = (self.at - self.low).astype(np.uint64) * np.uint64(1 << 20) + (self.high - self.low).astype(np.uint64)
        return range_hash(self.prefix, self.low, self.high + self.length) ^ mix(shape + np.uint64(1))


def text_names(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b for each text: no two texts that anybody can write share them."""
    names = digests(*text_bytes(texts))
    return names[:, 0].copy(), names[:, 1].copy()


def _grams(docs: DataFrame, length: int) -> DataFrame:
    """The grams that are sampled more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            c = Cover(batch.column("text"), length)
            if len(c.at):
                yield pa.RecordBatch.from_arrays([pa.array(signed(c.grams))], names=["gram"])

    sampled = docs.select("text").mapInArrow(run, "gram bigint")
    return sampled.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")


def _place_name(t1: np.ndarray, triples: np.ndarray) -> np.ndarray:
    return mix(t1 * np.uint64(0x9E3779B97F4A7C15) + triples)


def _samples(docs: DataFrame, length: int, twice: bytes) -> DataFrame:
    """Positions whose gram is sampled more than once, with the text's name."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in pieces(batches, "text"):
            c = Cover(batch.column("text"), length)
            if not len(c.at):
                continue
            keep = _passes(table, c.grams)
            low, high, grams, triples = (x[keep] for x in (c.low, c.high, c.grams, c.triples()))
            row = np.searchsorted(c.bounds, low, "right") - 1
            t1, t2 = (t[row] for t in text_names(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(t1)), pa.array(signed(t2)), pa.array(signed(grams)), pa.array(signed(triples)), pa.array(signed(_place_name(t1, triples))),
                 pa.array((low - c.bounds[row]).astype(np.int32)), pa.array((high - low + 1).astype(np.int32))],
                names=["t1", "t2", "gram", "triple", "place", "low", "starts"])

    return docs.select("text").mapInArrow(run, "t1 bigint, t2 bigint, gram bigint, triple bigint, place bigint, low int, starts int")


def _stretches(docs: DataFrame, length: int, places: bytes) -> DataFrame:
    """The bytes of the triples at chosen places, once in each batch."""
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in pieces(batches, "text"):
            c = Cover(batch.column("text"), length)
            if not len(c.at):
                continue
            triples, row = c.triples(), np.searchsorted(c.bounds, c.low, "right") - 1
            t1, t2 = (t[row] for t in text_names(batch.column("text")))
            place = _place_name(t1, triples)
            which = np.flatnonzero(_passes(table, place))
            which = which[np.unique(place[which], return_index=True)[1]]
            low, high = c.low[which], c.high[which]
            raw = c.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(x[which])) for x in (t1, t2, c.grams, triples, place)]
                + [pa.array((low - c.bounds[row[which]]).astype(np.int32)), pa.array((c.at[which] - low).astype(np.int32)), pa.array((high - low + 1).astype(np.int32)),
                   pa.array([raw[a : b + length] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())],
                names=["t1", "t2", "gram", "triple", "place", "low", "off", "starts", "bytes"])

    return docs.select("text").mapInArrow(run, "t1 bigint, t2 bigint, gram bigint, triple bigint, place bigint, low int, off int, starts int, bytes binary")


def _strings(batch: pa.RecordBatch, length: int):
    """(triple's row, start in it, distance to the sampled position, two names) of every string of the triples."""
    data, bounds = text_bytes(batch.column("bytes"))
    starts = batch.column("starts").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), starts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    begin = bounds[row] + nth
    names = [range_hash(prefix_hash(byte_table(seed)[data]), begin, begin + length) for seed in (3, 9)]
    return row, nth, batch.column("off").to_numpy().astype(np.int64)[row] - nth, *names


def _neighbours(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of the strings that equal another one of the same gram and offset."""
    row, nth, off, h1, h2 = _strings(batch, length)
    gram = batch.column("gram").to_numpy().view(np.uint64)[row]
    key = mix(gram + mix(off.astype(np.uint64) + np.uint64(7))) ^ h1
    order = np.lexsort((h2, key))
    same = (key[order][1:] == key[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    equal = np.zeros(len(row), bool)
    equal[order[1:][same]] = True
    equal[order[:-1][same]] = True
    return _spans(batch, row, nth, equal, length)


def _spans(batch: pa.RecordBatch, row: np.ndarray, nth: np.ndarray, equal: np.ndarray, length: int) -> pa.RecordBatch:
    single = batch.column("n").to_numpy()[row] == 1  # a triple that occurs twice is settled
    place = np.flatnonzero(equal & single)
    new = np.ones(len(place), bool)
    new[1:] = (row[place][1:] != row[place][:-1]) | (nth[place][1:] != nth[place][:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    of = row[place[first]]
    low = batch.column("low").to_numpy().astype(np.int64)[of]
    take = pa.array(of)
    return pa.RecordBatch.from_arrays(
        [batch.column("t1").take(take), batch.column("t2").take(take), pa.array(low + nth[place[first]]), pa.array(low + nth[place[last]] + length)],
        names=["t1", "t2", "start", "end"])


def _by_gram(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches cut between grams: the rows of one gram, which stand together, are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        gram = table.column("gram").to_numpy()
        cut = len(gram) - int(np.argmax(gram[::-1] != gram[-1])) if gram[0] != gram[-1] else 0
        if cut:
            yield from table.slice(0, cut).combine_chunks().to_batches()
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_SPANS = "t1 bigint, t2 bigint, start bigint, end bigint"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, spans) for each text with repeated strings: sorted, overlapping (start, end) in bytes."""
    grams = common.staged(_grams(docs, length), "repeated-grams")
    samples = common.staged(_samples(docs, length, _filter_table(grams, "gram")), "repeated-samples")
    triples = common.staged(samples.groupBy("gram", "triple").agg(F.count("*").alias("n"), F.min("place").alias("place")), "triples")
    settled = samples.join(triples.filter("n > 1").select("gram", "triple"), ["gram", "triple"]).select(
        "t1", "t2", F.col("low").cast("bigint").alias("start"), (F.col("low") + F.col("starts") + F.lit(length - 1)).cast("bigint").alias("end"))

    several = triples.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    left = common.staged(triples.join(several, "gram"), "triples-left")
    bodies = _stretches(docs, length, _filter_table(left, "place"))
    left = common.staged(bodies.join(left, ["gram", "triple", "place"]).dropDuplicates(["gram", "triple"]), "triple-bytes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_gram(batches):
            yield _neighbours(batch, length)

    grouped = left.filter(F.col("kinds") <= GROUP).repartition("gram").sortWithinPartitions("gram").mapInArrow(meet, _SPANS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes", 1 << 18):
            row, nth, off, h1, h2 = _strings(batch, length)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("gram", "t1", "t2", "n")), pa.array(batch.column("low").to_numpy().astype(np.int64)[row] + nth), pa.array(off), pa.array(signed(h1)), pa.array(signed(h2))],
                names=["gram", "t1", "t2", "n", "start", "off", "h1", "h2"])

    strings = left.filter(F.col("kinds") > GROUP).mapInArrow(spread, "gram bigint, t1 bigint, t2 bigint, n bigint, start bigint, off bigint, h1 bigint, h2 bigint")
    twice = strings.groupBy("gram", "off", "h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    hot = strings.filter("n = 1").join(twice, ["gram", "off", "h1", "h2"]).select("t1", "t2", "start", (F.col("start") + length).alias("end"))
    spans = settled.unionByName(grouped).unionByName(hot)
    return spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint, maximal spans of sorted overlapping ones; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def whole_characters(body: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they cover in part."""
    out = []
    for a, b in runs:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per document: the key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the removed ``spans``;
    with ``keep_text`` also ``kept``, the remaining text. A text stays text: characters of which a part repeats stay whole in it."""
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    spans = common.staged(repeated_spans(own, length), "repeated-spans")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_table(spans, "t1"))

    def named(only: bool | None = None) -> DataFrame:
        """The rows with their text's name; with ``only`` those that may, or surely do not, have spans."""
        return own.mapInArrow(lambda batches: name(batches, only), f"id {kind}, n_bytes bigint, t1 bigint, t2 bigint, digest string, body binary")

    def name(batches: Iterator[pa.RecordBatch], only: bool | None) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in pieces(batches, "text"):
            t1, t2 = text_names(batch.column("text"))
            travels = _passes(table, t1)
            if only is not None:
                batch = batch.filter(pa.array(travels == only))
                t1, t2, travels = (x[travels == only] for x in (t1, t2, travels))
                if not batch.num_rows:
                    continue
            data, bounds = text_bytes(batch.column("text"))
            raw = data.tobytes()
            rows = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            body = [r if keep_text or t else None for r, t in zip(rows, travels.tolist(), strict=True)]
            digest = [None if t else hashlib.sha256(r).hexdigest() for r, t in zip(rows, travels.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(bounds)), pa.array(signed(t1)), pa.array(signed(t2)), pa.array(digest, pa.string()), pa.array(body, pa.binary())],
                names=["id", "n_bytes", "t1", "t2", "digest", "body"])

    columns = ["id", "n_bytes", "digest", "body", "spans"]
    joined = named(True if keep_text else None).join(spans, ["t1", "t2"], "left").select(columns)
    if keep_text:  # whole texts without spans stay where they are
        joined = joined.unionByName(named(False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(columns))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
            for body, found, digest in zip(batch.column("body"), batch.column("spans"), batch.column("digest"), strict=True):
                body, runs = body.as_py(), merged(found.as_py() or [])
                kept = body
                if runs:
                    edges = [0, *(e for s in runs for e in s), len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(digest.as_py() or hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in runs])
                if keep_text:
                    edges = [0, *(e for s in whole_characters(body, runs) for e in s), len(body)]
                    out["kept"].append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
                else:
                    out["kept"].append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], span_type), pa.array(out["kept"], pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    result = joined.mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept string")
    return (result if keep_text else result.drop("kept")).withColumnRenamed("id", key)


SQL = """
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rk, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT rk, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
dup AS (SELECT rk, i FROM (SELECT rk, i, count(*) OVER (PARTITION BY k) AS c FROM g) WHERE c > 1),
f AS (SELECT rk, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rk ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM dup),
r AS (SELECT rk, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY rk ORDER BY i) AS grp FROM f) GROUP BY rk, grp),
o AS (SELECT rk, a, b, lag(b, 1, 0) OVER (PARTITION BY rk ORDER BY a) AS was FROM r),
x AS (SELECT rk, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * was + 1 AS BIGINT), CAST(2 * (a - was) AS BIGINT)), '' ORDER BY a) AS kept FROM o JOIN d USING (rk) GROUP BY rk)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN x.rk IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256 FROM d LEFT JOIN x USING (rk)
"""


@common.query("op3_suffix_array_dedup", SQL)
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents")).drop("spans")
