"""Language identification with a linear-chain conditional random field over words.

A word's features are its affixes (2 to 4 bytes from either end), its byte bigrams and trigrams and the word itself
(the lexicon), hashed into one table of weights per language; a matrix of learned weights scores the language
of each word against that of the word before. Forward-backward gives every word its distribution over the languages
given the whole text, also where the text switches languages; a document's language is the one with the largest
share of its words' posterior mass, and ``score`` is that share.

Fitting happens on the driver from a bounded sample of labelled documents (``SAMPLE_DOCS`` for each language, a stretch of
``SAMPLE_CHARS`` characters of each, chosen by hashes of the key). Its words are used twice: as they stand, and cut into
short stretches that are dealt into mixed sequences, from which the model learns what a switch looks like. Every
text is then labelled whole in the tasks, in one pass and without a shuffle: texts are cut into blocks of words, each
block's transfer matrix is computed for all blocks at once, and blocks are chained per document.

Defined results: ``und`` with score 0 for a null text or one without letters; without any labelled document
every text is ``und``; rows repeat as they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import Words, pieces, text_bytes, word_table

SAMPLE_DOCS = 300
SAMPLE_CHARS = 1_000
TABLE_BITS = 17
BLOCK = 32
STRETCH = 12  # mean words of a stretch in the mixed sequences
STEPS = 30
LETTERS = word_table(lambda c: 0x61 <= c <= 0x7A or c >= 0x80, lower=True)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    features: np.ndarray  # 2**TABLE_BITS x languages
    start: np.ndarray
    transitions: np.ndarray  # from, to


def word_features(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, words they belong to) of the chosen words, in the order of ``chosen``."""
    starts, ends = words.starts[chosen], words.ends[chosen]
    sizes = ends - starts
    owner = np.repeat(np.arange(len(chosen)), sizes)
    places = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    padded = np.concatenate([words.folded[words.data], np.zeros(8, np.uint8)]).astype(np.uint32)
    numbers, owners = [], []

    def add(kind: int, at: np.ndarray, n: int, of: np.ndarray) -> None:
        code = np.full(len(at), kind, np.uint32)
        for j in range(n):
            code = (code ^ padded[at + j]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        numbers.append((code >> np.uint32(32 - TABLE_BITS)).astype(np.int32))
        owners.append(of)

    left = np.repeat(ends, sizes) - places
    for n in (2, 3):
        add(10 + n, places[left >= n], n, owner[left >= n])
    every = np.arange(len(chosen))
    for n in (2, 3, 4):
        long = sizes >= n
        add(20 + n, starts[long], n, every[long])
        add(30 + n, ends[long] - n, n, every[long])
    numbers.append((words.hashes()[chosen] >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
    owners.append(every)
    return np.concatenate(numbers), np.concatenate(owners)


def _sum_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def marginals(emission: np.ndarray, counts: np.ndarray, start: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posterior of each word's label, for sequences of ``counts`` words; with ``pairs`` also the expected number of each transition."""
    n, k = emission.shape
    counts = counts[counts > 0]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    seq_start = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(total) - first_block[of]
    begin = seq_start[of] + nth * BLOCK
    size = np.minimum(BLOCK, counts[of] - nth * BLOCK)
    place = begin[:, None] + np.arange(BLOCK)[None, :]
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    eb = np.where(inside[:, :, None], e[np.minimum(place, n - 1)], 1.0)
    first = np.exp(start - start.max())

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # transfer matrix of each block: entering from label i (of the word before) to label j of its last word
    transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for s in range(BLOCK):
        live = inside[:, s]
        if not live.any():
            break
        moved = (transfer[live] @ t) * eb[live, s][:, None, :]
        transfer[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
    # chained over the blocks of each sequence: distribution before a block, and weight of what follows it
    before, after = np.empty((total, k)), np.ones((total, k))
    alpha = np.empty((total, BLOCK, k))
    order = np.argsort(-blocks, kind="stable")
    alive = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max()) + 1), "right") if total else np.zeros(0, int)
    # the first block's forward pass starts from the start weights; later ones from the chained distribution
    zero = first_block
    head = scaled(first[None, :] * eb[zero, 0])
    last = head
    alpha[zero, 0] = head
    for s in range(1, BLOCK):
        live = inside[zero, s]
        if not live.any():
            break
        last = last.copy()
        last[live] = scaled((last[live] @ t) * eb[zero[live], s])
        alpha[zero[live], s] = last[live]
    state = last
    for j in range(1, int(blocks.max()) if total else 0):
        who = order[: alive[j]]
        b = first_block[who] + j
        before[b] = state[who]
        state[who] = scaled(np.einsum("mi,mij->mj", state[who], transfer[b]))
    later = np.flatnonzero(nth > 0)
    cur = before[later]
    for s in range(BLOCK):
        live = inside[later, s]
        if not live.any():
            break
        cur[live] = scaled((cur[live] @ t) * eb[later[live], s])
        alpha[later[live], s] = cur[live]
    weight = np.ones((len(counts), k))
    for j in range((int(blocks.max()) if total else 0) - 1, 0, -1):
        who = order[: alive[j]]
        b = first_block[who] + j
        after[b] = weight[who]
        weight[who] = scaled(np.einsum("mij,mj->mi", transfer[b], weight[who]))
    after[zero] = weight
    beta = np.empty((total, BLOCK, k))
    cur = after
    for s in range(BLOCK - 1, -1, -1):
        live = inside[:, s]
        beta[live, s] = cur[live]
        cur = cur.copy()
        cur[live] = scaled((eb[live, s] * cur[live]) @ t.T)
    a, b = alpha[inside], beta[inside]  # in the order of the words: blocks are
    gamma = scaled(a * b)
    if not pairs:
        return gamma
    inner = np.ones(n, bool)
    inner[seq_start] = False
    to = np.flatnonzero(inner)
    xi = a[to - 1][:, :, None] * t[None] * (e[to] * b[to])[:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    return gamma, xi.sum(axis=0)


def fit(texts: list[str], labels: list[int], n_labels: int, steps: int = STEPS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, start, transitions) by Adagrad on the likelihood of plain and mixed sequences."""
    lowered = pc.utf8_lower(pa.array(texts, pa.string()))
    words = Words(*text_bytes(lowered), LETTERS)
    _, sample, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    numbers, owner = word_features(words, sample)
    label = np.repeat(np.array(labels), words.counts)
    rng = np.random.default_rng(seed)
    # stretches of the same words, shuffled into sequences of about ten stretches
    cut = (rng.random(len(label)) < 1 / STRETCH) | (np.diff(words.row, prepend=-1) != 0)
    stretch = np.cumsum(cut) - 1
    rank = rng.permutation(int(stretch[-1]) + 1 if len(stretch) else 0)
    mixed = np.argsort(rank[stretch], kind="stable") if len(stretch) else np.zeros(0, int)
    groups = rank[stretch][mixed] // 10
    mixed_counts = np.bincount(groups) if len(groups) else np.zeros(0, int)
    order = np.concatenate([np.arange(len(label)), mixed])
    seq, gold = inverse[order], label[order]
    counts = np.concatenate([words.counts[words.counts > 0], mixed_counts[mixed_counts > 0]])
    begins = np.cumsum(counts) - counts
    inner = np.ones(len(seq), bool)
    inner[begins] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (gold[to - 1], gold[to]), 1)
    onehot = np.eye(n_labels)[gold]
    w, start, move = np.zeros((1 << TABLE_BITS, n_labels)), np.zeros(n_labels), np.zeros((n_labels, n_labels))
    sums = [np.full(x.shape, 1e-6) for x in (w, start, move)]
    for _ in range(steps):
        emission = _sum_by(owner, w[numbers], len(sample))[seq]
        gamma, xi = marginals(emission, counts, start, move, pairs=True)
        by_word = _sum_by(seq, onehot - gamma, len(sample))
        slopes = (_sum_by(numbers, by_word[owner], 1 << TABLE_BITS) - 0.01 * w, (onehot - gamma)[begins].sum(axis=0), seen - xi)
        for x, g, s in zip((w, start, move), slopes, sums, strict=True):
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    return w, start, move


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """The model of a bounded sample of labelled documents that are not held out; None if there is none."""
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    usable = own.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000_000))
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(int(1e9 * min(1.0, sample_docs / n))))])
    longest = F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1
    stretch = F.substring(F.col("text"), F.pmod(F.xxhash64(F.lit(13), "id"), longest).cast("int") + 1, F.lit(sample_chars))
    rows = usable.filter(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select(F.xxhash64(F.lit(17), "id").alias("h"), "lang", stretch.alias("text"))
    got = sorted((r["h"], r["lang"], r["text"]) for r in rows.limit(2 * sample_docs * len(sizes)).collect())
    languages = tuple(sorted({r[1] for r in got}))
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    return Model(languages, *[x.astype(np.float32) for x in fit([r[2] for r in got], [number[r[1]] for r in got], len(languages))])


def label_batch(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, share of the words' posterior mass) of each text."""
    lowered = pc.utf8_lower(texts)
    words = Words(*text_bytes(lowered), LETTERS)
    mass = np.zeros((len(texts), len(model.languages)))
    if len(words.starts):
        _, sample, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        numbers, owner = word_features(words, sample)
        emission = _sum_by(owner, model.features[numbers], len(sample))[inverse]
        mass = _sum_by(words.row, marginals(emission, words.counts, model.start, model.transitions), len(texts))
    best = mass.argmax(axis=1)
    score = mass.max(axis=1) / np.maximum(words.counts, 1)
    # bytes of other scripts count as letters above; where nothing else stands in a text, ask Unicode
    plain = pc.match_substring_regex(pc.fill_null(texts, ""), "[A-Za-z]").to_numpy(zero_copy_only=False)
    known = [bool(words.counts[i]) and (bool(plain[i]) or any(c.isalpha() for c in texts[i].as_py())) for i in range(len(texts))]
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return names, np.clip(np.where(known, score, 0.0), 0.0, 1.0)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the other columns pass through."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    names = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found, score = label_batch(batch.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)


@common.query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
