"""Token counts of whole texts with a public tokenizer file.

Huge texts are encoded as overlapping chunks with offsets and spliced. Two neighbouring chunks are joined at a place
inside their overlap where both encodings begin a token and the character before is ASCII white space. Such
a place is proven stable: the tokenizer's pieces never contain white space, its normaliser does not compose
characters across it and its special strings hold none, so what stands before the place does not change the
tokens after it, nor the other way round. If the overlap has no such place, the left chunk is encoded again with an
overlap twice as wide, past the next chunk's end if need be, until one is found or the text ends.

Texts below the chunk size are counted through the same fact: runs between ASCII white space are encoded on
their own by the library, each distinct run of a batch once, and counts of runs met before are kept in the
worker (bounded, emptied when full). No text is cut, no token is estimated.

Defined results: a null text is empty and has no bytes and no tokens; rows repeat as they came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import SPACED, Words, pieces, text_bytes

CHUNK = 1 << 15  # characters; longer texts are spliced
OVERLAP = 1 << 8
KEPT_RUNS = 400_000  # counts a worker keeps
SPACES = " \t\n\x0b\x0c\r"

_tokenizers: dict[str, object] = {}
_counts: dict[str, dict[bytes, int]] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each worker; Spark runs the tasks, so it gets one thread."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    return _tokenizers[path]


def token_starts(encode: Callable[[list[str]], list], texts: list[str], firsts: list[int]) -> list[np.ndarray]:
    """For each chunk the place in the whole text at which each of its tokens starts."""
    return [np.array([o[0] for o in e.offsets], np.int64) + f for e, f in zip(encode(texts), firsts, strict=True)]


def spliced_count(text: str, encode: Callable[[list[str]], list], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text from encodings of its overlapping chunks."""
    n = len(text)
    firsts = list(range(0, n, chunk)) or [0]
    ends = [min(f + chunk + overlap, n) for f in firsts]
    starts = token_starts(encode, [text[f:e] for f, e in zip(firsts, ends, strict=True)], firsts)
    total, cut, i = 0, 0, 0
    while True:
        own, end, wide, after, splice = starts[i], ends[i], overlap, i + 1, None
        while end < n and splice is None:
            while after < len(firsts) - 1 and ends[after] <= end:
                after += 1  # the widened chunk has passed that one's end
            low = max(firsts[after], cut + 1)
            both = np.intersect1d(own[(own >= low) & (own < end)], starts[after])
            places = [int(p) for p in both if text[p - 1] in SPACES]
            if places:
                splice = places[-1]
            else:
                wide *= 2
                end = min(firsts[after] + wide, n)
                own = token_starts(encode, [text[firsts[i] : end]], [firsts[i]])[0]
        total += int(np.count_nonzero((own >= cut) & (own < (n if splice is None else splice))))
        if splice is None:
            return total
        cut, i = splice, after


def _run_counts(path: str, words: Words) -> np.ndarray:
    """Tokens of every white-space-delimited run."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    kept = _counts.setdefault(path, {})
    _, sample, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    runs = [raw[a:b] for a, b in zip(words.starts[sample].tolist(), words.ends[sample].tolist(), strict=True)]
    new = [r for r in runs if r not in kept]
    if len(kept) + len(new) > KEPT_RUNS:
        kept.clear()
        new = runs
    encoded = tokenizer(path).encode_batch_fast([r.decode() for r in new], add_special_tokens=False)
    kept.update(zip(new, [len(e) for e in encoded], strict=True))
    return np.array([kept[r] for r in runs], np.int64)[inverse]


def token_counts(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: the key, ``n_bytes`` (UTF-8) and ``n_tokens`` without begin or end tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encode(texts):
            return tokenizer(tokenizer_path).encode_batch(texts, add_special_tokens=False)

        for batch in pieces(batches, "text"):
            data, bounds = text_bytes(batch.column("text"))
            sizes = np.diff(bounds)
            huge = np.flatnonzero(sizes > chunk)
            counts = np.zeros(batch.num_rows, np.int64)
            for row in huge:
                counts[row] = spliced_count(batch.column("text")[int(row)].as_py(), encode, chunk, overlap)
            small = np.ones(batch.num_rows, bool)
            small[huge] = False
            kept = data[np.repeat(small, sizes)]
            words = Words(kept, np.concatenate([[0], np.cumsum(np.where(small, sizes, 0))]), SPACED)
            counts += np.bincount(words.row, weights=_run_counts(tokenizer_path, words), minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    narrow = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", key)


@common.query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
