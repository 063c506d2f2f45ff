"""A training-data pipeline: each stage calls one of the corpus operators on what the stage before it kept.

language       documents whose language is not recognised go
near_copies    one document of each group of similar documents (shingles of five words, 0.8) stays, the one with the smallest id
repeats        passages of 200 bytes and more that repeat anywhere go, in every place; documents of which nothing is left go
decontaminate  documents that share a window of words with a benchmark item go
packing        the rest is cut into sequences and batched by length
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxatlas.llm import common, op3_suffixes, op4_jaccard, op6_language, op7_packing, op10_decontaminate

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
NEAR_K, NEAR_SHARE = 5, (80, 100)  # words of a shingle and least Jaccard similarity of near copies
LEAST_SCORE = 0.4  # share of the words' posterior mass


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key that also tells rows apart that share an id."""
    return docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op6_language.identify(docs, op6_language.train(docs))
    return found.filter((F.col("lang_pred") != op6_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    groups = op4_jaccard.similar_documents(keyed, key="_key", k=NEAR_K, share=NEAR_SHARE)
    others = groups.filter(~F.col("_key").eqNullSafe(F.col("component_id"))).select("_key").distinct()
    kept = common.without_keys(keyed, "_key", others)
    # rows that repeat id and text share a key: one of them stays
    repeated = common.staged(groups.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key"), "repeated-rows")
    once = common.by_key_table(kept, "_key", repeated, "_key").dropDuplicates(["_key"])
    return common.by_key_table(kept, "_key", repeated, "_key", present=False).unionByName(once).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = op3_suffixes.without_repeats(docs.select(F.struct(*rest).alias("_row"), "text"), key="_row", keep_text=True)
    out = cut.select("_row.*", F.col("kept").alias("text"), F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return out.filter(F.col("text").rlike(r"[^ \t-\r]")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = op10_decontaminate.decontaminate(keyed, common.table(spark, sf_dir, "benchmark"), doc_key="_key")
    return common.without_keys(keyed, "_key", found.filter("n_hit > 0").select("_key").distinct()).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: the language model and the repeated strings are beyond SQL: the tests compare run() with a plain version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps is written to the shared folder and read by the next one."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
