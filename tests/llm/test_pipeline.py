"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import re

from llm import plain

from rxatlas.llm import common, op6_language


def test_stages(spark, small):
    import corpus_pipeline as pipeline

    stages = dict(pipeline.STAGES)
    docs = common.table(spark, small, "documents")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34", "en", "s", 5)], docs.schema)
    first = common.staged(stages["language"](spark, docs.unionByName(extra), small), "t")
    assert first.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in first.collect()}
    assert kept.items() <= before.items() and len(kept) >= 0.98 * len(before)

    twice = first.unionByName(first.limit(3))
    second = common.staged(stages["near_copies"](spark, twice, small), "t")
    rows = sorted(kept.items())
    roots = plain.components([plain.shingles(t, 5) for _, t in rows], 80, 100)
    assert sorted(r.doc_id for r in second.collect()) == sorted({rows[r][0] for r in roots})

    third = common.staged(stages["repeats"](spark, second, small), "t")
    left = sorted((r.doc_id, r.text) for r in second.collect())
    expected = {}
    for (key, _), x in zip(left, plain.without_repeats([t for _, t in left]), strict=True):
        if re.search(r"[^ \t-\r]", x[3].decode(errors="ignore")):
            expected[key] = x[1]
    got = {r.doc_id: r for r in third.collect()}
    assert got.keys() == expected.keys() and third.columns == docs.columns
    texts = dict(left)
    for key, r in got.items():
        cut = len(texts[key].encode()) - len(r.text.encode())
        assert r.n_chars == len(r.text) and 0 <= expected[key] - cut <= 6 * expected[key] // 200

    fourth = common.staged(stages["decontaminate"](spark, third, small), "t")
    items = [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()]
    rows = [(k, r.text) for k, r in got.items()]
    clean = {k for (k, _), x in zip(rows, plain.contaminated([t for _, t in rows], items), strict=True) if not x[1]}
    assert {r.doc_id for r in fourth.collect()} == clean

    last = stages["packing"](spark, fourth, small).groupBy("doc_id").sum("n_words").collect()
    counts = {k: len(plain.SPACED.findall(got[k].text)) for k in clean}
    assert {r[0]: r[1] for r in last} == {k: n for k, n in counts.items() if n}


def test_rejected_languages(spark):
    import corpus_pipeline as pipeline

    rows = [(i, "the thing of the king " * 9, "en", "s", 9) for i in range(40)] + [(50, "…", "en", "s", 1), (51, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(pipeline.STAGES)["language"](spark, docs, "").collect()}
    assert kept == set(range(40)) and op6_language.UNKNOWN == "und"


def test_near_copies_by_five_words(spark):
    import corpus_pipeline as pipeline

    words = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(f"x{n}" if i % 45 == 20 and i // 45 < n else w for i, w in enumerate(words)), "en", "s", 9) for n in (0, 6, 7)] + [(9, "a b c d e", "en", "s", 9), (10, "a b c d", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(pipeline.STAGES)["near_copies"](spark, docs, "").collect()}
    roots = plain.components([plain.shingles(r[1], 5) for r in rows], 80, 100)
    assert kept == {rows[r][0] for r in roots} and 6 not in kept
