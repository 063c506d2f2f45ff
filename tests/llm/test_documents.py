"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import random

import pytest
from llm import plain

from rxatlas.llm import (
    common,
    linking,
    op1_quality,
    op2_tokens,
    op3_suffixes,
    op4_jaccard,
    op5_paragraphs,
    op6_language,
    op7_packing,
    op10_decontaminate,
)

random.seed(3)
WORDS = ["the", "of", "and", "ring", "gear", "Éte", "x9", "und", "für", "##", "rod", "plate", "bolt", "was"]


def prose(n, words=WORDS):
    return " ".join(random.choice(words) + random.choice(["", "", ".", "a", "ou", "ing"]) for _ in range(n))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = f"w{random.random():.6f}"
    return " ".join(words)


BASE, OTHER = prose(300), prose(220)
TEXTS = [
    None, "", " \n\t ", "one", "one two", "one two", BASE, BASE, edited(BASE, 1), edited(BASE, 3), edited(BASE, 8), edited(BASE, 40), BASE.upper(), OTHER,
    OTHER + "\n" + BASE[:400], prose(4000), "a" * 3000, "ab " * 400, "é" * 500, "x\n" * 30, prose(30) + "\n" + OTHER, "\n".join([OTHER] * 3),
    *(edited(BASE, 2) for _ in range(12)),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(6, BASE), (100, OTHER)]


def by_id(rows):
    out = collections.defaultdict(list)
    for key, *rest in rows:
        out[key].append(tuple(rest))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_quality_counts(documents, spark):
    docs = documents(ROWS).withColumnRenamed("text_2", "lang")
    got = op1_quality.judged(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert by_id(rows) == by_id((i, *plain.quality(t)) for i, t in ROWS)
    # nothing is certified without labels: only the base rejects
    assert got.filter("kept = base_failed").count() == 0


def test_quality_cutoffs_hold_their_limit(spark):
    good = [(i, prose(60), "en") for i in range(400)]
    bad = [(i, prose(30, ["#", "$", "%", "ring"]), "en") for i in range(400, 600)]
    few = [(i, prose(30, ["#", "$", "%", "ring"]), "de") for i in range(600, 620)] + [(i, prose(60), None) for i in range(620, 640)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(600)] + [(7, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in op1_quality.judged(docs, labels).collect()}
    assert all(got[i].rejected_by for i in range(400, 600))
    assert sum(bool(got[i].rejected_by) for i in range(400)) <= op1_quality.LIMIT * 400
    assert not any(got[i].rejected_by for i in range(600, 640))  # strata without labels lose nothing


def test_binomial_tail_is_exact(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 10), (3, 100), (1, 400), (12, 300), (0, 0), (40, 5000)]
    rows = spark.createDataFrame(cases, "k long, n long").withColumn("p", op1_quality.binomial_tail(F.col("k"), F.col("n"), 0.05)).collect()
    for r in rows:
        exact = sum(comb(r.n, j) * 0.05**j * 0.95 ** (r.n - j) for j in range(r.k + 1)) if r.k < r.n * 0.05 else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_token_counts_and_splices(documents):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    tokenizer = op2_tokens.tokenizer(path)

    def count(text):
        return len(tokenizer.encode(text or "", add_special_tokens=False))

    rows = [*ROWS, (200, "a <|endoftext|>b"), (201, "ﬁ é́ it's 12 İ ß"), (202, "z" * 40_000), (203, " ".join(["ring's"] * 9000))]
    got = op2_tokens.token_counts(documents(rows), path).collect()
    assert by_id(got) == by_id((i, len((t or "").encode()), count(t)) for i, t in rows)

    def encode(texts):
        return tokenizer.encode_batch(texts, add_special_tokens=False)

    parts = ["a", "b ", "it's", " ", "é", "\n", "<|endoftext|>", "12", "x" * 40, "́", "!?", "İ", "日本"]
    for _ in range(400):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 60)))
        assert op2_tokens.spliced_count(text, encode, random.choice([1, 3, 20]), random.choice([1, 2, 9])) == count(text)


def test_repeated_strings(documents, monkeypatch):
    expected = by_id((i, *x[:3], plain.sha(x[3])) for (i, _), x in zip(ROWS, plain.without_repeats([t for _, t in ROWS]), strict=True))
    got = op3_suffixes.without_repeats(documents(ROWS)).drop("spans")
    assert by_id(got.collect()) == expected
    # grams with many triples take the other way to the same result
    monkeypatch.setattr(op3_suffixes, "GROUP", 2)
    assert by_id(op3_suffixes.without_repeats(documents(ROWS)).drop("spans").collect()) == expected


def test_names_without_known_collisions():
    """Thue-Morse texts have one polynomial hash modulo 2**64 whatever the base is."""
    import numpy as np
    import pyarrow as pa

    from rxatlas.llm import op3_suffixes
    from rxatlas.llm.textops import SPACED, Words, text_bytes

    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = pa.array([bits, bits.translate({97: 98, 98: 97}), bits])
    for names in (np.stack(op3_suffixes.text_names(texts)).T, Words(*text_bytes(texts), SPACED).hashes()[:, None]):
        assert (names[0] == names[2]).all() and (names[0] != names[1]).all()


def test_cut_texts_keep_whole_characters(documents):
    rows = [(1, "é" * 150 + "a" * 51), (2, "é" * 150 + "b"), (3, "c")]
    kept = {r.doc_id: r.kept for r in op3_suffixes.without_repeats(documents(rows), keep_text=True).collect()}
    assert kept == {1: "a" * 51, 2: "b", 3: "c"}


def expected_components(rows, k, num, den):
    sets = [plain.shingles(t, k) for _, t in rows]
    roots = plain.components(sets, num, den)
    least = collections.defaultdict(list)
    for (key, _), root in zip(rows, roots, strict=True):
        least[root].append(key)
    return by_id((key, len(s), min(least[r])) for (key, _), s, r in zip(rows, sets, roots, strict=True))


def test_similar_documents(documents):
    got = op4_jaccard.similar_documents(documents(ROWS)).select("doc_id", "n_shingles", "component_id")
    assert by_id(got.collect()) == expected_components(ROWS, 3, 90, 100)


def test_links_do_not_depend_on_rounds(documents, monkeypatch):
    rows = [(i, edited(BASE, random.choice([1, 3, 5, 7]))) for i in range(60)]
    expected = expected_components(rows, 3, 90, 100)
    for dense, sparse in ((0, 0), (10**9, 0), (10**9, 10**9)):  # many rounds of many pivots, one of few, none
        monkeypatch.setattr(linking, "DENSE", dense)
        monkeypatch.setattr(linking, "SPARSE", sparse)
        got = op4_jaccard.similar_documents(documents(rows)).select("doc_id", "n_shingles", "component_id")
        assert by_id(got.collect()) == expected


def test_repeated_paragraphs(documents):
    got = {}
    for r in op5_paragraphs.repeated_paragraphs(documents(ROWS[:-2])).collect():
        got[r.doc_id] = (r.n_paragraphs, r.removed)
    places, sets = [], []
    for i, t in ROWS[:-2]:
        for nth, line in enumerate((t or "").split("\n")):
            if len(plain.SPACED.findall(line)) >= 20:
                places.append((i, nth))
                sets.append(plain.shingles(line, 5))
    roots = plain.components(sets, 80, 100)
    removed = collections.defaultdict(list)
    for nth, root in enumerate(roots):
        if nth != root:
            removed[places[nth][0]].append(places[nth][1])
    n = collections.Counter(p[0] for p in places)
    assert got == {i: (n[i], removed[i]) for i, _ in ROWS[:-2]}


def test_short_lines_are_paragraphs(spark, tmp_path):
    notice = "copying and distribution are permitted in any medium"
    rows = [
        (1, f"Contents\n{notice}\n{OTHER}"), (2, f"{notice}\ncontents\n\n \t"), (3, "Copying and  distribution are permitted in any medium\nall rights reserved"),
        (4, "a b c d e f g h i\na b c d\na b c"), (5, "a b c d e f g h i j\nall rights Reserved\na b c x"), (6, None), (7, f"a b c d e f g h\na b c d e f g\n{edited(OTHER, 2)}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_paragraphs, r.removed) for r in op5_paragraphs.op5_paragraph_dedup(spark, str(tmp_path)).collect()}
    places = [(i, nth, plain.shingles(line, 5)) for i, t in rows for nth, line in enumerate((t or "").split("\n")) if plain.SPACED.findall(line)]
    removed = collections.defaultdict(list)
    for nth, root in enumerate(plain.components([p[2] for p in places], 80, 100)):
        if nth != root:
            removed[places[nth][0]].append(places[nth][1])
    n = collections.Counter(p[0] for p in places)
    assert got == {i: (n[i], removed[i]) for i, _ in rows} and got[2] == (2, [0, 1])


def test_language(documents, spark):
    sounds = {"en": ["the", "thing", "of", "tion"], "de": ["ung", "sch", "der", "keit"], "fr": ["eau", "oi", "le", "ment"]}
    rows = [(i, prose(40, sounds[lang]), lang) for i, lang in enumerate(list(sounds) * 60)] + [(900, prose(20), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5 AS score", "'q' AS id")
    model = op6_language.train(docs)
    assert set(model.languages) == set(sounds)
    mixed = prose(60, sounds["de"]) + " " + prose(10, sounds["fr"])
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "12 ++ …"), (1003, mixed), (1004, "日本語")], "doc_id long, text string")
    got = {r.doc_id: r for r in op6_language.identify(docs.drop("lang").unionByName(extra, allowMissingColumns=True), model).collect()}
    held = [r for r in docs.filter(op6_language.held_out("doc_id")).collect() if r.lang]
    assert held and all(got[r.doc_id].lang_pred == r.lang for r in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de" and got[1004].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert op6_language.train(docs.filter("lang IS NULL")) is None


def test_marginals_against_every_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    counts, k = np.array([1, 4, 0, 2]), 3
    emission, start, move = rng.normal(size=(7, k)), rng.normal(size=k), rng.normal(size=(k, k))
    got, moves = op6_language.marginals(emission, counts, start, move, pairs=True)
    at, expected, pairs = 0, np.zeros((7, k)), np.zeros((k, k))
    for n in counts[counts > 0]:
        total, part, moved = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(emission[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                part[i, y] += w
            for a, b in zip(path, path[1:]):
                moved[a, b] += w
        expected[at : at + n] = part / total
        pairs += moved / total
        at += n
    assert np.allclose(got, expected) and np.allclose(moves, pairs)


def test_buckets_are_optimal():
    import itertools

    for _ in range(60):
        lengths = sorted(random.sample(range(1, 40), random.randint(1, 8)))
        counts = [random.randint(1, 9) for _ in lengths]
        k = random.randint(1, 4)

        def waste(ends, lengths=lengths, counts=counts):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))

        got = op7_packing.best_buckets(lengths, counts, k)
        best = min(waste((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert len(got) <= k and got == sorted(set(got)) and waste(got) == best
    assert op7_packing.best_buckets([], [], 3) == []


def test_packing_keeps_every_word(documents):
    got = op7_packing.packed(documents(ROWS), max_words=100, buckets=4, budget=250, rows_per_block=3).collect()
    words = collections.Counter()
    for r in got:
        words[r.doc_id] += r.n_words
        assert r.n_words <= r.bucket and 0 <= r.slot < max(250 // r.bucket, 1)
    expected = collections.Counter()
    for i, t in ROWS:
        expected[i] += len(plain.SPACED.findall(t or ""))
    assert words == +expected
    places = collections.Counter((r.bucket, r.batch, r.slot) for r in got)
    assert max(places.values()) == 1
    for bucket in {r.bucket for r in got}:  # batches are full but for the last
        size = max(250 // bucket, 1)
        rows = [r for r in got if r.bucket == bucket]
        assert {r.batch for r in rows} == set(range(-(-len(rows) // size)))


def test_decontamination(documents, spark):
    items = [(1, BASE[:300]), (2, OTHER), (3, "one two"), (4, None), (5, "…"), (6, "Ring gear"), (7, "one two"), (8, prose(14))]
    benchmark = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS doc_id", "2 AS id")
    rows = [*ROWS, (300, "x ONE, two y ring-gear z"), (301, items[-1][1] + " " + items[-1][1])]
    found = op10_decontaminate.decontaminate(documents(rows), benchmark).select("doc_id", "n_words", "n_hit", "items")
    expected = [(i, *x) for (i, _), x in zip(rows, plain.contaminated([t for _, t in rows], items), strict=True)]
    assert by_id(found.collect()) == by_id(expected)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        op1_quality.judged(docs, labels), op3_suffixes.without_repeats(docs), op4_jaccard.similar_documents(docs), op5_paragraphs.repeated_paragraphs(docs),
        op6_language.identify(docs, op6_language.train(docs)), op7_packing.packed(docs), op10_decontaminate.decontaminate(docs, items),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_parity_vectors_never_rule_out_a_similar_pair(spark):
    import numpy as np

    rng, rows = np.random.default_rng(2), []
    for n in (1, 5, 40, 400):
        for _ in range(40):
            base = rng.integers(0, 1 << 62, n).astype(np.uint64)
            other = base.copy()
            changed = rng.random(n) < rng.random() * 0.3
            other[changed] = rng.integers(0, 1 << 62, int(changed.sum())).astype(np.uint64)
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            row = np.repeat([0, 1], [len(a), len(b)])
            vectors = [v.view(np.int64).tolist() for v in linking.parities(row, np.concatenate([a, b]), 2, 2)]
            rows.append((len(a), len(b), both, *[x for v in vectors for x in v]))
    frame = spark.createDataFrame(rows, "x_n int, y_n int, both int, x0 long, y0 long, x1 long, y1 long")
    pair = frame.selectExpr("struct(x_n AS n, x0 AS parity_0, x1 AS parity_1) AS x", "struct(y_n AS n, y0 AS parity_0, y1 AS parity_1) AS y", "100 * both >= 80 * (x_n + y_n - both) AS similar")
    judged = pair.select("similar", linking.close("x", "y", 2, (80, 100)).alias("open"))
    assert judged.filter("similar AND NOT open").count() == 0 and judged.filter("NOT open").count() > 20


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 100)]
    got = dict(linking.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102, 200), 100)}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_suffix_array_dedup", "op4_ngram_jaccard_join", "op7_packing", "op9_warc", "op10_benchmark_decontamination"])
def test_queries_match_their_sql(spark, small, name):
    from oracle import connect, normalised

    from rxatlas.llm import queries

    frame = queries.QUERIES[name](spark, small)
    result = connect(small).execute(common.ORACLES[name])
    assert normalised(frame.columns, [tuple(r) for r in frame.collect()]) == normalised([d[0] for d in result.description], result.fetchall())
