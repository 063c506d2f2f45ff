"""Personal data, conversations and spelling variants against plain versions."""

import random

import pytest
from llm import plain
from pyspark.sql import functions as F

from rxatlas.llm import common, op11_pii, op12_conversations, op13_variants

random.seed(11)

TEXTS = [
    None, "", " \n ", "write to a.b@c.de, or x@y or @z.q or p@q.r@s.t!", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 010.0.0.1 1..2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (017) 555-7713 +12 +1--------2 +1 5)(+44 20 7946 0958 0000",
    "9" * 5000 + "." + "8" * 3000, "a" * 20000 + "@" + "b" * 20000, ("12 " * 4000) + "+1 (2", "x@y.z" * 50, "@" * 3000, "é 4111111111111111é a@é.b",
    "." * 3000 + "@a.b", "+" * 2000 + "1 2 3 4 5 6 7 8 9 0", "0 " * 12, "\u3000" + "0" * 16,
]


def noise(n):
    return "".join(random.choice("ab1 2.3@4-5+6(7)8 9\n%_") for _ in range(n))


def test_seeds_of_personal_data(documents):
    rows = list(enumerate(TEXTS + [noise(400) for _ in range(150)])) + [(3, TEXTS[3]), (None, TEXTS[5])]
    found = op11_pii.personal_data(documents(rows).withColumn("instance", F.lit(1)).withColumn("kind", F.lit("k")))
    got = sorted((repr(r.doc_id), [tuple(s) for s in r.base]) for r in found.collect())
    assert got == sorted((repr(k), [tuple(s) for s in plain.personal(t)]) for k, t in rows)
    for r in found.collect():
        assert all(s in r.spans for s in r.base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.kind == k for s in r.base) for k in range(4)]


def test_unseen_identifiers(spark):
    """Phone numbers without a country stand where those with one stand; what stands elsewhere is left alone."""
    words = ["ring", "gear", "of", "the", "bolt"]
    rows = [(i, f"{random.choice(words)} call me at +1 (20{i}) 555-0{i}00 today {random.choice(words)}") for i in range(10, 22)]
    rows += [(100 + i, f"{random.choice(words)} call me at 555-8{i}11 today") for i in range(10, 14)]
    rows += [(200 + i, f"{random.choice(words)} batch number 555-9{i}11 of {i}") for i in range(10, 16)]
    rows += [(300, "we said 555-81011 once"), (301, "call me at noon"), (302, "call me at 7 today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op11_pii.personal_data(docs).collect()}
    texts = dict(rows)
    for key in range(110, 114):
        (span,) = got[key].spans
        assert texts[key][span.start : span.end] == f"555-8{key - 100}11" and span.kind == 3 and not got[key].base
    assert [texts[300][s.start : s.end] for s in got[300].spans] == ["555-81011"]
    assert not any(got[k].spans for k in got if k >= 200 and k != 300) and all(len(got[k].spans) == 1 for k in range(10, 22))
    _, held = op11_pii.bootstrapped(common.staged(op11_pii._scanned(docs.selectExpr("doc_id AS id", "text")), "t"))
    assert {r.pattern for r in held.collect()} == {"at _", "me at _", "at _ today"}


TURN_TEXTS = ["Yes.", "No!", "what then", "", " \n", None, "a. b", "so.\t", "Yes.", "e\u0301?"]
TURN_ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]


def turns_table(conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(random.randrange(1, longest + 1)):
            rows.append((conv, random.choice([turn, turn, turn, turn + 1, None]), random.choice(TURN_ROLES), random.choice(TURN_TEXTS)))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_repaired_conversations(spark, parts, monkeypatch):
    rows = turns_table(60, 3) + [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hello.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("seq", F.lit(1))
    if parts > 1:
        monkeypatch.setattr(op12_conversations, "HELD", 2)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = op12_conversations.repair(op12_conversations.damaged(frame), present=F.col("present"))
        got = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    expected = {c: plain.repair(t) for c, t in plain.damage(rows).items()}
    assert got == expected


def test_long_conversations_and_their_turns(spark):
    """One conversation with most turns, spread over tasks; the texts of the result give its digest."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i % 700}." if i % 9 else "cut") for i in range(20000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    report = {r.conv_id: r for r in op12_conversations.repair(frame).collect()}
    flaws = plain.faults([(t, r, x) for c, t, r, x in rows if c == 1])
    symbols = bytes(op12_conversations.GO if f in ("blank", "duplicate") else 2 * op12_conversations.CLASSES[r[2][0]] + (f == "truncated") for f, r in zip(flaws, rows))
    letters, cost = op12_conversations.edits(symbols)
    assert (report[1].audit, report[1].cost, report[1].duplicate) == (letters, cost, flaws.count("duplicate"))
    turns = sorted(op12_conversations.repair(frame, texts=True).collect(), key=lambda r: r.place)
    for conv in (1, 2):
        said = "\n".join(f"{r.role}:{r.text}" for r in turns if r.conv_id == conv)
        assert plain.sha(said.encode()) == report[conv].repaired_sha256
    assert report[2].audit == "KK"


def test_edits_by_blocks_and_by_symbols():
    t = op12_conversations.tables()
    assert t.block.shape == (len(t.vectors), op12_conversations.SYMBOLS**op12_conversations.BLOCK)
    for _ in range(300):
        symbols = bytes(random.randrange(op12_conversations.SYMBOLS) for _ in range(random.randrange(12)))
        best = [(c, "I" * (c // 2)) for c in op12_conversations.END]  # from the end: (cost, letters) of each state
        for s in reversed(symbols):
            ways = [[(c + 3, "D" + x)] for c, x in best]
            if s != op12_conversations.GO:
                role, cut = divmod(s, 2)
                for q in range(4):
                    due, kept = op12_conversations.DUE[q], op12_conversations._kept(q, role)
                    ways[q].append((best[due][0] + 2 + cut, "R" + best[due][1]))
                    if kept is not None:
                        ways[q].append((best[kept][0] + cut, "K" + best[kept][1]))
            best = [min(w) for w in ways]
            for _ in range(3):
                best = [min(best[q], (best[op12_conversations.DUE[q]][0] + 2, "I" + best[op12_conversations.DUE[q]][1])) for q in range(4)]
        assert op12_conversations.edits(symbols) == best[0][::-1]


def test_spelling_variants(documents):
    base = ["ringing", "anvils", "Éteindre", "forgeron", "aaaaa", "bolting", "x" * 40, "gears"]
    seen = set()

    def changed(w):
        i, c = random.randrange(len(w)), random.choice("abéxÿ")
        return random.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w])

    texts = [None, "", "12 ## \n", "aaaa aaaa aaaa", "a" * 300000 + " b"]
    for _ in range(60):
        texts.append(" ".join(random.choice([w, w, w.upper(), changed(w), changed(changed(w))]) + random.choice(["", ".", "-", "\u0416"]) for w in random.choices(base, k=60)))
    rows = list(enumerate(texts)) + [(6, texts[6]), (None, texts[7])]
    counted = op13_variants.word_counts(documents(rows).withColumn("word", F.lit("w")), thin=True)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in op13_variants.variants(counted).collect()}
    assert got == plain.variants(rows)
    assert any(r[2] and r[2] != r[4] for r in got.values())  # a chain of forms


def test_empty_tables_of_the_newer_ones(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op11_pii.personal_data(docs).count() == 0
    assert op13_variants.variants(op13_variants.word_counts(docs)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op12_conversations.repair(op12_conversations.damaged(turns), present=F.col("present")).count() == 0
    assert op12_conversations.repair(turns, texts=True).columns == ["conv_id", "place", "letter", "role", "text"]
