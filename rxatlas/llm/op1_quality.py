"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets a few junk signals, each a share between 0 and 1. A rule rejects a document whose signal lies
above the rule's cutoff. Rules are found per stratum from two halves of the labelled documents:

* *propose*, on the fitting half: for each signal the cutoff of a fixed grid with the largest number of bad
  documents rejected less ``penalty`` times the good ones, the most lenient among equals, none if no cutoff gains. The
  proposed rules are ranked by that gain;
* *certify*, on the holdout half: the first ``r`` rules together reject ``k`` of the stratum's ``n`` good
  documents. They are certified when the exact binomial tail ``P(X <= k; n, limit)`` is at most the test level: then the
  share of good documents they reject is below ``limit`` at that confidence. The error rate is divided by the
  number of strata (Bonferroni). Inside a stratum the sets of rules grow, so their tails only grow: testing from
  the first rule on until a set fails keeps the level without a further correction (fixed-sequence testing).

A stratum with too few labels certifies nothing and loses nothing.

All of it is built-in functions. Eight-word windows are compared by 64-bit hashes inside one document.
Labelled rows are counted into grid cells before they are compared; a stratum's rules are a handful of rows.

Defined results: a null or wordless text has zero counts and fails the base; a null stratum is a stratum of
its own; labels that are null are ignored, repeated ones count as the worst; rows repeat as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.base import let
from . import common

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
#: signal and its expression over the measured columns
SIGNALS = {
    "symbols": "n_symbols / word_chars",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "capitals": "n_capitals / word_chars",
}
#: cutoffs on trial, in hundredths
GRID = (1, 2, 3, 5, 8, 12, 16, 20, 25, 30, 35, 40, 50, 60, 70, 80, 90)
LIMIT = 0.05  # share of a stratum's good documents that its rules may reject
LEVEL = 0.05  # chance that the rules of any stratum break the limit
PENALTY = 10
TERMS = 400  # largest terms of a binomial tail that are added one by one


def _repeated(windows: Column) -> Column:
    """Words in windows that occur at least twice: windows are hashes in order of place, each 8 words long."""

    def places(sorted_windows: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            same_before = F.coalesce(F.get(sorted_windows, i - 1)["h"] == x["h"], F.lit(False))
            return same_before | F.coalesce(F.get(sorted_windows, i + 1)["h"] == x["h"], F.lit(False))

        kept = F.filter(sorted_windows, again)
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(8), i + 8 - acc["reach"])).alias("n"), (i + 8).alias("reach"))

    start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("reach"))
    found = let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)
    return F.aggregate(found, start, step, lambda acc: acc["n"])


def _measures(text: Column) -> Column:
    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            n = F.size(hashes)
            windows = F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(hashes, i, 8)))
            counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _repeated(w)).otherwise(F.lit(0)))
            return F.struct(n.cast("bigint").alias("n_words"), F.when(n >= 9, counted).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"))

        return F.struct(
            let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).alias("w"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        )

    def of_lines(lines: Column) -> Column:
        n = F.size(lines).cast("bigint")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return F.struct(
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: the key, the stratum and the counts."""
    m = docs.select(F.col(key).alias("id"), F.col(stratum).cast("string").alias("stratum"), _measures(F.coalesce(F.col(text), F.lit(""))).alias("m"))
    return m.select(
        "id", "stratum", "m.words.w.n_words", "m.words.word_chars", "m.n_symbols", "m.lines.n_dup_lines",
        "m.words.w.n_repeat_words", "m.lines.n_lines", "m.n_capitals",
    )


def with_signals(df: DataFrame) -> DataFrame:
    return df.withColumns({f"signal_{name}": F.coalesce(F.expr(f"try_divide({expr.replace(' / ', ', ')})"), F.lit(0.0)) for name, expr in SIGNALS.items()})


def _log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number to about 1e-12: Stirling's series, moved up by ten."""
    up = x + 10.0
    series = (up - 0.5) * F.log(up) - up + 0.9189385332046727 + 1 / (12.0 * up) - 1 / (360.0 * up**3) + 1 / (1260.0 * up**5)
    shift = F.lit(0.0)
    for i in range(10):
        shift = shift + F.log(x + float(i))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), k < n p: the ``TERMS`` largest terms, and for any left the geometric
    series that bounds them from above, so the value never errs towards certifying."""
    kd, nd = k.cast("double"), n.cast("double")
    log_top = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    odds = (1 - p) / p

    def step(acc: Column, j: Column) -> Column:
        # from the term at j + 1 to the one at j
        term = acc["term"] * (j + 1) / (nd - j) * odds
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    low = F.greatest(F.lit(0).cast("bigint"), k - TERMS)
    below = F.when(k > 0, F.sequence(k - 1, low)).otherwise(F.array().cast("array<bigint>"))
    ratio = kd / (nd - kd + 1) * odds
    total = F.aggregate(below, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")), step, lambda acc: acc["sum"] + F.when(low > 0, acc["term"] * ratio / (1 - ratio)).otherwise(F.lit(0.0)))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def _fires(name: str) -> Column:
    return F.col(f"signal_{name}") * 100 > F.col(f"cut_{name}")


def _as_columns(rules: DataFrame) -> DataFrame:
    """One row per stratum (``of``) with the cutoff and the rank of each signal's rule."""
    wide = rules.groupBy("stratum").pivot("signal", list(SIGNALS)).agg(F.first("cutoff").alias("cut"), F.first("nth").alias("nth"))
    return wide.select(F.col("stratum").alias("of"), *[F.col(f"{s}_{c}").alias(f"{c}_{s}") for s in SIGNALS for c in ("cut", "nth")])


def cutoffs(scored: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", limit: float = LIMIT, level: float = LEVEL, penalty: float = PENALTY) -> DataFrame:
    """(stratum, signal, cutoff, nth) of the certified rules, cutoffs in hundredths. ``scored``: rows of ``measured``."""
    marks = labels.filter(F.col(good).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(good).cast("int")).alias("good"))
    holdout = F.substring(F.md5(F.col("id").cast("string")), 1, 1) >= "8"
    marked = with_signals(scored).join(marks, "id").select("stratum", "good", holdout.alias("holdout"), *[f"signal_{s}" for s in SIGNALS])
    marked = common.staged(marked, "quality-labelled")

    signals = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"signal_{s}").alias("value")) for s in SIGNALS]))
    grid = F.array(*[F.lit(c) for c in GRID])
    passed = F.filter(grid, lambda c: F.col("s.value") * 100 > c)  # the cutoffs that reject the row: the first of the grid
    cells = (
        marked.filter(~F.col("holdout")).select("stratum", "good", signals.alias("s"))
        .groupBy("stratum", F.col("s.signal").alias("signal"), passed.alias("passed"))
        .agg(F.sum(F.when(F.col("good") == 0, 1).otherwise(-penalty)).alias("gain"))
    )
    gains = cells.select("stratum", "signal", "gain", F.explode("passed").alias("cutoff")).groupBy("stratum", "signal", "cutoff").agg(F.sum("gain").alias("gain"))
    best = gains.filter(F.col("gain") > 0).groupBy("stratum", "signal").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    order = Window.partitionBy("stratum").orderBy(F.col("b.gain").desc(), "signal")  # as many rows as signals
    proposed = best.select("stratum", "signal", "b.cutoff", F.row_number().over(order).alias("nth"))

    held = marked.filter(F.col("holdout") & (F.col("good") == 1)).join(_as_columns(proposed), F.col("stratum").eqNullSafe(F.col("of")))
    first = F.least(*[F.when(_fires(s), F.col(f"nth_{s}")) for s in SIGNALS], F.lit(len(SIGNALS) + 1))
    counts = held.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("n"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(len(SIGNALS))))
    sets = counts.select("*", sizes.alias("r")).groupBy("stratum", "r").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first") <= F.col("r"), F.col("n")).otherwise(0)).alias("k"))
    strata = max(marked.select("stratum").distinct().count(), 1)
    certified = sets.filter(binomial_tail(F.col("k"), F.col("n"), limit) <= level / strata).groupBy(F.col("stratum").alias("of")).agg(F.max("r").alias("r"))
    chosen = proposed.join(certified, F.col("stratum").eqNullSafe(F.col("of")) & (F.col("nth") <= F.col("r")))
    return common.staged(chosen.select("stratum", "signal", "cutoff", "nth"), "quality-rules")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept`` and ``rejected_by`` (signals, comma-joined)."""
    rows = common.staged(measured(docs, key, text, stratum), "quality-measures")
    chosen = cutoffs(rows, labels, key, **options)
    joined = with_signals(rows).join(_as_columns(chosen), F.col("stratum").eqNullSafe(F.col("of")), "left")
    fired = F.array_compact(F.array(*[F.when(_fires(s), F.lit(s)) for s in SIGNALS]))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = joined.withColumn("base_failed", base).withColumn("rejected_by", F.array_join(fired, ","))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).withColumnRenamed("id", key)


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rk, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rk, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
win AS (SELECT rk, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT rk, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 9)),
dup AS (SELECT rk, i FROM (SELECT rk, i, count(*) OVER (PARTITION BY rk, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rk, count(DISTINCT p) AS n FROM (SELECT rk, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rk),
m AS (SELECT w.rk, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
  FROM w JOIN l USING (rk) LEFT JOIN rep USING (rk)),
sg AS (SELECT rk, doc_id, lang, 1 AS o, 'symbols' AS signal, coalesce(n_symbols / nullif(word_chars, 0), 0) AS v FROM m
  UNION ALL SELECT rk, doc_id, lang, 2, 'repeated_lines', coalesce(n_dup_lines / nullif(n_lines, 0), 0) FROM m
  UNION ALL SELECT rk, doc_id, lang, 3, 'repeated_words', coalesce(n_repeat_words / nullif(n_words, 0), 0) FROM m
  UNION ALL SELECT rk, doc_id, lang, 4, 'capitals', coalesce(n_capitals / nullif(word_chars, 0), 0) FROM m),
mk AS (SELECT doc_id, min(quality) AS good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) >= '8' AS holdout FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
gains AS (SELECT lang, signal, c, sum(CASE WHEN good = 0 THEN 1 ELSE -10 END) AS gain FROM sg JOIN mk USING (doc_id) JOIN (SELECT unnest(GRIDLIST) AS c) ON v * 100 > c WHERE NOT holdout GROUP BY ALL),
best AS (SELECT lang, signal, max(gain) AS gain, arg_max(c, gain * 1000 + c) AS cutoff FROM gains WHERE gain > 0 GROUP BY ALL),
prop AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, signal) AS nth FROM best),
hit AS (SELECT sg.*, nth, v * 100 > cutoff AS fires FROM sg JOIN prop ON prop.lang IS NOT DISTINCT FROM sg.lang AND prop.signal = sg.signal),
held AS (SELECT rk, lang, min(nth) FILTER (fires) AS first FROM hit JOIN mk USING (doc_id) WHERE holdout AND good = 1 GROUP BY ALL),
sets AS (SELECT lang, r, count(*) AS n, count(*) FILTER (first <= r) AS k FROM held JOIN (SELECT unnest([1, 2, 3, 4]) AS r) ON true GROUP BY ALL),
terms AS (SELECT *, unnest(range(0, k + 1)) AS j FROM sets WHERE k < n * 0.05),
tails AS (SELECT lang, r, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(0.95))) AS tail FROM terms GROUP BY ALL),
cert AS (SELECT lang, max(r) AS r FROM tails WHERE tail <= 0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM m JOIN mk USING (doc_id))) GROUP BY lang),
rej AS (SELECT rk, string_agg(signal, ',' ORDER BY o) AS rejected_by FROM hit JOIN cert ON cert.lang IS NOT DISTINCT FROM hit.lang WHERE fires AND nth <= r GROUP BY rk),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m LEFT JOIN rej USING (rk))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by FROM f
""".replace("GRIDLIST", str(list(GRID)))


@common.query("op1_quality_rules", SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
