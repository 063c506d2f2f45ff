"""Personal data: identifiers of known form, and unseen ones found by bootstrapping from the words around them.

**Seeds.** E-mail addresses, IP addresses, card numbers (Luhn) and phone numbers of exact form are found in each text.

**Marks.** Besides them every other identifier-like stretch is marked: neighbouring words that hold a digit or an at sign. A mark
has an instance (its string) and, by its characters, the kinds it could be: an address written otherwise, a number
with a digit missing, a phone number without its country. Both seeds and marks have lexical patterns: the two words to the left, the word to
the left with the one to the right, and the word to the left; in lower case, digits as 9.

**Graph.** Patterns and instances are the two sides of a graph. ``rounds`` times, with groupings and joins,

* a pattern's confidence for a kind is the sum of its instances' scores of that kind over one more than all its distinct instances, known or
  not, of any kind; it holds if that reaches ``least_confidence`` and the scores sum up to ``least_support``;
* an instance's score is 1 for seeds, else 1 minus the product of (1 - confidence) over the patterns that hold and that it stands
  in, for kinds it could be; it counts from ``least_score`` on.

All occurrences of the instances found are spans too, with the kind of the highest score (ties: as listed). Seeds stay as they are, and
no mark touches one.

Sums are partial before they are shuffled, so a pattern or instance with very many occurrences is no large group; nothing
but the marks, never a text, is shuffled. Words of over 40 and instances of over 80 code points are named by their digest.

Defined results: a null text is empty; an empty table gives no rows; repeated rows give equal rows and count as one instance; a
text without identifiers has an empty list and the digest of the empty string. Texts are read whole; contexts reach 200 characters
to each side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import pieces

KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE = 3, 3.0, 0.5, 0.5
CONTEXT = 200
SPACES = re.compile("[\x20\t-\r]+")
DIGIT = re.compile("[0-9]")
ANY = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts where its digits start: the same as from any place, but without reading a run of digits again from each of them
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WHITE = frozenset(" \t\n\v\f\r")
EDGE = "!\"#$%&'*,./:;<=>?[]^_`{|}~-"

Span = tuple[int, int, int]  # start, number of the kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, at sign and domain; each at sign is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Seeds by start, then kind. What matches but fails its test is passed over, not tried again."""
    if not ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def could_be(instance: str) -> int:
    """A bit for each kind that the characters of an instance allow."""
    digits = len(DIGIT.findall(instance))
    numeric = not instance.strip("0123456789 ().-+")
    bits = int(bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", instance)))
    bits |= 2 * (bool(re.fullmatch(r"[0-9A-Fa-f.:]+", instance)) and (instance.count(".") >= 3 or instance.count(":") >= 2))
    bits |= 4 * (numeric and 12 <= digits <= 19 and not instance.strip("0123456789 -"))
    return bits | 8 * (numeric and 7 <= digits <= 15)


def marks(text: str, seeds: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of identifier-like stretches that touch no seed."""
    stretches: list[list[int]] = []
    pos = 0
    while found := ANY.search(text, pos):
        start = found.start()
        while start > pos and text[start - 1] not in WHITE:
            start -= 1
        space = SPACES.search(text, found.end())
        pos = space.start() if space else len(text)
        if stretches and stretches[-1][1] == start - 1 and text[start - 1] == " ":
            stretches[-1][1] = pos
        else:
            stretches.append([start, pos])
    out, i, reach = [], 0, 0
    for start, end in stretches:
        while i < len(seeds) and seeds[i][0] < end:
            reach = max(reach, seeds[i][2])
            i += 1
        if reach > start:
            continue
        whole = text[start:end]
        left = len(whole) - len(whole.lstrip(EDGE + ")"))
        kept = whole.strip(EDGE + ")") if "(" not in whole else whole[left:].rstrip(EDGE)
        if kept:
            out.append((start + left, start + left + len(kept)))
    return out


def _named(s: str, longest: int) -> str:
    return s if len(s) <= longest else "#" + hashlib.blake2b(s.encode(), digest_size=16).hexdigest()


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span."""
    before = SPACES.split(DIGIT.sub("9", text[max(0, start - CONTEXT) : start].lower()))
    after = SPACES.split(DIGIT.sub("9", text[end : end + CONTEXT].lower()))
    left = [_named(w, 40) for w in before if w][-2:]
    right = [_named(w, 40) for w in after if w][:1]
    out = []
    if left:
        out.append(f"{left[-1]} _")
        if len(left) > 1:
            out.append(f"{left[0]} {left[1]} _")
        if right:
            out.append(f"{left[-1]} _ {right[0]}")
    return out


COUNTS = ", ".join(f"n_{k} bigint" for k in KINDS)
SEEN = f"row bigint, mark boolean, kind int, start bigint, end bigint, instance string, could int, patterns array<string>, {COUNTS}, base array<struct<start:bigint,kind:int,end:bigint>>"


def _scanned(docs: DataFrame) -> DataFrame:
    """A row for each document with its seeds, and rows for seeds and marks with their instances and patterns (``mark``)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.row_keys()
        for batch in pieces(batches, "text"):
            owner, row, mark, kind, start, end, instance, could, pats, counts, base = ([] for _ in range(11))
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                seeds = base_spans(text)
                key = next(counter)
                numbers = [s[1] for s in seeds]
                rows = [(None, None, None, None, None, None, [numbers.count(k) for k in range(4)], [{"start": a, "kind": k, "end": b} for a, k, b in seeds])]
                spans = [*seeds, *((a, None, b) for a, b in marks(text, seeds))] if ANY.search(text) else seeds
                for a, k, b in spans:
                    said = text[a:b]
                    rows.append((k, a, b, _named(said, 80), 0 if k is not None else could_be(said), patterns(text, a, b), [None] * 4, None))
                for j, values in enumerate(rows):
                    owner.append(i)
                    row.append(key)
                    mark.append(j > 0)
                    for column, value in zip((kind, start, end, instance, could, pats, counts, base), values, strict=True):
                        column.append(value)
            schema = _SCHEMA
            columns = [row, mark, kind, start, end, instance, could, pats, *(list(c) for c in zip(*counts, strict=True)), base]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            ids = batch.column("id").take(pa.array(np.array(owner, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *schema.names])

    return docs.mapInArrow(run, f"id {id_type}, {SEEN}")


_SCHEMA = pa.schema([
    ("row", pa.int64()), ("mark", pa.bool_()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("could", pa.int32()),
    ("patterns", pa.list_(pa.string())), *((f"n_{k}", pa.int64()) for k in KINDS),
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
])


def bootstrapped(seen: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE, least_score: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """((instance, kind, score) of the instances found, (pattern, kind, confidence, support) of the patterns that hold)."""
    links = seen.filter("mark").select("instance", "kind", "could", F.explode("patterns").alias("pattern"))
    links = common.staged(links.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"), F.max("could").alias("could")), "pattern-links")
    sizes = links.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = links.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    open_links = links.filter("kind IS NULL AND could > 0").select("pattern", "instance", "could")
    found, held = None, None
    for _ in range(rounds):
        scores = seeds if found is None else seeds.unionByName(found)
        support = links.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        strong = support.filter(F.col("support") >= least_support).join(sizes, "pattern")
        # sums come in any order: rounded, they do not depend on it
        held = strong.withColumn("confidence", F.round(F.col("support") / (F.col("n") + 1), 9)).filter(F.col("confidence") >= least_confidence)
        held = common.staged(held.select("pattern", "kind", "confidence", "support"), "patterns")
        reached = open_links.join(held, "pattern").filter(F.expr("could & shiftleft(1, kind)") > 0)
        missed = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        scored = reached.groupBy("instance", "kind").agg(F.round(1 - missed, 9).alias("score")).filter(F.col("score") >= least_score)
        found = common.staged(scored.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("m"), "kind")).alias("b")).select("instance", "b.kind", (-F.col("b.m")).alias("score")), "instances")
    return found, held


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """One row per document: the key, seed counts ``n_<kind>``, ``base`` (seeds) and ``spans`` (all), arrays of (start, kind, end)."""
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    seen = common.staged(_scanned(own), "identifiers")
    found, _ = bootstrapped(seen, **limits)
    places = seen.filter("mark AND kind IS NULL AND could > 0").select("row", "instance", "start", "end")
    more = places.join(found.select("instance", "kind"), "instance").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    rows = seen.filter("NOT mark").join(more, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select(F.col("id").alias(key), *[f"n_{k}" for k in KINDS], "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@common.query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_discovered"))
