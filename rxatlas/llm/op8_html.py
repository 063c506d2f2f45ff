"""Main text of web pages through wrappers: union-free regular expressions inferred for each host.

1. Each page is a stream of block tags and text slots. Inline tags and comments are dropped, scripts and styles skipped,
   missing end tags supplied. Repeated neighbours fold into one repeated group right away, so pages that
   differ only in the number of paragraphs or menu entries have one skeleton.
2. Distinct skeletons of a host are counted, and aligned one after the other, the most frequent first: what matches is
   merged level by level, what stands on one side only becomes optional, what occurs more often on one side becomes
   repeated, and text becomes a slot. The result is the host's wrapper. Hosts with many skeletons are merged in
   ``PARTS`` parts first, then the parts with each other. Elements below ``DEEP`` levels have no groups of their own.
3. Each page is aligned with its host's wrapper, which gives every text its slot. A slot is main text by where it stands:
   inside an article or main element if the page has one, and never inside a menu, header, footer, sidebar, notice,
   advert, form or reader comment, told by tag or by the words of its class, id or role (but not by what follows has-, no- or with-,
   and no mark hides an article element that holds most of the page's text). On a page without article or main element, a text that stands in
   the same slot on at least half of the host's distinct pages, and on ``TEMPLATE_PAGES`` of them at least (fewer do not tell a template from
   two similar articles), is a constant of the wrapper and goes, however long it is; unless nothing would be left of the page. Text inside an
   article or main element is never judged by how often it stands somewhere. Copies of a page count once.

Text is decoded, white space inside a block becomes one space, and blocks are joined by line breaks in page order.

Defined results: pages may be nested as deep and be as wide as they like (trees are walked with stacks, and long lists of unlike siblings are
aligned by label); a null or empty page has empty text; a page without article or main element gives all text outside the
excluded parts, but list entries that are one link; a null or odd url has the empty host; repeated rows are extracted one by one.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textops import pieces

PARTS = 16
TEMPLATE_PAGES = 3  # distinct pages that show that a text is the template's
TEMPLATE_SHARE = 0.5
DEEP = 60  # levels of a wrapper; texts further down have slots named by their tags alone
WIDE = 200  # unlike siblings from which a list is aligned by label instead of by order

#: fixed values: HTML element names by role
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
EXCLUDED = frozenset("head nav header footer aside form button select textarea dialog menu fieldset".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: an element closes an open one of these, up to the container named last
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",))}
#: words of class, id or role that mark what is not the article
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist disqus reply replies respond footer header masthead search pagination pager toolbar copyright legal hidden complementary contentinfo".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<>]*\Z", re.S | re.I)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: a word after one of these in the same class says what the element has or lacks, not what it is
QUALIFIERS = frozenset(("has", "no", "with", "without"))


def _mark(attributes: str) -> str:
    """The first excluding word of an element's class, id or role."""
    if "=" not in attributes:
        return ""
    for groups in _MARKED.findall(attributes):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(groups)).lower()
        for compound in value.split():
            for word in _WORD.findall(compound):
                if word in QUALIFIERS:
                    break
                if word in MARKS:
                    return word
    return ""


class Page:
    """Blocks of a page: ``root`` is the tree [label, children]; a text is a leaf, the number of its block; ``texts`` the blocks."""

    def __init__(self, source: str):
        self.root: list = ["", []]
        self.texts: list[str] = []
        self.linked: list[bool] = []
        stack = [self.root]
        pending: list[str] = []
        outside = links = 0

        def flush() -> None:
            nonlocal outside
            if pending:
                text = " ".join(html.unescape("".join(pending)).split())
                if text:
                    stack[-1][1].append(len(self.texts))
                    self.texts.append(text)
                    self.linked.append(outside == 0)
                pending.clear()
            outside = 0

        def name(node: list) -> str:
            return node[0].partition("!")[0]

        def close_to(depth: int) -> None:
            flush()
            del stack[depth:]

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                pending.append(piece)
                outside += links == 0 and not piece.isspace()
            at = m.end()
            tag = m.group(3)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(2):
                if tag == "a":
                    links = max(links - 1, 0)
                for depth in range(len(stack) - 1, 0, -1):
                    if name(stack[depth]) == tag:
                        close_to(depth)
                        break
                    if tag in INLINE and name(stack[depth]) not in INLINE:
                        break
                continue
            if tag in VOID:
                pending.append(" ")
                if tag == "hr":
                    flush()
                continue
            mark = _mark(m.group(4))
            if tag in INLINE and not mark:
                links += tag == "a"
                continue
            flush()
            if tag in CLOSES_PARAGRAPH:
                links = 0
                for depth in range(len(stack) - 1, 0, -1):
                    if name(stack[depth]) == "p":
                        del stack[depth:]
                        break
                    if name(stack[depth]) not in INLINE:
                        break
            if tag in IMPLIED:
                same, within = IMPLIED[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if name(stack[depth]) in same:
                        del stack[depth:]
                        break
                    if name(stack[depth]) in within:
                        break
            node = [f"{tag}!{mark}" if mark else tag, []]
            stack[-1][1].append(node)
            if not m.group(4).endswith("/") or tag not in INLINE:
                stack.append(node)
        if at < len(source):
            pending.append(source[at:])
            outside += links == 0
        flush()
        self._unmark_article()

    def _unmark_article(self) -> None:
        """Where every article or main element is marked or below a mark, the one that holds most of the page's text loses those marks."""
        found: list[tuple[int, list[list]]] = []
        clear = False

        # from the leaves up: an element is visited again when its children's lengths are known
        length: dict[int, int] = {}
        todo: list[tuple[list, list[list], bool]] = [(self.root, [], False)]
        while todo:
            node, marked, done = todo.pop()
            inner = [c for c in node[1] if not isinstance(c, int) and c[0].partition("!")[0] not in EXCLUDED]
            if not done:
                todo.append((node, marked, True))
                for child in inner:
                    tag, _, mark = child[0].partition("!")
                    todo.append((child, [*marked, child] if mark and tag not in ("html", "body") else marked, False))
                continue
            length[id(node)] = sum(len(self.texts[c]) for c in node[1] if isinstance(c, int)) + sum(length.pop(id(c)) for c in inner)
            if node is not self.root and node[0].partition("!")[0] in MAIN:
                clear |= not marked
                found.append((length[id(node)], marked))
        whole = length[id(self.root)]
        if found and not clear:
            most, on_way = max(found, key=lambda x: x[0])
            if 2 * most > whole:
                for node in on_way:
                    node[0] = node[0].partition("!")[0]


# A wrapper is [label, optional, repeated, children]; a text slot is ["#", optional, repeated, []].


def skeleton(node: list, levels: int = DEEP) -> list:
    if not levels:
        return []
    return fold(["#", 0, 0, []] if isinstance(child, int) else [child[0], 0, 0, skeleton(child, levels - 1)] for child in node[1])


def fold(children) -> list:
    """Neighbours with one label become one repeated group."""
    out: list = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = [child[0], out[-1][1] & child[1], 1, align(out[-1][3], child[3])]
        else:
            out.append(child)
    return out if len(out) <= WIDE else by_label(out)


def by_label(children: list) -> list:
    """One repeated group for each label, in the order in which the labels first occur."""
    out: dict[str, list] = {}
    for child in children:
        had = out.get(child[0])
        out[child[0]] = child if had is None else [child[0], had[1] | child[1], 1, align(had[3], child[3])]
    return list(out.values())


def align(a: list, b: list) -> list:
    """One list of groups that matches whatever either list matches."""
    if not a or not b:
        return [[x[0], 1, x[2], x[3]] for x in a or b]
    if a == b:
        return a
    # longest common subsequence of the labels
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            x, y = a[i], b[j]
            out.append([x[0], x[1] | y[1], x[2] | y[2], align(x[3], y[3])])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 1, a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], 1, b[j][2], b[j][3]])
            j += 1
    return fold(out)


def merged(wrappers: Iterator[str]) -> str:
    out: list = []
    for nth, wrapper in enumerate(wrappers):
        groups = json.loads(wrapper)
        out = align(out, groups) if nth else groups
    return json.dumps(out, separators=(",", ":"))


def slots(page: Page, wrapper: list) -> list[tuple[int, str]]:
    """(block, slot) of each text: the slot is the way to it through the wrapper's groups."""
    found: list[tuple[int, str]] = []
    todo = [(iter(page.root[1]), wrapper, "", [0])]
    while todo:
        children, groups, path, at = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            continue
        label = "#" if isinstance(child, int) else child[0]
        place = next((i for i in range(at[0], len(groups)) if groups[i][0] == label), None)
        if place is None:  # a repeat of an earlier group
            place = next((i for i in range(at[0] - 1, -1, -1) if groups[i][0] == label), None)
        if place is not None:
            at[0] = max(at[0], place)
        step = f"{path}/{'' if place is None else place}{label}"
        if isinstance(child, int):
            found.append((child, step))
        else:
            todo.append((iter(child[1]), groups[place][3] if place is not None else [], step, [0]))
    return found


def is_main(slot: str, article: bool, linked: bool) -> bool:
    inside = False
    parts = [p.lstrip("0123456789") for p in slot.split("/")[1:-1]]
    for nth, part in enumerate(parts):
        tag, _, mark = part.partition("!")
        if mark and tag not in ("body", "html"):
            return False
        if tag in EXCLUDED and not (tag == "header" and inside and any(p in HEADINGS for p in parts[nth + 1 :])):
            return False
        inside |= tag in MAIN
    return inside if article else not (linked and parts and parts[-1] == "li")


def has_article(node: list) -> bool:
    """Whether the page has an article or main element that is not marked as something else."""
    todo = [node]
    while todo:
        for child in todo.pop()[1]:
            if isinstance(child, int):
                continue
            if child[0] in MAIN:
                return True
            if ("!" not in child[0] or child[0].startswith(("html", "body"))) and child[0] not in EXCLUDED:
                todo.append(child)
    return False


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 1 << 22):
            found = [json.dumps(skeleton(Page(h.as_py() or "").root), separators=(",", ":")) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], names=["host", "skeleton"])

    seen = pages.mapInArrow(run, "host string, skeleton string").groupBy("host", "skeleton").agg(F.count("*").alias("n"))

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["n", "skeleton"], ascending=[False, True])
        return pd.DataFrame({"host": [rows.host.iloc[0]], "skeleton": [merged(ordered.skeleton)], "n": [int(rows.n.sum())]})

    schema = "host string, skeleton string, n bigint"
    parts = seen.withColumn("part", F.pmod(F.xxhash64("skeleton"), F.lit(PARTS))).groupBy("host", "part").applyInPandas(part, schema)
    whole = parts.groupBy("host").applyInPandas(part, schema)
    return whole.select("host", F.col("skeleton").alias("wrapper"))


def _aligned(batch: pa.RecordBatch, cache: dict[str, list]):
    for source, wrapper in zip(batch.column("html"), batch.column("wrapper"), strict=True):
        page = Page(source.as_py() or "")
        form = wrapper.as_py() or "[]"
        if form not in cache:
            if len(cache) > 2000:
                cache.clear()
            cache[form] = json.loads(form)
        article = has_article(page.root)
        yield page, article, [(block, slot) for block, slot in slots(page, cache[form]) if is_main(slot, article, page.linked[block])]


def _named(slot: str, text: str) -> bytes:
    return hashlib.blake2b(f"{slot} {text}".encode(errors="replace"), digest_size=16).digest()


def template_texts(wrapped: DataFrame) -> DataFrame:
    """(host, constants): names of slot and text of what stands on most distinct pages of a host that have no article or main element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list] = {}
        for batch in pieces(batches, "html", 1 << 22):
            hosts, keys, contents = [], [], []
            for host, source, (page, article, kept) in zip(batch.column("host").to_pylist(), batch.column("html"), _aligned(batch, cache), strict=True):
                if article:
                    continue
                found = {_named(slot, page.texts[block]) for block, slot in kept}
                hosts += [host] * (len(found) + 1)
                keys += [None, *sorted(found)]
                contents += [hashlib.blake2b((source.as_py() or "").encode(errors="replace"), digest_size=16).digest()] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(contents, pa.binary())], names=["host", "text", "content"])

    found = wrapped.mapInArrow(run, "host string, text binary, content binary").groupBy("host", "text", "content").agg(F.lit(1).alias("one"))
    counted = found.groupBy("host", "text").agg(F.count("*").alias("n"))
    counted = common.staged(counted, "template-counts")
    pages = counted.filter("text IS NULL").select("host", F.col("n").alias("pages"))
    often = counted.filter("text IS NOT NULL").join(pages, "host").filter((F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= F.col("pages") * TEMPLATE_SHARE))
    # at most 1 / TEMPLATE_SHARE times as many as a page has texts
    return often.groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("constants"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: the key, the url, ``text``."""
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(source).cast("string").alias("html"))
    known = common.staged(wrappers(own.select("host", "html")), "wrappers")
    wrapped = own.join(known, "host", "left")
    constants = common.staged(template_texts(wrapped.select("host", "html", "wrapper")), "template-texts")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list] = {}
        for batch in pieces(batches, "html", 1 << 22):
            texts = []
            for fixed, (page, article, kept) in zip(batch.column("constants"), _aligned(batch, cache), strict=True):
                template = set() if article else set(fixed.as_py() or ())
                own = [page.texts[block] for block, slot in kept if not template or _named(slot, page.texts[block]) not in template]
                texts.append("\n".join(own or (page.texts[block] for block, _ in kept)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = wrapped.join(constants, "host", "left").select("id", "url", "html", "wrapper", "constants")
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string").withColumnRenamed("id", key)


@common.query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
