"""Reading leaflets and pages: lines, labelled sections, companies, packs, links.

A document stays in its row: its lines are an array, and a section is found with higher-order
functions. There is no shuffle and no Python; documents of any number are one narrow projection.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DOCUMENT_COUNTRIES, one_of, literal_map
from .base import any_of, as_col, case, character, clean_block, collapse_ws, cp1252, extract, filled, is_ascii, let, single_blanks, text
from .text import absolute_url, address_like, company_like, extract_pack_size

# --- Fixed values: labels and patterns ----------------------------------------------------------

METADATA_LABEL = (
    r"\b(?:marketing authorisation holder|manufacturer|batch release|contents of the pack|pack sizes?|package sizes?)\b"
)
SECTION_STOP = (
    r"^(?:marketing authorisation holder|marketing authorization holder|ma holder|"
    r"holder of the marketing authorisation|for any information|this leaflet was last revised|"
    r"date of revision|package leaflet|contents of the pack|what .* contains|\d+\.|annex|b\.|c\.)\b"
)
HOLDER_LABELS = [
    "Marketing Authorisation Holder", "Marketing authorization holder", "MA Holder",
    "Holder of the marketing authorisation",
]
HOLDER_CONTAINED = ["Marketing Authorisation Holder", "Marketing authorization holder", "MA Holder"]
HOLDER_TERMS = ["marketing authorisation holder", "marketing authorization holder", "ma holder"]
MAKER_LABELS = [
    "Manufacturer", "Manufacturers", "Manufacturer responsible for batch release",
    "Manufacturers responsible for batch release", "Manufacturer of the medicinal product",
    "Manufacturers of the medicinal product",
]
MAKER_CONTAINED = [
    "Manufacturer", "Manufacturer responsible for batch release", "Manufacturers responsible for batch release",
    "Manufacturer of the medicinal product",
]
MAKER_BLOCK = (
    r"(?:^|\n)\s*(?:Manufacturer|Manufacturers|Manufacturer responsible for batch release|"
    r"Manufacturers responsible for batch release|Manufacturer of the medicinal product|"
    r"Manufacturers of the medicinal product)\s*:?\s*\n?"
    r"(.*?)(?=\n\s*(?:Marketing Authorisation Holder|Marketing Authorization Holder|"
    r"MA Holder|For any information|This leaflet was last revised|Date of revision|"
    r"Package leaflet|Contents of the pack|What .* contains|\d+\.|ANNEX|B\.|C\.)\b|$)"
)
MAKER_COLON = (
    r"(?:^|\n)\s*Manufacturer(?:s responsible for batch release| responsible for batch release)?"
    r"\s*:\s*(.*?)(?:This leaflet was last revised|Marketing Authorisation Holder|Package leaflet|$)"
)
REPORT_MAKER = [
    r"(?:^|\n)\s*Manufacturer(?:s)?(?: responsible for batch release| of the medicinal product)?\s*:?\s*(.*?)"
    r"(?:\n\s*(?:Marketing Authorisation Holder|For any information|This leaflet was last revised|"
    r"Detailed information|Package leaflet|ANNEX|B\.\s|C\.\s)|$)",
    r"(?:^|\n)\s*Manufacturer\s*\n\s*(.*?)"
    r"(?:\n\s*(?:Marketing Authorisation Holder|For any information|This leaflet was last revised|"
    r"Detailed information|Package leaflet|ANNEX|B\.\s|C\.\s)|$)",
]
PACK_MARKERS = [
    "Pack size", "Pack sizes", "Package size", "Package sizes", "Contents of the pack", "What the pack contains",
]
PACK_SENTENCE = (
    r"(?:available|supplied|presented|marketed)?\s*(?:in\s+)?"
    r"(?:packs?|boxes?|cartons?|blisters?|bottles?)\s+(?:of|containing)\s+"
    r"[\d,\s]+(?:and|or|to|-)?[\d,\s]*"
    r"(?:tablets?|capsules?|sachets?|vials?|ampoules?|patch(?:es)?|doses?)"
)
PACK_AVAILABLE = (
    r"Available in\s+(.*?)(?:Not all pack sizes may be marketed|Marketing Authorisation Holder|"
    r"Manufacturer:|This leaflet was last revised)"
)
INDICATIONS = [
    r"(?:4\.1\s*)?Therapeutic indications?\s*(.*?)(?:\n\s*(?:4\.2|Posology|Dose|Method of administration|Contraindications)\b)",
    r"What .{0,80}? is used for\s*(.*?)(?:\n\s*(?:2\.|Before you|What you need to know|How to take|Warnings)\b)",
    r"\b(?:is|are) used (?:for|to treat)\s+(.*?)(?:\.|\n)",
    r"\b(?:indicated|indicated for)\s+(.*?)(?:\.|\n)",
]
HIGHLIGHT_COMPANY = r"\b(?:ltd|limited|plc|gmbh|s\.?a\.?|b\.?v\.?|inc|llc|company|pharma|pharmaceuticals?)\b"
HIGHLIGHT_ANY = r"\b(?:ltd|limited|plc|gmbh|s\.?a\.?|b\.?v\.?|inc|llc|pharma|pharmaceuticals?)\b"
HIGHLIGHT_HEADINGS = [
    "public assessment report", "national procedure", "lay summary", "summary of product characteristics",
    "patient information leaflet", "package leaflet", "par ", "pl ",
]
#: character names from the standard library; a no-break space is read as a blank, as white space is collapsed anyway
CHARACTER_NAMES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "}

# ----------------------------------------------------------------------------------------------


def lines(c: Column | str, strip: str = " :;-") -> Column:
    """Cleaned non-empty lines."""
    cleaned = F.transform(F.split(text(c), r"\R"), lambda x: F.trim(single_blanks(x), F.lit(strip)))
    return F.filter(cleaned, lambda x: x != "")


def stripped_lines(c: Column, strip: str) -> Column:
    """A text without the characters of ``strip`` (a dash last) around its line ends and without empty lines: by one pattern, not line by line."""
    one = f"[{strip}]"  # a run of them is entered at its start only: long runs inside a line are not searched again and again
    ends = rf"(?:\R|{one}(?<!{one}{one}){one}*+\R)(?:{one}*+\R)*+{one}*+"
    return F.regexp_replace(F.trim(c, F.lit(strip + "\r\n\x0b\x0c\x85\u2028\u2029")), ends, "\n")


def joined_lines(c: Column | str, strip: str = " :;-") -> Column:
    """The lines of D1 with a line feed between them."""
    def over(value: Column) -> Column:
        tidy = is_ascii(value) & ~any_of([F.contains(value, F.lit(s)) for s in ("  ", "\t", "\x0b", "\x0c")])
        return F.when(tidy, stripped_lines(value, strip)).otherwise(F.array_join(lines(value, strip), "\n"))

    return let(text(c), over)


def _plain_label(line: Column) -> Column:
    return F.rtrim(F.lower(line), F.lit(":"))


def _label_pattern(labels: list[str]) -> str:
    alternatives = "|".join(re.escape(label.lower().rstrip(":")) for label in labels)
    return f"(?iu)^(?:{alternatives})(?=:|$)"


def _left(c: Column, n: int | None) -> Column:
    return filled(F.trim(F.substring(c, 1, n) if n else c))


def _first(values: Column) -> Column:
    """First value that is not NULL."""
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _after(rows: Column, i: Column, n: int | None) -> Column:
    """The elements behind place ``i``, the first ``n`` of them if a number is given."""
    return F.slice(rows, i + 2, F.lit(n) if n else F.size(rows))


def _until(rows: Column, stop) -> Column:
    """Elements before the first one that ``stop`` holds for."""
    first = F.array_position(F.transform(rows, stop), True)
    return let(first, lambda n: F.when(n > 0, F.slice(rows, F.lit(1), (n - 1).cast("int"))).otherwise(rows))


def section_after_label(
    c: Column | str, labels: list[str], max_lines: int | None = None, max_chars: int | None = None,
    excluded: list[str] | None = None, continuation: list[str] | None = None, metadata_stop: bool = True,
) -> Column:
    """Text after a label line, up to the next heading or metadata label, lines joined with ``"; "``."""
    pattern = _label_pattern(labels)
    bare = [label.lower().rstrip(":") for label in labels]

    def contains_any(line: Column, terms: list[str]) -> Column:
        return any_of([F.contains(F.lower(line), F.lit(t.lower())) for t in terms]) if terms else F.lit(False)

    def stops(line: Column) -> Column:
        heading = F.rlike(line, F.lit(f"(?iU){SECTION_STOP}"))
        if not metadata_stop:
            return heading
        label = F.rlike(line, F.lit(f"(?iU){METADATA_LABEL}"))
        return heading | (label & ~contains_any(line, continuation or []))

    def over(rows: Column) -> Column:
        def value(i: Column) -> Column:
            line = F.get(rows, i)
            rest = F.substring(line, F.length(F.regexp_extract(line, pattern, 0)) + 1, F.length(line))
            remainder = filled(F.ltrim(text(clean_block(rest)), F.lit(": ")))
            following = _until(_after(rows, i, max_lines), stops)
            kept = F.filter(following, lambda x: ~one_of(_plain_label(x), bare))
            return _left(text(clean_block(F.array_join(F.concat(F.array_compact(F.array(remainder)), kept), "; "))), max_chars)

        positions = F.filter(
            F.transform(rows, lambda x, i: F.when(F.rlike(x, F.lit(pattern)) & ~contains_any(x, excluded or []), i)),
            lambda i: i.isNotNull(),
        )
        return _first(F.transform(positions, value))

    return let(lines(c), over)


def value_after_label(c: Column | str, labels: list[str], max_lines: int | None = None, max_chars: int | None = None) -> Column:
    """D3: the first company-like value at or after a line that contains a label, else all of it."""
    wanted = list(dict.fromkeys(label.lower() for label in labels))

    def over(rows: Column) -> Column:
        def label_of(line: Column) -> Column:
            return let(_plain_label(line), lambda low: case([(F.contains(low, F.lit(label)), F.lit(label)) for label in wanted]))

        def value(i: Column) -> Column:
            line = F.get(rows, i)
            without = let(
                label_of(line), lambda label: case([(label == w, F.regexp_replace(line, f"(?iu){re.escape(w)}", "")) for w in wanted])
            )
            remainder = filled(F.ltrim(text(clean_block(without)), F.lit(": ")))
            following = _until(
                _after(rows, i, max_lines), lambda x: F.rlike(x, F.lit(f"(?iU){METADATA_LABEL}"))
            )
            candidates = F.concat(F.array_compact(F.array(remainder)), following)
            chosen = let(candidates, lambda all_: F.coalesce(F.get(F.filter(all_, company_like), F.lit(0)), F.array_join(all_, " ")))
            return _left(chosen, max_chars)

        positions = F.filter(F.transform(rows, lambda x, i: F.when(label_of(x).isNotNull(), i)), lambda i: i.isNotNull())
        return _first(F.transform(positions, value))

    return let(lines(c), over)


def text_after_label(c: Column | str, labels: list[str], max_chars: int | None = None) -> Column:
    """Rest of a label line, else the next line unless that is a label too."""
    return let(joined_lines(c, " :-"), lambda joined: text_after_label_line(joined, labels, max_chars))


def text_after_label_line(joined: Column, labels: list[str], max_chars: int | None = None) -> Column:
    """D4 on the ``joined_lines`` (with " :-" stripped) of a text, which several labels look at.

    The first label line and the one behind it are found by one pattern; only where they give no value are all lines looked through.
    """
    pattern = _label_pattern(labels)
    bare = [label.lower() for label in labels]
    near = pattern.replace("^", r"\n").replace("(?=:|$)", r"(?=:|\n|$)([^\n]*)(?:\n([^\n]*))?")

    def told(rest: Column, following: Column) -> Column:
        own = filled(F.trim(rest, F.lit(" :-")))
        return _left(F.coalesce(own, F.when(~one_of(_plain_label(following), bare), following)), max_chars)

    def value(rows: Column, i: Column) -> Column:
        line = F.get(rows, i)
        return told(F.substring(line, F.length(F.regexp_extract(line, pattern, 0)) + 1, F.length(line)), F.get(rows, i + 1))

    def any_line(rows: Column) -> Column:
        positions = F.filter(F.transform(rows, lambda x, i: F.when(F.rlike(x, F.lit(pattern)), i)), lambda i: i.isNotNull())
        return _first(F.transform(positions, lambda i: value(rows, i)))

    def over(found: Column) -> Column:
        first = told(F.regexp_extract(found, near, 1), filled(F.regexp_extract(found, near, 2)))
        return F.when(found != "", F.coalesce(first, let(F.split(joined, "\n"), any_line)))

    return let(F.regexp_extract(F.concat(F.lit("\n"), joined), near, 0), over)


def company_names(block: Column, allow_address_name: bool = False) -> Column:
    """Company names among the ``;`` parts of a block: the text before the comma, no address lines."""
    parts = F.filter(F.transform(F.split(text(block), ";"), lambda p: F.trim(p)), lambda p: p != "")

    def name(part: Column) -> Column:
        def before_comma(value: Column) -> Column:
            first = F.when(F.contains(value, F.lit(",")), clean_block(F.substring_index(value, ",", 1)))
            return F.coalesce(first, value)

        return let(text(clean_block(part)), before_comma)

    def wanted(x: Column) -> Column:
        known = company_like(x["name"])
        fits = (F.contains(x["part"], F.lit(",")) | known) if allow_address_name else known
        return (x["name"] != "") & fits & ~address_like(x["name"])

    # each part with its name, which is looked at several times
    named = F.transform(parts, lambda p: F.struct(p.alias("part"), name(p).alias("name")))
    return F.array_distinct(F.transform(F.filter(named, wanted), lambda x: x["name"]))


def _company_after(c: Column | str, phrase: str, n: int | None = None) -> Column:
    """First company-like line behind a line that contains ``phrase``, up to the next metadata label; among ``n`` lines if given."""
    def over(rows: Column) -> Column:
        near = F.transform(
            F.filter(F.transform(rows, lambda x, i: F.when(F.contains(F.lower(x), F.lit(phrase)), i)), lambda i: i.isNotNull()),
            lambda i: F.get(F.filter(_until(_after(rows, i, n), lambda x: F.rlike(x, F.lit(f"(?iU){METADATA_LABEL}"))), company_like), F.lit(0)),
        )
        return _first(near)

    return let(lines(c), over)


def ma_holder(c: Column | str) -> Column:
    """Marketing authorisation holder."""
    section = section_after_label(
        c, HOLDER_LABELS, excluded=["manufacturer"], continuation=HOLDER_TERMS
    )
    named = let(section, lambda s: F.when(s.isNotNull(), F.coalesce(F.get(company_names(s, True), F.lit(0)), s)))
    loose = value_after_label(c, HOLDER_CONTAINED)
    loose = let(loose, lambda v: F.when(F.lower(v) != "and manufacturer", v))
    return F.coalesce(named, loose, _company_after(c, "marketing authorisation holder"))


def manufacturer_blocks(c: Column | str) -> Column:
    """Candidate blocks, the labelled section first; ``array`` of distinct texts."""
    section = section_after_label(c, MAKER_LABELS, excluded=HOLDER_TERMS, continuation=["manufacturer"])
    found = F.transform(
        F.regexp_extract_all(text(c), F.lit(f"(?isU){MAKER_BLOCK}"), F.lit(1)), lambda b: text(clean_block(b))
    )
    full = F.filter(found, lambda b: b != "")
    return F.array_distinct(F.concat(F.array_compact(F.array(section)), full))


def manufacturers(c: Column | str) -> Column:
    """Manufacturers as ``"; "``-joined names, by block, by ``Manufacturer:``, by label, by neighbourhood."""
    def from_blocks(blocks: Column) -> Column:
        named = F.filter(F.transform(blocks, lambda b: F.array_join(company_names(b), "; ")), lambda n: n != "")
        return F.coalesce(F.get(named, F.lit(0)), F.get(blocks, F.lit(0)))

    colon = let(
        clean_block(extract(c, f"(?isU){MAKER_COLON}", 1)),
        lambda v: F.coalesce(filled(F.array_join(company_names(v), "; ")), v),
    )
    return F.coalesce(
        let(manufacturer_blocks(c), from_blocks), colon, value_after_label(c, MAKER_CONTAINED), _company_after(c, "manufacturer")
    )


def report_manufacturer(c: Column | str) -> Column:
    """D6, the variant for all sources: struct of names and countries, NULL when none is found."""
    def described(value: Column) -> Column:
        named = F.coalesce(filled(F.array_join(company_names(value), "; ")), value)
        return F.when(
            value.isNotNull(),
            F.struct(named.alias("name"), extract_countries(value).alias("country")),
        )

    def matched(pattern: str) -> Column:
        block = clean_block(extract(c, f"(?isU){pattern}", 1))
        rest = F.regexp_replace(block, r"(?iU)^(?:responsible for batch release|of the medicinal product)\s*:?\s*", "")
        return let(rest, lambda v: described(F.when(F.length(v) >= 4, v)))

    section = section_after_label(c, MAKER_LABELS, excluded=HOLDER_TERMS[:2], metadata_stop=False)
    return F.coalesce(let(section, lambda v: described(v)), *[matched(p) for p in REPORT_MAKER])


def extract_countries(c: Column | str) -> Column:
    """Countries named in a text, longest name first, joined with ``"; "``."""
    return filled(F.array_join(_countries(c), "; "))


def _countries(c: Column | str) -> Column:
    by_length = sorted(DOCUMENT_COUNTRIES, key=len, reverse=True)

    def found(value: Column, near) -> Column:
        named = [
            F.when(near(name) & F.rlike(value, F.lit(rf"(?iU)\b{name}\b")), F.lit(name.removeprefix("The "))) for name in by_length
        ]
        return F.array_distinct(F.array_compact(F.array(*named)))

    def over(value: Column) -> Column:
        # in ASCII texts a pattern runs only where the letters of its name are found
        plain = let(F.lower(value), lambda low: found(value, lambda name: F.contains(low, F.lit(name.lower()))))
        return F.when(is_ascii(value), plain).otherwise(found(value, lambda name: F.lit(True)))

    return let(text(c), over)


def pack_info(c: Column | str) -> Column:
    """Pack sizes after one of six markers: a sentence about packs, else a plain pack size."""
    def over(value: Column) -> Column:
        low = F.lower(value)

        def after(marker: str) -> Column:
            at = F.locate(marker.lower(), low)
            section = F.when(at > 0, clean_block(F.substring(value, at, F.length(value))))
            return let(section, lambda s: F.coalesce(
                clean_block(extract(s, f"(?iU){PACK_SENTENCE}")), extract_pack_size(s)
            ))

        return F.coalesce(*[after(m) for m in PACK_MARKERS])

    return let(text(c), over)


def report_pack(c: Column | str) -> Column:
    """D8, the variant for all sources: "Available in …", what follows a marker, the whole document."""
    def over(value: Column) -> Column:
        available = collapse_ws(extract(value, f"(?isU){PACK_AVAILABLE}", 1))
        low = F.lower(value)

        def after(marker: str) -> Column:
            at = F.locate(marker, low)
            return F.when(at > 0, extract_pack_size(F.substring(value, at, F.length(value))))

        markers = [after(m) for m in ("pack size", "pack sizes", "package size", "package sizes")]
        return F.coalesce(available, *markers, extract_pack_size(value))

    return let(text(c), over)


def indication(c: Column | str) -> Column:
    """Therapeutic indication of at least 12 characters."""
    def cleaned(c: Column) -> Column:
        plain = F.regexp_replace(collapse_ws(c), r"(?iU)^(therapeutic indications?|what .*? is used for)\s*[:.-]?\s*", "")

        return let(F.trim(plain, F.lit(" :-")), lambda v: F.when(F.length(v) >= 12, v))

    return F.coalesce(*[cleaned(extract(c, f"(?isU){p}", 1)) for p in INDICATIONS])


def holder_from_highlights(c: Column | str, registration: Column | str) -> Column:
    """Company line within four lines after the registration number, else the first company-like line."""
    number = F.upper(F.regexp_replace(text(registration), r"(?U)\s+", ""))

    def over(rows: Column) -> Column:
        def near(i: Column) -> Column:
            ok = F.filter(
                F.slice(rows, i + 2, F.lit(4)),
                lambda x: ~any_of([F.startswith(F.lower(x), F.lit(h)) for h in HIGHLIGHT_HEADINGS])
                & F.rlike(x, F.lit(f"(?iU){HIGHLIGHT_COMPANY}")),
            )
            return F.get(ok, F.lit(0))

        has_number = F.transform(
            rows, lambda x, i: F.when((number != "") & F.contains(F.upper(F.regexp_replace(x, r"(?U)\s+", "")), number), i)
        )
        hits = F.transform(F.filter(has_number, lambda i: i.isNotNull()), near)
        first = F.get(F.filter(hits, lambda v: v.isNotNull()), F.lit(0))
        other = F.get(F.filter(rows, lambda x: F.rlike(x, F.lit(f"(?iU){HIGHLIGHT_ANY}"))), F.lit(0))
        return F.trim(F.coalesce(first, other), F.lit(" ."))

    without_tags = F.regexp_replace(text(c), "<[^>]+>", "")
    return let(F.filter(F.transform(F.split(without_tags, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), over)


# --- HTML ---------------------------------------------------------------------------------------


def unescape(c: Column) -> Column:
    """Character references (decimal, hexadecimal, by name) as characters; what is no reference stays."""
    names = literal_map(CHARACTER_NAMES)

    def one(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        return let(ref, lambda r: F.when(r == "", piece).otherwise(replaced(piece, r)))

    def replaced(piece: Column, ref: Column) -> Column:
        digits = F.when(F.rlike(ref, F.lit("^#[xX]")), F.conv(F.substring(ref, 3, 6), 16, 10)).when(F.startswith(ref, F.lit("#")), F.substring(ref, 2, 7))
        char = F.coalesce(cp1252(character(digits.cast("int"))), F.try_element_at(names, ref))
        rest = F.substring(piece, F.length(ref) + 3, F.length(piece))
        return let(char, lambda ch: F.when(ch.isNotNull(), F.concat(ch, rest)).otherwise(piece))

    return let(c, lambda v: F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(F.split(v, "(?=&)"), one), "")).otherwise(v))


def inner_text(c: Column) -> Column:
    """Text of an HTML fragment: tags become blanks, white space collapsed."""
    return text(collapse_ws(unescape(F.regexp_replace(c, "(?s)<[^>]+>", " "))))


def attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 1)
    single = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*'([^']*)'""", 1)
    bare = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*([^\s>"']+)""", 1)
    return unescape(F.coalesce(filled(quoted), filled(single), bare))


def anchors(c: Column | str) -> Column:
    """Links of a page in order: array of (href, label)."""
    found = F.regexp_extract_all(as_col(c), F.lit(r"(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>"), F.lit(0))

    def one(a: Column) -> Column:
        tag = F.regexp_extract(a, r"(?s)^<[^>]*>", 0)
        return F.struct(let(tag, lambda t: attribute(t, "href")).alias("href"), inner_text(a).alias("label"))

    return F.transform(found, one)


def _any_in(c: Column, needles: list[str]) -> Column:
    return any_of([F.contains(c, F.lit(n)) for n in needles])


def doc_links(c: Column | str, base: str, rules: str = "uk") -> Column:
    """First summary, leaflet and assessment link of a page: struct (smpc_url, pil_url, assessment_report_url).

    A link fills the first role it fits that is still open, in page order; the rules differ by register.
    """
    def fits(label: Column, href: Column) -> list[Column]:
        both = F.concat_ws(" ", F.lower(label), F.lower(href))
        no = F.lit(False)
        return {
            "uk": [
                _any_in(both, ["spc", "summary of product characteristics"]),
                _any_in(both, ["pil", "patient information leaflet", "package leaflet"]),
                _any_in(both, ["par", "public assessment report"]),
            ],
            "eu": [
                F.contains(F.lower(href), F.lit("_en.pdf")) & F.contains(F.lower(href), F.lit("/product-information/")),
                no,
                F.contains(F.lower(href), F.lit("_en.pdf")) & F.contains(F.lower(href), F.lit("/assessment-report/")),
            ],
            "au": [
                F.contains(both, F.lit("product information")) | F.rlike(both, F.lit(r"(?U)\bpi\b")),
                F.contains(both, F.lit("consumer medicine information")) | F.rlike(both, F.lit(r"(?U)\bcmi\b")),
                no,
            ],
            "nz": [
                _any_in(both, ["data sheet", "/datasheet/"]),
                _any_in(both, ["consumer medicine information", "cmi", "/consumers/cmi/"]),
                no,
            ],
        }[rules]

    empty = F.lit(None).cast("string")
    start = F.struct(empty.alias("smpc_url"), empty.alias("pil_url"), empty.alias("assessment_report_url"))
    links = F.transform(anchors(c), lambda a: F.struct(absolute_url(base, a["href"]).alias("href"), a["label"].alias("label")))

    def step(acc: Column, a: Column) -> Column:
        is_smpc, is_pil, is_report = fits(a["label"], a["href"])
        take_smpc = acc["smpc_url"].isNull() & is_smpc
        take_pil = ~take_smpc & acc["pil_url"].isNull() & is_pil
        take_report = ~take_smpc & ~take_pil & acc["assessment_report_url"].isNull() & is_report
        return F.struct(
            F.when(take_smpc, a["href"]).otherwise(acc["smpc_url"]).alias("smpc_url"),
            F.when(take_pil, a["href"]).otherwise(acc["pil_url"]).alias("pil_url"),
            F.when(take_report, a["href"]).otherwise(acc["assessment_report_url"]).alias("assessment_report_url"),
        )

    roles = F.aggregate(links, start, step)
    if rules != "eu":
        return roles
    # the central product information is both the summary and the leaflet
    return let(roles, lambda r: F.struct(
        r["smpc_url"].alias("smpc_url"), r["smpc_url"].alias("pil_url"), r["assessment_report_url"].alias("assessment_report_url")
    ))


def tables(c: Column | str) -> Column:
    """Tables of a page: array of (has_form, header texts, rows of (label, href) cells).

    The header is every ``th`` of the table, or the first row's cells; the first row is never data. A table inside another
    one is a table of its own, before those around it, and not part of their cells.
    """
    # a table without a table inside; with these gone, the tables around them are such ones, up to three levels
    plain = r"(?is)<table\b(?:[^<]++|<(?!table\b|/table))*+</table\s*>"

    def whole(page: Column, levels: int) -> Column:
        found = F.regexp_extract_all(page, F.lit(plain), F.lit(0))
        if levels == 1:
            return found

        def with_outer(inner: Column) -> Column:
            # as many tables as there are tags that open one: none stands around another
            opened = (F.length(page) - F.length(F.replace(F.lower(page), F.lit("<table"), F.lit("")))) / len("<table")
            outer = let(F.regexp_replace(page, plain, " "), lambda rest: whole(rest, levels - 1))
            return F.when(opened == F.size(inner), inner).otherwise(F.concat(inner, outer))

        return let(found, with_outer)

    def upto(tag: str, ends: str) -> str:
        """From a tag to the next of the ends, which all start with ``<``, or to the end of the text."""
        return rf"(?is)<{tag}\b[^<]*+(?:<(?!{ends})[^<]*+)*+"

    def cells(row: Column, tag: str) -> Column:
        return F.regexp_extract_all(row, F.lit(upto(tag, r"t[dh]\b|/t[dhr]\s*>|/t(?:head|body|able)\s*>")), F.lit(0))

    def cell(x: Column) -> Column:
        link = F.regexp_extract(x, r"(?is)<a\b[^>]*\bhref\s*=[^>]*>", 0)
        href = let(link, lambda a: F.when(a != "", filled(attribute(a, "href"))))
        return F.struct(inner_text(x).alias("label"), href.alias("href"))

    def one(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(upto("tr", r"tr\b|/tr\s*>|/table\s*>")), F.lit(0))
        return let(found, lambda rows: let(cells(t, "th"), lambda heads: read(t, rows, heads)))

    def read(t: Column, rows: Column, heads: Column) -> Column:
        first = F.when(F.size(heads) > 0, heads).otherwise(cells(F.get(rows, F.lit(0)), "td"))
        data = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda r: F.transform(cells(r, "td"), cell))
        return F.struct(
            F.rlike(t, F.lit(r"(?i)<(?:form|input|textarea)\b")).alias("has_form"),
            F.transform(first, inner_text).alias("header"),
            F.filter(data, lambda r: F.size(r) > 0).alias("rows"),
        )

    return F.transform(let(as_col(c), lambda page: whole(page, 3)), one)


def after_phrase_line(c: Column, phrase: str) -> Column:
    """Line after the one where a phrase starts."""
    at = F.locate(phrase, c)
    near = F.split(F.substring(c, at, F.length(c)), "\n", 3)
    return F.when(at > 0, F.nullif(F.trim(F.get(near, F.lit(1))), F.lit("")))


