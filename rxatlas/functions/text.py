"""Parsers of product names, codes and categories (Column -> Column, no UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import literal_list, literal_map
from .base import any_of, as_col, by_letters, case, collapse_ws, extract, is_ascii, is_tidy, let, nz, text

# --- Fixed values: patterns in order of precedence --------------------------------------------

DOSAGE_FORMS = [
    ("Suspension", r"\bsuspension\b"),
    ("Suspension/drops", r"\bsuspension\s*/\s*drops\b"),
    ("Prolonged-release tablet", r"\bprolonged[- ]release tablets?\b"),
    ("Modified-release tablet", r"\bmodified[- ]release tablets?\b"),
    ("Film-coated tablet", r"\bfilm[- ]coated tablets?\b"),
    ("Film-coated tablet", r"\bcomprimidos?\s+recubiertos?\s+con\s+pel[iíï¿½]cula\b"),
    ("Tablet", r"\bcomprimidos?\b"),
    ("Orodispersible tablet", r"\borodispersible tablets?\b"),
    ("Tablet", r"\btablets?\b"),
    ("Capsule", r"\bcapsules?\b"),
    ("Oral solution", r"\boral solution\b"),
    ("Oral suspension", r"\boral suspension\b"),
    ("Solution for injection", r"\b(solution for )?injection\b"),
    ("Cream", r"\bcream\b"),
    ("Ointment", r"\bointment\b"),
    ("Gel", r"\bgel\b"),
    ("Patch", r"\bpatch(?:es)?\b"),
    ("Spray", r"\bspray\b"),
    ("Drops", r"\bdrops?\b"),
    ("Syrup", r"\bsyrup\b"),
    ("Powder", r"\bpowder\b"),
]
ROUTES = [
    ("Oral", r"\boral\b|\bby mouth\b"),
    ("Intravenous", r"\bintravenous\b|\biv\b"),
    ("Subcutaneous", r"\bsubcutaneous\b|\bsc\b"),
    ("Topical", r"\btopical\b|\bcutaneous\b"),
    ("Ophthalmic", r"\bophthalmic\b|\beye\b"),
    ("Nasal", r"\bnasal\b"),
    ("Inhalation", r"\binhalation\b"),
    ("Rectal", r"\brectal\b"),
]
PACK_SIZES = [
    r"\b\d+\s*(?:x\s*)?\d*\s*(?:tablets?|capsules?|caplets?|patch(?:es)?|sachets?|vials?|ampoules?|bottles?|blisters?|syringes?)\b",
    r"\b\d+(?:\.\d+)?\s*(?:ml|mL|g)\b\s*(?:in\s*)?(?:bottle|vial|tube|sachet|ampoule)?",
]
STRENGTH_UNITS = "mg|mcg|micrograms?|g|kg|ml|l|iu|units?"
PREFERRED_UNITS = r"\b(?:mg|mcg|micrograms?|g|iu|units?|%)\b"
REGISTRATION = r"\b(?:PLGB|PLNI|PL|THRGB|THRNI|THR|NRGB|NRNI|NR)\s*\d+/\d+(?:-\d+)?\b"
COMPACT_REGISTRATION = r"^(PLGB|PLNI|PLPI|PL|THRGB|THRNI|THR|NRGB|NRNI|NR)(\d{5})(\d{4})$"
ATC = r"[A-Z]\d{2}[A-Z]{1,2}\d{0,2}"
ATC_LABEL = r"(?:ATC\s*code|Anatomical\s+therapeutic\s+chemical\s*\(ATC\)\s*code)\s*[:\-\n\r ]+(" + ATC + ")"
NAME_NOISE = [
    (r"\.(?:pdf|html?|docx?)$", ""),
    (r"\b(?:pdf|download|view document|document)\b", ""),
    (r"\b(?:summary of product characteristics|patient information leaflet|package leaflet|"
     r"public assessment report|assessment report)\b", ""),
    (r"\b(?:sm?pc|spc|pil|par)\b\s*[-:]*\s*", ""),
]
# letters of which every match of the above has some
NAME_NOISE_LETTERS = ["pdf", "htm", "doc", "download", "summary", "leaflet", "report", "spc", "mpc", "pil", "par"]
SIGNS = "".join(c for c in map(chr, range(1, 128)) if not (c.isalnum() or c in "_ "))
SIMPLE_FORMS = [
    "ORAL SOLUTION", "ORAL SUSPENSION", "FILM-COATED TABLET", "TABLETS", "TABLET", "CAPSULES", "CAPSULE",
    "INJECTION", "CREAM", "OINTMENT", "GEL", "PATCH", "SPRAY", "DROPS", "SYRUP", "POWDER",
]
COMPANY_LIKE = r"\b(?:ltd|limited|plc|gmbh|kft|s\.?a\.?|b\.?v\.?|inc|llc|pharma|pharmaceuticals?|laboratories|company)\b"
ADDRESS_LIKE = (
    r"^(?:\d+|[a-z]?-?\d{3,}|floor\b|flat\b|unit\b|suite\b|building\b|"
    r"street\b|road\b|avenue\b|lane\b|drive\b)"
)
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:Tel(?:ephone)?|Phone|Contact)[:\s]+(\+?\d[\d\s()./-]{6,}\d)"

ATC_CATEGORIES = {
    "A10": "Antidiabetic", "A02": "Acid disorder medicine", "B01": "Antithrombotic", "C": "Cardiovascular",
    "J01": "Antibiotic", "L": "Oncology / immunology", "M01": "Anti-inflammatory", "N02": "Analgesic",
    "N05": "Antipsychotic / sedative", "N06": "Psychoanaleptic", "R03": "Respiratory medicine",
}
SUBSTANCE_CATEGORIES = {
    "metformin": "Antidiabetic", "ibuprofen": "Anti-inflammatory / analgesic",
    "paracetamol": "Analgesic / antipyretic", "acetaminophen": "Analgesic / antipyretic",
    "enalapril": "Antihypertensive", "amlodipine": "Antihypertensive", "atorvastatin": "Lipid-lowering",
    "mirabegron": "Overactive bladder medicine", "solifenacin": "Overactive bladder medicine",
    "quetiapine": "Antipsychotic", "tafluprost": "Glaucoma medicine", "prilocaine": "Local anaesthetic",
    "lidocaine": "Local anaesthetic", "lidocaine prilocaine": "Local anaesthetic",
    "prilocaine lidocaine": "Local anaesthetic",
}
KEYWORD_CATEGORIES = [
    (r"\bdiabet", "Antidiabetic"),
    (r"\bhypertension|\bhigh blood pressure|\bantihypertensive", "Antihypertensive"),
    (r"\bcholesterol|\blipid|\bstatin", "Lipid-lowering"),
    (r"\bpain|\banalgesi|\bantipyretic|\bfever", "Analgesic / antipyretic"),
    (r"\binflamm", "Anti-inflammatory"),
    (r"\bantibacterial|\bantibiotic", "Antibiotic"),
    (r"\bpsychosis|\bschizophrenia|\bbipolar|\bantipsychotic", "Antipsychotic"),
    (r"\boveractive bladder|\burinary urgency|\burolog", "Overactive bladder medicine"),
    (r"\bglaucoma|\bintraocular pressure", "Glaucoma medicine"),
    (r"\blocal anaesthetic|\blocal anesthetic|\banaesthesia|\banesthesia", "Local anaesthetic"),
    (r"\bcancer|\boncology|\bneoplasm", "Oncology medicine"),
    (r"\basthma|\bcopd|\bbronchodilator|\brespiratory", "Respiratory medicine"),
    (r"\bthromb|\bcoagul|\bplatelet", "Antithrombotic"),
]

# ----------------------------------------------------------------------------------------------


def _needles(pattern: str) -> list[str]:
    """Per alternative of a pattern the longest run of letters every match holds."""
    bare = re.sub(r"\\[a-z]|\((?:\?:)?[^()]*\)\??|\[[^]]*\]|[a-z]\?", " ", pattern)
    return [max(re.findall("[a-z]+", part), key=len) for part in bare.split("|")]


def _ladder(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that occurs; over ASCII texts a pattern runs only where its letters are found."""
    def over(value: Column, low: Column) -> Column:
        def occurs(pattern: str) -> Column:
            near = any_of([F.contains(low, F.lit(n)) for n in _needles(pattern)])
            return near & F.rlike(value, F.lit(f"(?i){pattern}"))

        return case([(occurs(pattern), F.lit(label)) for label, pattern in rules])

    def full(value: Column) -> Column:
        return case([(F.rlike(value, F.lit(f"(?iU){pattern}")), F.lit(label)) for label, pattern in rules])

    return let(as_col(c), lambda v: F.when(is_ascii(v), let(F.lower(v), lambda low: over(v, low))).otherwise(full(v)))


def strength_pattern() -> str:
    part = (
        rf"\d+(?:\.\d+)?\s*(?:{STRENGTH_UNITS}|%)\b"
        rf"(?:\s*/\s*\d*(?:\.\d+)?\s*(?:{STRENGTH_UNITS}))?"
    )
    return rf"{part}(?:\s*\+\s*{part})*"


def extract_strength(c: Column | str) -> Column:
    """The first match with a mass or activity unit, else the first match."""
    found = F.regexp_extract_all(as_col(c), F.lit(f"(?iU){strength_pattern()}"), F.lit(0))

    def best(matches: Column) -> Column:
        preferred = F.filter(matches, lambda m: F.rlike(m, F.lit(f"(?iU){PREFERRED_UNITS}")))
        return F.coalesce(F.get(preferred, F.lit(0)), F.get(matches, F.lit(0)))

    return collapse_ws(let(found, best))


def extract_dosage_form(c: Column | str) -> Column:
    """Label of the first pattern that occurs."""
    return _ladder(c, DOSAGE_FORMS)


def extract_registration_number(c: Column | str) -> Column:
    """UK registration number, upper case."""
    def read(value: Column) -> Column:
        return F.when(F.contains(value, F.lit("/")), extract(value, f"(?iU){REGISTRATION}"))  # every number has one

    return collapse_ws(F.upper(let(as_col(c), read)))


def extract_pack_size(c: Column | str) -> Column:
    """Count of units, else a volume or mass."""
    def read(value: Column) -> Column:
        return by_letters(value, lambda u: F.coalesce(*[extract(value, f"(?i{u}){p}") for p in PACK_SIZES]))

    return collapse_ws(let(as_col(c), read))


def extract_route(c: Column | str) -> Column:
    """X9."""
    return _ladder(c, ROUTES)


def extract_atc_code(c: Column | str) -> Column:
    """A labelled code wins over a bare one."""
    return F.upper(F.coalesce(extract(c, f"(?iU){ATC_LABEL}", 1), extract(c, rf"(?iU)\b{ATC}\b")))


def format_registration(c: Column | str) -> Column:
    """X11: compact UK numbers to ``PL 12345/0001``; anything else only stripped of separators."""
    compact = F.regexp_replace(F.upper(as_col(c)), r"[ _-]", "")
    return F.regexp_replace(F.nullif(compact, F.lit("")), COMPACT_REGISTRATION, "$1 $2/$3")


def clean_product_name(c: Column | str) -> Column:
    """Drop file and document words, a repeated leading block and repeated runs.

    Most names have none of these: a tidy name without the letters of a dropped word and without a word that stands in it twice
    is only trimmed. What repeats starts and ends at word limits, so it has a word that repeats, or is four signs in a row.
    """
    value = as_col(c)
    low = F.lower(value)

    def distinct(words: Column) -> Column:
        return F.size(F.array_distinct(words)) == F.size(words)

    noisy = any_of([F.contains(low, F.lit(n)) for n in NAME_NOISE_LETTERS])
    # signs as blanks, so that four in a row and words are found without a pattern
    spaced = F.translate(F.trim(low), SIGNS, " " * len(SIGNS))
    noisy |= F.contains(spaced, F.lit("    "))
    words, pieces = F.split(F.trim(value), " "), F.array_remove(F.split(spaced, " "), "")
    plain = is_tidy(value) & ~noisy & distinct(words) & distinct(pieces)
    return F.when(plain, F.nullif(F.trim(value, F.lit(" -")), F.lit(""))).otherwise(let(collapse_ws(value), _clean_any_name))


def _clean_any_name(cleaned: Column) -> Column:
    for pattern, replacement in NAME_NOISE:
        cleaned = F.regexp_replace(cleaned, f"(?iU){pattern}", replacement)
    words = F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: w != "")

    def without_repeated_block(w: Column) -> Column:
        sizes = F.when(F.size(w) >= 2, F.sequence(F.lit(1), F.floor(F.size(w) / 2).cast("int")))
        hit = F.get(F.filter(sizes, lambda k: F.slice(w, F.lit(1), k) == F.slice(w, k + 1, k)), F.lit(0))
        return F.array_join(F.when(hit.isNull(), w).otherwise(F.slice(w, hit + 1, F.size(w))), " ")

    once = F.get(F.transform(F.array(words), without_repeated_block), F.lit(0))
    return F.nullif(F.trim(F.regexp_replace(once, r"(?iU)\b(.{4,}?)\s+\1\b", "$1"), F.lit(" -")), F.lit(""))


def simple_strength(c: Column | str) -> Column:
    """X12 (older, narrower parser)."""
    return extract(c, r"(?iU)\d+\s*(MG|MCG|G|ML)(?:/\d+\s*(MG|MCG|G|ML))?")


def simple_form(c: Column | str) -> Column:
    upper = F.upper(as_col(c))
    return case([(F.contains(upper, F.lit(form)), F.lit(form)) for form in SIMPLE_FORMS])


def simple_pl(c: Column | str) -> Column:
    return extract(c, r"(?U)PL\s*\d+/\d+")


def normalize_key(c: Column | str) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def category_from_atc(c: Column | str) -> Column:
    """Longest matching prefix."""
    code = F.upper(F.trim(as_col(c)))
    lengths = sorted({len(p) for p in ATC_CATEGORIES}, reverse=True)
    known = literal_map(ATC_CATEGORIES)
    return F.coalesce(*[F.try_element_at(known, F.substring(code, 1, n)) for n in lengths])


def category_from_substance(c: Column | str) -> Column:
    """First known name contained in the substance."""
    name = collapse_ws(F.replace(F.lower(as_col(c)), F.lit("+"), F.lit(" ")))
    hit = let(name, lambda n: F.get(F.filter(literal_list(list(SUBSTANCE_CATEGORIES)), lambda k: F.contains(n, k)), F.lit(0)))
    return F.try_element_at(literal_map(SUBSTANCE_CATEGORIES), hit)


def short_category(category: Column | str, substance: Column | str, atc: Column | str) -> Column:
    """By ATC code, by substance, then from the text itself."""
    def from_text(value: Column) -> Column:
        short_enough = (F.length(value) <= 48) & ~F.rlike(value, F.lit("[.;:]"))
        keyword = let(
            F.lower(value), lambda v: case([(F.rlike(v, F.lit(f"(?U){p}")), F.lit(label)) for p, label in KEYWORD_CATEGORIES])
        )
        clause = F.trim(F.regexp_extract(value, r"^[^.;:]*", 0))
        six_words = F.array_join(F.slice(F.split(clause, " "), 1, 6), " ")
        return F.when(short_enough, value).otherwise(
            F.coalesce(keyword, F.nullif(F.trim(F.substring(six_words, 1, 48)), F.lit("")))
        )

    return F.coalesce(category_from_atc(atc), category_from_substance(substance), let(collapse_ws(category), from_text))


def iso_date(c: Column | str) -> Column:
    """Text before ``T``."""
    return F.nullif(F.substring_index(collapse_ws(c), "T", 1), F.lit(""))


def size_kb(c: Column | str) -> Column:
    """Kilobytes, 0 when not stated."""
    return F.coalesce(extract(c, r"(?i)(\d+)\s*KB", 1).try_cast("int"), F.lit(0))


def find_email(c: Column | str) -> Column:
    """X34."""
    return extract(c, f"(?i){EMAIL}")


def find_phone(c: Column | str) -> Column:
    return collapse_ws(extract(c, f"(?iU){PHONE}", 1))


def company_like(c: Column | str) -> Column:
    """X36."""
    return F.rlike(text(c), F.lit(f"(?iU){COMPANY_LIKE}"))


def address_like(c: Column | str) -> Column:
    return F.rlike(text(c), F.lit(f"(?iU){ADDRESS_LIKE}"))


def strip_html(c: Column | str) -> Column:
    """Tags dropped, blank lines dropped, every line trimmed."""
    lines = F.split(F.regexp_replace(as_col(c), "<[^>]+>", ""), r"\R")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(" \t\xa0"))), lambda x: x != ""), "\n")


def document_type_of(c: Column | str) -> Column:
    """X43."""
    value = F.lower(as_col(c))

    def has(*needles: str) -> Column:
        return F.rlike(value, F.lit("|".join(needles)))

    return case([
        (has("spc", "summary of product characteristics"), F.lit("SPC")),
        (has("pil", "patient information leaflet"), F.lit("PIL")),
        (has("par", "public assessment report"), F.lit("PAR")),
    ])


def loose_json(c: Column | str) -> Column:
    """JSON object, else the text between the first and the last brace; values as trimmed text."""
    value = as_col(c)
    schema = "map<string,string>"
    braces = F.regexp_extract(value, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.from_json(value, schema), F.from_json(F.nullif(braces, F.lit("")), schema))
    return F.transform_values(parsed, lambda _, v: F.trim(text(v)))


def percent_encode(c: Column | str) -> Column:
    """Like url_encode, with ``%20`` for a blank and ``/`` kept."""
    encoded = F.url_encode(as_col(c))
    for raw, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(raw), F.lit(plain))
    return encoded


def absolute_url(base: str | Column, href: Column | str) -> Column:
    """A link resolved against its page."""
    base_col = F.lit(base) if isinstance(base, str) else base
    root = F.regexp_extract(base_col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    scheme = F.regexp_extract(base_col, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    no_query = F.regexp_extract(base_col, r"^[^?#]*", 0)
    folder = F.regexp_extract(no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)", 0)
    folder = let(folder, lambda path: F.when(path == "", F.concat(root, F.lit("/"))).otherwise(path))

    def joined(link: Column) -> Column:
        return case(
            [
                (link == "", base_col),
                (F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), link),
                (F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)),
                (F.startswith(link, F.lit("/")), F.concat(root, link)),
                (F.startswith(link, F.lit("?")), F.concat(no_query, link)),
                (F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base_col, r"^[^#]*", 0), link)),
            ],
            F.concat(folder, link),
        )

    # dot segments: "x/../" and "./" are rare, so the replacement runs only where they occur
    def tidied(url: Column) -> Column:
        tidy = F.regexp_replace(F.regexp_replace(url, r"(?<=/)\./", ""), r"(?<![:/])/(?!\.\./)[^/?#]+/\.\./", "/")
        return F.when(F.contains(url, F.lit("/.")), tidy).otherwise(url)

    return let(F.trim(as_col(href)), lambda link: F.when(link.isNotNull(), let(joined(link), tidied)))
