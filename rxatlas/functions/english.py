"""English rendering of registry texts (X19-X22), on the JVM only.

Unicode compatibility decomposition has no SQL function; its tables are derived here from the
``unicodedata`` rules and applied with ``translate`` (one character to one or none) and, for the
rare characters that expand, with a map look-up. Pure ASCII values skip all of it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import literal_list, literal_map
from .base import all_of, as_col, case, collapse_ws, filled, is_ascii, is_tidy, let, nz

# --- Fixed values: transliteration and translations --------------------------------------------

CYRILLIC_UPPER = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "E", "Ж": "Zh", "З": "Z", "И": "I",
    "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T",
    "У": "U", "Ф": "F", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ъ": "", "Ы": "Y",
    "Ь": "", "Э": "E", "Ю": "Yu", "Я": "Ya",
}
WHOLE_VALUES = {
    "Д": "Active", "д": "Active", "Н": "Inactive", "н": "Inactive", "Мирабегрон": "Mirabegron",
    "Бетмига": "Betmiga", "Астеллас Фарма Юроп Б.В.": "Astellas Pharma Europe B.V.",
    "Нидерланды": "Netherlands", "Германия": "Germany", "Индия": "India", "Италия": "Italy",
    "Испания": "Spain", "Франция": "France", "Венгрия": "Hungary", "Ирландия": "Ireland",
    "Россия": "Russia", "Китай": "China", "Япония": "Japan",
}
PHRASES = {
    "таблетки": "tablets", "таблетка": "tablet", "капсулы": "capsules", "капсула": "capsule",
    "раствор": "solution", "суспензия": "suspension", "крем": "cream", "мазь": "ointment",
    "капли": "drops", "порошок": "powder", "инъекций": "injection", "инъекции": "injection",
    "пленочной оболочкой": "film-coated", "пролонгированного высвобождения": "prolonged-release",
    "зарегистрирован": "registered", "зарегистрировано": "registered", "действующий": "active",
    "истек": "expired",
}
ENGLISH_COLUMNS = [
    "substance", "active_substance", "active_substances", "searched_substance", "source_substance", "product",
    "company", "commercial_company", "brand_owner", "labeler_name", "sponsor", "applicant", "mah", "ma_holder",
    "manufacturer_name", "manufacturer_country", "status", "dosage_form", "pack_size", "therapeutic_category",
    "document_type",
]
LOCAL_LANGUAGE_PREFIX = "Local-language registry value: "
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3

# ----------------------------------------------------------------------------------------------

NON_ASCII = r"[^\x00-\x7F]"
CYRILLIC = r"[Ѐ-ӿ]"


@cache
def _decomposition() -> tuple[str, str, str, dict[str, str]]:
    """(replaced characters, their replacements, deleted characters, expansions) under NFKD less combining marks."""
    single_from, single_to, deleted, expanded = [], [], [], {}
    for code in range(0x80, 0x110000):
        if HANGUL_FIRST <= code <= HANGUL_LAST or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        plain = "".join(p for p in unicodedata.normalize("NFKD", char) if not unicodedata.combining(p))
        if plain == char:
            continue
        if not plain:
            deleted.append(char)
        elif len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        else:
            expanded[char] = plain
    return "".join(single_from), "".join(single_to), "".join(deleted), expanded


def _expand(c: Column) -> Column:
    """Characters that decompose to several: compatibility ligatures by map, Hangul syllables by arithmetic."""
    *_, expanded = _decomposition()
    table = literal_map(expanded)
    lead = literal_list([chr(0x1100 + i) for i in range(19)])
    vowel = literal_list([chr(0x1161 + i) for i in range(21)])
    tail = literal_list(["", *[chr(0x11A7 + i) for i in range(1, 28)]])

    def one(char: Column) -> Column:
        offset = F.ascii(char) - HANGUL_FIRST
        syllable = F.concat(
            F.get(lead, F.floor(offset / 588).cast("int")),
            F.get(vowel, F.floor((offset % 588) / 28).cast("int")),
            F.get(tail, offset % 28),
        )
        hangul = F.ascii(char).between(HANGUL_FIRST, HANGUL_LAST)
        return F.when(hangul, syllable).otherwise(F.coalesce(F.try_element_at(table, char), char))

    present = F.array_distinct(F.regexp_extract_all(c, F.lit(_expanding_class()), F.lit(0)))
    return F.aggregate(present, c, lambda acc, char: F.replace(acc, char, one(char)))


@cache
def _expanding_class() -> str:
    """Character class of everything ``_expand`` changes, as ranges."""
    codes = sorted(ord(char) for char in _decomposition()[3])
    ranges, start, previous = [], codes[0], codes[0]
    for code in codes[1:] + [0x110000]:
        if code != previous + 1:
            ranges.append((start, previous))
            start = code
        previous = code
    ranges.append((HANGUL_FIRST, HANGUL_LAST))
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _fold_marks(value: Column) -> Column:
    source, target, deleted, _ = _decomposition()
    expanded = F.when(F.rlike(value, F.lit(_expanding_class())), _expand(value)).otherwise(value)
    return F.translate(expanded, source + deleted, target)


def strip_accents(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks."""
    value = as_col(c)
    return F.when(F.rlike(value, F.lit(NON_ASCII)), let(value, _fold_marks)).otherwise(value)


def transliterate_cyrillic(c: Column | str) -> Column:
    """Russian letters to Latin ones."""
    table = CYRILLIC_UPPER | {k.lower(): v.lower() for k, v in CYRILLIC_UPPER.items()}
    value = as_col(c)
    for letter, latin in table.items():
        if len(latin) > 1:
            value = F.replace(value, F.lit(letter), F.lit(latin))
    single = [k for k, v in table.items() if len(v) == 1]
    gone = [k for k, v in table.items() if not v]
    return F.translate(value, "".join(single + gone), "".join(table[k] for k in single))


def translate_phrases(c: Column | str) -> Column:
    """Known phrases, longest first, in any letter case."""
    longest_first = sorted(PHRASES.items(), key=lambda item: len(item[0]), reverse=True)
    return reduce(lambda acc, p: F.regexp_replace(acc, f"(?iu){re.escape(p[0])}", p[1]), longest_first, as_col(c))


def _house_style(c: Column) -> Column:
    value = F.regexp_replace(c, r"(?U)\bB\.V\b(?!\.)", "B.V.")
    value = F.regexp_replace(value, r"(?iU)\bFarma\b", "Pharma")
    return F.regexp_replace(value, r"(?iU)\bYurop\b", "Europe")


def _styled(value: Column) -> Column:
    """Whether an ASCII value holds a word the house style rewrites, told by byte searches."""
    low = F.lower(value)
    return F.contains(value, F.lit("B.V")) | F.contains(low, F.lit("farma")) | F.contains(low, F.lit("yurop"))


def _from_cyrillic(value: Column) -> Column:
    return F.when(
        F.rlike(value, F.lit(CYRILLIC)),
        let(translate_phrases(value), lambda v: F.when(F.rlike(v, F.lit(CYRILLIC)), transliterate_cyrillic(v)).otherwise(v)),
    ).otherwise(value)


def _mark_foreign(value: Column) -> Column:
    foreign = F.rlike(value, F.lit(NON_ASCII)) & ~F.rlike(value, F.lit(CYRILLIC))
    return F.when(foreign, F.concat(F.lit(LOCAL_LANGUAGE_PREFIX), value)).otherwise(value)


def _english(value: Column) -> Column:
    known = F.try_element_at(literal_map(WHOLE_VALUES), value)
    rendered = let(_house_style(let(_from_cyrillic(value), _fold_marks)), _mark_foreign)
    return case(
        [
            (is_ascii(value), collapse_ws(F.when(_styled(value), _house_style(value)).otherwise(value))),
            (known.isNotNull(), known),
        ],
        collapse_ws(rendered),
    )


def _stays(value: Column) -> Column:
    """Values ``english_text`` only trims: NULL, or tidy ASCII without a word in another style. Never NULL itself."""
    last = F.ascii(F.right(value, F.lit(1)))
    same = is_tidy(value) & (F.ascii(value) >= 32) & (last >= 32) & ~_styled(value)
    return value.isNull() | F.coalesce(same, F.lit(False))


def english_text(c: Column | str) -> Column:
    """Known values and phrases translated, Cyrillic transliterated, accents dropped, the rest marked."""
    return let(nz(c), _english)


def english_row(df: DataFrame) -> DataFrame:
    """X21 over every text column the frame carries, as one expression over an array of them."""
    names = [name for name in ENGLISH_COLUMNS if name in df.columns]
    if not names:
        return df
    # most values are plain ASCII and are only trimmed: told from bytes outside the lambda, which runs only for rows with others
    told = df.withColumns({f"_asis_{name}": _stays(F.col(name)) for name in names})
    asis = {name: F.col(f"_asis_{name}") for name in names}
    others = F.when(~all_of(list(asis.values())), F.transform(F.array(*names), english_text))
    english = told.withColumn("_english", others)
    return english.withColumns({
        name: F.when(asis[name], filled(F.trim(F.col(name)))).otherwise(F.get("_english", F.lit(i))) for i, name in enumerate(names)
    }).drop("_english", *[f"_asis_{name}" for name in names])
