"""Text normalisation as JVM-side column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as Unicode text engines define it; Java's \s covers ASCII only
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
_SPACE_CHARS = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                         0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def blank_if_null(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def null_if_blank(col: Column) -> Column:
    return F.when(col != "", col)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def strip_spaces(col: Column) -> Column:
    """Blank-like characters off both ends; the slow character-set trim only runs where an unusual one occurs."""
    return F.when(col.rlike(f"[{SPACE.replace(' ', '').replace('x20', 'x1f')}]"), F.btrim(col, F.lit(_SPACE_CHARS))).otherwise(F.trim(col))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(from, to) for translate(): every character that canonical decomposition turns into one base character (all but
    Hangul syllables, which decompose into several letters), followed by the combining marks, which have no counterpart in `to` and are therefore deleted."""
    src, dst, marks = [], [], []
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base == "":
            marks.append(ch)
        elif len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src + marks), "".join(dst)


def remove_accents(col: Column) -> Column:
    """Canonical decomposition without marks; pure-ASCII text skips the table lookup."""
    src, dst = _accent_table()
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) > F.char_length(text), F.translate(text, src, dst)).otherwise(text)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def normalize_keywords(col: Column) -> Column:
    """Lower case, no accents, every non-word character a space, single spaces."""
    folded = remove_accents(F.lower(F.coalesce(col, F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def normalize_plain(col: Column) -> Column:
    """Lower case and single spaces; accents stay."""
    return squeeze(F.lower(F.coalesce(col, F.lit(""))))


def clean_for_matching(col: Column) -> Column:
    return F.regexp_replace(remove_accents(normalize_plain(col)), "[^a-z0-9]", "")


def normalize_identity(col: Column) -> Column:
    """The fold used inside fingerprints: French accents only, then ASCII letters and digits."""
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return F.regexp_replace(F.translate(lowered, "éèêëàâäùûüôöîïç", "eeeeaaauuuooiic"), "[^a-z0-9]", "")


def title_case(col: Column) -> Column:
    """Upper case after every non-letter (initcap only looks at blanks): letters are split into runs, each run capitalised."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
