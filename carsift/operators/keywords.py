"""Keyword detection on normalised text.

Normalised text holds only word characters and single blanks, so a plain pattern with word boundaries is the same as the
pattern between blanks. Patterns that keep punctuation (hyphen, apostrophe) can never occur in such a text and are dropped
when the expression is built. A match is carried as the sorted positions of the keywords in the dictionary.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from carsift.functions.phrases import PhraseSet, pick
from carsift.functions.text import blank_if_null, normalize_keywords
from carsift.sources.dictionaries import builtin


def fold(pattern: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", pattern.lower()) if unicodedata.category(c) != "Mn")


def plain(patterns: list[str]) -> list[str]:
    """Folded patterns that can occur in normalised text, without repeats."""
    return [p for p in dict.fromkeys(fold(p) for p in patterns) if re.fullmatch(r"\w+( \w+)*", p)]


def scan_text(*cols: Column) -> Column:
    """Normalised text of the columns with one blank on both sides."""
    return F.concat(F.lit(" "), normalize_keywords(F.concat_ws(" ", *[blank_if_null(c) for c in cols])), F.lit(" "))


def opportunity_entries(keywords: dict | None = None) -> list[dict]:
    kw = keywords or builtin("keywords")
    return kw["opportunity"] + kw.get("opportunity_regex", [])


def risk_entries(keywords: dict | None = None) -> list[dict]:
    return (keywords or builtin("keywords"))["risk"]


def _regex(e: dict) -> str:
    """One expression per keyword. In padded text a word boundary next to a word character is a blank, so patterns written
    between boundaries are only tried after blanks."""
    inner = [re.fullmatch(r"\\b(\w.*)\\b", p) for p in e["patterns"]]
    if all(inner):
        return "(?U) (?:" + "|".join(f"(?:{m.group(1)})" for m in inner) + ")(?= )"
    return "(?U)" + "|".join(f"(?:{p})" for p in e["patterns"])


def opportunity_hits(padded: Column, keywords: dict | None = None) -> Column:
    kw = keywords or builtin("keywords")
    n = len(kw["opportunity"])
    extra = [(padded.rlike(_regex(e)), n + i) for i, e in enumerate(kw.get("opportunity_regex", []))]
    return PhraseSet([plain(e["patterns"]) for e in kw["opportunity"]], True).hits(padded, extra)


def risk_hits(padded: Column, keywords: dict | None = None) -> Column:
    return PhraseSet([plain(e["patterns"]) for e in risk_entries(keywords)], True).hits(padded)


def max_severity(hits: Column, entries: list[dict], keywords: dict | None = None) -> Column:
    """Highest known rank; severities outside the rank table count as rank 0, ties go to dictionary order."""
    rank = (keywords or builtin("keywords"))["severity_rank"]
    order = sorted(range(len(entries)), key=lambda i: -rank.get(entries[i]["severity"], 0))
    place = [order.index(i) for i in range(len(entries))]
    return F.coalesce(F.get(F.array(*[F.lit(entries[i]["severity"]) for i in order]), F.array_min(pick(hits, place))), F.lit("none"))


def exclusion_match(padded: Column, keywords: dict | None = None) -> Column:
    """Text of the first exclusion pattern (dictionary order) that occurs, else NULL."""
    words = plain((keywords or builtin("keywords"))["exclusions"])
    return F.get(pick(PhraseSet([[w] for w in words], True).hits(padded), words), F.lit(0))


def _first_per_keyword(entries: list[dict], category: str, padded: Column) -> Column:
    flat = [(k, p) for k, e in enumerate(entries) for p in plain(e["patterns"])]
    owner = F.array(*[F.lit(k) for k, _ in flat])
    hits = PhraseSet([[p] for _, p in flat], True).hits(padded)
    table = F.array(*[_record(entries[k], category, F.lit(p)) for k, p in flat])
    firsts = F.filter(hits, lambda h, i: (i == 0) | (F.get(owner, h) != F.get(owner, F.get(hits, i - 1))))
    return F.transform(firsts, lambda h: F.get(table, h))


def _record(e: dict, category: str, matched: Column) -> Column:
    return F.struct(
        F.lit(e["id"]).alias("keyword_id"), F.lit(category).alias("category"), matched.alias("matched_text"),
        F.lit(e.get("bonus", 0)).alias("bonus"), F.lit(e.get("penalty", 0)).alias("penalty"),
        F.lit(e.get("cost", 0)).alias("cost_estimate"), F.lit(e.get("severity", "low")).alias("severity"),
        F.lit(e.get("description", "")).alias("description"))


def match_structs(padded: Column, keywords: dict | None = None) -> tuple[Column, Column]:
    """Full match records (opportunities, risks); the first pattern of a keyword that occurs gives matched_text."""
    kw = keywords or builtin("keywords")
    extra = []
    for e in kw.get("opportunity_regex", []):
        text = F.coalesce(*[F.when(padded.rlike("(?U)" + p), F.regexp_extract(padded, "(?U)" + p, 0)) for p in e["patterns"]])
        extra.append(F.when(text.isNotNull(), _record(e, "opportunite", text)))
    opp = F.concat(_first_per_keyword(kw["opportunity"], "opportunite", padded), F.array_compact(F.array(*extra)))
    return opp, _first_per_keyword(kw["risk"], "risque", padded)


def substring_hits(text: Column, entries: list[dict]) -> Column:
    """Older matcher: lower-cased substring, accents kept, no word boundaries."""
    return PhraseSet([list(dict.fromkeys(p.lower() for p in e["patterns"])) for e in entries], False).hits(text)


def first_substring(text: Column, words: list[str]) -> Column:
    return F.get(pick(PhraseSet([[w.lower()] for w in words], False).hits(text), words), F.lit(0))
