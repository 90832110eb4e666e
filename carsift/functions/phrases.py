"""Finding many fixed phrases in one pass.

A dictionary of phrases becomes one regular expression (a prefix tree) that is tried at every word start or at every
character, inside a look-ahead so that overlapping phrases are all seen. One scan of the text replaces one scan per phrase.
Only one phrase can be reported per start position, so phrases where one is the beginning of another one with a different
owner go to separate expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tree_regex(words: list[str]) -> str:
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(ch) + render(sub) for ch, sub in node.items() if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return render(tree)


def _look_up(phrases: Column, table: Column) -> Column:
    return F.transform(phrases, lambda p: F.try_element_at(table, p))


class PhraseSet:
    """owners[i] holds the phrases of owner i; `hits` gives the sorted positions of the owners found in a text.

    whole_words: the text is normalised (word characters and single blanks) with a blank on both sides, and phrases match
    between blanks. Otherwise phrases match anywhere.
    """

    def __init__(self, owners: list[list[str]], whole_words: bool):
        self.whole_words = whole_words
        self.groups: list[dict[str, int]] = []
        for i, phrases in enumerate(owners):
            for p in phrases:
                group = next((g for g in self.groups if self._fits(g, p, i)), None)
                if group is None:
                    group = {}
                    self.groups.append(group)
                group[p] = i

    def _fits(self, group: dict[str, int], phrase: str, owner: int) -> bool:
        end = " " if self.whole_words else ""
        return not any(
            o != owner and (p == phrase or p.startswith(phrase + end) or phrase.startswith(p + end)) for p, o in group.items())

    def _regex(self, group: dict[str, int]) -> str:
        body = _tree_regex(list(group))
        return f" (?=({body}) )" if self.whole_words else f"(?=({body}))"

    def found(self, text: Column) -> Column:
        """Phrases found, with repeats, expression by expression."""
        return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(self._regex(g)), 1) for g in self.groups]))

    def hits(self, text: Column, extra: list[tuple[Column, int]] = ()) -> Column:
        """Sorted distinct owner positions; `extra` holds further positions, each with the condition under which it counts.

        array_sort and array_compact take a lambda, below which nothing is compiled; a hash set is only built where two were found.
        """
        none = F.array().cast("array<int>")
        parts = []
        for g in self.groups:
            table = F.create_map(*[F.lit(x) for kv in g.items() for x in kv])
            parts.append(_look_up(F.regexp_extract_all(text, F.lit(self._regex(g)), 1), table))
        parts += [F.when(found, F.array(F.lit(i))).otherwise(none) for found, i in extra]
        if not parts:
            return none
        joined = parts[0] if len(parts) == 1 else F.concat(*parts)
        return F.when(F.size(joined) > 1, F.sort_array(F.array_distinct(joined))).otherwise(joined)


def pick(hits: Column, values: list) -> Column:
    """values[i] for every hit."""
    table = F.array(*[F.lit(v) for v in values])
    return F.transform(hits, lambda i: F.get(table, i))


def total(hits: Column, values: list[int]) -> Column:
    table = F.array(*[F.lit(v) for v in values])
    return F.aggregate(hits, F.lit(0), lambda acc, i: acc + F.get(table, i))
