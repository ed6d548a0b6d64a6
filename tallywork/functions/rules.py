"""Ordered rule tables over texts (STR-15..17): all patterns in one automaton, the first rule in the table's order wins.

A table has rows (place, kind, pattern, value).  Kinds: ``substring``; ``phrase``: whole words, with any white space between
them; ``regex``.  Substrings and phrases of one table are one Aho-Corasick automaton, so a text is passed once however many
there are; regular expressions are tested by the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules of a table: it is held by every task.
MOST_RULES = 100_000
KINDS = ("substring", "phrase", "regex")
Rules = list[tuple[int, str, str, str]]


def rule_table(rules: DataFrame | Iterable, most: int = MOST_RULES) -> Rules:
    """Rules from a DataFrame (place, kind, pattern, value) or a list, in their order; a table of over ``most`` rows or an unknown kind is an error.

    Null and blank patterns match nothing and are left out.
    """
    rows = rules.select("place", "kind", "pattern", "value").limit(most + 1).collect() if isinstance(rules, DataFrame) else list(rules)
    if len(rows) > most:
        raise ValueError(f"a rule table has at most {most} rows")
    if odd := {k for _, k, _, _ in rows} - set(KINDS):
        raise ValueError(f"unknown kinds of rules: {sorted(map(str, odd))}")
    return sorted(((int(p), k, t, v) for p, k, t, v in rows if t and t.strip()), key=lambda r: r[0])


def _automaton(rules: Rules):
    """The first places by pattern: (automaton, whether phrases are in it)."""
    places: dict[str, list[tuple[int, bool]]] = {}
    for n, (_, kind, pattern, _) in enumerate(rules):
        whole = kind == "phrase"
        key = " ".join(pattern.lower().split()) if whole else pattern.lower()
        places.setdefault(key, []).append((n, whole))
    a = ahocorasick.Automaton()
    for key, at in places.items():
        a.add_word(key, (len(key), at))
    a.make_automaton()
    return a


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _first_literal(rules: Rules):
    """The number of the first substring or phrase rule of a text, or null."""
    literal = [(n, r) for n, r in enumerate(rules) if r[1] != "regex"]
    numbers, table = [n for n, _ in literal], [r for _, r in literal]
    made: list = []

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(_automaton(table))
        out = []
        for text in texts:
            best, low = None, " ".join(text.lower().split()) if text else ""
            for end, (size, rows) in made[0].iter(low):
                whole = (end - size < 0 or not _is_word(low[end - size])) and (end + 1 == len(low) or not _is_word(low[end + 1]))
                for n, phrase in rows:
                    if (whole or not phrase) and (best is None or n < best):
                        best = n
            out.append(None if best is None else numbers[best])
        return pd.Series(out, dtype="Int32")

    return run


def first_rule(text: Column, rules: DataFrame | Iterable, default: str | None = None) -> Column:
    """STR-16, STR-17: the value of the first rule, in the table's order, that is in the text (white space collapsed, lower case); ``default`` if none is.  A null text is empty."""
    table = rule_table(rules)
    if not table:
        return F.lit(default).cast("string")
    shown = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))
    regexes = [F.when(shown.rlike(f"(?iU){p}"), F.lit(n)) for n, (_, k, p, _) in enumerate(table) if k == "regex"]
    literals = [_first_literal(table)(text)] if any(k != "regex" for _, k, _, _ in table) else []
    found = [*literals, *regexes]
    at = F.least(*found) if len(found) > 1 else found[0]
    return F.coalesce(F.get(F.array(*[F.lit(v) for *_, v in table]), at), F.lit(default))


def with_overrides(text: Column, rules: DataFrame | Iterable, overrides: DataFrame | Iterable, default: str | None = None) -> Column:
    """STR-15: the first rule's value, which a rule of ``overrides``, again the first, always replaces."""
    return F.coalesce(first_rule(text, overrides), first_rule(text, rules, default))


def literal_rules(buckets: list[tuple[str, list[str]]], kind: str = "substring") -> Rules:
    """A table from buckets in their order: (value, patterns)."""
    return [(n, kind, p, value) for n, (value, p) in enumerate((v, p) for v, patterns in buckets for p in patterns)]
