"""Text functions (STR-01..24, FLT-08, FLT-09, FLT-15, SNK-14, SRC-19, SRC-20)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_pattern(phrases: list[str], ignore_case: bool = False) -> str:
    """STR-01, STR-04: phrases, longest first, whole words in Unicode, any white space between their words.

    Places that begin with no phrase's first letter are passed over before the costlier look behind.
    """
    words = sorted({" ".join(p.split()) for p in phrases if p.strip()}, key=lambda p: (-len(p), p))
    quoted = [r"\s+".join(re.sub(r"([^\w])", r"\\\1", w) for w in p.split(" ")) for p in words]
    begin = "(?=[" + "".join(sorted({re.sub(r"([^\w])", r"\\\1", p[0]) for p in words})) + "])" if words and not ignore_case else ""
    return ("(?iU)" if ignore_case else "(?U)") + begin + r"(?<!\w)(?:" + "|".join(quoted) + r")(?!\w)"


def matched(text: Column, vocabulary: list[tuple[str, list[str]]]) -> Column:
    """STR-02, JOI-21: the keys, in the vocabulary's order, of which an alias stands in ``text``; each at most once."""
    keys = [F.when(text.rlike(phrase_pattern([a.lower() for a in aliases])), F.lit(key)) for key, aliases in vocabulary if any(a.strip() for a in aliases)]
    return F.array_compact(F.array(*keys)) if keys else F.expr("CAST(array() AS array<string>)")


def matching_text(*parts: Column) -> Column:
    """Title, description and tags in lower case, for :func:`matched`."""
    return F.lower(F.concat_ws(" ", *parts))


def words(text: Column) -> Column:
    """STR-05."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z.'-]*)"), F.lit(1))


def tokens(text: Column) -> Column:
    """STR-06: Unicode letters with inner quotes, hyphens or slashes, or numbers with a plus."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+(?:['’\-/][\p{L}]+)*|\d+\+?)"), F.lit(1))


def kept_tokens(token_list: Column, fillers: list[str]) -> Column:
    """FLT-15: for each token whether a gram may begin or end with it."""
    return F.transform(token_list, lambda w: ~F.array_contains(F.array(*map(F.lit, fillers or [""])), w))


def number_tokens(token_list: Column) -> Column:
    """FLT-15: for each token whether it is a number."""
    return F.transform(token_list, lambda w: w.rlike(r"^\d"))


def ngrams(token_list: Column, kept: Column, number: Column, most: int = 4, bare: list[str] | None = None) -> Column:
    """STR-07, FLT-15: all distinct n-grams of 1 to ``most`` tokens whose ends are kept and that are not numbers only; single words of ``bare`` are none.

    The arguments are to be columns of the input: an expression would be computed again for each gram.
    """
    n = F.size(token_list)

    def of(k: int) -> Column:
        def good(i: Column) -> Column:
            numbers = F.get(number, i)
            for x in range(1, k):
                numbers = numbers & F.get(number, i + x)
            return F.get(kept, i) & F.get(kept, i + (k - 1)) & ~numbers

        at = F.filter(F.sequence(F.lit(0), n - k), good)
        grams = F.transform(at, lambda i: F.get(token_list, i)) if k == 1 else F.transform(at, lambda i: F.array_join(F.slice(token_list, i + 1, F.lit(k)), " "))
        if k == 1 and bare:
            grams = F.filter(grams, lambda g: ~F.array_contains(F.array(*map(F.lit, bare)), g))
        return F.when(n >= k, grams).otherwise(F.expr("CAST(array() AS array<string>)"))

    return F.array_distinct(F.concat(*[of(k) for k in range(1, most + 1)]))


def snippet(text: Column, phrase: Column, around: int = 40) -> Column:
    """STR-08: the phrase's first place with its surroundings, dots where text is cut, white space collapsed; null if absent."""
    at = F.instr(F.lower(text), F.lower(phrase))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.length(phrase) + around, F.length(text) + 1)
    body = F.trim(F.regexp_replace(F.substring(text, start, end - start), r"\s+", " "))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise("")))


def strip_prefixes(title: Column, prefixes: list[str]) -> Column:
    """STR-09: leading words of seniority, as often as they repeat."""
    alt = "|".join(re.sub(r"([^\w ])", r"\\\1", p).replace(" ", r"\s+") for p in sorted(prefixes, key=len, reverse=True))
    return F.trim(F.regexp_replace(title, rf"(?i)^(?:\s*(?:{alt})\b[\s:.\-/]*)+", ""))


def html_to_text(html: Column) -> Column:
    """STR-10: breaks and list items as lines, tags gone, the common entities decoded, blank lines dropped."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<li[^>]*>", "\n- "), r"(?i)</(?:li|p|div|ul|ol|h[1-6])>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "-")), "\n")


# Letters with marks that occur in place names, and what they are without.
_MARKED, _BARE = "āăáàâäãåčçćďđéèêëēėęěğģíìîïīįķłļńňñņóòôöõøōőŕřśšşțťţúùûüūůűųýÿźžż", "aaaaaaaacccddeeeeeeeeggiiiiiikllnnnnoooooooorrsssttt" "uuuuuuuuyyzzz"


def strip_marks(text: Column) -> Column:
    """STR-11: lower case without diacritics."""
    return F.translate(F.lower(text), _MARKED, _BARE)


def normal(text: Column) -> Column:
    """STR-12: lower case, trimmed, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def word_set(phrase: Column, stop: list[str]) -> Column:
    """STR-13: distinct words, without brackets, punctuation and stop words."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(phrase), r"\([^)]*\)", " "), r"[^\p{L}\p{N}+#]+", " ")
    return F.array_distinct(F.array_except(F.filter(F.split(F.trim(bare), " "), lambda w: w != ""), F.array(*map(F.lit, stop or [""]))))


def canonical(value: Column, synonyms: dict[str, str]) -> Column:
    """STR-14."""
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), normal(value)), normal(value)) if pairs else normal(value)


def scope_encode(names: Column) -> Column:
    """STR-18."""
    return F.array_join(names, ",")


def scope_decode(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def numerals(text: Column) -> Column:
    """STR-20: numbers without thousands commas, signs and trailing zeros."""
    raw = F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    bare = F.transform(raw, lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.transform(bare, lambda n: F.when(F.contains(n, F.lit(".")), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n))


def names_in(text: Column, common: list[str]) -> Column:
    """STR-21: capitalised words that do not begin a sentence and are not common."""
    inner = F.regexp_replace(text, r"(^|[.!?]\s+)\p{Lu}[\p{L}'-]*", "$1")
    found = F.regexp_extract_all(inner, F.lit(r"(?<![\p{L}])(\p{Lu}[\p{L}'-]+)"), F.lit(1))
    return F.array_distinct(F.array_except(found, F.array(*map(F.lit, common or [""]))))


def money_range(text: Column) -> Column:
    """SRC-19: struct(low, high) of all ``number[k|m]`` in a salary text, whole numbers; nulls without any."""
    digits = F.regexp_extract_all(text, F.lit(r"(?i)(\d[\d,]*(?:\.\d+)?)\s*([km]?)"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"(?i)(\d[\d,]*(?:\.\d+)?)\s*([km]?)"), F.lit(2))
    value = F.zip_with(digits, units, lambda d, u: (F.replace(d, F.lit(","), F.lit("")).cast("double") * F.when(F.lower(u) == "k", 1e3).when(F.lower(u) == "m", 1e6).otherwise(1.0)).cast("long"))
    return F.struct(F.array_min(value).alias("low"), F.array_max(value).alias("high"))


def normal_url(url: Column) -> Column:
    """SRC-20."""
    return F.regexp_replace(F.trim(url), "^//", "https://")


def posting_date(text: Column) -> Column:
    """SNK-14, DAT-06: ISO dates and times, ``Jul 5, 2026``, ``July 5, 2026``; else null."""
    t = F.trim(text)
    return F.coalesce(F.to_date(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t))), F.to_date(F.try_to_timestamp(t, F.lit("MMM d, yyyy"))), F.to_date(F.try_to_timestamp(t, F.lit("MMMM d, yyyy"))), F.to_date(F.try_to_timestamp(t, F.lit("d/M/yyyy"))))


def resolves_to(location: Column, countries: list[str], cities: list[str]) -> Column:
    """FLT-08: the last comma part is a country, or a city's name is in the location; false for null."""
    place = strip_marks(F.coalesce(location, F.lit("")))
    last = F.trim(F.element_at(F.split(place, ","), -1))
    return last.isin(*countries) | reduce(lambda a, c: a | F.contains(place, F.lit(c)), cities, F.lit(False))


def first_place(location: Column) -> Column:
    """FLT-09."""
    part = F.trim(F.element_at(F.split(location, ","), 1))
    return F.when(part != "", part)


def query_string(url: Column) -> Column:
    """JSN-03."""
    return F.str_to_map(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
