"""Structured fields from posting texts by guarded patterns (EXT-01..13).

The guards look at words around a match, inside its clause, so each text is one call of a small function; texts come
in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Degree levels from lowest to highest, with the phrases that name them without a doubt.
LEVELS = ["matriculation", "intermediate", "diploma", "bachelors", "masters", "phd"]
_SURE = [
    ("matriculation", r"matric(?:ulation)?|o[- ]?levels?|ssc"), ("intermediate", r"a[- ]?levels?|hssc|f\.?sc|fa/fsc"), ("diploma", r"diploma|dae"),
    ("bachelors", r"bachelor(?:['’]?s)?|b\.?sc|bba|b\.?com|b\.?tech|bs[cé]?s|undergraduate"), ("masters", r"master['’]?s|m\.?sc|mba|m\.?phil|m\.?com|postgraduate"), ("phd", r"ph\.?d\.?|doctorate"),
]
#: Short forms that need a degree or field word beside them, and the level of each.
_SHORT = {"bs": "bachelors", "ba": "bachelors", "be": "bachelors", "ms": "masters", "ma": "masters"}
_DEGREE_WORDS = {"degree", "degrees", "bachelor", "bachelors", "master", "masters", "graduate", "qualification"}
_FIELDS = {"computer", "science", "engineering", "software", "electrical", "mechanical", "civil", "economics", "commerce", "finance", "accounting", "marketing", "english", "arts", "business", "statistics", "mathematics", "physics", "chemistry", "psychology", "education", "it", "cs"}
_NEED = re.compile(r"\b(?:degree|required|requirements?|qualifications?|education|must|hold|holding|minimum|university)\b", re.I)
_PROGRAMME = re.compile(r"\b(?:fresh|recent|new|our|programme|program|trainee|alumni)\b", re.I)
_PROFICIENCY = re.compile(r"\b(?:level|skills?|knowledge|proficiency|user|english|excel)\b", re.I)
# Phrases that, before a colon or dash, head a section that asks for something, and that head another one.
_ASKING = ("requirement", "requirements", "qualification", "qualifications", "required skill", "required skills", "what youll need", "what you'll need", "what you’ll need", "who you are")
_OTHER = ("responsibilities", "about us", "about the role", "about the company", "benefits", "perks", "overview", "job description", "role overview", "company description", "what we offer", "duties")
_spaced = lambda phrases: "|".join(re.escape(p).replace(r"\ ", r"\s+") for p in sorted(phrases, key=len, reverse=True))
_HEADING = re.compile(rf"(?P<asking>{_spaced(_ASKING)})\s*[:-]|(?:{_spaced(_OTHER)})\s*[:-]", re.I)
_SUBJECT = re.compile(r"\b(?:old|age[ds]?|education|schooling|founded|company|history|in business|since)\b", re.I)
_CONTEXT = re.compile(r"\b(?:experience|exp|required|minimum|least|must|working|background|relevant|hands[- ]on)\b", re.I)
_YEAR = r"(?:years?|yrs?)"
_TIERS = [
    re.compile(rf"(\d{{1,2}})\s*(?:-|–|to)\s*(\d{{1,2}})\+?\s*{_YEAR}", re.I), re.compile(rf"(?:minimum|min\.?|at least)(?:\s+of)?\s*(\d{{1,2}})\+?\s*{_YEAR}", re.I), re.compile(rf"(\d{{1,2}})\s*\+\s*{_YEAR}", re.I), re.compile(rf"(\d{{1,2}})\s*{_YEAR}", re.I),
]
_FIELD = re.compile(r"\b(?:degree|bachelor(?:['’]?s)?|master(?:['’]?s)?|diploma|bs|ms|ph\.?d)\b(?:\s+degree)?\s+in\s+([A-Za-z][A-Za-z &/]{2,60}?)(?=\s*(?:[,.;:()\n]|\bor\b|\bfrom\b|\bwith\b|\brequired\b|$))", re.I)


def clause(text: str, start: int, end: int, around: int = 80) -> tuple[str, str]:
    """What stands before and after a match in its clause."""
    before = re.split(r"[.;()\n]", text[max(0, start - around) : start])[-1]
    return before, re.split(r"[.;()\n]", text[end : end + around])[0]


def in_requirements(text: str, at: int, reach: int = 400) -> bool:
    """EXT-09: the last heading in the ``reach`` characters before ``at``, wherever it stands in its line, asks for something."""
    headings = list(_HEADING.finditer(text[max(0, at - reach) : at]))
    return bool(headings) and headings[-1]["asking"] is not None


def degree_level(text: str) -> str | None:
    """EXT-01..04: the lowest level that is named with its guard passed."""
    found = set()
    for level, pattern in _SURE:
        if re.search(rf"(?<!\w)(?:{pattern})(?!\w)", text, re.I):
            found.add(level)
    for m in re.finditer(r"(?<![\w.+#-])(bs|ba|be|ms|ma)(?![\w.+#-])", text, re.I):
        words = re.findall(r"[A-Za-z]+", text[m.end() : m.end() + 24].lower())
        if words[:1] == ["in"]:
            words = words[1:]
        before = re.findall(r"[A-Za-z]+", text[max(0, m.start() - 24) : m.start()].lower())[-1:]
        if (words[:1] and words[0] in _DEGREE_WORDS | _FIELDS) or (before and before[0] in _DEGREE_WORDS):
            found.add(_SHORT[m[1].lower()])
    for m in re.finditer(r"(?<!\w)graduat(?:e|es|ion)(?!\w)", text, re.I):
        before, after = clause(text, *m.span())
        if not _PROGRAMME.search(before) and not re.match(r"\s*(?:programme|program|trainee)", after, re.I) and (_NEED.search(before + after) or set(re.findall(r"[a-z]+", after.lower())[:3]) & _FIELDS):
            found.add("bachelors")
    for m in re.finditer(r"(?<!\w)intermediate(?!\w)", text, re.I):
        before, after = clause(text, *m.span())
        if not re.match(r"\W*(?:\w+\W+)?(?:level|skills?|knowledge|proficiency|user|english|excel)\b", after, re.I) and (_NEED.search(before + after) or in_requirements(text, m.start())):
            found.add("intermediate")
    return next((x for x in LEVELS if x in found), None)


def degree_field(text: str) -> str | None:
    """EXT-05."""
    m = _FIELD.search(text)
    return " ".join(m[1].lower().split()) if m else None


def _years(text: str, guarded: bool) -> tuple[int | None, int | None]:
    """EXT-07, EXT-08: the first tier with a match that its guard lets pass; the ends of a range are put in order."""
    for i, tier in enumerate(_TIERS):
        for m in tier.finditer(text):
            if guarded:
                before, after = clause(text, *m.span())
                if _SUBJECT.search(before[-40:]) or _SUBJECT.search(after[:40]):
                    continue
                if not (_CONTEXT.search(before) or _CONTEXT.search(after) or i == 1 or in_requirements(text, m.start())):
                    continue
            low = int(m[1])
            if i == 0:
                high = int(m[2])
                return min(low, high), max(low, high)
            return (low, low) if i == 3 else (low, None)
    return None, None


def experience_years(text: str, raw: str | None) -> tuple[int | None, int | None]:
    """EXT-10: the field of its own first, unguarded; else the text."""
    got = _years(raw, False) if raw else (None, None)
    if got == (None, None) and raw and (m := re.search(r"\d{1,2}", raw)):
        got = (int(m[0]), int(m[0]))
    return got if got != (None, None) else _years(text, True)


# Words near ``senior`` that make it someone else's level: among the four before, or the two after; how the level of those without experience is named.
_OTHERS_BEFORE = {"support", "supporting", "reporting", "report", "reports", "communicating", "communicate"}
_OTHERS_AFTER = {"management", "stakeholders", "director", "directors", "analyst", "accountants", "accountant", "manager", "managers"}
_FRESH = re.compile(r"(?<!\w)(?:fresh\s+graduate|entry\s+level)(?!\w)", re.I)


def senior_signal(text: str) -> bool:
    """EXT-11: ``senior`` as the posting's own level, not that of people it works with."""
    words = lambda part: re.findall(r"[a-z][a-z.'-]*", part.lower())
    for m in re.finditer(r"(?<!\w)senior(?!\w)", text, re.I):
        near = set(words(text[max(0, m.start() - 40) : m.start()])[-4:]) & _OTHERS_BEFORE | set(words(text[m.end() : m.end() + 30])[:2]) & _OTHERS_AFTER
        if not near:
            return True
    return False


def experience_level(text: str, low: int | None, high: int | None) -> str | None:
    """EXT-12: senior by the word, fresh by phrase, else by the least years asked for, or the most where there is no least."""
    if senior_signal(text):
        return "senior"
    years = low if low is not None else high
    if _FRESH.search(text):
        return "fresh"
    if years is None:
        return None
    return "fresh" if years <= 0 else "junior" if years <= 2 else "mid" if years <= 5 else "senior"


def structured_fields(text: str | None, raw: str | None) -> dict:
    """EXT-13: all six; blank texts have nulls and no certification."""
    t = text or ""
    low, high = experience_years(t, raw)
    return {
        "degree_level": degree_level(t), "degree_field": degree_field(t), "has_certification": bool(re.search(r"(?<!\w)certifications?(?!\w)", t, re.I)),
        "experience_min_years": low, "experience_max_years": high, "experience_level": experience_level(t, low, high),
    }


SCHEMA = "degree_level string, degree_field string, has_certification boolean, experience_min_years int, experience_max_years int, experience_level string"


def extracted(description: Column, experience_raw: Column) -> Column:
    """EXT-13 as a Column of struct type."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series, raws: pd.Series) -> pd.DataFrame:
        # postings are often published again word for word: a text that a batch repeats is read once
        known: dict[tuple, dict] = {}
        pairs = list(zip(texts, raws))
        for p in set(pairs):
            known[p] = structured_fields(*p)
        rows = [known[p] for p in pairs]
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
        for c in ("experience_min_years", "experience_max_years"):
            out[c] = out[c].astype("Int32")
        return out

    return run(description, experience_raw)
