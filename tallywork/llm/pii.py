"""Personal data by weak supervision, in DataFrame operations only.

Patterns with checks find the base spans, which always stay.  Looser patterns propose candidates.  Labelers vote on each
candidate, or abstain: the format, a gazetteer, words before it, words that speak against it, and its surroundings.
The votes of all documents are counted; expectation-maximisation over those counts estimates how reliable each labeler
is and how likely each pattern of votes is personal data, and a naive Bayes model on span features is trained on that.
Both tables are bounded by the numbers of kinds, votes and feature values, whatever the corpus.  The model, as an
expression, then judges each document's candidates where the document is: no row is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
# Possessive repeats and look-behinds keep the patterns linear on long texts; they match what the plain ones match.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign that a text can hold a match at all, looked for first.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_KEYWORDS = r"pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
LOOSE = {
    "email": r"(?i)(?<![\w.])[a-z0-9][a-z0-9._-]{1,40} ?(?:\(at\)|\[at\]|\{at\}) ?[a-z0-9-]{2,40}(?: ?(?:\(dot\)|\[dot\]|\.) ?[a-z]{2,10}){1,3}",
    "phone": r"(?<![\w+.(/-])(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "secret": rf"(?i)(?<![a-z])(?:{_KEYWORDS})\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"'<>]{{6,200}}|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,60}}|sk-[A-Za-z0-9-]{{16,80}}|xox[abp]-[A-Za-z0-9-]{{10,60}}|eyJ[A-Za-z0-9_-]{{10,400}}\.[A-Za-z0-9_-]{{10,400}}\.[A-Za-z0-9_-]{{10,400}})",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
_LOOSE_NEEDS = {"email": r"(?i)[(\[{]at[)\]}]", "phone": r"\d{3}[ .-]\d{4}", "secret": rf"(?i)(?:{_KEYWORDS})\s{{0,3}}[=:]|AKIA|gh[pousr]_|sk-|xox|eyJ", "ssn": r"\d-\d{2}-\d", "iban": r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}"}
#: Words that speak for a kind when they stand before a candidate, and words that speak against any.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\W*$|\bto\W*$", "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp)\b[^.\n]{0,12}$", "secret": r"(?i)\b(?:key|login|user|export|config|secret|token)\b[^.\n]{0,12}$",
    "ssn": r"(?i)\b(?:ssn|social|security|tax)\b[^.\n]{0,16}$", "iban": r"(?i)\b(?:iban|account|bank|transfer)\b[^.\n]{0,16}$",
}
AGAINST = r"(?i)\b(?:isbn|version|release|order|invoice|ref|part|serial|doi|page|pages|section|figure|build)\b[^.\n]{0,8}$"
_COUNTRIES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK"
LABELERS = ("format", "gazetteer", "context", "against", "apart")
FEATURES = ("kind", "before", "length", "digits", "upper", "near", "form")


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches: start and end in code points, end exclusive.

    The pieces between matches and the matches alternate, so their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.greatest(F.size(found), F.lit(1))), lambda v, p: F.struct(v.alias("v"), F.length(p).alias("n")))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    step = lambda s, x: F.struct(
        (s["at"] + x["n"] + F.length(x["v"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["n"]).alias("start"), (s["at"] + x["n"] + F.length(x["v"])).alias("end"), x["v"].alias("value")))).alias("out"),
    )
    return F.aggregate(F.filter(zipped, lambda x: x["v"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def valid(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: valid(kind, s["value"])


def _numbered(spans: Column, no: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end>>, sorted."""
    none = F.expr("CAST(array() AS array<struct<start:int,kind_no:int,end:int>>)")
    parts = []
    for no, kind in enumerate(BASE):
        spans = _numbered(F.filter(located(text, BASE[kind]), _check(kind)), no)
        need = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")
        parts.append(F.when(need, spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _proposed(text: Column, base: Column, pattern: str, no: int) -> Column:
    free = F.filter(located(text, pattern), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    near = lambda s: F.exists(base, lambda b: (b["end"] > s["start"] - 200) & (b["start"] < s["end"] + 200))
    return F.transform(
        free,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), s["value"].alias("value"),
            F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40))).alias("before"), F.substring(text, s["end"] + 1, F.lit(8)).alias("after"),
            F.when(near(s), 1).otherwise(0).alias("near"),
        ),
    )


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, end, kind_no, value, before, after, near>>: what the looser patterns propose beside the base spans."""
    none = F.expr("CAST(array() AS array<struct<start:int,kind_no:int,end:int,value:string,before:string,after:string,near:int>>)")
    parts = []
    for kind, pattern in LOOSE.items():
        full = _proposed(text, base, pattern, KINDS.index(kind))
        parts.append(F.when(text.rlike(_LOOSE_NEEDS[kind]), full).otherwise(none))
    return F.concat(*parts)


def _by_kind(c: Column, of) -> Column:
    return reduce(lambda e, k: e.when(c["kind_no"] == KINDS.index(k), of(k)), LOOSE, F.when(F.lit(False), F.lit(None).cast("int")))


def votes(c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, 0, or -1 to abstain."""
    v = c["value"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    strict = {
        "email": v.rlike(r"(?i)(?:at).*(?:dot|\.)"), "phone": F.length(digits).between(9, 12), "secret": v.rlike(r"(?=.*[0-9])(?=.*[A-Za-z])"),
        "ssn": ~v.rlike(r"^(?:000|666|9\d\d)|-00-|0000$"), "iban": F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & (F.length(digits) >= 8),
    }
    known = {
        "email": v.rlike(r"(?i)(?:com|net|org|edu|gov|io|info|de|fr|es|uk|pk)$"), "phone": ~v.rlike(r"^\(?[01]"), "secret": v.rlike(rf"(?i)^(?:{_KEYWORDS})|^(?:AKIA|gh|sk-|xox|eyJ)"),
        "ssn": v.rlike(r"^[0-8]"), "iban": v.rlike(f"^(?:{_COUNTRIES})"),
    }
    bit = lambda e: F.when(e, 1).otherwise(0)
    return {
        "format": _by_kind(c, lambda k: bit(strict[k])),
        "gazetteer": _by_kind(c, lambda k: bit(known[k])),
        "context": F.when(_by_kind(c, lambda k: bit(c["before"].rlike(CONTEXT[k]))) == 1, 1).otherwise(-1),
        "against": F.when(c["before"].rlike(AGAINST), 0).otherwise(-1),
        "apart": bit(~c["before"].rlike(r"\w$") & ~c["after"].rlike(r"^\w")),
    }


def span_features(c: Column) -> dict[str, Column]:
    v = c["value"]
    n = F.length(v)
    return {
        "kind": c["kind_no"],
        "before": F.when(_by_kind(c, lambda k: F.when(c["before"].rlike(CONTEXT[k]), 1).otherwise(0)) == 1, 2).when(c["before"].rlike(AGAINST), 0).otherwise(1),
        "length": F.when(n < 10, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3),
        "digits": F.floor(F.length(F.regexp_replace(v, "[^0-9]", "")) * 4 / n).cast("int"),
        "upper": F.when(v.rlike("[A-Z]"), 1).otherwise(0),
        "near": c["near"],
        "form": votes(c)["format"],
    }


def estimate(counts: list[dict], rounds: int = 30) -> dict[tuple, float]:
    """Posterior of each pattern (kind and votes) by expectation-maximisation; ``counts`` rows have kind, the votes and n."""
    pattern = lambda r: (r["kind"], *(r[x] for x in LABELERS))
    n: dict[tuple, float] = defaultdict(float)
    for r in counts:
        n[pattern(r)] += r["n"]
    given = lambda p: [v for v in p[1:] if v >= 0]
    post = {p: (sum(given(p)) + 0.5) / (len(given(p)) + 1) for p in n}
    for _ in range(rounds):
        rate = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in LABELERS]  # labeler, class, vote + 1
        prior: dict[int, list[float]] = defaultdict(lambda: [1.0, 1.0])
        for p, m in n.items():
            for y, q in ((1, post[p]), (0, 1 - post[p])):
                prior[p[0]][y] += m * q
                for j, v in enumerate(p[1:]):
                    rate[j][y][v + 1] += m * q
        for j in range(len(LABELERS)):
            for y in (0, 1):
                total = sum(rate[j][y])
                rate[j][y] = [x / total for x in rate[j][y]]
            # a vote for must not count against: which class is which is fixed by the labelers' meaning
            if rate[j][1][2] < rate[j][0][2] or rate[j][1][1] > rate[j][0][1]:
                rate[j] = [[(a + b) / 2 for a, b in zip(*rate[j])]] * 2
        for p in n:
            z = math.log(prior[p[0]][1] / prior[p[0]][0]) + sum(math.log(rate[j][1][v + 1] / rate[j][0][v + 1]) for j, v in enumerate(p[1:]))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
    return post


def classifier(counts: list[dict]) -> tuple[float, dict[str, dict[int, float]]]:
    """Naive Bayes log odds, from the posteriors: the prior's, and each feature value's."""
    post = estimate(counts)
    total = [1.0, 1.0]
    seen: dict = {f: defaultdict(lambda: [0.5, 0.5]) for f in FEATURES}
    for r in counts:
        q = post[(r["kind"], *(r[x] for x in LABELERS))]
        for y, w in ((1, q * r["n"]), (0, (1 - q) * r["n"])):
            total[y] += w
            for f in FEATURES:
                seen[f][r["kind"] if f == "kind" else r["f_" + f]][y] += w
    odds = {f: {v: math.log(c[1] / (total[1] + 1)) - math.log(c[0] / (total[0] + 1)) for v, c in of.items()} for f, of in seen.items()}
    return math.log(total[1] / total[0]), odds


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.0) -> DataFrame:
    """``docs`` with ``base`` and ``added``: sorted array<struct<start, kind_no, end>>; kind_no counts KINDS from 0.

    Spans are in code points of the whole text, end exclusive; null and empty texts have none.  base are the checked
    matches, added the candidates whose log odds under the trained model are above ``bar``.  All columns stay (those
    called base or added are replaced); rows are returned as often as given; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = docs.select(F.struct(*docs.columns).alias("row"), text.alias("_text")).withColumn("base", base_spans(F.col("_text")))
    seen = start.select("_text", "base").select(F.explode(candidates(F.col("_text"), F.col("base"))).alias("c"))
    c = F.col("c")
    by = {"kind": c["kind_no"]} | votes(c) | {"f_" + k: v for k, v in span_features(c).items() if k != "kind"}
    counts = [r.asDict() for r in seen.groupBy(*[v.alias(k) for k, v in by.items()]).agg(F.count("*").alias("n")).collect()]
    prior, odds = classifier(counts)

    def score(x: Column) -> Column:
        of = span_features(x)
        parts = [reduce(lambda e, kv: e.when(of[f] == kv[0], kv[1]), sorted(odds[f].items()), F.when(F.lit(False), F.lit(0.0))).otherwise(0.0) for f in FEATURES]
        return reduce(lambda a, b: a + b, parts, F.lit(prior))

    kept = F.filter(candidates(F.col("_text"), F.col("base")), lambda x: score(x) > bar)
    added = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind_no"].alias("kind_no"), x["end"].alias("end"))))
    return start.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("base", "added")], "base", added.alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    name = lambda n: F.element_at(F.array(*map(F.lit, KINDS)), n + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, their hash, and all spans spelled out."""
    found = find_spans(docs.select(id_col, text_col), id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col(id_col).alias("doc_id"), *map(count, BASE), F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; overlapping spans become the first one's."""
    found = find_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), "row", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda n: F.element_at(F.array(*map(F.lit, KINDS)), n + 1)
    take = lambda a, b: F.substring(text, a + 1, b - a)
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], take(s["at"], x["start"]), F.lit("<"), F.upper(name(x["kind_no"])), F.lit(">")).alias("out"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))
    spans = F.array_sort(F.concat("base", "added"))
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    new = found.select("row", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")).alias("new"))
    return new.select(*[F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
