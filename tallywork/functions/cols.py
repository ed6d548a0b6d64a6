"""Derived attributes, each defined once (ATT-01..14, DAT-01..05, FLT-02..10, MTH)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The market's rules.
BULK_SHARE = 0.25
HIDDEN_CATEGORIES = ("soft", "office_admin")
MARKET_DOMAINS = ("technology_it", "engineering")
HOME_CURRENCY = "PKR"
LEVELS = ("fresh", "junior", "mid", "senior")
BANDS = ("Entry (0-1 yrs)", "Junior (2-3 yrs)", "Mid (4-6 yrs)", "Senior (7+ yrs)", "Unspecified")
PKT_HOURS = 5


def company_key(company: Column) -> Column:
    """ATT-01: white space collapsed, trimmed, lower case; the empty name is no company."""
    return F.lower(F.trim(F.regexp_replace(F.when(company != "", company), r"(?U)\s+", " ")))


def city_norm(city: Column) -> Column:
    """Trimmed, each run of letters capitalised; blank is null."""
    bare = F.trim(city)
    marked = F.regexp_replace(F.lower(bare), r"(\p{L}+)", "\u0001$1")
    titled = F.array_join(F.transform(F.split(marked, "\u0001"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2_147_483_647))), "")
    return F.when(bare != "", titled)


def salary_point(low: Column, high: Column) -> Column:
    """ATT-03: the midpoint, else whichever is there."""
    return F.coalesce((low + high) / 2, low.cast("double"), high.cast("double"))


def experience_band(raw: Column) -> Column:
    """ATT-02: by words, else by the first number; one year or less is an entry as well."""
    text = F.lower(F.coalesce(raw, F.lit("")))
    years = F.regexp_extract(text, r"(\d+)", 1).try_cast("decimal(38,0)")
    entry = F.contains(text, F.lit("fresh")) | F.contains(text, F.lit("entry")) | F.contains(text, F.lit("intern"))
    return F.when(entry | (years <= 1), BANDS[0]).when(years <= 3, BANDS[1]).when(years <= 6, BANDS[2]).when(text.rlike(r"\d"), BANDS[3]).otherwise(BANDS[4])


def blank(text: Column) -> Column:
    """ATT-05."""
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def skills_raw_empty(raw: Column) -> Column:
    """ATT-04: over the JSON text of tags, in any of its shapes: null, [], list, object with required_skills_text, text."""
    v = F.try_parse_json(raw)
    inner = F.try_variant_get(v, "$.required_skills_text", "string")
    kind = F.schema_of_variant(v)
    return F.when(blank(raw) | F.trim(raw).isin("[]", "{}", "null", '""'), True).when(kind.startswith("OBJECT"), blank(inner)).otherwise(False)


def skills_raw_text(raw: Column) -> Column:
    """STR-03: tags as text, from a list, an object, JSON text of either, or the text itself."""
    v = F.try_parse_json(raw)
    listed = F.array_join(F.try_variant_get(v, "$", "array<string>"), " ")
    return F.when(raw.isNull(), "").otherwise(F.coalesce(listed, F.try_variant_get(v, "$.required_skills_text", "string"), F.when(F.schema_of_variant(v).startswith("OBJECT"), "").otherwise(raw)))


def text_bucket(description: Column, tags: Column) -> Column:
    """ATT-06: A has a text, B only tags, C neither."""
    return F.when(~blank(description), "A").when(~skills_raw_empty(tags), "B").otherwise("C")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def utc_week(ts: Column) -> Column:
    """DAT-02: Monday of the UTC date."""
    return F.to_date(F.date_trunc("week", ts))


def pkt_week(ts: Column) -> Column:
    """DAT-03: the Monday, as a date, of the week in UTC+5."""
    return F.to_date(F.date_trunc("week", ts + F.expr(f"INTERVAL {PKT_HOURS} HOURS")))


def bucket_of(ts: Column, granularity: str) -> Column:
    if granularity not in ("day", "week"):
        raise ValueError("granularity is day or week")
    return utc_day(ts) if granularity == "day" else utc_week(ts)


def lifespan_days(first: Column, last: Column) -> Column:
    """DAT-04."""
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 86_400e6


def hours_between(first: Column, last: Column) -> Column:
    """DAT-05, to two places."""
    return F.round((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3_600e6, 2)


def substantive(category: Column, requirement_type: Column) -> Column:
    """FLT-02, FLT-03: a skill proper outside the hidden categories; unknown is not."""
    return F.coalesce((requirement_type == "skill") & ~category.isin(*HIDDEN_CATEGORIES), F.lit(False))


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """MTH-04, MTH-07: a ratio, 0 where the whole is."""
    return F.round(F.when(whole == 0, 0.0).otherwise(part / whole), places)


def outcome(error: Column, baseline_error: Column) -> Column:
    """FCT-05: beat, tie or lost, on the errors as stored."""
    return F.when(error < baseline_error, "beat").when(error == baseline_error, "tie").when(error > baseline_error, "lost")
