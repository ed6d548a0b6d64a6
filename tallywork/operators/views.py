"""What the market's pages show: names, orderings, matches and steps built on the other operators (ATT-09, FLT-12, FLT-17, SRT-04, SRT-06, SRT-07, AGG-11, AGG-17, AGG-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cols as C
from .market import _level_no, _levelled, companies_top, dimension, distinct_counts, family_paths, keyed, templated_share

# A skill counts in a level's signature from so many companies on; a match covers this share of one.
LEAST_COMPANIES = 3
MATCH_BAR = 0.7
VOLUME_NAME = "All postings (Mustakbil)"


def with_display(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """ATT-09: ``rows`` (target_type, target_key, ...) with ``display``: the label of volumes, a skill's display name, else the key."""
    named = rows.join(dimension(taxonomy.select(F.col("skill").alias("target_key"), F.col("display").alias("_display"))), "target_key", "left")
    return named.select(*rows.columns, F.when(F.col("target_type") == "volume", VOLUME_NAME).otherwise(F.coalesce("_display", "target_key")).alias("display"))


def pending_forecasts(forecasts: DataFrame, taxonomy: DataFrame, contaminated: tuple[str, ...] = ()) -> DataFrame:
    """FCT-06, FLT-11, FLT-12, SRT-06: ungraded rows with display names and a mark on the weeks of another collection regime, in the order of week, type and key."""
    note = F.coalesce(F.col("target_week_start").cast("string").isin(*contaminated), F.lit(False)) if contaminated else F.lit(False)
    return with_display(forecasts.where("graded_at IS NULL"), taxonomy).withColumn("collection_regime_note", note).orderBy("target_week_start", "target_type", "target_key")


def backtest_detail(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """FCT-06, SRT-06: backtest rows with display names, all keys descending."""
    return with_display(rows, taxonomy).orderBy(F.desc("target_week_start"), F.desc("target_type"), F.desc("target_key"))


def by_target(summary: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """SRT-07: outcome counts of each target, in the order of type, most rows first, key; ``place`` is the row's number."""
    w = Window.orderBy("target_type", F.desc("n"), "target_key")
    return with_display(summary.where("target_type <> 'overall'"), taxonomy).withColumn("place", F.row_number().over(w))


def curriculum_gaps(alignment: DataFrame) -> DataFrame:
    """SRT-04: demanded skills that no course teaches, by companies, then postings, then name."""
    w = Window.orderBy(F.desc("company_count"), F.desc("posting_count"), "skill")
    return alignment.where("status = 'gap'").select("skill", "company_count", "posting_count").withColumn("place", F.row_number().over(w))


def ignored_skills(taxonomy: DataFrame, skills: list[str]) -> DataFrame:
    """FLT-17: which of ``skills`` a match leaves out, and why: soft ones, and what is no skill.  Unknown ones are an error."""
    asked = taxonomy.sparkSession.createDataFrame([(s,) for s in sorted(set(skills))], "skill string")
    j = asked.join(taxonomy, "skill", "left").select("skill", "category", "requirement_type")
    unknown = [r["skill"] for r in j.where("category IS NULL AND requirement_type IS NULL").collect()]
    if unknown:
        raise KeyError(f"unknown skills: {unknown}")
    why = F.when(F.col("category") == "soft", "soft").when(F.col("requirement_type") != "skill", "non_skill")
    return j.select("skill", why.alias("ignored")).where("ignored IS NOT NULL")


def strong_matches(postings: DataFrame, covered: DataFrame, limit: int = 50) -> DataFrame:
    """AGG-17, SRT-11: the newest postings of :func:`market.coverage` that are strong matches; unseen dates last, ties by id."""
    ids = covered.where("strong").select(F.col("posting_id").alias("id"))
    return postings.join(ids, "id", "left_semi").orderBy(F.col("first_seen_at").desc_nulls_last(), "id").limit(limit).select("id", "company", "city", "detail_url")


def signatures(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, least_postings: int = 15, least_companies: int = LEAST_COMPANIES, tasks: int | None = None) -> DataFrame:
    """AGG-26: (job_family, experience_level, skill): the skills, soft ones left out, that enough companies ask for at a level of a family with data."""
    p = _levelled(postings, least_postings).select(F.col("id").alias("posting_id"), "job_family", "experience_level", "company_key")
    dim = dimension(taxonomy.where("category <> 'soft'").select("skill"))
    n = distinct_counts(mentions.join(p, "posting_id").join(dim, "skill"), ["job_family", "experience_level", "skill"], tasks).withColumnRenamed("c", "companies").drop("k")
    return n.where(F.col("companies") >= least_companies).drop("companies")


def best_match(signature: DataFrame, skills: list[str], bar: float = MATCH_BAR) -> DataFrame:
    """AGG-26: the level whose signature ``skills`` cover best, or no row: share, then size of the signature, then family and level decide."""
    hit = F.count_if(F.col("skill").isin(*skills)) if skills else F.lit(0).cast("long")
    n = signature.groupBy("job_family", "experience_level").agg(F.count("*").alias("size"), hit.alias("covered"))
    fits = n.where(F.col("covered") >= bar * F.col("size")).withColumn("match_fraction", F.round(F.col("covered") / F.col("size"), 3))
    return fits.orderBy(F.desc("match_fraction"), F.desc("size"), "job_family", _level_no()).limit(1)


def next_level(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, skills: list[str], least_postings: int = 15, tasks: int | None = None) -> DataFrame:
    """AGG-26: the best match and the skills that grow towards the family's next level, one a row (null where it is the top one)."""
    best = best_match(signatures(postings, mentions, taxonomy, least_postings, tasks=tasks), skills).withColumnRenamed("experience_level", "your_level")
    steps = family_paths(postings, mentions, taxonomy, least_postings, LEAST_COMPANIES, tasks).select("job_family", F.col("level_from").alias("your_level"), F.col("level_to").alias("next_level"), "skill", "delta")
    return F.broadcast(best).join(steps, ["job_family", "your_level"], "left").select("job_family", "your_level", "match_fraction", "next_level", "skill", "delta")


def company_profile(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, tags: DataFrame, name: str, recent_limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """AGG-11: (summary, recent) of a company: its row of :func:`market.companies_top` with its templated share, and its newest postings; an unknown one is an error."""
    key = " ".join(name.split()).lower()
    own = keyed(postings).where(F.col("company_key") == key)
    if own.isEmpty():
        raise KeyError(f"unknown company: {name}")
    own = own.select(*postings.columns)
    summary = companies_top(own, mentions, taxonomy, limit=1).join(templated_share(own, tags), "company_key", "left")
    recent = own.orderBy(F.col("first_seen_at").desc_nulls_last(), "id").limit(recent_limit)
    return summary, recent


def number_text(n: Column) -> Column:
    """STR-24: a rounded number with thousands commas."""
    return F.format_number(F.floor(n + 0.5), 0)


def percent_text(share: Column, places: int = 0) -> Column:
    """STR-24: a share in percent."""
    return F.concat(F.format_string(f"%.{places}f", (share * 100).cast("double")), F.lit("%"))


def relative_time(then: Column, now: Column) -> Column:
    """STR-24: ``just now``, hours, days or weeks ago, from whole hours, half an hour up."""
    hours = F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3_600e6 + 0.5))
    days = F.floor(hours / 24)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(hours < 1, "just now").when(hours < 24, ago(hours, "h")).when(days < 7, ago(days, "d")).otherwise(ago(F.floor(days / 7), "w"))


def scope_text(scope: Column) -> Column:
    """STR-24, STR-18: ``a,b`` as ``A + B``; a dash for none."""
    parts = F.filter(F.transform(F.split(scope, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.coalesce(scope, F.lit("")) == "", "—").otherwise(F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 2_147_483_647))), " + "))


def course_title(raw: Column) -> Column:
    """STR-23: a title without the capitals of a prerequisite before it, unless it is all capitals or ``&`` follows."""
    short = F.regexp_extract(raw, r"^[A-Z]{2,6}\s+(?=[^\s&])", 0)
    return F.trim(F.when((short != "") & (F.upper(raw) != raw), F.substring(raw, F.length(short) + 1, 2_147_483_647)).otherwise(raw))


def json_array_text(said: Column) -> Column:
    """STR-19: the first form: inside a code fence the widest array, else from the first bracket to the last, else all of it."""
    text = F.trim(said)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*\])\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare).otherwise(text)


def last_json_array(said: Column) -> Column:
    """STR-19: the second form: the array of the last code fence of several, else the first array whose brackets close, else what follows the first bracket, else all of it.

    Brackets are counted over pieces (a string literal with its escapes, a bracket, other text), so those inside strings do not count.
    """
    text = F.trim(said)
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\[.*?\])\s*```"), F.lit(1))
    rest = F.regexp_extract(text, r"(?s)(\[.*)", 1)
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)("(?:\\.|[^"\\])*"?|[\[\]]|[^"\[\]]+)'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("closed"))

    def step(s: Column, p: Column) -> Column:
        depth = s["depth"] + F.when(p == "[", 1).when(p == "]", -1).otherwise(0)
        return F.when(s["closed"], s).otherwise(F.struct(depth.alias("depth"), (s["at"] + F.length(p)).alias("at"), (depth == 0).alias("closed")))

    end = F.aggregate(pieces, start, step)
    scanned = F.when(end["closed"], F.substring(rest, F.lit(1), end["at"])).otherwise(rest)
    return F.when(F.size(fences) > 0, F.element_at(fences, -1)).when(rest != "", scanned).otherwise(text)


def batches(n: Column, size: int) -> Column:
    """MTH-08: how many batches of ``size`` hold ``n`` rows."""
    return F.ceil(n / size)


def experience_share(postings: DataFrame) -> DataFrame:
    """ATT-02: postings of each experience band and their share."""
    n = postings.groupBy(C.experience_band(F.col("experience_raw")).alias("band")).agg(F.count("*").alias("n"))
    whole = F.broadcast(n.agg(F.sum("n").alias("whole")))
    return n.crossJoin(whole).select("band", "n", C.share(F.col("n"), F.col("whole")).alias("share"))
