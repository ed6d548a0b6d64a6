"""Whole answers of pages that join several results: weekly facts, briefings, companies, currencies, health (AGG-09..11, AGG-16, AGG-19, AGG-28, AGG-31, ATT-14, FCT-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cols as C
from . import forecast as W
from . import market as M

#: What a briefing shows in lists, and the sizes of the weekly lists.
BRIEFING_FIELDS = ("id", "week_start", "created_at", "body", "source", "model_version", "blocked_reason", "superseded_by")
TOP_SKILLS, COMPARED_SKILLS = 5, 10
NO_COMPARISON = "collection cadence changed after an initial bulk backfill; the prior week is not comparable"


def outcomes(graded: DataFrame) -> Column:
    """The columns of FCT-05's counts and the mean error, as one struct."""
    is_ = lambda o: F.count_if(C.outcome(F.col("abs_error"), F.col("baseline_abs_error")) == o).alias(o)
    mae = F.round(F.sum(F.col("abs_error").cast("decimal(24,6)")).cast("double") / F.count("abs_error"), 2)
    return F.struct(F.count("*").alias("count"), is_("beat"), is_("tie"), is_("lost"), mae.alias("mae"))


def named_targets(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """ATT-09: rows with ``display``: the volume's label, a skill's display name, else its key."""
    names = M.dimension(taxonomy.select(F.col("skill").alias("target_key"), "display"))
    shown = F.when(F.col("target_type") == "volume", "All postings (Mustakbil)").otherwise(F.coalesce("display", "target_key"))
    return rows.join(names, "target_key", "left").withColumn("display", shown)


def week_companies(postings: DataFrame, mentions: DataFrame, week: Column, bulk: tuple[str, ...] = ()) -> DataFrame:
    """AGG-28, AGG-30: (skill, companies) of one PKT week: different companies with a name, bulk ones left out."""
    named = F.col("company_key").isNotNull()
    own = named & ~F.col("company_key").isin(*bulk) if bulk else named
    p = M.keyed(postings).where((C.pkt_week(F.col("first_seen_at")) == week) & own)
    return mentions.join(p.select(F.col("id").alias("posting_id"), "company_key"), "posting_id").groupBy("skill", "company_key").agg(F.lit(1)).groupBy("skill").agg(F.count("*").alias("companies"))


def weekly_facts(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, forecasts: DataFrame, as_of: str, start: str, volume_source: str, automated: tuple[str, ...], bulk: tuple[str, ...] = ()) -> DataFrame:
    """AGG-31: one row of all that a briefing may say about the week before ``as_of``.

    Structs: last_week (graded outcomes, mean error), running (of all graded weeks), volume (of one source; compared only if
    both weeks lie after the collection's ``start``); arrays: graded (targets with predicted, actual, baseline, outcome),
    predictions (of the week that runs), top (five skills by companies, automated sources, substantive skills alone), entered
    and left (against the week before, among ten).  forecasts: target_type, target_key, target_week_start, predicted,
    baseline_predicted, actual, abs_error, baseline_abs_error, graded_at.  Arrays hold a week's targets, which are few.
    """
    spark = postings.sparkSession
    now = W.as_of_date(as_of, pkt=True)
    last, prior = F.date_sub(now, 7), F.date_sub(now, 14)
    one = spark.range(1).select(last.alias("week_start"), now.alias("next_week_start"), prior.alias("prior_week"))
    done = forecasts.where(F.col("graded_at").isNotNull())
    of_week = named_targets(done.where(F.col("target_week_start") == last), taxonomy)
    two = lambda c: F.round(F.col(c).cast("double"), 2).alias(c)
    targets = F.array_sort(F.collect_list(F.struct("target_type", "target_key", "display", two("predicted"), two("actual"), two("baseline_predicted"), C.outcome(F.col("abs_error"), F.col("baseline_abs_error")).alias("outcome"))))
    week = of_week.agg(outcomes(of_week).alias("last_week"), targets.alias("graded"))
    running = done.agg(outcomes(done).alias("running"))
    new = named_targets(forecasts.where(F.col("target_week_start") == now), taxonomy).agg(F.array_sort(F.collect_list(F.struct("target_type", "target_key", "display", two("predicted")))).alias("predictions"))
    facts = W.weekly_facts(postings.where(F.col("source") == volume_source), as_of, start)
    both = prior >= C.pkt_week(F.lit(start).cast("timestamp"))
    volume = facts.select(F.struct("volume", F.when(both, F.col("volume_before")).alias("volume_before"), "change", "change_pct", both.alias("comparable"), F.when(~both, NO_COMPARISON).alias("reason")).alias("volume"))
    own = postings.where(F.col("source").isin(*automated))
    market = mentions.join(M.dimension(taxonomy.where(C.substantive(F.col("category"), F.col("requirement_type"))).select("skill")), "skill")
    ranked = []
    for w in (last, prior):
        r = F.row_number().over(Window.orderBy(F.desc("companies"), "skill"))  # after the limit, of ten rows
        best = week_companies(own, market, w, bulk).orderBy(F.desc("companies"), "skill").limit(COMPARED_SKILLS)
        ranked.append(best.withColumn("place", r))
    names = M.dimension(taxonomy.select("skill", "display"))
    shown = F.coalesce("display", "skill").alias("display")
    this, before = (x.join(names, "skill", "left") for x in ranked)
    top = this.where(F.col("place") <= TOP_SKILLS).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "skill", shown, "companies"))), lambda x: F.struct(x["skill"].alias("skill"), x["display"].alias("display"), x["companies"].alias("companies"))).alias("top"))
    listed = lambda a, b, name: a.join(b.select("skill"), "skill", "left_anti").agg(F.array_sort(F.collect_list(F.struct("skill", shown))).alias(name))
    out = one
    for part in (week, running, new, volume, top, listed(this, before, "entered"), listed(before, this, "left")):
        out = out.crossJoin(part)  # one row each
    return out.drop("prior_week")


def briefing_summary(briefings: DataFrame) -> DataFrame:
    """ATT-14: what lists of briefings show; a field that the table lacks is null."""
    return briefings.select(*[F.col(c) if c in briefings.columns else F.lit(None).cast("string").alias(c) for c in BRIEFING_FIELDS])


def briefings_list(briefings: DataFrame, limit: int = 12) -> DataFrame:
    """FCT-07, SRT-08: every briefing, superseded ones too, newest week first, then newest; 1 to 52 of them."""
    if not 1 <= limit <= 52:
        raise ValueError("limit is 1 to 52")
    return briefing_summary(briefings).orderBy(F.desc("week_start"), F.desc("created_at"), F.desc("id")).limit(limit)


def latest_briefing(briefings: DataFrame) -> DataFrame:
    """FCT-07, FLT-16, JOI-13: the current briefing of the newest week with ``supersedes``, the summary of the one it replaced (null if none); no rows without one."""
    current = briefings.where("superseded_by IS NULL").orderBy(F.desc("week_start"), F.desc("created_at"), F.desc("id")).limit(1)
    old = briefing_summary(briefings).where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("_new"), F.struct(*BRIEFING_FIELDS).alias("_old"))
    j = current.join(old, F.col("id") == F.col("_new"), "left")
    keep = [c for c in BRIEFING_FIELDS if c in briefings.columns] + [c for c in briefings.columns if c == "facts_json"]
    return j.groupBy(*keep).agg(F.min_by("_old", "_old.id").alias("supersedes"))


def company_summaries(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, tags: DataFrame, include_soft: bool = False, limit: int | None = 25) -> DataFrame:
    """AGG-09, AGG-10: the companies of most postings with cities, five skills and their counts, quartiles of pay in the home currency, and how many tag lists repeat.

    tags: posting_id, tag; a company without tagged postings has a null share.
    """
    if limit is not None and not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    p = M.keyed(postings).where(F.col("company_key").isNotNull())
    n = p.groupBy("company_key", "company").agg(F.count("*").alias("k")).groupBy("company_key").agg(F.sum("k").alias("posting_count"), F.min_by("company", F.struct(-F.col("k"), F.col("company"))).alias("company"))
    top = n.orderBy(F.desc("posting_count"), "company_key")
    top = M.dimension(top.limit(limit) if limit else top)
    p = p.join(top.select("company_key"), "company_key", "left_semi")
    city = F.array_sort(F.collect_set(C.city_norm(F.col("city")))).alias("cities")
    pay = F.when(F.coalesce("currency", F.lit(C.HOME_CURRENCY)) == C.HOME_CURRENCY, C.salary_point(F.col("salary_min"), F.col("salary_max")))
    figures = p.withColumn("_v", pay).groupBy("company_key").agg(city, F.struct(*M.iqr_columns(F.col("_v"))).alias("salary"))
    dim = M.dimension(taxonomy.where(F.lit(include_soft) | (F.col("category") != "soft")).select("skill", "ord"))
    k = mentions.join(p.select(F.col("id").alias("posting_id"), "company_key"), "posting_id").join(dim, "skill").groupBy("company_key", "skill", "ord").agg(F.count("*").alias("n"))
    w = Window.partitionBy("company_key").orderBy(F.desc("n"), "ord")
    five = k.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("company_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "skill", "n"))), lambda x: F.struct(x["skill"].alias("skill"), x["n"].alias("count"))).alias("top_skills"))
    same = M.templated_share(p.drop("company_key"), tags).select("company_key", "tagged", "repeated", "templated_share")
    j = top.join(figures, "company_key").join(five, "company_key", "left").join(same, "company_key", "left")
    none = F.expr("CAST(array() AS array<struct<skill: string, count: bigint>>)")
    return j.select("company", "company_key", "posting_count", "cities", F.coalesce("top_skills", none).alias("top_skills"), "salary", F.struct(F.coalesce("tagged", F.lit(0)).alias("tagged"), F.coalesce("repeated", F.lit(0)).alias("templated"), F.col("templated_share").alias("share")).alias("templated"))


def company_page(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, tags: DataFrame, name: str, recent_limit: int = 20, include_soft: bool = False) -> tuple[DataFrame, DataFrame]:
    """AGG-11: (summary, recent postings with their skills) of one company; an unknown one is an error."""
    if not 1 <= recent_limit <= 100:
        raise ValueError("recent_limit is 1 to 100")
    own = M.keyed(postings).where(F.col("company_key") == " ".join(name.split()).lower())
    if own.isEmpty():
        raise KeyError(f"unknown company: {name}")
    own = own.select(*postings.columns)
    recent = own.orderBy(F.col("first_seen_at").desc_nulls_last(), "id").limit(recent_limit)
    skills = mentions.join(F.broadcast(recent.select(F.col("id").alias("posting_id"))), "posting_id").groupBy("posting_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    shown = [F.col(c) if c in recent.columns else F.lit(None).cast("string").alias(c) for c in ("id", "title", "city", "posting_date", "source", "detail_url")]
    rows = recent.join(skills, recent["id"] == skills["posting_id"], "left").select(*shown, F.coalesce("skills", F.expr("CAST(array() AS array<string>)")).alias("skills"))
    return company_summaries(own, mentions, taxonomy, tags, include_soft, 1), rows


def foreign_postings(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """AGG-16, FLT-07: postings in another currency with their skills, soft ones left out, sorted."""
    f = postings.where(F.col("currency").isNotNull() & (F.col("currency") != "") & (F.col("currency") != C.HOME_CURRENCY))
    m = M.mentions_of(mentions, f).join(M.dimension(taxonomy.where("category <> 'soft'").select("skill")), "skill")
    own = m.groupBy("posting_id").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    shown = [F.col(c) if c in f.columns else F.lit(None).cast("string").alias(c) for c in ("id", "currency", "salary_min", "salary_max", "title", "company", "city", "detail_url")]
    return f.join(own, f["id"] == own["posting_id"], "left").select(*shown, F.coalesce("skills", F.expr("CAST(array() AS array<string>)")).alias("skills"))


def health(postings: DataFrame, mentions: DataFrame, as_of: str, enriched_source: str = "mustakbil") -> DataFrame:
    """AGG-19: one row: postings added in a day and in seven (from then on), share of one source with tags, share with mentions, hours since the newest sighting, rows of both tables."""
    now = F.lit(as_of).cast("timestamp")
    added = lambda days: F.count_if(F.col("first_seen_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    own = F.col("source") == enriched_source
    full = own & ~C.skills_raw_empty(F.col("skills_raw"))
    p = postings.agg(F.count("*").alias("postings"), added(1).alias("added_24h"), added(7).alias("added_7d"), F.round(F.count_if(full) / F.nullif(F.count_if(own), F.lit(0)), 4).alias("enrichment_coverage"), C.hours_between(F.max("last_seen_at"), now).alias("freshness_hours"))
    m = mentions.groupBy("posting_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("with_mention"), F.coalesce(F.sum("n"), F.lit(0)).alias("skill_mentions"))
    return p.crossJoin(m).select("added_24h", "added_7d", "enrichment_coverage", F.round(F.col("with_mention") / F.nullif("postings", F.lit(0)), 4).alias("extraction_coverage"), "freshness_hours", "postings", "skill_mentions")
