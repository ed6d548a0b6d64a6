"""Weeks, trends, forecasts, grading and backtests (WIN-01..11, 16; FCT-01..06; AGG-20, 21, 27..31; JOI-14..16).

A posting belongs to one week, so weekly counts are made once and every trailing statistic is a window over the grid of
keys and weeks, gaps filled with zeros.  ``as_of`` is a parameter everywhere; a week that it lies in is not complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cols as C
from .market import dimension, without_bulk

# Fixed values of the model.
MEAN_WEEKS, SPREAD_WEEKS, SPREAD = 3, 4, 1.5
TARGETS = 12
MODEL = "trailing-mean-v1"


def as_of_date(as_of: str, pkt: bool = False) -> Column:
    ts = F.lit(as_of).cast("timestamp")
    return C.pkt_week(ts) if pkt else C.utc_week(ts)


def calendar(first: DataFrame, step: str) -> DataFrame:
    """WIN-02: ``first`` has one row (low, high) of dates; every bucket from low to high."""
    return first.select(F.explode(F.sequence("low", "high", F.expr(f"INTERVAL 1 {step}"))).alias("bucket")).select(F.col("bucket").cast("date").alias("bucket"))


def skill_trend(postings: DataFrame, mentions: DataFrame, skills: list[str], granularity: str, as_of: str) -> DataFrame:
    """WIN-01..03: per bucket of each skill: its postings, all postings, the bucket before's value, and whether the bucket still runs."""
    step = "DAY" if granularity == "day" else "WEEK"
    p = postings.select("id", C.bucket_of(F.col("first_seen_at"), granularity).alias("bucket")).where(F.col("bucket").isNotNull())
    totals = p.groupBy("bucket").agg(F.count("*").alias("total"))
    have = mentions.where(F.col("skill").isin(*skills)).select(F.col("posting_id").alias("id"), "skill").distinct().join(p, "id").groupBy("skill", "bucket").agg(F.count("*").alias("n"))
    days = calendar(totals.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")), step)
    names = postings.sparkSession.createDataFrame([(s,) for s in skills], "skill string")
    grid = days.crossJoin(F.broadcast(names)).join(totals, "bucket", "left").join(have, ["skill", "bucket"], "left").fillna(0, ["n", "total"])
    now = F.lit(as_of).cast("timestamp")
    lag = F.lag("n").over(Window.partitionBy("skill").orderBy("bucket"))
    return grid.select("skill", "bucket", F.col("n").alias("with_skill"), "total", lag.alias("baseline"), (F.col("bucket") == C.bucket_of(now, granularity)).alias("is_partial"))


def week_counts(postings: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """AGG-27, JOI-14: (target_type, target_key, week, n): distinct postings of each PKT week, of all and of each skill."""
    p = postings.select("id", C.pkt_week(F.col("first_seen_at")).alias("week")).where(F.col("week").isNotNull())
    volume = p.groupBy("week").agg(F.countDistinct("id").alias("n")).select(F.lit("volume").alias("target_type"), F.lit("all").alias("target_key"), "week", "n")
    if mentions is None:
        return volume
    skills = mentions.select(F.col("posting_id").alias("id"), "skill").distinct().join(p, "id").groupBy("skill", "week").agg(F.count("*").alias("n")).select(F.lit("skill").alias("target_type"), F.col("skill").alias("target_key"), "week", "n")
    return volume.unionByName(skills)


def week_grid(counts: DataFrame, high: Column, start: str | None = None) -> DataFrame:
    """WIN-08: counts on every week from the earliest (or ``start``, if later) through ``high``, zeros where there are none.

    The grid is keys x weeks: weeks are few, and keys are those that occur.
    """
    low = F.min("week") if start is None else F.greatest(F.min("week"), F.lit(start).cast("date"))
    weeks = calendar(counts.agg(low.alias("low")).select("low", high.alias("high")).where("low <= high"), "WEEK").withColumnRenamed("bucket", "week")
    keys = counts.select("target_type", "target_key").distinct()
    return keys.crossJoin(F.broadcast(weeks)).join(counts, ["target_type", "target_key", "week"], "left").fillna(0, ["n"])


def with_forecast(grid: DataFrame) -> DataFrame:
    """WIN-04..07, FCT-01: what the weeks before each week predict for it; frames end the week before (WIN-10)."""
    w = Window.partitionBy("target_type", "target_key").orderBy("week")
    mean, spread = w.rowsBetween(-MEAN_WEEKS, -1), w.rowsBetween(-SPREAD_WEEKS, -1)
    m = F.avg("n").over(mean)
    s = SPREAD * F.coalesce(F.stddev_samp("n").over(spread), F.lit(0.0))
    return grid.select(
        "*", F.round(m, 4).alias("predicted"), F.round(F.greatest(F.lit(0.0), m - s), 4).alias("interval_low"), F.round(m + s, 4).alias("interval_high"), F.lag("n").over(w).cast("double").alias("baseline_predicted"),
        F.count("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("weeks_before"), F.sum("n").over(spread).alias("trailing"),
    ).withColumn("model_version", F.when(F.col("weeks_before") < MEAN_WEEKS, MODEL + "_shorthist").otherwise(MODEL))


def top_targets(grid: DataFrame, limit: int = TARGETS) -> DataFrame:
    """AGG-29, SRT-05, WIN-09: of each week the volume row and the skills with the largest trailing sums, ties alphabetical."""
    w = Window.partitionBy("week", "target_type").orderBy(F.desc("trailing"), "target_key")
    return grid.withColumn("r", F.row_number().over(w)).where((F.col("target_type") == "volume") | ((F.col("r") <= limit) & (F.col("trailing") > 0))).drop("r")


_FORECAST = ("model_version", "target_type", "target_key", "target_week_start", "predicted", "interval_low", "interval_high", "baseline_predicted")


def predict(postings: DataFrame, mentions: DataFrame, as_of: str, start: str | None = None, scope: str = "all") -> DataFrame:
    """FCT-02: forecasts of the week that ``as_of`` lies in, from complete weeks alone."""
    target = as_of_date(as_of, pkt=True)
    past = week_counts(postings, mentions).where(F.col("week") < target)
    rows = top_targets(with_forecast(week_grid(past, target, start)).where((F.col("week") == target) & (F.col("weeks_before") > 0)))
    return rows.withColumnRenamed("week", "target_week_start").select(*_FORECAST, F.lit(scope).alias("source_scope"))


def grade(forecasts: DataFrame, postings: DataFrame, mentions: DataFrame, as_of: str) -> DataFrame:
    """FCT-03, JOI-15, MTH-05: rows of complete weeks with actual, errors and whether the baseline was beaten (strictly).

    Each row is graded on the sources of its own scope, ``all`` or names joined by commas.
    """
    f = forecasts.withColumn("row_id", F.xxhash64("model_version", "target_type", "target_key", "target_week_start")).where(F.col("target_week_start") < as_of_date(as_of, pkt=True))
    # a scope of names is met by an equi-join on them, that of all postings needs none
    names = F.split("source_scope", r"\s*,\s*")
    f = f.withColumn("_scope", F.when(F.array_contains(names, "all"), "all").otherwise(F.col("source_scope")))
    scopes = f.select("_scope", F.explode(names).alias("one")).distinct()
    p = postings.select("id", "source", C.pkt_week(F.col("first_seen_at")).alias("week"))
    named = p.join(scopes.where("one <> 'all'"), p["source"] == scopes["one"]).select("_scope", "id", "week")
    scoped = named.unionByName(p.select(F.lit("all").alias("_scope"), "id", "week")).distinct()
    volume = scoped.groupBy("_scope", "week").agg(F.countDistinct("id").alias("n")).select("_scope", F.lit("volume").alias("target_type"), F.lit("all").alias("target_key"), "week", "n")
    skills = scoped.join(mentions.select(F.col("posting_id").alias("id"), "skill").distinct(), "id").groupBy("_scope", "skill", "week").agg(F.countDistinct("id").alias("n")).select("_scope", F.lit("skill").alias("target_type"), F.col("skill").alias("target_key"), "week", "n")
    actual = volume.unionByName(skills).withColumnRenamed("week", "target_week_start")
    out = f.join(actual, ["_scope", "target_type", "target_key", "target_week_start"], "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    return graded(out).select(*_FORECAST, "source_scope", "actual", "abs_error", "baseline_abs_error", "beat_baseline", "outcome")


def graded(rows: DataFrame) -> DataFrame:
    e, b = F.round(F.abs(F.col("predicted") - F.col("actual")), 4), F.round(F.abs(F.col("baseline_predicted") - F.col("actual")), 4)
    return rows.withColumn("abs_error", e).withColumn("baseline_abs_error", b).withColumn("beat_baseline", F.col("abs_error") < F.col("baseline_abs_error")).withColumn("outcome", C.outcome(F.col("abs_error"), F.col("baseline_abs_error")))


def backtest(postings: DataFrame, mentions: DataFrame, as_of: str) -> DataFrame:
    """FCT-04, WIN-09, WIN-10, JOI-16: the forecasts that each past week would have had, graded."""
    last = F.date_sub(as_of_date(as_of, pkt=True), 7)
    grid = with_forecast(week_grid(week_counts(postings, mentions).where(F.col("week") <= last), last))
    rows = top_targets(grid.where("weeks_before > 0")).withColumn("actual", F.col("n")).withColumnRenamed("week", "target_week_start")
    return graded(rows).select(*_FORECAST, "actual", "abs_error", "baseline_abs_error", "beat_baseline", "outcome")


def accuracy(rows: DataFrame, by_key: bool = False) -> DataFrame:
    """AGG-20, AGG-21: counts of outcomes, beat rate and mean error, overall, by type, and by key if asked."""
    keys = ["target_type", "target_key"] if by_key else ["target_type"]
    n = F.count("*")
    out = rows.groupingSets([keys, []], *keys).agg(
        n.alias("n"), F.count_if(F.col("outcome") == "beat").alias("beat"), F.count_if(F.col("outcome") == "tie").alias("tie"), F.count_if(F.col("outcome") == "lost").alias("lost"), F.round(F.count_if(F.col("outcome") == "beat") / n, 4).alias("beat_rate"), F.round(F.sum(F.col("abs_error").cast("decimal(18,4)")).cast("double") / F.count("abs_error"), 4).alias("mae"), F.countDistinct("target_week_start").alias("weeks")
    )
    return out.select(*[F.coalesce(k, F.lit("overall")).alias(k) for k in keys], "n", "beat", "tie", "lost", "beat_rate", "mae", "weeks")


def percent_errors(rows: DataFrame) -> DataFrame:
    """AGG-20: each row's error in percent of the actual, null where that is 0."""
    return rows.select("target_type", "target_key", "target_week_start", "predicted", "actual", F.round(100 * F.col("abs_error") / F.nullif("actual", F.lit(0)), 2).alias("pct_error"))


def top_movers(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame | None, as_of: str, least_weeks: int = 3) -> DataFrame:
    """WIN-11, INS-01: change of each skill between the last two complete UTC weeks, if there are enough of them."""
    now = as_of_date(as_of)
    p = postings.select("id", C.utc_week(F.col("first_seen_at")).alias("week")).where(F.col("week") < now)
    weeks = p.agg(F.countDistinct("week").alias("weeks"), F.max("week").alias("last"))
    m = mentions.select(F.col("posting_id").alias("id"), "skill").distinct()
    if taxonomy is not None:
        m = m.join(dimension(taxonomy.where(C.substantive(F.col("category"), F.col("requirement_type"))).select("skill")), "skill")
    j = m.join(p, "id").crossJoin(F.broadcast(weeks)).where((F.col("weeks") >= least_weeks) & (F.col("week") >= F.date_sub("last", 7)))
    out = j.groupBy("skill").agg(F.count_if(F.col("week") == F.col("last")).alias("n_last"), F.count_if(F.col("week") < F.col("last")).alias("n_before"))
    return out.withColumn("delta", F.col("n_last") - F.col("n_before"))


def top_skills(postings: DataFrame, mentions: DataFrame, week: Column, limit: int = 10) -> DataFrame:
    """AGG-29, AGG-30: skills of one PKT week by distinct postings, with companies outside the bulk ones."""
    p = without_bulk(postings).where(C.pkt_week(F.col("first_seen_at")) == week).select(F.col("id").alias("posting_id"), "company_key")
    return mentions.join(p, "posting_id").groupBy("skill").agg(F.countDistinct("posting_id").alias("n"), F.countDistinct("company_key").alias("companies")).orderBy(F.desc("n"), "skill").limit(limit)


def entered_left(postings: DataFrame, mentions: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """WIN-16, SET-04: skills that entered or left the top of the last complete week."""
    now = as_of_date(as_of, pkt=True)
    this, before = (top_skills(postings, mentions, F.date_sub(now, d), limit).select("skill") for d in (7, 14))
    return this.exceptAll(before).select("skill", F.lit("entered").alias("move")).unionByName(before.exceptAll(this).select("skill", F.lit("left").alias("move")))


def weekly_facts(postings: DataFrame, as_of: str, start: str) -> DataFrame:
    """AGG-31: volume of the last complete week, the one before, and the change, null unless both lie after the collection's start."""
    now = as_of_date(as_of, pkt=True)
    week = C.pkt_week(F.col("first_seen_at"))
    n = postings.agg(F.count_if(week == F.date_sub(now, 7)).alias("volume"), F.count_if(week == F.date_sub(now, 14)).alias("volume_before"))
    both = F.date_sub(now, 14) >= C.pkt_week(F.lit(start).cast("timestamp"))
    change = F.col("volume") - F.col("volume_before")
    return n.select(F.date_sub(now, 7).alias("week"), "volume", "volume_before", F.when(both, change).alias("change"), F.when(both & (F.col("volume_before") > 0), F.round(100 * change / F.col("volume_before"), 1)).alias("change_pct"))


def current_briefings(briefings: DataFrame, limit: int = 52) -> DataFrame:
    """FCT-07, FLT-16, JOI-13, SRT-08: briefings that none supersedes, newest week first, with the one each replaced."""
    old = briefings.where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("id")).agg(F.min("id").alias("original_id"))
    return briefings.where("superseded_by IS NULL").join(old, "id", "left").orderBy(F.desc("week_start"), F.desc("created_at")).limit(limit)
