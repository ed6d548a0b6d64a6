"""Market operators over postings, mentions and a taxonomy (AGG-01..17, 19, 22..26; FLT-04; JOI-01..12).

postings: id, source, company, city, first_seen_at, last_seen_at, salary_min, salary_max, currency, domain, job_family,
experience_level, experience_raw, ...; mentions: posting_id, skill; taxonomy: skill, display, category,
requirement_type, ord.  The taxonomy is a dimension: it is broadcast below ``DIMENSION`` rows, joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cols as C

#: Rows up to which a dimension is broadcast.
DIMENSION = 50_000


def dimension(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted only as far as needed, are few."""
    return F.broadcast(df) if df.limit(DIMENSION + 1).count() <= DIMENSION else df


def keyed(postings: DataFrame) -> DataFrame:
    return postings.withColumn("company_key", C.company_key(F.col("company")))


def require_skill(taxonomy: DataFrame, skill: str) -> None:
    """FLT-01: unknown keys are an error."""
    if taxonomy.where(F.col("skill") == skill).isEmpty():
        raise KeyError(f"unknown skill: {skill}")


def typed(mentions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """ATT-10: mentions with the category and requirement type of their skill; a skill that the taxonomy lacks has no category and the type ``skill``."""
    dim = dimension(taxonomy.select("skill", F.col("category").alias("_c"), F.col("requirement_type").alias("_t")))
    j = mentions.join(dim, "skill", "left")
    return j.select(*[c for c in mentions.columns if c not in ("category", "requirement_type")], F.col("_c").alias("category"), F.coalesce("_t", F.lit("skill")).alias("requirement_type"))


def bulk_companies(postings: DataFrame, known: tuple[str, ...] = (), bar: float = C.BULK_SHARE) -> DataFrame:
    """AGG-05, SET-01: keys of over ``bar`` of all postings, and known keys that occur."""
    p = keyed(postings)
    n = p.groupBy("company_key").agg(F.count("*").alias("n"))
    whole = F.broadcast(n.agg(F.sum("n").alias("whole")))
    return n.crossJoin(whole).where(F.col("company_key").isNotNull() & ((F.col("n") > bar * F.col("whole")) | F.col("company_key").isin(*known))).select("company_key")


def without_bulk(postings: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """FLT-04, JOI-06: postings without those of bulk companies; a null company stays.  At most 1/share keys and the known ones are broadcast."""
    return keyed(postings).join(F.broadcast(bulk_companies(postings, known)), "company_key", "left_anti")


def mentions_of(mentions: DataFrame, postings: DataFrame) -> DataFrame:
    """JOI-07."""
    return mentions.join(postings.select(F.col("id").alias("posting_id")), "posting_id", "left_semi")


def _scope(postings, mentions, exclude_bulk):
    p = without_bulk(postings) if exclude_bulk else keyed(postings)
    return p, mentions.join(p.select(F.col("id").alias("posting_id"), "company_key"), "posting_id")


def distinct_counts(rows: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """(keys, k, c): distinct postings and companies of each of ``keys``, from rows with posting_id and company_key.

    Two distinct counts at once would double the rows and hold them all by posting.  Here a posting's rows are made one
    where they are, and move once, by key and company, to ``tasks`` partitions (the session's number if not given).
    """
    once = rows.select("posting_id", *keys, "company_key").distinct()
    first = F.row_number().over(Window.partitionBy("posting_id", *keys).orderBy("company_key")) == 1
    once = once.select(*keys, "company_key", first.cast("long").alias("k"))
    to = [*keys, "company_key"]
    by = (once.repartition(tasks, *to) if tasks else once.repartition(*to)).groupBy(*to).agg(F.sum("k").alias("k"))
    return by.groupBy(*keys).agg(F.sum("k").alias("k"), F.count("company_key").alias("c"))


def skill_counts(mentions: DataFrame, postings: DataFrame, tasks: int | None = None) -> DataFrame:
    """AGG-03, AGG-04: distinct postings and companies of each skill."""
    m = mentions.join(keyed(postings).select(F.col("id").alias("posting_id"), "company_key"), "posting_id")
    return distinct_counts(m, ["skill"], tasks).select("skill", F.col("k").alias("posting_count"), F.col("c").alias("company_count"))


def skills_top(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, category: str | None = None, include_soft: bool = False, exclude_bulk: bool = False, limit: int | None = 100, tasks: int | None = None) -> DataFrame:
    """AGG-02, JOI-02, SRT-01: skills by distinct postings, with share of all postings in scope; ties by taxonomy order."""
    p, _ = _scope(postings, mentions, exclude_bulk)
    dim = taxonomy.where(F.lit(category is None) | (F.col("category") == category)).where(F.lit(include_soft) | (F.col("category") != "soft"))
    counts = skill_counts(mentions, p, tasks).join(dimension(dim), "skill").crossJoin(F.broadcast(p.agg(F.count("*").alias("total"))))
    out = counts.select("skill", "category", "requirement_type", "posting_count", "company_count", C.share(F.col("posting_count"), F.col("total")).alias("share"), "ord")
    out = out.orderBy(F.desc("posting_count"), "ord")
    return (out.limit(limit) if limit else out).drop("ord")


def overview(postings: DataFrame, mentions: DataFrame) -> DataFrame:
    """AGG-01: totals, distinct raw companies and cities, newest sighting, the top company's share by key."""
    p = keyed(postings)
    top = p.where(F.col("company_key").isNotNull()).groupBy("company_key").count().agg(F.max("count").alias("top"))
    return (
        p.agg(F.count("*").alias("total_postings"), F.countDistinct(F.when(F.col("company") != "", F.col("company"))).alias("distinct_companies"), F.countDistinct("city").alias("distinct_cities"), F.max("last_seen_at").cast("date").alias("last_seen"))
        .crossJoin(top).crossJoin(mentions.agg(F.count("*").alias("total_mentions")))
        .select("total_postings", "distinct_companies", "distinct_cities", "last_seen", "total_mentions", C.share(F.col("top"), F.col("total_postings")).alias("top_company_share"))
    )


def counts_by(postings: DataFrame, column: str, missing: str) -> DataFrame:
    """MAP-01: rows of each value, in long form."""
    return postings.groupBy(F.coalesce(column, F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def cities(postings: DataFrame, mentions: DataFrame, skill: str | None = None) -> DataFrame:
    """AGG-06, JOI-05: postings and raw spellings of each city; the null city counts those without one."""
    p = postings if skill is None else postings.join(mentions.where(F.col("skill") == skill).select(F.col("posting_id").alias("id")), "id", "left_semi")
    by = p.groupBy(C.city_norm(F.col("city")).alias("city_norm"), "city").agg(F.count("*").alias("n"))
    return by.groupBy(F.lower("city_norm").alias("city_key")).agg(F.sum("n").alias("posting_count"), F.array_join(F.array_sort(F.collect_set("city")), "|").alias("variants"))


def iqr_columns(value: Column) -> list[Column]:
    """AGG-07, MTH-01: n, median, quartiles (both the median under four values) and their distance, to two places; nulls of none."""
    n, q = F.count(value), F.percentile(value, [0.25, 0.5, 0.75])
    q1, q3 = F.when(n < 4, q[1]).otherwise(q[0]), F.when(n < 4, q[1]).otherwise(q[2])
    two = lambda x: F.round(x.cast("decimal(24,6)"), 2).cast("double")  # noqa: E731  a half is not lost to binary fractions
    return [n.alias("n"), two(q[1]).alias("median"), two(q1).alias("q1"), two(q3).alias("q3"), two(q3 - q1).alias("iqr")]


def salaries(postings: DataFrame, mentions: DataFrame, currency: str = C.HOME_CURRENCY, skill: str | None = None) -> DataFrame:
    """AGG-08, FLT-06: quartiles over all and by experience band (band ``overall`` is all); a null currency is the home one."""
    p = postings.where(F.coalesce("currency", F.lit(C.HOME_CURRENCY)) == currency)
    if skill is not None:
        p = p.join(mentions.where(F.col("skill") == skill).select(F.col("posting_id").alias("id")), "id", "left_semi")
    p = p.select(C.experience_band(F.col("experience_raw")).alias("band"), C.salary_point(F.col("salary_min"), F.col("salary_max")).alias("v"))
    return p.groupingSets([["band"], []], "band").agg(F.count("*").alias("postings"), *iqr_columns(F.col("v")), F.grouping("band").alias("g")).select(F.when(F.col("g") == 1, "overall").otherwise(F.col("band")).alias("band"), "postings", "n", "median", "q1", "q3", "iqr")


def recent(postings: DataFrame, mentions: DataFrame, source: str | None = None, limit: int = 50) -> DataFrame:
    """JOI-04, FLT-05, SRT-02: the newest postings with their skills; skills are gathered for those rows alone."""
    p = postings if source is None else postings.where(F.col("source") == source)
    top = p.orderBy(F.col("first_seen_at").desc_nulls_last(), "id").limit(limit)
    own = mentions.join(F.broadcast(top.select(F.col("id").alias("posting_id"))), "posting_id").groupBy("posting_id").agg(F.array_join(F.array_sort(F.collect_set("skill")), ",").alias("skills"))
    return top.join(own, top["id"] == own["posting_id"], "left").select("id", "source", "company", F.col("first_seen_at").cast("date").alias("first_seen"), F.coalesce("skills", F.lit("")).alias("skills"))


def templated_share(postings: DataFrame, tags: DataFrame) -> DataFrame:
    """AGG-12, WIN-17, ARR-01: per company, postings with tags and those whose sorted tags another posting of it has.

    ``tags`` has posting_id and tag, repeats counting.
    """
    sets = tags.groupBy("posting_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    p = keyed(postings).join(sets, F.col("id") == F.col("posting_id")).where(F.col("company_key").isNotNull())
    by = p.groupBy("company_key", "tags").agg(F.count("*").alias("n"))
    return by.groupBy("company_key").agg(F.sum("n").alias("tagged"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated")).withColumn("templated_share", C.share(F.col("repeated"), F.col("tagged")))


def companies_top(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, include_soft: bool = False, limit: int | None = 50) -> DataFrame:
    """AGG-09, AGG-10, WIN-12, WIN-13: each company's modal name, postings, cities, five top skills and salary quartiles, in one pass each."""
    p = keyed(postings).where(F.col("company_key").isNotNull())
    n = p.groupBy("company_key").agg(F.count("*").alias("posting_count"))
    top = n.orderBy(F.desc("posting_count"), "company_key")
    top = top.limit(limit) if limit else top
    p = p.join(F.broadcast(top.select("company_key")) if limit and limit <= DIMENSION else top.select("company_key"), "company_key", "left_semi")
    name = p.groupBy("company_key", "company").count().groupBy("company_key").agg(F.min_by("company", F.struct(-F.col("count"), F.col("company"))).alias("display_name"))
    towns = p.groupBy("company_key").agg(F.array_join(F.array_sort(F.collect_set(C.city_norm(F.col("city")))), "|").alias("cities"))
    pay = p.where(F.coalesce("currency", F.lit(C.HOME_CURRENCY)) == C.HOME_CURRENCY).withColumn("v", C.salary_point(F.col("salary_min"), F.col("salary_max"))).groupBy("company_key").agg(*iqr_columns(F.col("v"))).select("company_key", F.col("median").alias("salary_median"), F.col("n").alias("salary_n"))
    dim = dimension(taxonomy.where(F.lit(include_soft) | (F.col("category") != "soft")).select("skill", "ord"))
    skills = mentions.join(p.select(F.col("id").alias("posting_id"), "company_key"), "posting_id").groupBy("company_key", "skill").agg(F.countDistinct("posting_id").alias("k")).join(dim, "skill")
    rank = F.row_number().over(Window.partitionBy("company_key").orderBy(F.desc("k"), "ord"))
    five = skills.withColumn("r", rank).where("r <= 5").groupBy("company_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "skill"))), lambda x: x["skill"]), "|").alias("top_skills"))
    out = top.join(name, "company_key").join(towns, "company_key", "left").join(pay, "company_key", "left").join(five, "company_key", "left")
    return out.select("company_key", "display_name", "posting_count", "cities", F.coalesce("salary_n", F.lit(0)).alias("salary_n"), "salary_median", F.coalesce("top_skills", F.lit("")).alias("top_skills"))


def company_detail(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, name: str) -> DataFrame:
    """AGG-11: the summary of one company; an unknown one is an error."""
    key = " ".join(name.split()).lower()
    own = keyed(postings).where(F.col("company_key") == key)
    if own.isEmpty():
        raise KeyError(f"unknown company: {name}")
    return companies_top(own.select(*postings.columns), mentions, taxonomy, limit=1)


def cooccurrence(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, least_joint: int = 5, include_soft: bool = False, exclude_bulk: bool = False) -> DataFrame:
    """AGG-13, AGG-14, JOI-08, ARR-03: pairs of skills of one posting, with conditional shares and lift over all postings.

    Pairs are made inside a posting from its own distinct skills, whose number the taxonomy bounds.
    """
    p, _ = _scope(postings, mentions, exclude_bulk)
    dim = dimension(taxonomy.where(F.lit(include_soft) | (F.col("category") != "soft")).select("skill"))
    m = mentions_of(mentions, p).join(dim, "skill").select("posting_id", "skill").distinct()
    return paired(m, F.broadcast(p.agg(F.count("*").alias("total"))), least_joint)


def paired(m: DataFrame, total: DataFrame, least_joint: int = 5) -> DataFrame:
    """Pairs as :func:`cooccurrence`, from different rows (posting_id, skill) and the row ``total`` of all postings."""
    single = m.groupBy("skill").agg(F.count("*").alias("n"))
    lists = m.groupBy("posting_id").agg(F.array_sort(F.collect_list("skill")).alias("s")).where(F.size("s") > 1)
    pairs = lists.select(F.posexplode("s").alias("i", "skill_a"), "s").select("skill_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("skill_b"))
    joint = pairs.groupBy("skill_a", "skill_b").agg(F.count("*").alias("joint")).where(F.col("joint") >= least_joint)
    a, b = single.select(F.col("skill").alias("skill_a"), F.col("n").alias("count_a")), single.select(F.col("skill").alias("skill_b"), F.col("n").alias("count_b"))
    j = joint.join(a, "skill_a").join(b, "skill_b").crossJoin(total)
    x, na, nb, t = F.col("joint"), F.col("count_a"), F.col("count_b"), F.col("total")
    return j.select("skill_a", "skill_b", "joint", "count_a", "count_b", F.round(x / na, 4).alias("p_b_given_a"), F.round(x / nb, 4).alias("p_a_given_b"), F.round((x * t) / (na * nb), 3).alias("lift"))


def companions(pairs: DataFrame, skill: str, limit: int = 50) -> DataFrame:
    """AGG-15: partners of one skill by P(partner | skill)."""
    one = lambda own, other, p: pairs.where(F.col(own) == skill).select(F.col(other).alias("companion"), "joint", F.col(p).alias("p_companion"), "lift")
    both = one("skill_a", "skill_b", "p_b_given_a").unionByName(one("skill_b", "skill_a", "p_a_given_b"))
    return both.orderBy(F.desc("p_companion"), "companion").limit(limit)


def foreign_currency(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """AGG-16, FLT-07: skills, soft ones left out, of postings in another currency."""
    p = postings.where(F.col("currency").isNotNull() & (F.col("currency") != C.HOME_CURRENCY))
    return mentions_of(mentions, p).join(dimension(taxonomy.where("category <> 'soft'").select("skill")), "skill").groupBy("skill").agg(F.countDistinct("posting_id").alias("posting_count"))


def coverage(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, skills: list[str], bar: float = 0.7, exclude_bulk: bool = False) -> DataFrame:
    """AGG-17, SET-05, ARR-02: per technical posting how many of its skills ``skills`` covers and what is missing.

    Only taxonomy skills of type ``skill`` outside ``soft`` count on either side.
    """
    p, _ = _scope(postings, mentions, exclude_bulk)
    dim = taxonomy.where("requirement_type = 'skill' AND category <> 'soft'").select("skill")
    own = F.array(*map(F.lit, sorted(set(skills)))) if skills else F.expr("CAST(array() AS array<string>)")
    need = mentions_of(mentions, p).join(dimension(dim), "skill").groupBy("posting_id").agg(F.collect_set("skill").alias("need"))
    return need.select("posting_id", F.size("need").alias("needed"), F.size(F.array_intersect("need", own)).alias("covered"), F.array_except("need", own).alias("missing")).withColumn("strong", F.col("covered") >= bar * F.col("needed"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """AGG-17: technical, strong and full postings."""
    n = F.count("*")
    return covered.agg(n.alias("technical"), F.count_if("strong").alias("strong"), F.count_if(F.col("covered") == F.col("needed")).alias("full"), F.round(100 * F.count_if("strong") / n, 1).alias("strong_pct"))


def next_skills(covered: DataFrame, bar: float = 0.7, limit: int = 10) -> DataFrame:
    """AGG-17, SRT-11: skills that alone would lift a posting over the bar, by how many they would."""
    near = covered.where(~F.col("strong") & (F.col("covered") + 1 >= bar * F.col("needed")))
    return near.select(F.explode("missing").alias("skill")).groupBy("skill").agg(F.count("*").alias("unlocks")).orderBy(F.desc("unlocks"), "skill").limit(limit)


def system_health(postings: DataFrame, mentions: DataFrame, as_of: str) -> DataFrame:
    """AGG-19: per source newest sighting, postings of the last day and week, freshness, share with mentions."""
    now = F.lit(as_of).cast("timestamp")
    some = mentions.select(F.col("posting_id").alias("id")).distinct().withColumn("has", F.lit(True))
    p = postings.join(some, "id", "left")
    recent_ = lambda days: F.count_if((F.col("first_seen_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("first_seen_at") <= now))
    return p.groupBy("source").agg(
        F.count("*").alias("postings"), F.max("last_seen_at").cast("date").alias("last_seen"), recent_(1).alias("added_day"), recent_(7).alias("added_week"), C.share(F.count("has"), F.count("*")).alias("extracted_share"), C.hours_between(F.max("last_seen_at"), now).alias("freshness_hours")
    )


def curriculum_alignment(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, curriculum: DataFrame, domains: tuple[str, ...] = C.MARKET_DOMAINS, least_companies: int = 5) -> DataFrame:
    """AGG-22..24, JOI-09, JOI-10, SET-02, SET-03: demanded skills with the courses that teach them; ``gap`` for those none does."""
    p = postings.where(F.col("domain").isin(*domains))
    dim = dimension(taxonomy.where(C.substantive(F.col("category"), F.col("requirement_type"))).select("skill"))
    demand = skill_counts(mentions, p).join(dim, "skill")
    taught = curriculum.groupBy("skill").agg(F.countDistinct("course_id").alias("courses"))
    j = demand.join(taught, "skill", "left").withColumn("status", F.when(F.col("courses").isNotNull(), "taught").when(F.col("company_count") >= least_companies, "gap"))
    return j.where("status IS NOT NULL").select("skill", "status", "posting_count", "company_count", F.coalesce("courses", F.lit(0)).alias("courses"))


def _levelled(postings: DataFrame, least_postings: int) -> DataFrame:
    """Postings with a level of families that have enough of them and two levels or more."""
    p = keyed(postings).where(F.col("job_family").isNotNull() & F.col("experience_level").isNotNull())
    fit = p.groupBy("job_family").agg(F.count("*").alias("n"), F.countDistinct("experience_level").alias("levels")).where((F.col("n") >= least_postings) & (F.col("levels") >= 2)).select("job_family")
    return p.join(fit, "job_family", "left_semi")


def _level_no(level: str = "experience_level") -> Column:
    return F.array_position(F.array(*map(F.lit, C.LEVELS)), F.col(level)).cast("int")


def family_paths(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, least_postings: int = 15, least_companies: int = 3, tasks: int | None = None) -> DataFrame:
    """AGG-25, WIN-15, JOI-12: skills whose share grows from one present level of a family to the next."""
    p = _levelled(postings, least_postings)
    levels = p.groupBy("job_family", "experience_level").agg(F.count("*").alias("n")).withColumn("no", _level_no())
    w = Window.partitionBy("job_family").orderBy("no")
    steps = levels.select("job_family", F.col("experience_level").alias("level_from"), F.col("n").alias("n_from"), F.lead("experience_level").over(w).alias("level_to"), F.lead("n").over(w).alias("n_to")).where("level_to IS NOT NULL")
    dim = dimension(taxonomy.where("category <> 'soft'").select("skill"))
    m = mentions.join(p.select(F.col("id").alias("posting_id"), "job_family", "experience_level", "company_key"), "posting_id").join(dim, "skill")
    k = distinct_counts(m, ["job_family", "experience_level", "skill"], tasks).withColumnRenamed("c", "companies")
    high = k.select("job_family", F.col("experience_level").alias("level_to"), "skill", F.col("k").alias("k_to"), "companies")
    low = k.select("job_family", F.col("experience_level").alias("level_from"), "skill", F.col("k").alias("k_from"))
    j = steps.join(high, ["job_family", "level_to"]).join(low, ["job_family", "level_from", "skill"], "left")
    delta = F.col("k_to") / F.col("n_to") - F.coalesce("k_from", F.lit(0)) / F.col("n_from")
    return j.where((delta > 0) & (F.col("companies") >= least_companies)).select("job_family", "level_from", "level_to", "skill", "companies", F.round(delta, 4).alias("delta"))


def match_paths(postings: DataFrame, mentions: DataFrame, taxonomy: DataFrame, skills: list[str], least_postings: int = 15, signature: int = 10, bar: float = 0.7, tasks: int | None = None) -> DataFrame:
    """AGG-26: families and levels by the share of their signature (most common skills, soft ones left out) that ``skills`` covers."""
    p = _levelled(postings, least_postings)
    dim = dimension(taxonomy.where("category <> 'soft'").select("skill"))
    m = mentions.join(p.select(F.col("id").alias("posting_id"), "job_family", "experience_level", "company_key"), "posting_id").join(dim, "skill")
    k = distinct_counts(m, ["job_family", "experience_level", "skill"], tasks)
    w = Window.partitionBy("job_family", "experience_level").orderBy(F.desc("c"), F.desc("k"), "skill")
    top = k.withColumn("r", F.row_number().over(w)).where(F.col("r") <= signature)
    out = top.groupBy("job_family", "experience_level").agg(F.count("*").alias("size"), F.count_if(F.col("skill").isin(*skills)).alias("covered")).withColumn("fraction", F.round(F.col("covered") / F.col("size"), 3))
    best = Window.orderBy(F.desc("fraction"), F.desc("size"), "job_family", "experience_level")
    return out.withColumn("fits", F.col("covered") >= bar * F.col("size")).withColumn("place", F.row_number().over(best)).select("job_family", "experience_level", "size", "covered", "fraction", "fits", "place")
