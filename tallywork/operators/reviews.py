"""Comparisons of extraction passes and vocabularies, and the targets of a discovery (AGG-39, AGG-40, AGG-41, ORC-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cols as C
from .market import dimension

#: The bars of a discovery.
LEAST_TARGETS, LARGE_DOMAIN, LARGE_BAR, SMALL_BAR, EXCLUDED = 15, 60, 3, 2, ("other",)


def counts_of(mentions: DataFrame, method: str, types: tuple[str, ...] | None = None, without: DataFrame | None = None) -> DataFrame:
    """(id, n): different substantive skills of one pass, by the category and type stored with the mention; ``without`` has skills to leave out.

    A null category is substantive, as only the hidden ones are left out; a null type is of no type.
    """
    m = mentions.where((F.col("extraction_method") == method) & ~F.coalesce(F.col("category").isin(*C.HIDDEN_CATEGORIES), F.lit(False)))
    if types is not None:
        m = m.where(F.col("requirement_type").isin(*types))
    if without is not None:
        m = m.join(dimension(without.select("skill").distinct()), "skill", "left_anti")
    return m.groupBy("posting_id", "skill").agg(F.lit(1)).groupBy(F.col("posting_id").alias("id")).agg(F.count("*").alias("n"))


def _two(x: Column) -> Column:
    return F.round(x.cast("decimal(24,6)"), 2).cast("double")


def _stats(value: str, suffix: str) -> list[Column]:
    return [_two(F.percentile(value, 0.5)).alias(f"median_{suffix}"), F.round(100 * F.count_if(F.col(value) <= 1) / F.count("*"), 2).alias(f"pct_le1_{suffix}")]


def side_by_side(postings: DataFrame, mentions: DataFrame, by: str, before: str, after: str, missing: str = "unknown") -> DataFrame:
    """AGG-39: per source or domain the postings, and of two passes median and percent with one at most, of skills and of all requirements.

    Requirements of the later pass also count one for a credential (degree or certification) and one for a level of experience.
    """
    frames = {"skill_before": counts_of(mentions, before, ("skill",)), "skill_after": counts_of(mentions, after, ("skill",)), "req_before": counts_of(mentions, before), "req_after": counts_of(mentions, after)}
    p = postings.select("id", F.coalesce(by, F.lit(missing)).alias("value"), F.coalesce((F.col("degree_level") != "") | F.col("has_certification"), F.col("has_certification"), F.col("degree_level") != "", F.lit(False)).alias("credential"), F.coalesce(F.col("experience_level") != "", F.lit(False)).alias("experience"))
    for name, n in frames.items():
        p = p.join(n.withColumnRenamed("n", name), "id", "left").fillna(0, [name])
    p = p.withColumn("req_after", F.col("req_after") + F.col("credential").cast("int") + F.col("experience").cast("int"))
    return p.groupBy("value").agg(F.count("*").alias("n"), *[c for name in frames for c in _stats(name, name)])


def field_yield(postings: DataFrame, mentions: DataFrame, after: str) -> DataFrame:
    """AGG-39: one row: postings, and those with a degree, with a level of experience, with an attribute of the later pass."""
    some = mentions.where((F.col("extraction_method") == after) & (F.col("requirement_type") == "attribute")).select(F.col("posting_id").alias("id")).distinct().withColumn("has", F.lit(True))
    p = postings.join(some, "id", "left")
    given = lambda c: F.count_if(F.coalesce(F.col(c) != "", F.lit(False)))
    return p.agg(F.count("*").alias("postings"), given("degree_level").alias("degree"), given("experience_level").alias("experience"), F.count_if(F.col("has")).alias("attribute"))


def vocabulary_buckets(before: DataFrame, after: DataFrame, new_categories: tuple[str, ...]) -> DataFrame:
    """AGG-40: (skill, bucket) of a later vocabulary: ``a`` new in a new category, ``b`` new, ``c`` reclassified, ``other`` unchanged."""
    j = after.select("skill", "category").join(before.select("skill", F.col("category").alias("was"), F.lit(True).alias("old")), "skill", "left")
    return j.select("skill", F.when(F.col("old").isNull() & F.col("category").isin(*new_categories), "a").when(F.col("old").isNull(), "b").when(~F.col("category").eqNullSafe(F.col("was")), "c").otherwise("other").alias("bucket"))


def source_breakdown(postings: DataFrame, mentions: DataFrame, buckets: DataFrame, method: str) -> DataFrame:
    """AGG-40: mentions of one pass by domain and bucket, with a TOTAL row; a mention whose posting is gone or has no domain is of ``other``."""
    m = mentions.where(F.col("extraction_method") == method).join(dimension(buckets), "skill", "left").join(postings.select(F.col("id").alias("posting_id"), "domain"), "posting_id", "left")
    b = F.coalesce("bucket", F.lit("other"))
    columns = [F.count_if(b == k).alias(k) for k in ("a", "b", "c", "other")]
    named = m.withColumn("domain", F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit("other")))
    return named.groupingSets([["domain"], []], "domain").agg(*columns, F.count("*").alias("total"), F.grouping("domain").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("domain")).alias("domain"), "a", "b", "c", "other", "total")


def relabelling(postings: DataFrame, mentions: DataFrame, buckets: DataFrame, before: str, after: str) -> DataFrame:
    """AGG-40: per domain the percent of postings with one substantive skill at most before, after, and after without reclassified skills; the difference of the last two is mere relabelling."""
    frames = {"before": counts_of(mentions, before, ("skill",)), "after": counts_of(mentions, after, ("skill",)), "kept": counts_of(mentions, after, ("skill",), buckets.where("bucket = 'c'"))}
    p = postings.select("id", F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit("other")).alias("domain"))
    for name, n in frames.items():
        p = p.join(n.withColumnRenamed("n", name), "id", "left").fillna(0, [name])
    pct = lambda c: F.round(100 * F.count_if(F.col(c) <= 1) / F.count("*"), 2)
    out = p.groupBy("domain").agg(F.count("*").alias("n"), pct("before").alias("pct_before"), pct("after").alias("pct_after"), pct("kept").alias("pct_without_reclassified"))
    return out.withColumn("relabelled", F.round(F.col("pct_without_reclassified") - F.col("pct_after"), 2))


def targets(postings: DataFrame, mentions: DataFrame, method: str) -> DataFrame:
    """ORC-06: postings with one substantive skill at most, their domain ``other`` where there is none."""
    n = counts_of(mentions, method, ("skill",))
    p = postings.join(n, "id", "left").where(F.coalesce("n", F.lit(0)) <= 1).drop("n")
    return p.withColumn("domain", F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit("other")))


def company_bar(n: Column) -> Column:
    """ORC-06: the companies that a phrase needs in a domain of ``n`` targets."""
    return F.when(n >= LARGE_DOMAIN, LARGE_BAR).otherwise(SMALL_BAR)


def target_report(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """AGG-41: per domain its targets, postings, percent, whether it qualifies (yes, no, excluded), and its bar of companies."""
    whole = postings.groupBy(F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit("other")).alias("domain")).agg(F.count("*").alias("total"))
    j = whole.join(chosen.groupBy("domain").agg(F.count("*").alias("targets")), "domain", "left").fillna(0, ["targets"])
    fit = F.when(F.col("domain").isin(*EXCLUDED), "excluded").when(F.col("targets") >= LEAST_TARGETS, "yes").otherwise("no")
    return j.select("domain", "targets", "total", F.round(100 * F.col("targets") / F.col("total"), 1).alias("pct"), fit.alias("qualifies"), company_bar(F.col("targets")).alias("bar"))
