"""Rule classification with an optional last stage (CLS-01..08, LLM-01..06)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import phrase_pattern

#: (key, keywords); a key without keywords is never chosen by rule.
Vocabulary = list[tuple[str, list[str]]]
LEAST_CONFIDENCE = 0.6


def keyword_counts(text: Column, vocabulary: Vocabulary) -> Column:
    """CLS-01: array<struct<n, ord, key>>, largest count first, ties in the vocabulary's order; distinct keywords count."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: reduce(lambda a, w: a + low.rlike(phrase_pattern([w.lower()])).cast("int"), words, F.lit(0))
    return F.array_sort(F.array(*[F.struct((-count(words)).alias("n"), F.lit(i).alias("ord"), F.lit(key).alias("key")) for i, (key, words) in enumerate(vocabulary)]))


def _top(counts: Column, i: int) -> Column:
    return -F.coalesce(F.get(counts, F.lit(i))["n"], F.lit(0))


def classify_title(counts: Column) -> Column:
    """CLS-02: the key with the single largest count, else null."""
    return F.when((_top(counts, 0) > 0) & (_top(counts, 0) > _top(counts, 1)), F.get(counts, F.lit(0))["key"])


def classify_description(counts: Column) -> Column:
    """CLS-03: struct(key, confidence): at least two hits and two more than the next."""
    a, b = _top(counts, 0), _top(counts, 1)
    return F.when((a >= 2) & (a - b >= 2), F.struct(F.get(counts, F.lit(0))["key"].alias("key"), F.round(a / (a + b), 2).alias("confidence")))


def classify_domains(postings: DataFrame, vocabulary: Vocabulary, ask: Callable | None = None) -> DataFrame:
    """CLS-04: ``postings`` with domain, domain_method, domain_confidence: title, description, ``ask``, else ``other``.

    ``ask`` is a function for mapInPandas from rows to (id, domain, confidence); it is off unless given.  Its answers
    outside the vocabulary or under the least confidence become ``other``.
    """
    # the counts are columns of their own, so that each text is scanned once
    p = postings.withColumn("_tc", keyword_counts(F.col("title"), vocabulary)).withColumn("_dc", F.when(classify_title(F.col("_tc")).isNull(), keyword_counts(F.col("description"), vocabulary)))
    p = p.withColumn("_t", classify_title(F.col("_tc"))).withColumn("_d", classify_description(F.col("_dc")))
    out = p.select(
        *postings.columns, F.coalesce("_t", "_d.key").alias("domain"), F.when(F.col("_t").isNotNull(), "rule_title").when(F.col("_d").isNotNull(), "rule_description").alias("domain_method"),
        F.when(F.col("_t").isNotNull(), 1.0).otherwise(F.col("_d.confidence")).alias("domain_confidence"),
    )
    if ask is not None:
        open_rows = out.where("domain IS NULL").select("id", "title", F.substring("description", 1, 400).alias("description"))
        said = open_rows.mapInPandas(ask, "id long, said string, sure double")
        bare = F.trim(F.coalesce("description", F.lit(""))) == ""
        good = F.col("said").isin(*[k for k, _ in vocabulary]) & (F.col("sure") >= LEAST_CONFIDENCE)
        j = out.join(said, "id", "left")
        out = j.select(
            *postings.columns, F.coalesce("domain", F.when(good, F.col("said"))).alias("domain"), F.coalesce("domain_method", F.when(good, F.when(bare, "llm_title_only").otherwise("llm"))).alias("domain_method"),
            F.coalesce("domain_confidence", F.when(good, F.when(bare, F.least("sure", F.lit(LEAST_CONFIDENCE))).otherwise(F.col("sure")))).alias("domain_confidence"),
        )
    return out.withColumn("domain_method", F.coalesce("domain_method", F.lit("unclassified"))).withColumn("domain", F.coalesce("domain", F.lit("other")))


def classify_family(title: Column, domain: Column, families: list[tuple[str, str | None, list[str]]]) -> Column:
    """CLS-05, CLS-06: the family by title, first among those of the domain or of none, then among all; a tie is null."""
    low = F.lower(title)
    hits = lambda words: reduce(lambda a, w: a + low.rlike(phrase_pattern([w.lower()])).cast("int"), words, F.lit(0))

    def best(scoped: bool) -> Column:
        rows = [F.struct((-(F.when((domain == d) if d and scoped else F.lit(True), hits(words)).otherwise(0))).alias("n"), F.lit(i).alias("ord"), F.lit(key).alias("key")) for i, (key, d, words) in enumerate(families)]
        return classify_title(F.array_sort(F.array(*rows)))

    return F.coalesce(best(True), best(False))


def classify_families(postings: DataFrame, families: list[tuple[str, str | None, list[str]]], answers: DataFrame | None = None) -> DataFrame:
    """CLS-05, CLS-06, LLM-02: ``postings`` with family, family_method and family_confidence: by rule on the title, else by an answer, else null with the method ``unclassified``.

    answers (id, family, confidence, batch) come from outside; the last of a posting counts, and only if its family is known
    and its confidence is not under the least.
    """
    known = [k for k, *_ in families]
    out = postings.withColumn("_r", classify_family(F.col("title"), F.col("domain"), families))
    if answers is not None:
        last = answers.groupBy("id").agg(F.max_by(F.struct("family", "confidence"), F.struct("batch")).alias("_a"))
        out = out.join(last, "id", "left")
    else:
        out = out.withColumn("_a", F.lit(None).cast("struct<family: string, confidence: double>"))
    good = F.col("_a.family").isin(*known) & (F.col("_a.confidence") >= LEAST_CONFIDENCE)
    said = F.when(F.col("_r").isNull() & good, F.col("_a"))
    return out.select(
        *postings.columns, F.coalesce("_r", said["family"]).alias("family"), F.when(F.col("_r").isNotNull(), "rule_title").when(said.isNotNull(), "llm").otherwise("unclassified").alias("family_method"),
        F.when(F.col("_r").isNotNull(), 1.0).otherwise(said["confidence"]).alias("family_confidence"),
    )


def title_only_relabel(postings: DataFrame) -> DataFrame:
    """SNK-15: answers on postings without a description are relabelled and their confidence capped."""
    hit = (F.col("domain_method") == "llm") & (F.trim(F.coalesce("description", F.lit(""))) == "")
    return postings.withColumn("domain_confidence", F.when(hit, F.least(F.coalesce("domain_confidence", F.lit(0.6)), F.lit(0.6))).otherwise(F.col("domain_confidence"))).withColumn("domain_method", F.when(hit, "llm_title_only").otherwise(F.col("domain_method")))


def needs_review(confidence: Column, heuristic: Column, proposed: Column) -> Column:
    """CLS-08, ATT-13: a readable confidence under the least, or a proposed type other than the heuristic's, whatever the case; no proposal is none other."""
    differs = F.lower(F.trim(proposed)) != F.lower(F.trim(heuristic))
    return F.coalesce(confidence.try_cast("double") < LEAST_CONFIDENCE, F.lit(False)) | F.coalesce(differs, F.lit(False))


def confidence_bins(rows: DataFrame) -> DataFrame:
    """AGG-48: rows and percent in each bin of confidence from 0.6 on."""
    c = F.col("domain_confidence")
    b = F.when(c < 0.7, "[0.6,0.7)").when(c < 0.8, "[0.7,0.8)").when(c < 0.9, "[0.8,0.9)").otherwise("[0.9,1]")
    return rows.where(c >= 0.6).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(_all()), 1))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """AGG-45: rows and percent of each value."""
    total = F.broadcast(rows.agg(F.count("*").alias("whole")))
    return rows.groupBy(column).agg(F.count("*").alias("n")).crossJoin(total).select(F.col(column).alias("value"), "n", F.round(100 * F.col("n") / F.col("whole"), 1).alias("pct"))
