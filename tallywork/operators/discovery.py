"""Whole discovery runs: drift of the vocabulary, and the consolidation of two passes (ORC-05, ORC-07).

A run makes its tables from one mining of the postings and returns them by name; :func:`sources.sinks.publish_all` puts all
of them before readers at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import cols as C
from ..functions import rules as U
from ..functions import text as T
from ..session import written
from . import drift as D
from . import phrases as P
from . import reviews as V

#: How much of a result is shown in full, in segments, and of the gap.
DETAIL, SEGMENT, GAP = 50, 30, 100
#: Most aliases that are taken out of the arrays of grams; more are joined.
ALIASES = 1_000
#: Most postings in a file of their texts.
TEXTS = 500


def run_drift(
    postings: DataFrame, vocabulary: list[tuple[str, list[str]]], taxonomy: DataFrame, fillers: list[str], bare: list[str], domain_rules, type_rules, most: int = 4, gap_focus: bool = True, least_postings: int = 8, least_companies: int = 3
) -> dict[str, DataFrame]:
    """ORC-05: the tables of a drift report by name.

    postings: id, source, company, title, description.  Each posting's domain comes from ``domain_rules`` on its title, each gram's
    type from ``type_rules``.  The postings are read once: their texts and matches are one table, from which the rest is made.
    Grams are made from it twice, to be counted (in all postings and in the gap at once) and for the few that are shown.
    Tables: counters (one row), depth_by_source, depth_by_domain, candidates (with types), by_type, by_source, by_domain (the
    leading ones of each), details (of the first of each type), and with ``gap_focus`` gap: the candidates among
    postings with one substantive skill at most, by lift over all postings, with details.
    """
    own = ["id", "source", "company", "domain"]
    text = F.coalesce("description", F.lit(""))
    known = taxonomy.where(C.substantive(F.col("category"), F.col("requirement_type"))).select("skill").collect()  # bounded by the vocabulary
    hidden = F.array(*[F.lit(r["skill"]) for r in known]) if known else F.expr("CAST(array() AS array<string>)")
    aliases = [" ".join(a.lower().split()) for _, names in vocabulary for a in names if a.strip()]
    p = postings.select(
        "id", F.coalesce("source", F.lit("unknown")).alias("source"), C.company_key(F.col("company")).alias("company"), U.first_rule(F.col("title"), domain_rules, "other_unclassified").alias("domain"), "description",
        F.size(F.array_intersect(T.matched(T.matching_text(F.coalesce("title", F.lit("")), text), vocabulary), hidden)).alias("n_skills"),
    )
    mined = written(p, TEXTS)
    own = [*own, "n_skills"]
    t = mined.select(*own, T.tokens(text).alias("tokens"))
    t = t.select(*own, "tokens", T.kept_tokens(F.col("tokens"), fillers).alias("kept"), T.number_tokens(F.col("tokens")).alias("number"))
    listed = T.ngrams(F.col("tokens"), F.col("kept"), F.col("number"), most, bare)
    few = sorted(set(aliases)) if len(set(aliases)) <= ALIASES else []
    grams = t.select(*own, F.explode(F.array_except(listed, F.array(*map(F.lit, few))) if few else listed).alias("gram"))  # made anew from the texts wherever it is read: its rows take far more room
    if len(set(aliases)) > ALIASES:
        alias = mined.sparkSession.createDataFrame([(a,) for a in sorted(set(aliases))], "gram string")
        grams = grams.join(F.broadcast(alias) if len(aliases) <= 50_000 else alias, "gram", "left_anti")
    considered = F.trim(F.coalesce("description", F.lit(""))) != ""

    blind = F.col("n_skills") <= 1
    part = blind if gap_focus else None
    raw = Observation()  # all grams are counted on the way to the candidates, those of the gap in the same shuffle
    every = D.counted(grams, mined, part).observe(raw, F.count(F.lit(1)).alias("raw_candidates"))
    both = written(D.qualified(every, grams, least_postings, least_companies, part).withColumn("type", U.first_rule(F.col("gram"), type_rules, "skill")))
    found = both.select("gram", "postings", "companies", "sources", "domains", "type")
    depth = mined.drop("description")
    out = {"depth_by_source": D.depth_stats(depth, "source"), "depth_by_domain": D.depth_stats(depth, "domain"), "candidates": found}
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("companies"), F.desc("postings"), "gram"))
    ranked = written(found.withColumn("place", rank).where(F.col("place") <= max(DETAIL, SEGMENT)))
    out["by_type"] = ranked.where(F.col("place") <= SEGMENT)
    first = written(ranked.where(F.col("place") <= DETAIL).drop("place"))
    for by in ("source", "domain"):
        out[f"by_{by}"] = D.segments(grams, by, SEGMENT, 1, found.select("gram"))
    counters = mined.agg(F.count("*").alias("postings"), F.count_if(considered).alias("considered"), F.count_if(blind).alias("blind_spots"), F.count_if(blind & considered).alias("blind_considered"))
    counted = written(counters.withColumn("raw_candidates", F.lit(raw.get["raw_candidates"]).cast("long")).crossJoin(found.agg(F.count("*").alias("qualified"))))
    shown = first.select("gram")
    if gap_focus:
        n = counted.first()
        gap = both.where((F.col("part_postings") >= least_postings) & (F.col("part_companies") >= least_companies))  # what qualifies in a part does so in the whole
        lift = D.lift_of(F.col("part_postings"), F.col("postings"), max(1, n["blind_considered"]), max(1, n["considered"]))
        lifted = gap.select("gram", *[F.col(f"part_{c}").alias(c) for c in ("postings", "companies", "sources", "domains")], lift.alias("lift"), "type")
        top = written(lifted.orderBy(F.desc("lift"), F.desc("postings"), "gram").limit(GAP))
        shown = shown.unionByName(top.select("gram")).distinct()
        counted = counted.crossJoin(gap.agg(F.count("*").alias("gap_qualified")))
    shown = written(shown)
    mine = written(grams.join(F.broadcast(shown) if shown.count() <= 50_000 else shown, "gram", "left_semi"))
    out["details"] = D.details(mine, mined, first)
    if gap_focus:
        out["gap"] = D.details(mine.where(blind), mined, top)
    return {"counters": counted, **out}


def consolidate(postings: DataFrame, mentions: DataFrame, proposals: DataFrame, vocabulary: list[tuple[str, list[str]]], method: str, heuristics, answers: DataFrame, synonyms: dict[str, str], stop: list[str], cap: int = 40) -> dict[str, DataFrame]:
    """ORC-07: the tables of an approval sheet: sheet (the leading candidates of each domain), summary, merge_groups, counts (of proposals).

    postings: id, company, domain, description, tags (array<string>); proposals (id, phrase) come from outside.  Of the domains
    that qualify, tag and text passes are merged each with the domain's own bar of companies; the phrases of all domains are
    categorised together, and near-duplicates among them are grouped; nothing is applied.
    """
    chosen = written(V.targets(postings, mentions, method))
    fit = written(V.target_report(postings, chosen).where("qualifies = 'yes'").select("domain", "bar"))
    own = written(chosen.join(F.broadcast(fit), "domain"))  # domains are few
    pairs = written(P.confirmed(proposals, own))
    bars = fit.collect()
    rows = None
    for r in bars:
        texts = pairs.where(F.col("domain") == r["domain"])
        good = P.surviving(texts, 2, r["bar"]).select("key")
        no_text = own.where((F.col("domain") == r["domain"]) & C.blank(F.col("description")))
        m = P.merged(P.tag_pairs(no_text, vocabulary), texts.join(good, "key", "left_semi"), r["bar"]).withColumn("domain", F.lit(r["domain"]))
        rows = m if rows is None else rows.unionByName(m)
    if rows is None:
        rows = P.merged(P.tag_pairs(own, vocabulary), pairs, 1).withColumn("domain", F.lit(None).cast("string"))
    rows = written(rows)
    once = rows.groupBy("key").agg(F.min("phrase").alias("phrase"))
    known = written(P.categorised(once, heuristics, answers, synonyms).drop("phrase"))
    groups = written(D.merge_groups(once.select("phrase"), stop))
    sized = groups.join(groups.groupBy("canonical").agg(F.count("*").alias("members")), "canonical").where("members > 1").drop("members")
    j = rows.join(known, "key").join(once.select("key", F.col("phrase").alias("_p")), "key").join(sized.select(F.col("phrase").alias("_p"), "canonical"), "_p", "left").drop("_p")
    w = Window.partitionBy("domain").orderBy(F.desc("companies"), F.desc("postings"), "key")
    sheet = j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    flag = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    summary = j.groupingSets([["domain"], []], "domain").agg(F.count("*").alias("candidates"), flag(F.col("substantive"), "substantive"), flag(~F.col("substantive"), "hidden"), F.count_if(F.col("substantive").isNull()).alias("unknown"), F.grouping("domain").alias("g"))
    summary = summary.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("domain")).alias("domain"), "candidates", "substantive", "hidden", "unknown")
    return {"sheet": sheet, "summary": summary, "merge_groups": sized, "counts": P.proposal_counts(pairs), "targets": V.target_report(postings, chosen)}
