"""Phrases confirmed by the texts they are said to be in, their first excerpts, merged passes and categories (AGG-37, AGG-41, AGG-43, WIN-19, CLS-07, LLM-03..06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as U
from ..functions import text as T
from ..functions.classify import needs_review
from ..session import written

#: Excerpts a phrase, and characters on each side.
EXCERPTS, AROUND = 3, 60
UNKNOWN_COMPANY = "(unknown company)"


def verbatim_pattern(phrase: Column, whole_words: bool = False) -> Column:
    """A regular expression of a phrase as it stands: any case, any white space between its words."""
    words = F.transform(F.split(F.trim(F.regexp_replace(phrase, r"(?U)\s+", " ")), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    body = F.array_join(words, "\\s+")
    return F.concat(F.lit("(?iU)(?<!\\w)"), body, F.lit("(?!\\w)")) if whole_words else F.concat(F.lit("(?iU)"), body)


def excerpt(text: Column, pattern: Column, around: int = AROUND) -> Column:
    """struct(at, excerpt): the first place (from 1) of a pattern and what stands around it, white space collapsed, dots where text is cut; null if it isn't there."""
    at = F.regexp_instr(text, pattern)
    size = F.length(F.regexp_substr(text, pattern))
    start, end = F.greatest(at - around, F.lit(1)), F.least(at + size + around, F.length(text) + 1)
    body = F.trim(F.regexp_replace(F.substring(text, start, end - start), r"(?U)\s+", " "))
    shown = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, F.struct(at.alias("at"), shown.alias("excerpt")))


def confirmed(proposals: DataFrame, postings: DataFrame, around: int = AROUND) -> DataFrame:
    """(id, key, phrase, company, domain, at, excerpt): each proposed phrase of a posting, looked for in that posting's own text; at and excerpt are null where it is not there.

    proposals: id, phrase; postings: id, company, domain, description.  Proposals for unknown postings and blank phrases
    are none.  A text moves once: its phrases are brought to it.
    """
    key = T.normal(F.col("phrase"))
    of = proposals.where(F.col("phrase").isNotNull()).withColumn("key", key).where("key <> ''")
    once = of.groupBy("id", "key").agg(F.min(F.trim("phrase")).alias("phrase"))
    mine = once.groupBy("id").agg(F.collect_list(F.struct("key", "phrase")).alias("said"))  # bounded by what was said of one posting
    p = postings.select("id", F.coalesce("company", F.lit(UNKNOWN_COMPANY)).alias("company"), "domain", F.coalesce("description", F.lit("")).alias("text"))
    j = p.join(mine, "id").select("id", "company", "domain", "text", F.explode("said").alias("s"))
    seen = j.select("id", "company", "domain", "s.key", "s.phrase", excerpt(F.col("text"), verbatim_pattern(F.col("s.phrase")), around).alias("e"))
    return seen.select("id", "key", "phrase", "company", "domain", F.col("e.at").alias("at"), F.col("e.excerpt").alias("excerpt"))


def first_excerpts(rows: DataFrame, keys: list[str], order: str = "id", value: str = "excerpt", k: int = EXCERPTS) -> DataFrame:
    """WIN-19: (keys, excerpts): the first ``k`` different values of each key, by ``order``.

    Values are made one first; then each task keeps ``k`` rows of a key before any moves, so no list is longer than that.
    """
    once = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first", value)
    few = once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(f"{value}s"))


def surviving(pairs: DataFrame, least_postings: int = 2, least_companies: int | Column = 3, k: int = EXCERPTS) -> DataFrame:
    """AGG-41: (key, phrase, postings, companies, excerpts) of phrases confirmed in enough postings of enough companies, from :func:`confirmed`.

    The spelling is that of the first posting that confirms it.  What is confirmed is written, so that texts are searched once
    and not for the counts and the excerpts each.
    """
    ok = written(pairs.where("at IS NOT NULL"))
    n = ok.groupBy("key").agg(F.min(F.struct("id", "phrase")).alias("f"), F.count_distinct("id").alias("postings"), F.count_distinct("company").alias("companies"))
    good = n.where((F.col("postings") >= least_postings) & (F.col("companies") >= least_companies))
    shown = first_excerpts(ok.join(good.select("key"), "key", "left_semi"), ["key"], k=k)
    return good.join(shown, "key").select("key", F.col("f.phrase").alias("phrase"), "postings", "companies", "excerpts")


def proposal_counts(pairs: DataFrame) -> DataFrame:
    """AGG-41: one row (proposed, confirmed, dropped): different phrases, those found in a text, and those found in none."""
    own = pairs.groupBy("key").agg(F.max(F.col("at").isNotNull()).alias("seen"))
    return own.agg(F.count("*").alias("proposed"), F.count_if("seen").alias("confirmed"), F.count_if(~F.col("seen")).alias("dropped"))


def aggregate_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG-37: (group, phrases, postings, companies, domains) of groups (key, group) of phrases: unions, so a posting with two of a group's phrases counts once.

    ``domains`` is text ``domain:postings``, most first.
    """
    hit = pairs.where("at IS NOT NULL").join(groups.select("key", "group"), "key")
    phrases = hit.groupBy("group", "key").agg(F.lit(1)).groupBy("group").agg(F.count("*").alias("phrases"))
    posting = hit.groupBy("group", "id").agg(F.min("company").alias("company"), F.min("domain").alias("domain"))
    n = posting.groupBy("group", "company", "domain").agg(F.count("*").alias("n"))
    companies = n.groupBy("group", "company").agg(F.sum("n").alias("n")).groupBy("group").agg(F.sum("n").alias("postings"), F.count("company").alias("companies"))
    domain = n.groupBy("group", "domain").agg(F.sum("n").alias("n")).where("domain IS NOT NULL")
    split = domain.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "domain"))), lambda x: F.concat_ws(":", x["domain"], (-x["m"]).cast("string"))), ", ").alias("domains"))
    return phrases.join(companies, "group").join(split, "group", "left").select("group", "phrases", "postings", "companies", F.coalesce("domains", F.lit("")).alias("domains"))


def tag_pairs(postings: DataFrame, vocabulary: list[tuple[str, list[str]]]) -> DataFrame:
    """AGG-43: (id, key, phrase, company, domain) of tags (``tags``: array<string>) of postings, those that the vocabulary has left out."""
    t = postings.select("id", F.coalesce("company", F.lit(UNKNOWN_COMPANY)).alias("company"), "domain", F.explode("tags").alias("tag")).where("trim(tag) <> ''")
    new = t.where(F.size(T.matched(F.lower("tag"), vocabulary)) == 0) if vocabulary else t
    return new.select("id", T.normal(F.col("tag")).alias("key"), F.trim("tag").alias("phrase"), "company", "domain")


def merged(tags: DataFrame, texts: DataFrame, least_companies: int = 3) -> DataFrame:
    """AGG-43, JOI-18, SET-07: (key, phrase, passes, postings, companies, example) of a tag pass (:func:`tag_pairs`) and of a text pass (:func:`confirmed` and surviving).

    Postings and companies are unions.  The example is an excerpt if the text pass has one, else the tag.  The tag's spelling goes before the text's.
    """
    u = tags.select("key", "phrase", "id", "company", F.lit("tag").alias("pass"), F.concat(F.lit("(tag) "), "phrase").alias("example")).unionByName(
        texts.where("at IS NOT NULL").select("key", "phrase", "id", "company", F.lit("text").alias("pass"), F.concat(F.lit("(verbatim) "), "excerpt").alias("example"))
    )
    out = u.groupBy("key").agg(
        F.count_distinct("id").alias("postings"), F.count_distinct("company").alias("companies"), F.min(F.struct("pass", "id", "phrase")).alias("f"), F.max(F.struct(F.col("pass"), -F.col("id"), F.col("example"))).alias("e"),
        F.max(F.col("pass") == "tag").alias("t"), F.max(F.col("pass") == "text").alias("x"),
    )
    passes = F.when(F.col("t") & F.col("x"), "both").when(F.col("t"), "tag").otherwise("text")
    return out.where(F.col("companies") >= least_companies).select("key", F.col("f.phrase").alias("phrase"), passes.alias("passes"), "postings", "companies", F.col("e.example").alias("example"))


def answered(answers: DataFrame, wanted: DataFrame, on: str = "phrase") -> tuple[DataFrame, DataFrame]:
    """LLM-01..06: (answers, ledger): the last answer (by ``batch``) of each wanted row, and for every wanted row how it stands.

    ``answers`` come from outside.  The ledger says ``answered``, ``repeated`` (more than one answer) or ``unanswered``; answers to what nobody asked
    are ``unknown`` and go to no one.
    """
    own = answers.groupBy(on).agg(F.count("*").alias("n"), F.max_by(F.struct(*answers.columns), F.struct("batch")).alias("a"))
    j = wanted.select(on).distinct().withColumn("_w", F.lit(True)).join(own, on, "full")
    state = F.when(F.col("_w").isNull(), "unknown").when(F.col("n").isNull(), "unanswered").when(F.col("n") > 1, "repeated").otherwise("answered")
    return j.where("_w AND n IS NOT NULL").select("a.*"), j.select(on, state.alias("state"))


def categorised(candidates: DataFrame, heuristics, answers: DataFrame, synonyms: dict[str, str], hidden: tuple[str, ...] = ("soft", "office_admin")) -> DataFrame:
    """CLS-07: (key, phrase, requirement_type, category, substantive, source) of every candidate: by the heuristic rules, else by its answer, else ``uncategorized``.

    Three passes by precedence: a phrase that a heuristic rule names is never asked for, and the rule wins over an answer
    too.  Answers (phrase, proposed_category, proposed_requirement_type, batch) are named by spelling; categories go through the
    synonyms; an answer without a type is of type ``skill``, one without a category ``(uncategorized)``.
    """
    ruled = candidates.withColumn("_h", U.first_rule(F.col("phrase"), heuristics))
    said, _ = answered(answers, ruled.where("_h IS NULL"))
    key = F.replace(F.replace(T.normal(F.col("proposed_category")), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
    canonical = F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.col("proposed_category")) if pairs else F.col("proposed_category")
    a = said.select(F.col("phrase").alias("_p"), F.coalesce(canonical, F.lit("(uncategorized)")).alias("_c"), F.coalesce("proposed_requirement_type", F.lit("skill")).alias("_t"))
    j = ruled.join(a, F.col("_h").isNull() & (F.col("phrase") == F.col("_p")), "left")
    category = F.coalesce("_h", "_c")
    return j.select(
        "key", "phrase", F.when(F.col("_h").isNotNull(), "skill").otherwise(F.col("_t")).alias("requirement_type"), category.alias("category"), (~F.lower(category).isin(*hidden)).alias("substantive"),
        F.when(F.col("_h").isNotNull(), "heuristic").when(F.col("_p").isNotNull(), "llm").otherwise("uncategorized").alias("source"),
    )


def reviewed(answers: DataFrame, type_rules, existing: list[str]) -> DataFrame:
    """LLM-03, CLS-08, ATT-13: (phrase, category, is_new, heuristic, proposed_type, confidence, flagged) of each answered phrase, the last answer by ``batch``.

    A category is new if the answer says so, or, where it says nothing, if none of ``existing`` is the same but for case; one that
    is not new is written as it exists.  An answer without a category is ``(uncategorized)``, one without a type takes the
    heuristic's, an unreadable confidence is null.  answers: phrase, proposed_category, proposed_requirement_type,
    confidence (text), is_new_category, batch.
    """
    last, _ = answered(answers, answers)
    given = F.coalesce(F.nullif(F.col("proposed_category"), F.lit("")), F.lit("(uncategorized)"))
    same = F.lower(F.trim(given))
    names = [F.lit(x) for c in dict.fromkeys(existing) for x in (c.lower(), c)]
    known = F.try_element_at(F.create_map(*names), same) if names else F.lit(None).cast("string")
    new = F.coalesce("is_new_category", known.isNull())
    heuristic = U.first_rule(F.col("phrase"), type_rules, "skill")
    said = F.coalesce(F.nullif(F.col("proposed_requirement_type"), F.lit("")), F.col("heuristic"))
    rows = last.withColumn("heuristic", heuristic)
    return rows.select(
        "phrase", F.when(new, given).otherwise(F.coalesce(known, given)).alias("category"), new.alias("is_new"), "heuristic", said.alias("proposed_type"), F.col("confidence").try_cast("double").alias("confidence"),
        needs_review(F.col("confidence"), F.col("heuristic"), said).alias("flagged"),
    )


def gram_excerpts(grams: DataFrame, postings: DataFrame, wanted: DataFrame, k: int = EXCERPTS, around: int = 40) -> DataFrame:
    """WIN-19: (gram, excerpts): of each wanted gram the first ``k`` different excerpts of postings that have it, by posting id.

    grams: id, gram.  Texts that are the same give the same excerpts, so only the first of them is looked at.  A gram's first
    few postings are tried, then eight times as many as long as it has too few excerpts and more postings; a text moves
    once a round, its grams are brought to it.
    """
    texts = postings.select("id", F.coalesce("description", F.lit("")).alias("text"))
    first = texts.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("id").alias("id")).select("id")
    rows = written(grams.select("id", "gram").join(wanted.select("gram"), "gram", "left_semi").join(first, "id", "left_semi").distinct())
    done, tried, most = None, None, 4 * k
    while True:
        w = Window.partitionBy("gram").orderBy("id")
        ranked = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        mine = written(ranked.groupBy("id").agg(F.collect_list("gram").alias("said")))  # bounded by the grams of one posting; written, so that texts only move if it is large
        seen = texts.join(mine, "id").select("id", "text", F.explode("said").alias("gram"))
        e = written(seen.select("id", "gram", excerpt(F.col("text"), verbatim_pattern(F.col("gram"), True), around)["excerpt"].alias("excerpt")))
        found = written(first_excerpts(e, ["gram"], k=k))
        tried = e.groupBy("gram").agg(F.count("*").alias("n")).join(found, "gram", "left")
        short = written(tried.where((F.col("n") >= most) & (F.coalesce(F.size("excerpts"), F.lit(0)) < k)).select("gram"))
        have = found.join(short, "gram", "left_anti")
        done = have if done is None else done.unionByName(have)
        if short.isEmpty():
            return done
        rows, most = written(rows.join(short, "gram", "left_semi")), 8 * most
