"""Whole runs from tables to the next state of tables, with counters (ORC-01..04, ORC-08, GATE-03, SNK-11, SNK-12, DAT-07).

A run returns DataFrames; who calls it publishes them with :func:`sources.sinks.publish`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cols as C
from ..functions import extract as X
from ..functions import text as T
from ..session import checkpointed
from ..sources import curriculum as R
from ..sources import parse, sinks, tables
from ..sources.deltalog import DeltaLog, last, last_given
from .insights import template_briefing, verify_draft
from .market import typed

#: Fixed value: the method that active mentions carry.
METHOD = "taxonomy_v3"
_STRUCTURED = ["degree_level", "degree_field", "has_certification", "experience_min_years", "experience_max_years", "experience_level"]


def run_extraction(postings: DataFrame, mentions: DataFrame, vocabulary: list[tuple[str, list[str]]], taxonomy: DataFrame, run_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ORC-04: (mentions, postings, counters) after skills and structured fields are read from the postings of one run, or all.

    postings: id, title, description, skills_raw, experience_raw, the structured columns and others; mentions:
    posting_id, skill, category, requirement_type, extraction_method.  Mentions that are there stay; structured columns
    are set, nulls too.  Skills that the taxonomy lacks have the type ``skill`` and no category.
    """
    todo = tables.to_extract(postings, run_id)
    text = T.matching_text(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), C.skills_raw_text(F.col("skills_raw")))
    found = todo.select(F.col("id").alias("posting_id"), F.explode(T.matched(text, vocabulary)).alias("skill"))
    new = checkpointed(typed(found, taxonomy).withColumn("extraction_method", F.lit(METHOD)))
    keys = ["posting_id", "skill", "extraction_method"]
    inserted = checkpointed(sinks.insert_absent(mentions, new, keys))
    fields = todo.select("id", X.extracted(F.col("description"), F.col("experience_raw")).alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in _STRUCTURED])
    after = sinks.set_columns(postings, fields, _STRUCTURED)
    done = todo.agg(F.count("*").alias("postings_processed"))
    counters = done.crossJoin(new.agg(F.count("*").alias("mentions_found"))).crossJoin(inserted.agg(F.count("*").alias("inserted")))
    return mentions.unionByName(inserted), after, counters.withColumn("skipped", F.col("mentions_found") - F.col("inserted")).withColumn("structured_updated", F.col("postings_processed"))


def run_id(now: str, token: str) -> str:
    """DAT-07: a run's name from its moment (``2024-01-31 08:05:00``) and eight letters or digits of a random token."""
    day, _, clock = now.partition(" ")
    return f"{day.replace('-', '')}T{clock[:8].replace(':', '')}-{token[:8]}"


#: Fixed value: a stream that gives less than this of what was asked for is suspect.
LEAST_YIELD = 30


def _merge_in(postings: DataFrame, batch: DataFrame, name: str, seen_at: str) -> tuple[DataFrame, DataFrame]:
    """(the table with ``was_insert``, counts): rows with a url as sightings of a run; the others failed."""
    at = F.lit(seen_at).cast("timestamp")
    stamped = {"id": F.xxhash64("source", "detail_url"), "first_seen_at": at, "last_seen_at": at, "scraped_at": at, "scrape_run_id": F.lit(name)}
    rows = checkpointed(batch.withColumns(stamped))
    whole = rows.where("detail_url IS NOT NULL")
    lacking = [F.lit(None).cast(t).alias(c) for c, t in postings.dtypes if c not in whole.columns]
    merged = checkpointed(sinks.upsert_postings(postings, whole.select("*", *lacking)))
    counts = merged.agg(F.count_if(F.col("was_insert")).alias("inserted"), F.count_if(F.coalesce(~F.col("was_insert"), F.lit(False))).alias("updated"))
    return merged, counts.crossJoin(rows.agg(F.count("*").alias("postings_parsed"), F.count_if(F.col("detail_url").isNull()).alias("failed")))


def _extract(postings: DataFrame, mentions: DataFrame | None, vocabulary, taxonomy: DataFrame | None, name: str, counts: DataFrame):
    """Skills of the run's postings, if there is a vocabulary: (postings, mentions, counts)."""
    if mentions is None or vocabulary is None:
        return postings, mentions, counts
    mentions, postings, n = run_extraction(postings, mentions, vocabulary, taxonomy, name)
    return postings, mentions, counts.crossJoin(n.select(F.col("inserted").alias("skill_mentions_inserted"), F.col("skipped").alias("skill_mentions_skipped")))


def run_collection(
    pages: DataFrame, postings: DataFrame, name: str, seen_at: str, source: str = "mustakbil", category: str | None = None, details: DataFrame | None = None, mentions: DataFrame | None = None, vocabulary=None, taxonomy: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """ORC-01: (postings, mentions, counters) after listing pages that were fetched elsewhere are merged in.

    Of rows with one url the last in page order counts.  New postings, and only they, are enriched from ``details``
    (detail_url, description, skills_raw, currency), the pages that were fetched for them; those without one, or with one that
    has nothing, count as failed.  Then skills are read from all that the run touched.  ``postings`` has at least id, source,
    detail_url, category, first_seen_at, last_seen_at, scraped_at and scrape_run_id; columns that it lacks are dropped.
    """
    m = T.money_range(F.coalesce("salary_raw", F.lit("")))
    rows = parse.listing_rows(pages).withColumns({"source": F.lit(source), "category": F.lit(category).cast("string"), "salary_min": m["low"], "salary_max": m["high"]})
    merged, counts = _merge_in(postings, rows, name, seen_at)
    counts = counts.crossJoin(pages.agg(F.count("*").alias("pages_fetched")))
    after = merged.drop("was_insert")
    if details is not None:
        own = [c for c in ("description", "skills_raw", "currency") if c in postings.columns and c in details.columns]
        some = F.coalesce(*[F.nullif(F.trim(F.col(f"d.{c}").cast("string")), F.lit("")) for c in own])
        new = merged.where("was_insert").select("id", "detail_url").alias("p").join(parse.last_wins(details.withColumn("_n", F.lit(0)), ["detail_url"], "_n").alias("d"), "detail_url", "left")
        got = checkpointed(new.select("id", *[F.col(f"d.{c}").alias(c) for c in own], some.isNotNull().alias("_has")))
        after = sinks.enrich(after, got.where("_has").drop("_has"), tuple(own))
        counts = counts.crossJoin(got.agg(F.count_if("_has").alias("enriched"), F.count_if(~F.col("_has")).alias("enrich_failed")))
    return _extract(after, mentions, vocabulary, taxonomy, name, counts)


def run_streams(
    streams: dict[str, tuple[DataFrame, int]], postings: DataFrame, name: str, seen_at: str, source: str, places: tuple[list[str], list[str]] | None = None, mentions: DataFrame | None = None, vocabulary=None, taxonomy: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """ORC-02: (postings, mentions, counters, yields) after scraped streams, each with the number of rows asked for, are pooled and merged in.

    With ``places`` (countries, cities) rows elsewhere are dropped and counted, stale ones are counted but kept.  yields: stream,
    requested, received, low; the counters' verdict is ``LIKELY OK`` if no stream that was asked gave less than ``LEAST_YIELD``.
    """
    spark = postings.sparkSession
    pooled = checkpointed(parse.pooled([tables.clean_scraped(df) for df, _ in streams.values()]))
    kept = parse.geo_filtered(pooled, *places, as_of=seen_at) if places else pooled.withColumn("is_stale", F.lit(False))
    kept = checkpointed(kept)
    received = [(s, n, df.count()) for s, (df, n) in streams.items()]  # streams are few
    low = [s for s, n, k in received if n > 0 and k < LEAST_YIELD]
    batch = kept.drop("is_stale").withColumns({"source": F.lit(source), "ingest_seq": F.lit(0)})
    batch = batch if "category" in batch.columns else batch.withColumn("category", F.lit(None).cast("string"))
    merged, counts = _merge_in(postings, batch, name, seen_at)
    stale = kept.agg(F.count_if("is_stale").alias("stale"), F.count("*").alias("_kept")).crossJoin(pooled.agg(F.count("*").alias("_all")))
    counts = counts.crossJoin(stale.select("stale", (F.col("_all") - F.col("_kept")).alias("dropped"))).withColumn("verdict", F.lit("LIKELY BLOCKED/THROTTLED" if low else "LIKELY OK"))
    yields = spark.createDataFrame([(s, n, k, s in low) for s, n, k in received], "stream string, requested long, received long, low boolean")
    after, mentions, counts = _extract(merged.drop("was_insert"), mentions, vocabulary, taxonomy, name, counts)
    return after, mentions, counts, yields


def run_enrich_all(postings: DataFrame, details: DataFrame, source: str = "mustakbil") -> tuple[DataFrame, DataFrame]:
    """ORC-03: (postings, counters) after all postings of a source that need it are enriched from details (detail_url, description, skills_raw, currency) fetched elsewhere."""
    own = ("description", "skills_raw", "currency")
    need = tables.needing_enrichment(postings, source).select("id", "detail_url")
    d = parse.last_wins(details.withColumn("_n", F.lit(0)), ["detail_url"], "_n").select("detail_url", *own)
    some = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in own]).isNotNull()
    got = checkpointed(need.join(d, "detail_url", "left").withColumn("_has", some))
    counters = got.agg(F.count("*").alias("candidates"), F.count_if("_has").alias("enriched"), F.count_if(~F.col("_has")).alias("enrich_failed"))
    return sinks.enrich(postings, got.where("_has").select("id", *own), own), counters


def publish_briefing(briefings: DataFrame, facts: DataFrame, draft: str | None, banned: list[str], common: list[str], created_at: str, force: bool = False) -> tuple[DataFrame, str]:
    """GATE-03, SNK-11: (briefings, what was done: ``skipped``, ``draft`` or ``template``) for the week of the one row of ``facts``.

    A week that has a current briefing is left as it is unless ``force``; then the new one supersedes it, and the old
    row stays as published.  A draft that fails :func:`insights.verify_draft` gives way to the template, with the
    reason.  briefings: id long, week_start date, body, source, facts_json, blocked_reason, created_at, superseded_by.
    """
    built = template_briefing(facts).first()
    week = built["week"].isoformat()
    existing = tables.briefing_of(briefings, week).first()
    if existing is not None and not force:
        return briefings, "skipped"
    spark = briefings.sparkSession
    reason = "no draft"
    if draft is not None:
        checked = verify_draft(spark.createDataFrame([(draft, built["facts_json"])], "body string, facts string"), banned, common)
        reason = checked.first()["blocked"]
    body, source = (draft, "draft") if reason is None else (built["body"], "template")
    new_id = (briefings.agg(F.max("id")).first()[0] or 0) + 1
    row = spark.createDataFrame([(new_id, week, body, source, built["facts_json"], reason, created_at)], "id long, week_start string, body string, source string, facts_json string, blocked_reason string, created_at string")
    row = row.withColumn("week_start", F.col("week_start").cast("date")).withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("long"))
    old = briefings if existing is None else sinks.supersede(briefings, existing["id"], new_id)
    return old.unionByName(row.select(*briefings.columns)), source


def drain(pending: DataFrame, ledger: DeltaLog, work: Callable[[DataFrame], DataFrame], size: int = 20, max_batches: int = 10, order: str = "id") -> dict:
    """SNK-12, LLM-01: works off pending rows in batches of ``size``, at most ``max_batches`` a run, each written to the ledger before the next begins.

    Rows whose id the ledger has with a result are not pending any more, so a run that was capped or cut off goes on where it
    stopped.  ``work`` takes the rows of a batch and returns (id, result columns); ids that it leaves out are written as
    ``unanswered``, a batch whose work fails as ``failed`` with the reason, and both are pending again in the next run.  Returns
    counts: total, batches, written, unanswered, failed, remaining.
    """
    spark = pending.sparkSession
    known = ledger.read()
    todo = pending if known is None else pending.join(known.where("state = 'done'").select("id"), "id", "left_anti")
    total = todo.count()
    cap = min(total, size * max_batches)
    # no more rows than one run may take are put in order
    numbered = checkpointed(todo.orderBy(order).limit(cap).withColumn("_no", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size)))
    done = {"total": total, "batches": 0, "written": 0, "unanswered": 0, "failed": 0}
    seq = ledger.next_seq()
    for no in range(-(-cap // size)):
        batch = numbered.where(F.col("_no") == no).drop("_no")
        try:
            got = checkpointed(work(batch).join(batch.select("id"), "id", "left_semi").dropDuplicates(["id"]))
            rows = batch.select("id").join(got.withColumn("state", F.lit("done")), "id", "left").withColumn("state", F.coalesce("state", F.lit("unanswered"))).withColumn("reason", F.lit(None).cast("string"))
        except Exception as e:  # a failing batch must not take the others along
            rows = batch.select("id").withColumn("state", F.lit("failed")).withColumn("reason", F.lit(f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"))
        ledger.append(rows, seq + no)
        for r in rows.groupBy("state").count().collect():
            done[{"done": "written"}.get(r["state"], r["state"])] += r["count"]
        done["batches"] += 1
    return done | {"remaining": total - done["written"]}


def batch_ledger(spark: SparkSession, folder: str) -> DeltaLog:
    """The ledger of :func:`drain`: of each id the last state, and the last result that it was given."""
    return DeltaLog(spark, folder, ["id"], {"state": last, "reason": last}, default=last_given)


def run_curriculum(documents: dict[str, tuple[DataFrame, DataFrame]], vocabulary: list[tuple[str, list[str]]]) -> dict[str, DataFrame]:
    """ORC-08: (courses, skill_map, coverage, totals, top_skills, unmatched) of parsed documents, the (courses, topics) of :mod:`sources.curriculum` by a name.

    A course's id is a hash of its document, program, code, title and place; :func:`sources.sinks.publish_all` puts all tables in the old ones' stead at once.
    """
    courses, reports = None, None
    for rows, topics in documents.values():
        own = R.with_topics(rows, topics)
        report = R.coverage(rows, own, topics)
        courses, reports = (own, report) if courses is None else (courses.unionByName(own), reports.unionByName(report))
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document", "program", "code", "title", "page_no", "n")])
    courses = checkpointed(courses.withColumn("course_id", key))
    found = checkpointed(R.course_skills(courses, vocabulary))
    totals, ranked, unmatched = R.mapping_report(courses, found)
    return {"courses": courses, "skill_map": found, "coverage": reports, "totals": totals, "top_skills": ranked, "unmatched": unmatched}
