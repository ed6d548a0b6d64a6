"""Whole runs on small tables."""

from pyspark.sql import functions as F

from tallywork.operators import flows

POSTINGS = "id long, title string, description string, skills_raw string, experience_raw string, scrape_run_id string, degree_level string, degree_field string, has_certification boolean, experience_min_years int, experience_max_years int, experience_level string"


def test_extraction_run(spark):
    none = (None,) * 6
    posts = spark.createDataFrame([(1, "SQL developer", "BS Computer Science or equivalent. Minimum 3 years of experience required.", '["python"]', None, "r1", *none), (2, "Cook", "", None, None, "r1", *none), (3, "SQL", "sql", None, None, "r0", *none)], POSTINGS)
    mentions = spark.createDataFrame([(1, "sql", "data", "skill", "taxonomy_v3")], "posting_id long, skill string, category string, requirement_type string, extraction_method string")
    taxonomy = spark.createDataFrame([("sql", "data", "skill")], "skill string, category string, requirement_type string")
    m, p, n = flows.run_extraction(posts, mentions, [("sql", ["sql"]), ("python", ["python"])], taxonomy, "r1")
    assert sorted(tuple(r)[:4] for r in m.collect()) == [(1, "python", None, "skill"), (1, "sql", "data", "skill")]
    assert n.first().asDict() == {"postings_processed": 2, "mentions_found": 2, "inserted": 1, "skipped": 1, "structured_updated": 2}
    got = {r.id: (r.degree_level, r.experience_min_years) for r in p.collect()}
    assert got == {1: ("bachelors", 3), 2: (None, None), 3: (None, None)}


TABLE = "id long, source string, detail_url string, source_job_id string, title string, company string, city string, category string, description string, skills_raw string, currency string, experience_raw string, salary_min long, salary_max long, first_seen_at timestamp, last_seen_at timestamp, scraped_at timestamp, scrape_run_id string, degree_level string, degree_field string, has_certification boolean, experience_min_years int, experience_max_years int, experience_level string"
MENTION = "posting_id long, skill string, category string, requirement_type string, extraction_method string"


def state(*jobs):
    return '<script>__STATE__ = {"jobs": [' + ", ".join(jobs) + "]};</script>"


def job(i, title, url=None, salary=""):
    return f'{{"id": "{i}", "url": "{url or "https://x.example/j/" + str(i)}", "title": "{title}", "company": "C", "city": "K", "salary": "{salary}"}}'


def test_collection_run(spark):
    old = spark.createDataFrame([], TABLE)
    pages = spark.createDataFrame([("https://x.example/a?p=2", 2, state(job(7, "later", salary="25K - 40K"), '{"title": "no id"}')), ("https://x.example/a?p=1", 1, state(job(7, "earlier"), job(8, "SQL cook"), '{"id": "9", "title": "no url"}')), ("https://x.example/a?p=3", 3, None)], "url string, page_no int, html string")
    details = spark.createDataFrame([("https://x.example/j/7", "uses python", "[]", "USD"), ("https://x.example/j/8", " ", None, None), ("https://elsewhere", "x", None, None)], "detail_url string, description string, skills_raw string, currency string")
    taxonomy = spark.createDataFrame([("sql", "data", "skill")], "skill string, category string, requirement_type string")
    vocabulary = [("sql", ["sql"]), ("python", ["python"])]
    none = spark.createDataFrame([], MENTION)
    once, mentions, n = flows.run_collection(pages, old, "r1", "2024-01-01 00:00:00", category="it", details=details, mentions=none, vocabulary=vocabulary, taxonomy=taxonomy)
    assert n.first().asDict() == {"inserted": 2, "updated": 0, "postings_parsed": 4, "failed": 1, "pages_fetched": 3, "enriched": 1, "enrich_failed": 1, "skill_mentions_inserted": 2, "skill_mentions_skipped": 0}
    rows = {r.source_job_id: r for r in once.collect()}
    assert (rows["7"].title, rows["7"].salary_min, rows["7"].salary_max, rows["7"].description, rows["7"].currency, rows["7"].category) == ("later", 25000, 40000, "uses python", "USD", "it")
    assert {(r.skill, r.requirement_type) for r in mentions.collect()} == {("sql", "skill"), ("python", "skill")} and once.columns == old.columns
    again, more, n = flows.run_collection(pages, once, "r2", "2024-01-08 00:00:00", details=details, mentions=mentions, vocabulary=vocabulary, taxonomy=taxonomy)
    row = again.where("source_job_id = '7'").first()
    counts = n.first()
    assert (counts.inserted, counts.updated, counts.enriched, counts.enrich_failed, counts.skill_mentions_inserted, counts.skill_mentions_skipped) == (0, 2, 0, 0, 0, 2) and more.count() == 2
    assert (row.scrape_run_id, row.first_seen_at.day, row.last_seen_at.day, row.category) == ("r2", 1, 8, "it")
    only, _, n = flows.run_collection(pages, old, "r1", "2024-01-01 00:00:00")
    assert only.count() == 2 and "enriched" not in n.columns


def test_stream_runs_and_their_verdict(spark):
    old = spark.createDataFrame([], TABLE)
    row = lambda u, place, day=None: (u, f"t{u}", place, day)
    schema = "detail_url string, title string, location string, posting_date date"
    import datetime as dt

    many = spark.createDataFrame([row(f"u{i}", "Lahore, Punjab, Pakistan") for i in range(40)], schema)
    few = spark.createDataFrame([row("u1", "Karachi", dt.date(2023, 1, 1)), row("v", "Oslo, Norway"), row("w", "Karāchi, PK")], schema)
    after, mentions, n, yields = flows.run_streams({"blank": (many, 50), "data": (few, 50)}, old, "r1", "2024-01-01 00:00:00", "linkedin", (["pakistan", "pk"], ["karachi"]))
    counts = n.first()
    assert (counts.inserted, counts.dropped, counts.stale, counts.verdict) == (41, 1, 1, "LIKELY BLOCKED/THROTTLED") and mentions is None
    assert {(r.stream, r.received, r.low) for r in yields.collect()} == {("blank", 40, False), ("data", 3, True)}
    assert after.where("source = 'linkedin'").count() == 41
    assert flows.run_streams({"blank": (many, 50), "unasked": (few, 0)}, old, "r", "2024-01-01 00:00:00", "indeed")[2].first().verdict == "LIKELY OK"


def test_enrich_all(spark):
    rows = [(1, "m", "u1", "short", None, None), (2, "m", "u2", "w " * 130, '["a"]', "PKR"), (3, "m", "u3", None, None, None), (4, "r", "u4", None, None, None)]
    p = spark.createDataFrame(rows, "id long, source string, detail_url string, description string, skills_raw string, currency string")
    d = spark.createDataFrame([("u1", "long text", None, "EUR"), ("u3", None, "", None), ("u4", "x", None, None)], "detail_url string, description string, skills_raw string, currency string")
    after, n = flows.run_enrich_all(p, d, "m")
    assert tuple(n.first()) == (2, 1, 1) and {r.id: (r.description, r.currency) for r in after.where("id IN (1, 3, 4)").collect()} == {1: ("long text", "EUR"), 3: (None, None), 4: (None, None)}


def test_run_names():
    assert flows.run_id("2024-01-31 08:05:09", "0123456789ab") == "20240131T080509-01234567"


def test_curriculum_run(spark, tmp_path):
    from tallywork.sources import curriculum as R
    from tallywork.sources import sinks as S

    a = spark.createDataFrame([("d", 5, "SEMESTER-I\n1 Calculus 3 (3+0) Major"), ("d", 6, "GUIDELINES FOR SPECIALIZATIONS"), ("d", 7, "COURSE LEARNING OUTCOMES (CLOS):\n1. Calculus\nBy the end of this course sql")], "document string, page_no int, text string")
    b = spark.createDataFrame([("e", 16, "1 1 CS1xx SQL Core 4 (3-3)")], "document string, page_no int, text string")
    programs = spark.createDataFrame([("e", 16, "CS")], "document string, page_no int, program string")
    out = flows.run_curriculum({"cs": R.scheme_courses(a, "BS"), "bs": R.program_courses(b, programs)}, [("sql", ["sql"])])
    assert out["totals"].first().asDict() == {"courses": 2, "matched_courses": 2, "skills": 1, "rows": 2, "unmatched_courses": 0}
    assert {(r.document, r.courses) for r in out["coverage"].where("program IS NULL").collect()} == {("d", 1), ("e", 1)}
    S.publish_all(out, str(tmp_path / "c"), 1)
    read = S.current_all(spark, str(tmp_path / "c"))
    assert set(read) == set(out) and read["skill_map"].count() == 2


def test_tables_of_a_run_come_all_or_none(spark, tmp_path):
    from tallywork.sources import sinks as S

    folder = str(tmp_path / "t")
    S.publish_all({"a": spark.range(1), "b": spark.range(2)}, folder, 1)
    broken = spark.range(1).selectExpr("raise_error('broken') AS x")
    try:
        S.publish_all({"a": spark.range(9), "b": broken}, folder, 2)
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "broken" in str(e)
    assert S.current_all(spark, folder)["a"].count() == 1
    S.publish_all({"a": spark.range(9)}, folder, 2)
    assert set(S.current_all(spark, folder)) == {"a"} and S.current_all(spark, folder)["a"].count() == 9


def test_briefings_are_published_once_and_superseded_on_demand(spark):
    none = spark.createDataFrame([], "id long, week_start date, body string, source string, facts_json string, blocked_reason string, created_at timestamp, superseded_by long")
    facts = spark.createDataFrame([("2024-01-22", 120, 100, 20, 20.0)], "week string, volume long, volume_before long, change long, change_pct double").withColumn("week", F.col("week").cast("date"))
    run = lambda b, draft, force=False: flows.publish_briefing(b, facts, draft, ["synergy"], ["In", "There", "That"], "2024-01-29 00:00:00", force)
    first, did = run(none, None)
    assert did == "template" and first.count() == 1 and first.first().blocked_reason == "no draft"
    same, did = run(first, "anything")
    assert did == "skipped" and same.count() == 1
    second, did = run(first, "There were 999 postings. " + "word " * 120, True)
    rows = {r.id: r for r in second.collect()}
    assert did == "template" and rows[1].superseded_by == 2 and rows[2].superseded_by is None and "999" in rows[2].blocked_reason and rows[1].body == rows[2].body
    third, did = run(second, "There were 120 postings. " + "word " * 120, True)
    assert did == "draft" and {r.id: r.superseded_by for r in third.collect()} == {1: 2, 2: 3, 3: None}
