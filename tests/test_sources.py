import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywork.operators import drift as D
from tallywork.operators import forecast as W
from tallywork.operators import insights as I
from tallywork.operators import market as M
from tallywork.sources import lenses as L
from tallywork.sources import parse as P
from tallywork.sources import sinks as S
from tallywork.sources import tables as TB
from tallywork.streaming import stream as ST

from .conftest import DATA

_COLS = "id string, source string, detail_url string, first_seen_at string, last_seen_at string, scraped_at string, scrape_run_id string, category string"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "s", "u1", "d1", "d1", "d1", "r1", "all"), ("b", "s", "u2", "d1", "d1", "d1", "r1", "it"), ("z", "s", "u9", "d1", "d1", "d1", "r1", None)], _COLS)
    batch = spark.createDataFrame([("x", "s", "u1", "d2", "d2", "d2", "r2", "it", 1), ("y", "s", "u2", "d2", "d2", "d2", "r2", "all", 2), ("c", "s", "u3", "d2", "d2", "d2", "r2", "x", 3), ("d", "s", "u3", "d3", "d3", "d3", "r3", None, 4)], _COLS + ", ingest_seq int")
    got = {r.detail_url: (r.id, r.first_seen_at, r.last_seen_at, r.category, r.was_insert) for r in S.upsert_postings(old, batch).collect()}
    assert got == {"u1": ("a", "d1", "d2", "it", False), "u2": ("b", "d1", "d2", "it", False), "u3": ("d", "d3", "d3", None, True), "u9": ("z", "d1", "d1", None, None)}


def test_merges(spark):
    old = spark.createDataFrame([(1, "old", None, "PKR"), (2, None, None, None)], "id int, description string, skills_raw string, currency string")
    new = spark.createDataFrame([(1, None, "[1]", "USD"), (3, "x", None, None)], "id int, description string, skills_raw string, currency string")
    assert {tuple(r) for r in S.enrich(old, new).collect()} == {(1, "old", "[1]", "USD"), (2, None, None, None)}
    assert {tuple(r) for r in S.set_columns(old, new.select("id", "description"), ["description"]).collect()} == {(1, None, None, "PKR"), (2, None, None, None)}
    m = spark.createDataFrame([("p", "s", "v1"), ("p", "s", "v1"), ("q", None, "v1")], "posting_id string, skill string, extraction_method string")
    assert [tuple(r) for r in S.insert_absent(m.limit(0), m, S.MENTION_KEY).collect()] == [("p", "s", "v1")]
    b = spark.createDataFrame([(1, None), (2, None)], "id long, superseded_by long")
    after = S.supersede(b, 1, 2)
    S.check_locked(b, after, ["id"], [])
    with pytest.raises(ValueError):
        S.supersede(after, 1, 2)
    with pytest.raises(ValueError):
        S.check_locked(b, after, ["id"], ["superseded_by"])


def test_publish(spark, tmp_path):
    df = spark.range(3)
    S.publish(df, str(tmp_path / "t"), 1)
    S.publish(df.where("id > 0"), str(tmp_path / "t"), 2)
    assert S.current(spark, str(tmp_path / "t")).count() == 2


def test_parsers(spark):
    state = '<script>window.__STATE__ = {"jobs":[{"id":"7","url":"//x.y/7","title":"T","company":"C"},{"title":"no id"}]};</script>'
    pages = spark.createDataFrame([("http://x/?q=a&p=2", state), ("http://x", "<p>none</p>"), ("http://x", None)], "url string, html string")
    rows = P.listing_rows(pages).collect()
    assert [(r.source_job_id, r.detail_url, r.query["p"]) for r in rows] == [("7", "https://x.y/7", "2")]
    card = '<div class="card hot"><h3><a href="//a.b/1">Dev</a></h3><span class="company">Co</span><span class="salary">25K - 40K</span><i class="tag">sql</i></div><!--/card--><div class="card"><b>broken</b></div><!--/card-->'
    got = P.cards(spark.createDataFrame([("u", card)], "url string, html string")).collect()
    assert [(r.title, r.company, r.salary_min, r.salary_max, r.tags) for r in got] == [("Dev", "Co", 25000, 40000, ["sql"])]


def test_scans(spark):
    p = spark.createDataFrame([("m", "short", None, "PKR"), ("m", "w " * 130, '["a"]', "PKR"), ("r", None, None, None)], "source string, description string, skills_raw string, currency string")
    assert TB.needing_enrichment(p, "m").count() == 1
    assert D.text_availability(p).where("value = 'm'").first().a == 2
    assert D.refill_cost(p).first().blank == 1
    s = spark.createDataFrame([(float("nan"), " x ", "nan")], "salary_min double, title string, city string")
    assert tuple(TB.clean_scraped(s).first()) == (None, "x", None)


def test_errors(spark):
    with pytest.raises(KeyError):
        M.require_skill(L.taxonomy(spark, DATA), "nothing")
    with pytest.raises(ValueError):
        W.skill_trend(L.event_postings(spark, DATA), L.event_mentions(spark, DATA), ["k1"], "month", L.AS_OF)


def test_iqr_of_few(spark):
    from tallywork.operators.market import iqr_columns

    for values, want in (([], (0, None, None, None, None)), ([1.0, 2.0, 9.0], (3, 2.0, 2.0, 2.0, 0.0)), ([1.0, 2.0, 3.0, 4.0], (4, 2.5, 1.75, 3.25, 1.5))):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert tuple(df.agg(*iqr_columns(F.col("v"))).first()) == want


def test_last_row_wins_inside_and_between_streams(spark):
    from tallywork.sources.parse import pooled

    a = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("v", "a", 1), ("w", "x", 9)], "detail_url string, title string, ingest_seq long")
    b = spark.createDataFrame([("v", "b")], "detail_url string, title string")
    assert {r.detail_url: r.title for r in pooled([a, b]).collect()} == {"u": "new", "v": "b", "w": "x"}


def test_a_publish_that_was_cut_off_can_be_repeated(spark, tmp_path):
    from tallywork.sources import sinks

    folder, df = str(tmp_path / "t"), spark.range(3)
    df.write.parquet(f"{folder}/v000001-lost")  # written, but its pointer never came
    assert not sinks.any_published(spark, folder)
    sinks.publish(df, folder, 1)
    assert sinks.current(spark, folder).count() == 3 and sinks.published(spark, folder, 1)
    with pytest.raises(ValueError, match="published already"):
        sinks.publish(df, folder, 1)


def test_merge_groups_are_transitive(spark):
    df = spark.createDataFrame([("data",), ("data science",), ("data science lead",), ("a b c d",), ("a",)], "phrase string")
    got = {r.phrase: r.canonical for r in D.merge_groups(df, []).collect()}
    assert got["data science lead"] == "data" and got["a b c d"] == "a b c d"


def test_taxonomy_diff(spark):
    a = spark.createDataFrame([("s1", "c1"), ("s2", "c1"), ("s3", "c2")], "skill string, category string")
    b = spark.createDataFrame([("s1", "c1"), ("s2", "c2"), ("s4", "c9"), ("s5", "c1")], "skill string, category string")
    assert {(r.skill, r.kind) for r in D.taxonomy_diff(a, b).collect()} == {("s2", "reclassified"), ("s3", "gone"), ("s4", "new_category"), ("s5", "new_entry")}


def test_draft(spark):
    good = "Volume was 1,200. " + "word " * 100
    rows = spark.createDataFrame([(good, "volume 1200"), (good, "volume 7"), ("We met Mordor. 1200 " + "w " * 100, "1200"), (good + " skyrocket", "1200"), ("1200", "1200")], "body string, facts string")
    assert [r.blocked for r in I.verify_draft(rows, ["skyrocket"], []).collect()] == [None, "number not in facts: 1200", "name not in facts: Mordor", "banned phrase: skyrocket", "word count"]


def test_briefings(spark):
    b = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, 2), (2, dt.date(2024, 1, 1), 2, None), (3, dt.date(2024, 1, 8), 3, None)], "id long, week_start date, created_at int, superseded_by long")
    assert [(r.id, r.original_id) for r in W.current_briefings(b).collect()] == [(3, None), (2, 1)]


def test_grade_tie_is_no_win(spark):
    rows = spark.createDataFrame([(3.0, 5.0, 4), (4.0, 9.0, 4), (9.0, 4.0, 4)], "predicted double, baseline_predicted double, actual long")
    assert [(r.beat_baseline, r.outcome) for r in W.graded(rows).collect()] == [(False, "tie"), (True, "beat"), (False, "lost")]


def test_no_lookahead(spark):
    p, m = L.event_postings(spark, DATA), L.event_mentions(spark, DATA)
    cut = "2024-01-15"
    a = W.backtest(p, m, L.AS_OF).where(f"target_week_start < '{cut}'").select("target_type", "target_key", "target_week_start", "predicted")
    b = W.backtest(p.where(f"first_seen_at < '{cut} 00:00:00' - INTERVAL 5 HOURS"), m, f"{cut} 00:00:00").select("target_type", "target_key", "target_week_start", "predicted")
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    L.event_postings(spark, DATA).withColumn("detail_url", F.col("id").cast("string")).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    weekly = run(ST.weekly_counts(stream()), "weekly", "complete")
    want = W.week_counts(L.event_postings(spark, DATA)).groupBy("week").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in weekly.groupBy("week").agg(F.sum("n")).collect()} == {tuple(r) for r in want.collect()}
    assert run(ST.sessions(stream()), "sess", "complete").agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()
    assert run(ST.trailing_counts(stream()), "slide", "complete").agg(F.sum("n")).first()[0] == 4 * spark.read.parquet(src).count()
    assert run(ST.first_sightings(stream()), "seen", "append").count() == spark.read.parquet(src).count()


def test_search_answers_are_found_by_their_key(spark):
    good = '{"x": {"body": {}}, "httpCacheKey/ws/jobs/search/?categoryId=3&city=La%20hore": {"body": {"list": [{"id": 7, "title": "T", "company": "", "salaryMin": 10.0}, {"title": "no id"}, {"id": "8"}]}}}'
    page = lambda state: f'<script id="mustakbil-state" type="a">{state}</script>'
    rows = [("a", page(good)), ("b", page('{"other": 1}')), ("c", page("{broken")), ("d", "<p>"), ("e", None), ("f", page('{"httpCacheKey/ws/jobs/search/?": {"body": {}}}')), ("g", page("[1]"))]
    got = P.search_rows(spark.createDataFrame(rows, "url string, html string")).orderBy("source_job_id").collect()
    assert [(r.source_job_id, r.title, r.company, r.salary_min, r.params) for r in got] == [("7", "T", None, 10, {"categoryId": "3", "city": "La hore"}), ("8", None, None, None, {"categoryId": "3", "city": "La hore"})]
    assert got[0].detail_url.endswith("/7")


def test_reports_and_scans(spark, tmp_path):
    S.write_report(spark.createDataFrame([("a", 1), ("b", None)], "k string, n int").orderBy("k"), str(tmp_path / "r"), "Title", limit=1)
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["# Title", "", "| k | n |", "| - | - |", "| a | 1 |"]
    m = spark.createDataFrame([(1, "v2"), (2, "v1"), (3, None)], "posting_id int, extraction_method string")
    assert [r.posting_id for r in TB.active_mentions(m, "v2").collect()] == [1]
    m.write.parquet(str(tmp_path / "m"))
    scan = TB.scan(spark, str(tmp_path / "m"), ["posting_id"], F.col("extraction_method") == "v1")
    assert [tuple(r) for r in scan.collect()] == [(2,)] and "PushedFilters: [IsNotNull(extraction_method), EqualTo(extraction_method,v1)]" in scan._jdf.queryExecution().toString()
