"""Whole answers of pages: bounds, empty tables, nulls."""

import pytest
from pyspark.sql import functions as F

from tallywork.operators import pages as G
from tallywork.sources import lenses as L

from .conftest import DATA

FORECAST = "target_type string, target_key string, target_week_start date, predicted double, baseline_predicted double, actual double, abs_error double, baseline_abs_error double, graded_at timestamp"
BRIEFING = "id long, week_start string, created_at string, body string, source string, facts_json string, superseded_by long"


def test_facts_of_nothing(spark):
    p, m = L.event_postings(spark, DATA).limit(0), L.event_mentions(spark, DATA).limit(0)
    t = spark.createDataFrame([], "skill string, display string, category string, requirement_type string")
    f = G.weekly_facts(p, m, t, spark.createDataFrame([], FORECAST), L.AS_OF, "2024-01-01 00:00:00", "view", ("view",)).first()
    assert f.last_week["count"] == f.running["count"] == f.volume["volume"] == 0 and f.last_week["mae"] is None and f.graded == f.predictions == f.top == f.entered == f.left == []


def test_week_companies_leave_bulk_and_nameless_out(spark):
    p = spark.createDataFrame([(1, "A", "2024-01-02"), (2, "a ", "2024-01-03"), (3, "Bulk", "2024-01-03"), (4, None, "2024-01-03"), (5, "", "2024-01-03"), (6, "C", "2024-01-09")], "id long, company string, first_seen_at string").withColumn("first_seen_at", F.col("first_seen_at").cast("timestamp"))
    m = spark.createDataFrame([(i, "s") for i in range(1, 7)], "posting_id long, skill string")
    week = F.lit("2024-01-01").cast("date")
    assert G.week_companies(p, m, week, ("bulk",)).first().companies == 1 and G.week_companies(p, m, week).first().companies == 2


def test_briefings(spark):
    b = spark.createDataFrame([(1, "2024-01-01", "t1", "first", "s", "{}", 2), (2, "2024-01-01", "t2", "second", "s", "{}", None), (3, "2023-12-25", "t0", "older", "s", "{}", None)], BRIEFING)
    assert [r.id for r in G.briefings_list(b).collect()] == [2, 1, 3] and G.briefings_list(b).columns == list(G.BRIEFING_FIELDS)
    latest = G.latest_briefing(b).first()
    assert latest.body == "second" and latest.supersedes["body"] == "first" and latest.facts_json == "{}"
    assert G.latest_briefing(b.where("id = 3")).first().supersedes is None and G.latest_briefing(b.limit(0)).isEmpty()
    for bad in (0, 53):
        with pytest.raises(ValueError):
            G.briefings_list(b, bad)


def test_companies(spark):
    args = L.postings(spark, DATA), L.mentions(spark, DATA), L.taxonomy(spark, DATA), spark.createDataFrame([], "posting_id long, tag string")
    one = G.company_summaries(*args, limit=1).first()
    assert one.templated["share"] is None and one.templated["tagged"] == 0 and len(one.top_skills) == 5 and one.salary["q1"] <= one.salary["median"] <= one.salary["q3"]
    with pytest.raises(KeyError):
        G.company_page(*args, "nobody")
    for bad in (0, 101):
        with pytest.raises(ValueError):
            G.company_summaries(*args, limit=bad)
        with pytest.raises(ValueError):
            G.company_page(*args, "mega staffing", bad)
    summary, recent = G.company_page(*args, "Mega Staffing", 3)
    assert summary.count() == 1 and recent.count() == 3


def test_health_of_an_empty_table(spark):
    p = spark.createDataFrame([], "source string, skills_raw string, first_seen_at timestamp, last_seen_at timestamp")
    assert tuple(G.health(p, spark.createDataFrame([], "posting_id long, skill string"), "2024-01-01 00:00:00").first()) == (0, 0, None, None, None, 0, 0)
