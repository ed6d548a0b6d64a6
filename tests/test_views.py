"""Names, matches and texts of the pages."""

import pytest
from pyspark.sql import functions as F

from tallywork.operators import views as V
from tallywork.sources import lenses as L

DATA = "/root/testdata/sf0.001"


def test_best_match_needs_the_bar_and_prefers_larger_signatures(spark):
    rows = [("a", "fresh", s) for s in "xyz"] + [("b", "mid", s) for s in "xyzw"] + [("c", "mid", s) for s in "qr"]
    sig = spark.createDataFrame(rows, "job_family string, experience_level string, skill string")
    assert [tuple(r)[:2] for r in V.best_match(sig, ["x", "y", "z", "w"]).collect()] == [("b", "mid")]
    assert V.best_match(sig, ["q"]).isEmpty() and V.best_match(sig, []).isEmpty()


def test_unknown_names_are_errors(spark):
    t = L.taxonomy(spark, DATA)
    with pytest.raises(KeyError, match="unknown skills"):
        V.ignored_skills(t, ["no such skill"])
    with pytest.raises(KeyError, match="unknown company"):
        V.company_profile(L.postings(spark, DATA), L.mentions(spark, DATA), t, L.mentions(spark, DATA).select("posting_id", F.col("skill").alias("tag")), "nobody")


def test_company_profile(spark):
    m = L.mentions(spark, DATA)
    summary, recent = V.company_profile(L.postings(spark, DATA), m, L.taxonomy(spark, DATA), m.select("posting_id", F.col("skill").alias("tag")), " mega  STAFFING", 5)
    assert summary.count() == 1 and recent.count() == 5 and summary.first().display_name == "Mega  Staffing"


def test_texts(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    t = lambda x: F.lit(x)
    assert one(V.scope_text(t("a, bc,")), V.scope_text(t("")), V.scope_text(t(None).cast("string"))) == ("A + Bc", "—", "—")
    assert one(V.course_title(t("PF Object Oriented")), V.course_title(t("HCI & Graphics")), V.course_title(t("PF OOP"))) == ("Object Oriented", "HCI & Graphics", "PF OOP")
    assert one(V.json_array_text(t("x [1, [2]] y")), V.json_array_text(t("no array"))) == ("[1, [2]]", "no array")
    assert one(V.relative_time(t("2000-01-01 00:00:00"), t("2000-01-01 00:20:00")), V.relative_time(t("2000-01-01"), t("2000-01-09"))) == ("just now", "1w ago")
    assert one(V.batches(t(41), 20), V.number_text(t(1234.5)), V.percent_text(t(0.125), 1)) == (3, "1,235", "12.5%")
