"""Rules, confirmed phrases, excerpts, merged passes and categories: edges."""

import pytest
from pyspark.sql import functions as F

from tallywork.functions import rules as U
from tallywork.operators import drift as D
from tallywork.operators import phrases as P
from tallywork.operators import views as V

POSTINGS = "id long, company string, domain string, description string"


def texts(spark, rows):
    return spark.createDataFrame(rows, "t string").select


def test_first_rule_in_order(spark):
    rules = spark.createDataFrame([(3, "substring", "chef", "food"), (1, "phrase", "head  chef", "lead"), (2, "regex", r"chef\b.*sous", "sous"), (4, "substring", "", "never"), (5, "substring", None, "never"), (6, "substring", "c", "any c")], "place int, kind string, pattern string, value string")
    df = spark.createDataFrame([("Head\nCHEF wanted",), ("ahead chef",), ("chef or sous",), ("abc",), ("none",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(U.first_rule(F.col("t"), rules, "other")).collect()]
    assert got == ["lead", "food", "sous", "any c", "other", "other", "other"]
    forced = df.select(U.with_overrides(F.col("t"), rules, [(0, "phrase", "sous", "forced")], None)).collect()
    assert [r[0] for r in forced][2:5] == ["forced", "any c", None]


def test_rule_tables_are_bounded(spark):
    with pytest.raises(ValueError, match="at most 2"):
        U.rule_table([(i, "substring", "x", "y") for i in range(3)], most=2)
    with pytest.raises(ValueError, match="unknown kinds"):
        U.rule_table([(0, "glob", "x", "y")])
    assert spark.range(1).select(U.first_rule(F.lit("x"), [], "d")).first()[0] == "d"


def test_one_pattern_in_several_buckets(spark):
    rules = [(0, "phrase", "data", "whole"), (1, "substring", "data", "part")]
    df = spark.createDataFrame([("metadata",), ("data",)], "t string")
    assert [r[0] for r in df.select(U.first_rule(F.col("t"), rules)).collect()] == ["part", "whole"]


def test_confirmed_in_the_postings_own_text(spark):
    postings = spark.createDataFrame([(1, "A", "d", "We use C++ and\nData   Mining daily"), (2, None, "d", "nothing"), (3, "B", None, None), (4, "B", "e", "data mining (C++)")], POSTINGS)
    said = spark.createDataFrame([(1, "data mining"), (1, "Data Mining"), (1, "c++"), (2, "data mining"), (3, "x"), (4, "DATA  mining"), (9, "lost"), (1, "  "), (1, None), (4, r"a\Eb")], "id long, phrase string")
    rows = {(r.id, r.key): (r.company, r.at, r.excerpt) for r in P.confirmed(said, postings, around=3).collect()}
    assert rows[1, "data mining"] == ("A", 16, "…nd Data Mining da…") and rows[1, "c++"][1] == 8
    assert rows[2, "data mining"] == (P.UNKNOWN_COMPANY, None, None) and rows[3, "x"][1] is None and rows[4, r"a\eb"][1] is None
    pairs = P.confirmed(said, postings)
    assert P.proposal_counts(pairs).first().asDict() == {"proposed": 4, "confirmed": 2, "dropped": 2}
    assert [(r.key, r.phrase, r.postings, r.companies, len(r.excerpts)) for r in P.surviving(pairs, 2, 2).collect()] == [("data mining", "Data Mining", 2, 2, 2)]
    groups = spark.createDataFrame([("data mining", "g"), ("c++", "g"), ("x", "h")], "key string, `group` string")
    assert [tuple(r) for r in P.aggregate_groups(pairs, groups).collect()] == [("g", 2, 2, 2, "d:1, e:1")]


def test_first_excerpts_are_different_and_few(spark):
    rows = spark.createDataFrame([("g", i, f"e{i % 4}" if i > 5 else "same") for i in range(50)] + [("h", 1, None)], "key string, id long, excerpt string")
    assert [(r.key, r.excerpts) for r in P.first_excerpts(rows, ["key"]).collect()] == [("g", ["same", "e2", "e3"])]


def test_gram_excerpts_try_more_postings(spark):
    # a hundred copies, then texts in which the gram's words do not stand together, then the others
    rows = [(i, "a big red car here") for i in range(100)] + [(100 + i, f"red, car {i}") for i in range(60)] + [(200, "my red\ncar"), (201, "Red CAR!"), (202, "bored carp red car")]
    postings = spark.createDataFrame([(i, "c", "d", t) for i, t in rows], POSTINGS).withColumn("source", F.lit("s"))
    got = P.gram_excerpts(D.posting_grams(postings, [], 2), postings, spark.createDataFrame([("red car",)], "gram string"), around=4).first()
    assert got.excerpts == ["…big red car her…", "my red car", "Red CAR!"]


def test_candidates_with_many_sources(spark):
    rows = [(i, f"s{i}", f"c{i % 5}", "d" if i % 2 else None, "word") for i in range(100)]
    grams = spark.createDataFrame(rows, "id long, source string, company string, domain string, gram string")
    assert D.candidates(grams).first().asDict() == {"gram": "word", "postings": 100, "companies": 5, "sources": 100, "domains": 1}


def test_passes_and_categories(spark):
    tags = spark.createDataFrame([(1, "Welding", "A"), (2, "welding", "B"), (3, "welding", "C")], "id long, phrase string, company string").selectExpr("id", "lower(phrase) AS key", "phrase", "company", "'d' AS domain")
    texts = spark.createDataFrame([(4, "welding", "WELDING", "A", 1, "x"), (5, "only", "Only", "A", 1, "y"), (6, "only", "only", "B", None, None)], "id long, key string, phrase string, company string, at int, excerpt string")
    got = {r.key: (r.phrase, r.passes, r.postings, r.companies, r.example) for r in P.merged(tags, texts, 1).collect()}
    assert got == {"welding": ("Welding", "both", 4, 3, "(verbatim) x"), "only": ("Only", "text", 1, 1, "(verbatim) y")}
    assert P.merged(tags, texts, 2).count() == 1
    none = spark.createDataFrame([], "phrase string, proposed_category string, proposed_requirement_type string, batch int")
    c = spark.createDataFrame([("k", "Team Work")], "key string, phrase string")
    assert P.categorised(c, [(0, "phrase", "team work", "soft")], none, {}).first().asDict() == {"key": "k", "phrase": "Team Work", "requirement_type": "skill", "category": "soft", "substantive": False, "source": "heuristic"}
    assert P.categorised(c, [], none, {}).first().asDict() == {"key": "k", "phrase": "Team Work", "requirement_type": None, "category": None, "substantive": None, "source": "uncategorized"}


@pytest.mark.parametrize("said,want", [
    ('a [1, "]", [2]] b [3]', '[1, "]", [2]]'), ('["\\"]"] x', '["\\"]"]'), ("[1, 2", "[1, 2"), ("none", "none"), ("", ""), (None, None), ("```[1]``` and ```json [2, 3] ```", "[2, 3]"),
])
def test_last_json_array(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(V.last_json_array(F.col("t"))).first()[0] == want


def test_reviewed_proposals(spark):
    rows = [("a b", "DATA", "Skill", "0.7", None, 1), ("a b", "new one", None, "0.5", None, 2), ("c", None, "attribute", None, None, 1), ("d", "data ", "", "high", True, 1), ("e", "", "credential", "0.9", False, 1)]
    a = spark.createDataFrame(rows, "phrase string, proposed_category string, proposed_requirement_type string, confidence string, is_new_category boolean, batch int")
    got = {r.phrase: tuple(r)[1:] for r in P.reviewed(a, [(0, "phrase", "c", "attribute")], ["Data"]).collect()}
    assert got == {
        "a b": ("new one", True, "skill", "skill", 0.5, True), "c": ("(uncategorized)", True, "attribute", "attribute", None, False),
        "d": ("data ", True, "skill", "skill", None, False), "e": ("(uncategorized)", False, "skill", "credential", 0.9, True),
    }
    assert P.reviewed(a.limit(0), [], []).count() == 0
