"""Drift and consolidation runs: counters, one reading of the postings, empty tables; comparisons of passes."""

import os

import duckdb
import pytest

from tallywork.functions import classify as K
from tallywork.operators import discovery as R
from tallywork.operators import drift as D
from tallywork.operators import reviews as V
from tallywork.plans import run_queries as Q
from tallywork.sources import sinks as S

from .conftest import DATA
from .oracle import TABLES, same

POSTING = "id long, source string, company string, title string, description string"
TAXONOMY = "skill string, category string, requirement_type string"
RULES = [(0, "substring", "cook", "food")]
TYPES = [(0, "phrase", "certified", "credential")]


def postings(spark):
    rows = [(i, "a" if i % 2 else "b", f"co {i % 5}", "Head cook", f"{i} certified welder with sql and grit") for i in range(12)]
    rows += [(100 + i, None, f"co {i % 5}", None, f"{i} sql python sql, grit") for i in range(7)] + [(200, "a", None, "x", "  "), (201, "a", "z", "x", None)]
    return spark.createDataFrame(rows, POSTING)


def taxonomy(spark):
    return spark.createDataFrame([("sql", "data", "skill"), ("python", "data", "skill"), ("grit", "soft", "skill")], TAXONOMY)


VOCABULARY = [("sql", ["sql"]), ("python", ["Python"]), ("grit", ["grit"])]


def test_drift_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = R.run_drift(postings(spark).mapInArrow(counted, POSTING), VOCABULARY, taxonomy(spark), ["with", "and"], [], RULES, TYPES, most=2)
    c = out["counters"].first()
    # two skills that count keep a posting out of the blind spots; soft ones do not
    assert (c.postings, c.considered, c.blind_spots, c.blind_considered) == (21, 19, 14, 12)
    found = {r.gram: r for r in out["candidates"].collect()}
    assert set(found) == {"certified", "welder", "certified welder"} and found["certified welder"].type == "credential" and found["welder"].type == "skill"
    assert found["welder"].postings == 12 and found["welder"].companies == 5 and found["welder"].sources == 2 and c.qualified == 3 and c.gap_qualified == 3
    assert "sql" not in found and out["by_source"].where("value = 'a'").count() == 3
    gap = {r.gram: r for r in out["gap"].collect()}
    assert gap["welder"].lift == 1.583 and gap["welder"].by_domain["food"]["postings"] == 12 and len(gap["welder"].excerpts) == 3
    assert {r.value: r.n for r in out["depth_by_source"].collect()} == {"a": 8, "b": 6, "unknown": 7}
    assert {r.value for r in out["depth_by_domain"].collect()} == {"food", "other_unclassified"}
    S.publish_all(out, str(tmp_path / "d"), 1)
    assert seen.value == 21  # the postings were read once for all tables
    assert set(S.current_all(spark, str(tmp_path / "d"))) == set(out)


def test_drift_of_nothing(spark):
    out = R.run_drift(postings(spark).limit(0), VOCABULARY, taxonomy(spark), [], [], RULES, TYPES)
    assert out["counters"].first().postings == 0 and all(out[k].count() == 0 for k in out if k != "counters")
    assert "gap" not in R.run_drift(postings(spark).limit(0), [], taxonomy(spark).limit(0), [], [], [], [], gap_focus=False)


def test_consolidation(spark):
    rows = [(i, f"c{i % 4}", "trades", "arc welding and pipe fitting", None) for i in range(10)] + [(20 + i, f"c{i % 4}", "trades", None, ["Pipe Fitting", "lathe work"]) for i in range(10)] + [(90, "c", "small", "x", None), (91, "c", None, "x", None)]
    p = spark.createDataFrame(rows, "id long, company string, domain string, description string, tags array<string>")
    none = spark.createDataFrame([], "posting_id long, skill string, category string, requirement_type string, extraction_method string")
    said = spark.createDataFrame([(i, ph) for i in range(10) for ph in ("arc welding", "pipe fitting", "arc welding torch")], "id long, phrase string")
    answers = spark.createDataFrame([("lathe work", "trade-tools", None, 1)], "phrase string, proposed_category string, proposed_requirement_type string, batch int")
    out = R.consolidate(p, none, said, [], "v", [(0, "phrase", "pipe fitting", "soft")], answers, {}, ["and"])
    sheet = {r.key: r for r in out["sheet"].collect()}
    assert set(sheet) == {"arc welding", "pipe fitting", "lathe work"}
    assert (sheet["pipe fitting"].passes, sheet["pipe fitting"].postings, sheet["pipe fitting"].companies, sheet["pipe fitting"].substantive) == ("both", 20, 4, False)
    assert sheet["lathe work"].category == "trade-tools" and sheet["arc welding"].source == "uncategorized"
    assert {r.domain: (r.candidates, r.substantive, r.hidden, r.unknown) for r in out["summary"].collect()} == {"trades": (3, 1, 1, 1), "TOTAL": (3, 1, 1, 1)}
    assert out["counts"].first().asDict() == {"proposed": 3, "confirmed": 2, "dropped": 1}
    assert {r.domain: r.qualifies for r in out["targets"].collect()} == {"trades": "yes", "small": "no", "other": "excluded"}
    empty = R.consolidate(p.limit(0), none, said.limit(0), [], "v", [], answers.limit(0), {}, [])
    assert empty["sheet"].count() == 0


def test_requirements_count_credentials_and_experience(spark):
    p = spark.createDataFrame([(1, "s", "bachelors", None, "mid"), (2, "s", "", True, None), (3, None, None, None, "")], "id long, source string, degree_level string, has_certification boolean, experience_level string")
    m = spark.createDataFrame([(1, "sql", "data", "skill", "v2"), (1, "grit", "soft", "skill", "v2"), (2, "remote", "work", "attribute", "v2"), (2, "remote", "work", "attribute", "v2"), (3, "sql", None, None, "v1")], "posting_id long, skill string, category string, requirement_type string, extraction_method string")
    got = {r.value: r for r in V.side_by_side(p, m, "source", "v1", "v2").collect()}
    assert got["s"].n == 2 and got["s"].median_req_after == 2.5 and got["s"].median_skill_after == 0.5 and got["s"].pct_le1_skill_after == 100.0
    assert got["unknown"].median_req_before == 1.0 and got["unknown"].median_skill_before == 0.0
    assert tuple(V.field_yield(p, m, "v2").first()) == (3, 1, 1, 1)


def test_families_by_rule_and_answer(spark):
    p = spark.createDataFrame([(1, "Data Analyst", "it"), (2, "Wizard", "it"), (3, "Wizard", "it"), (4, "Wizard", None)], "id long, title string, domain string")
    a = spark.createDataFrame([(1, "cook", 0.9, 1), (2, "cook", 0.9, 1), (2, "analyst", 0.7, 2), (3, "analyst", 0.5, 1), (4, "unknown", 0.9, 1)], "id long, family string, confidence double, batch int")
    families = [("analyst", "it", ["analyst"]), ("cook", None, ["cook"])]
    got = {r.id: (r.family, r.family_method, r.family_confidence) for r in K.classify_families(p, families, a).collect()}
    assert got == {1: ("analyst", "rule_title", 1.0), 2: ("analyst", "llm", 0.7), 3: (None, "unclassified", None), 4: (None, "unclassified", None)}
    assert K.classify_families(p, families).where("family IS NULL").count() == 3


@pytest.mark.parametrize("companies", [5, 200])
def test_grams_move_once_to_be_counted(spark, companies):
    """Few companies are bits, so grams are shuffled once; many are a distinct count, which takes a second shuffle."""
    rows = [(i, "ab"[i % 2], f"c{i * 7 % companies}" if i % 11 else None, "xyz"[i % 3], f"g{k}") for i in range(600) for k in range(1, 12) if i % k == 0]
    grams = spark.createDataFrame(rows, "id long, source string, company string, domain string, gram string")
    got = D.candidates(grams, 8, 3)
    brute = {}
    for _, s, c, d, g in rows:
        n, *sets = brute.setdefault(g, [0, set(), set(), set()])
        brute[g][0] = n + 1
        for x, v in zip(sets, (c, s, d)):
            x.update({v} - {None})
    assert {tuple(r) for r in got.collect()} == {(g, n, len(c), len(s), len(d)) for g, (n, c, s, d) in brute.items() if n >= 8 and len(c) >= 3}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == (1 if companies <= D.MOST_BITS else 2)


@pytest.mark.parametrize("many", [(), ("company",), ("company", "source"), ("source", "domain")])
def test_grams_of_a_part_are_counted_with_all(spark, many):
    """Whole and part come from one counting, however many values a column has."""
    of = {c: 200 if c in many else 5 for c in ("company", "source", "domain")}
    rows = [(i, f"s{i * 3 % of['source']}", f"c{i * 7 % of['company']}" if i % 11 else None, f"d{i * 13 % of['domain']}" if i % 5 else None, f"g{k}", None if i % 4 == 1 else i % 4) for i in range(600) for k in range(1, 40) if i % k == 0]
    grams = spark.createDataFrame(rows, "id long, source string, company string, domain string, gram string, n_skills int")
    part = grams.n_skills <= 1
    got = {r.gram: tuple(r)[1:] for r in D.qualified(D.counted(grams, None, part), grams, 8, 3, part).collect()}

    def brute(of_rows):
        n = {}
        for _, s, c, d, g, _ in of_rows:
            row = n.setdefault(g, [0, set(), set(), set()])
            row[0] += 1
            for x, v in zip(row[1:], (c, s, d)):
                x.update({v} - {None})
        return {g: (k, *map(len, sets)) for g, (k, *sets) in n.items()}

    whole, some = brute(rows), brute([r for r in rows if r[5] is not None and r[5] <= 1])
    assert got == {g: (*n, *some.get(g, (0, 0, 0, 0))) for g, n in whole.items() if n[0] >= 8 and n[1] >= 3}


def test_no_gram_moves_for_each_posting_that_has_it(spark, monkeypatch):
    """However many grams qualify, those of the postings are not shuffled to meet them, and their lists are not written."""
    seen, write = [], R.written

    def watched(df, *rows):
        seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, *rows)

    monkeypatch.setattr(R, "written", watched)
    bar = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if very many grams qualified
    try:
        R.run_drift(postings(spark), VOCABULARY, taxonomy(spark), ["with", "and"], [], RULES, TYPES, most=2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)
    made = [plan for _, plan in seen if "Generate explode" in plan]
    assert made and not any("SortMergeJoin" in plan for plan in made) and not any("grams" in columns for columns, _ in seen)


def test_sheet_with_blank_texts_and_repeated_ids(spark, tmp_path):
    """Blank texts of documents without tags say nothing, and a posting counts once however often its id is there."""
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    d = f"read_parquet('{DATA}/documents.parquet')"
    duckdb.sql(f"COPY (SELECT * FROM {d} UNION ALL SELECT * REPLACE (doc_id + 1000000 AS doc_id, '  ' AS text) FROM {d} WHERE doc_id < 40 UNION ALL SELECT * REPLACE ('other' AS source) FROM {d} WHERE doc_id % 5 = 0) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    same(spark, Q.QUERIES["consolidation_sheet"], Q.ORACLE_SQL["consolidation_sheet"], str(tmp_path))
