"""The registered queries against their SQL, and the pipeline's stages against what each may drop."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallywork.llm import queries as Q
from tallywork.llm.common import table
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    same(spark, Q.QUERIES[name], Q.ORACLE_SQL[name], DATA)


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "tokens"]
    comps = {r.doc_id: r.component_id for r in Q.QUERIES["op1_simhash_near_dedup"](spark, DATA).collect()}
    kept = P.near_copies(spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comps.values()))
    bad = {r.doc_id for r in Q.QUERIES["op6_benchmark_decontamination"](spark, DATA).where("contaminated").collect()}
    clean = P.decontamination(spark, docs, DATA)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    mild = P.toxicity(spark, docs, DATA)
    assert mild.columns == docs.columns and 0 < mild.count() <= docs.count()
    private = P.personal_data(spark, docs, DATA)
    assert private.columns == docs.columns and private.count() == docs.count() and private.where(F.col("text").rlike(r"[a-z]@[a-z]+\.[a-z]")).isEmpty()


def test_decontamination_judges_rows_not_ids(spark):
    docs = table(spark, DATA, "documents")
    text = table(spark, DATA, "benchmark").where("text IS NOT NULL").first()["text"]
    rows = [(i, t, "en", "s", 1) for i, t in [(None, text), (None, "clean words without an id"), (None, "more of them"), (7, text), (7, "clean words under the same id")]]
    got = P.decontamination(spark, spark.createDataFrame(rows, docs.schema), DATA)
    assert got.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in got.collect()) == [("7", "clean words under the same id"), ("None", "clean words without an id"), ("None", "more of them")]


def test_whole_run(spark):
    out = P.run(spark, DATA)
    assert out.columns == ["doc_id", "ids", "decoded"] and 0 < out.count() <= table(spark, DATA, "documents").count()
