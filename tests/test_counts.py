"""Distinct counts that move each row once, in parts whose size does not grow with the table."""

from pyspark.sql import functions as F

from tallywork.functions import text as T
from tallywork.operators import market as M
from tallywork.operators import phrases as P
from tallywork.sources import lenses as L

from .conftest import DATA


def test_distinct_counts(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "a", None), (3, "a", "x"), (3, "b", None), (4, None, "x"), (5, "b", None)]
    df = spark.createDataFrame(rows, "posting_id long, skill string, company_key string")
    want = {(r.skill, r.k, r.c) for r in df.groupBy("skill").agg(F.countDistinct("posting_id").alias("k"), F.countDistinct("company_key").alias("c")).collect()}
    assert want == {("a", 3, 2), ("b", 2, 0), (None, 1, 1)}
    for tasks in (None, 7):
        assert {(r.skill, r.k, r.c) for r in M.distinct_counts(df, ["skill"], tasks).collect()} == want
    assert M.distinct_counts(df.limit(0), ["skill"]).count() == 0


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    n = L.read(spark, DATA, "lineitem").count()
    assert L.tasks(spark, DATA) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(L, "LINES", n // 9)
    assert L.tasks(spark, DATA) in (9, 10)
    sizes = [r["count"] for r in L.mentions(spark, DATA).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) in (9, 10) and max(sizes) < n / 4


def test_phrases_begin_where_they_begin(spark):
    phrases = ["de la", "C++", "été", "]x", "^y", "-z", "\\w", "&&", "𝒳 b", "a"]
    pattern = T.phrase_pattern(phrases)
    assert pattern.startswith("(?U)(?=[")  # most places are passed over by their first letter
    plain = pattern.replace(pattern[4 : pattern.index("])") + 2], "")
    texts = ["de  la", "ade la", "c++", "C++", "aété", "l'été.", "]x", "q]x", "^y", "-z", "--z", "\\w", "&&", "a&&b", "𝒳\tb", "x𝒳 b", "ba", "a", "", None, "z a"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(pattern).alias("new"), F.col("t").rlike(plain).alias("old")).collect()
    assert [r.new for r in got] == [r.old for r in got] and sum(bool(r.new) for r in got) >= 9


def test_surviving_searches_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "id long, key string, phrase string, company string, domain string, at int, excerpt string"
    rows = [(i, f"k{i % 3}", f"K{i % 3}", f"c{i % 4}", "d", 1 if i % 5 else None, f"e{i}") for i in range(60)]
    got = P.surviving(spark.createDataFrame(rows, kind).mapInArrow(look, kind)).collect()
    assert {r.key: (r.postings, r.companies) for r in got} == {f"k{j}": (16, 4) for j in range(3)} and all(len(r.excerpts) == 3 for r in got)
    assert seen.value == len(rows)
