"""The driver's tables seen as the market's: postings, skill mentions, taxonomy, curriculum.

Each lens has the same definition in Spark and, as CTEs, in SQL (``SQL``), so operators can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which the lens is looked at.
AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order lines that one task joins and counts.
LINES = 500_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for steps over all order lines: a task's share does not grow with the table.  The session's number, if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf_dir, "lineitem").count() // LINES))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skill, display, category, requirement_type, ord): part names, by their words."""
    noun, adjective = F.element_at(F.split("skill", " "), -1), F.element_at(F.split("skill", " "), 1)
    category = F.when(noun == "ring", "soft").when(noun == "rod", "office_admin").otherwise(noun)
    names = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("skill")).agg(F.min("p_partkey").alias("ord"))
    return names.select("skill", F.initcap("skill").alias("display"), category.alias("category"), F.when(adjective == "cold", "attribute").otherwise("skill").alias("requirement_type"), "ord")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings."""
    n = tasks(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("salary_min"), F.max("l_extendedprice").alias("salary_max"), F.max("l_shipdate").alias("shipped"))
    o, c, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    j = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").join(c, o["o_custkey"] == c["c_custkey"], "left").join(nation, c["c_nationkey"] == nation["n_nationkey"], "left")
    return j.select(
        k.alias("id"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("https://jobs.example/"), k.cast("string")).alias("detail_url"),
        F.when(F.col("o_custkey") % 10 < 3, "Mega  Staffing").otherwise(F.col("c_name")).alias("company"), F.col("n_name").alias("city"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), F.greatest("o_orderdate", "shipped").cast("timestamp").alias("last_seen_at"),
        "salary_min", "salary_max", F.when(k % 50 == 0, "USD").otherwise("PKR").alias("currency"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("category"), F.col("c_mktsegment").alias("domain"), F.col("o_orderpriority").alias("job_family"),
        F.when(k % 10 < 2, "fresh").when(k % 10 < 5, "junior").when(k % 10 < 8, "mid").when(k % 10 == 8, "senior").alias("experience_level"),
        F.when(k % 10 == 9, F.lit(None)).when(k % 10 == 0, "Fresh graduate").otherwise(F.concat((k % 10).cast("string"), F.lit(" Years"))).alias("experience_raw"),
        F.date_format("shipped", "yyyy-MM").alias("scrape_run_id"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(posting_id, skill): distinct parts of each order."""
    n = tasks(spark, sf_dir)
    j = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(n, "l_partkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("posting_id"), F.col("p_name").alias("skill")).repartition(n, "posting_id").distinct()


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(course_id, skill): suppliers as courses, which teach nothing new."""
    j = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.where(~F.col("p_name").startswith("new ")).select(F.col("l_suppkey").alias("course_id"), F.col("p_name").alias("skill")).distinct()


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings of four weeks: (id, source, company, first_seen_at)."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("company"), F.col("ts").cast("timestamp").alias("first_seen_at"))


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(posting_id, skill): one of twenty skills an event."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("posting_id"), F.concat(F.lit("k"), (k % 20).cast("string")).alias("skill")).where("skill IS NOT NULL")


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: (id, source, company, title, description, domain)."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("source").alias("company"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("description"), F.col("lang").alias("domain"))


#: The lenses as CTEs.
SQL = """
taxonomy AS (
  SELECT p_name AS skill, min(p_partkey) AS ord,
    CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'soft' WHEN 'rod' THEN 'office_admin' ELSE split_part(p_name, ' ', 2) END AS category,
    CASE WHEN split_part(p_name, ' ', 1) = 'cold' THEN 'attribute' ELSE 'skill' END AS requirement_type
  FROM part GROUP BY p_name),
lines AS (SELECT l_orderkey, min(l_extendedprice) AS salary_min, max(l_extendedprice) AS salary_max, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
postings AS (
  SELECT o_orderkey AS id, o_orderstatus AS source, 'https://jobs.example/' || o_orderkey AS detail_url,
    CASE WHEN o_custkey % 10 < 3 THEN 'Mega  Staffing' ELSE c_name END AS company, n_name AS city,
    o_orderdate AS first_seen_at, greatest(o_orderdate, shipped) AS last_seen_at, salary_min, salary_max,
    CASE WHEN o_orderkey % 50 = 0 THEN 'USD' ELSE 'PKR' END AS currency,
    CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END AS category, c_mktsegment AS domain, o_orderpriority AS job_family,
    CASE WHEN o_orderkey % 10 < 2 THEN 'fresh' WHEN o_orderkey % 10 < 5 THEN 'junior' WHEN o_orderkey % 10 < 8 THEN 'mid' WHEN o_orderkey % 10 = 8 THEN 'senior' END AS experience_level,
    CASE WHEN o_orderkey % 10 = 9 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'Fresh graduate' ELSE (o_orderkey % 10) || ' Years' END AS experience_raw,
    strftime(shipped, '%Y-%m') AS scrape_run_id,
    CASE WHEN o_custkey % 10 < 3 THEN 'mega staffing' ELSE lower(c_name) END AS company_key
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
mentions AS (SELECT DISTINCT l_orderkey AS posting_id, p_name AS skill FROM lineitem JOIN part ON p_partkey = l_partkey),
curriculum AS (SELECT DISTINCT l_suppkey AS course_id, p_name AS skill FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name NOT LIKE 'new %'),
ev AS (SELECT event_id AS id, event_type AS source, 'c' || user_id AS company, ts AS first_seen_at FROM events),
em AS (SELECT event_id AS posting_id, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS skill FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
total AS (SELECT count(*) AS n FROM postings),
bulk AS (SELECT company_key FROM postings WHERE company_key IS NOT NULL GROUP BY company_key HAVING count(*) > 0.25 * (SELECT n FROM total)),
kept AS (SELECT * FROM postings WHERE company_key IS NULL OR company_key NOT IN (SELECT company_key FROM bulk)),
kept_mentions AS (SELECT m.* FROM mentions m WHERE posting_id IN (SELECT id FROM kept))
"""
