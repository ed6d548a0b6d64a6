"""Queries of whole pages: weekly facts, briefings, companies, currencies, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as W
from ..operators import pages as G
from ..sources import lenses as L
from . import forecast_queries as FQ
from . import market_queries as MQ


def _all(s, d):
    return L.postings(s, d), L.mentions(s, d), L.taxonomy(s, d)


def _tags(s, d):
    return L.mentions(s, d).where("posting_id % 11 <> 0").select("posting_id", F.element_at(F.split("skill", " "), -1).alias("tag"))


def _list(column, *fields):
    """An array of structs as text."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields])), ", ")


def _facts(s, d, start="2024-01-01 00:00:00"):
    ev, em = L.event_postings(s, d), L.event_mentions(s, d)
    taxonomy = em.select("skill").distinct().select("skill", F.upper("skill").alias("display"), F.when(F.col("skill") == "k3", "soft").otherwise("x").alias("category"), F.when(F.col("skill") == "k4", "attribute").otherwise("skill").alias("requirement_type"))
    graded = W.backtest(ev, em, L.AS_OF).select("target_type", "target_key", "target_week_start", "predicted", "baseline_predicted", F.col("actual").cast("double").alias("actual"), "abs_error", "baseline_abs_error", F.lit("2024-01-30").cast("timestamp").alias("graded_at"))
    none = F.lit(None).cast("double")
    new = W.predict(ev, em, L.AS_OF).select("target_type", "target_key", "target_week_start", "predicted", "baseline_predicted", none.alias("actual"), none.alias("abs_error"), none.alias("baseline_abs_error"), F.lit(None).cast("timestamp").alias("graded_at"))
    f = G.weekly_facts(ev, em, taxonomy, graded.unionByName(new), L.AS_OF, start, "view", ("view", "click"), ("c1",))
    return f.select(
        "week_start", "next_week_start", *[F.col(f"last_week.{c}").alias(f"last_{c}") for c in ("count", "beat", "tie", "lost", "mae")], *[F.col(f"running.{c}").alias(f"all_{c}") for c in ("count", "beat", "tie", "lost", "mae")],
        "volume.volume", "volume.volume_before", "volume.change", "volume.change_pct", "volume.comparable", _list("graded", "target_type", "target_key", "display", "actual", "outcome").alias("graded"), _list("predictions", "target_type", "target_key", "display").alias("predictions"),
        _list("top", "skill", "display", "companies").alias("top"), _list("entered", "skill", "display").alias("entered"), _list("left", "skill", "display").alias("left"),
    )


def _briefings(s, d):
    """Customers' orders of a month as briefings, each third one corrected by the one after it."""
    k = F.col("o_orderkey")
    o = L.read(s, d, "orders").where(k % 50 < 2)
    return o.select(k.alias("id"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("body"), F.lit("template").alias("source"), F.lit("{}").alias("facts_json"), F.lit(None).cast("string").alias("blocked_reason"), F.when((k % 50 == 0) & (k % 3 == 0), k + 1).alias("superseded_by"))


def _latest(s, d):
    b = G.latest_briefing(_briefings(s, d))
    return b.select("id", "week_start", "created_at", "body", F.col("supersedes.id").alias("original_id"), F.col("supersedes.body").alias("original_body"))


def _companies(s, d):
    c = G.company_summaries(*_all(s, d), _tags(s, d))
    return c.select("company", "posting_count", F.array_join("cities", "|").alias("cities"), _list("top_skills", "skill", "count").alias("top_skills"), F.col("salary.n").alias("n"), *[f"salary.{x}" for x in ("median", "q1", "q3", "iqr")], F.col("templated.tagged").alias("tagged"), F.col("templated.templated").alias("templated"), F.col("templated.share").alias("share"))


def _company(s, d):
    rows = G.company_page(*_all(s, d), _tags(s, d), " mega STAFFING ")[1]
    return rows.select("id", "city", "source", "detail_url", F.array_join("skills", ",").alias("skills"))


def _health(s, d):
    p = L.postings(s, d).withColumn("skills_raw", F.when(F.col("id") % 4 == 0, "[]").when(F.col("id") % 4 == 1, None).otherwise('["x"]'))
    return G.health(p, L.mentions(s, d), "2001-01-01 00:00:00", "F")


QUERIES = {
    "briefing_facts": _facts,
    "briefing_facts_early": lambda s, d: _facts(s, d, "2024-01-23 00:00:00"),
    "briefings_list": lambda s, d: G.briefings_list(_briefings(s, d)).drop("model_version", "blocked_reason"),
    "briefing_latest": _latest,
    "company_summaries": _companies,
    "company_recent": _company,
    "foreign_postings": lambda s, d: G.foreign_postings(*_all(s, d)).select("id", "currency", "salary_min", "salary_max", "company", "city", "detail_url", F.array_join("skills", ",").alias("skills")),
    "health": _health,
}

_W = f"WITH {L.SQL}"
_NOW = "DATE '2024-01-29'"
_SHOWN = "CASE WHEN target_type = 'volume' THEN 'All postings (Mustakbil)' ELSE upper(target_key) END"


def _counts(prefix: str, where: str) -> str:
    return ", ".join([f"(SELECT count(*) FROM bt WHERE {where}) AS {prefix}_count", *[f"(SELECT count(*) FROM bt WHERE {where} AND outcome = '{o}') AS {prefix}_{o}" for o in ("beat", "tie", "lost")],
                      f"(SELECT round(CAST(sum(CAST(abs_error AS DECIMAL(24, 6))) AS DOUBLE) / count(*), 2) FROM bt WHERE {where}) AS {prefix}_mae"])


def _facts_sql(comparable: bool) -> str:
    c = "true" if comparable else "false"
    past, now = "week < " + _NOW, FQ._forecast(_NOW, "week < " + _NOW)
    return f"""WITH bt AS (SELECT * FROM ({FQ._BT} SELECT * FROM bt)), nw AS (SELECT * FROM ({now} SELECT * FROM f WHERE target_week_start = {_NOW})),
      {L.SQL}, p AS (SELECT id, source, company, {FQ._PKT.format('first_seen_at')} AS week FROM ev),
      wc AS (SELECT week, skill, count(DISTINCT company) AS n FROM em JOIN p ON id = posting_id WHERE source IN ('view', 'click') AND company <> 'c1' AND skill NOT IN ('k3', 'k4') GROUP BY 1, 2),
      rk AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, skill) AS r FROM wc),
      a AS (SELECT * FROM rk WHERE week = {_NOW} - 7 AND r <= 10), b AS (SELECT * FROM rk WHERE week = {_NOW} - 14 AND r <= 10),
      v AS (SELECT count(*) FILTER (week = {_NOW} - 7) AS x, count(*) FILTER (week = {_NOW} - 14) AS y FROM p WHERE source = 'view')
      SELECT {_NOW} - 7 AS week_start, {_NOW} AS next_week_start, {_counts('last', f'target_week_start = {_NOW} - 7')}, {_counts('all', 'true')},
        x AS volume, CASE WHEN {c} THEN y END AS volume_before, CASE WHEN {c} THEN x - y END AS change, CASE WHEN {c} THEN round(100 * (x - y) / y, 1) END AS change_pct, {c} AS comparable,
        (SELECT string_agg(target_type || ':' || target_key || ':' || {_SHOWN} || ':' || CAST(actual AS DOUBLE) || ':' || outcome, ', ' ORDER BY target_type, target_key) FROM bt WHERE target_week_start = {_NOW} - 7) AS graded,
        (SELECT string_agg(target_type || ':' || target_key || ':' || {_SHOWN}, ', ' ORDER BY target_type, target_key) FROM nw) AS predictions,
        coalesce((SELECT string_agg(skill || ':' || upper(skill) || ':' || n, ', ' ORDER BY r) FROM a WHERE r <= 5), '') AS top,
        coalesce((SELECT string_agg(skill || ':' || upper(skill), ', ' ORDER BY skill) FROM a WHERE skill NOT IN (SELECT skill FROM b)), '') AS entered,
        coalesce((SELECT string_agg(skill || ':' || upper(skill), ', ' ORDER BY skill) FROM b WHERE skill NOT IN (SELECT skill FROM a)), '') AS "left" FROM v"""


_BRIEFINGS = """WITH b AS (SELECT o_orderkey AS id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, o_orderdate AS created_at, o_orderpriority AS body, 'template' AS source,
  CASE WHEN o_orderkey % 50 = 0 AND o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS superseded_by FROM orders WHERE o_orderkey % 50 < 2)"""
_TITLED = "array_to_string(list_transform(string_split(lower(trim(city)), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_PAY = "coalesce((salary_min + salary_max) / 2, salary_min, salary_max)"


def _q(x: float) -> str:
    return f"quantile_cont({_PAY}, {x})"


ORACLE_SQL = {
    "briefing_facts": _facts_sql(True),
    "briefing_facts_early": _facts_sql(False),
    "briefings_list": f"{_BRIEFINGS} SELECT * FROM b ORDER BY week_start DESC, created_at DESC, id DESC LIMIT 12",
    "briefing_latest": f"""{_BRIEFINGS}, l AS (SELECT * FROM b WHERE superseded_by IS NULL ORDER BY week_start DESC, created_at DESC, id DESC LIMIT 1)
      SELECT l.id, l.week_start, l.created_at, l.body, o.id AS original_id, o.body AS original_body FROM l LEFT JOIN b o ON o.superseded_by = l.id""",
    "company_summaries": f"""{_W}, top AS (SELECT company_key, count(*) AS posting_count FROM postings WHERE company_key IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25),
      p AS (SELECT * FROM postings WHERE company_key IN (SELECT company_key FROM top)),
      nm AS (SELECT company_key, company, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, company) AS r FROM p GROUP BY 1, 2),
      tw AS (SELECT company_key, string_agg(DISTINCT {_TITLED}, '|' ORDER BY {_TITLED}) AS cities FROM p GROUP BY 1),
      pay AS (SELECT company_key, count({_PAY}) AS n, {_q(0.5)} AS m, CASE WHEN count({_PAY}) < 4 THEN {_q(0.5)} ELSE {_q(0.25)} END AS a, CASE WHEN count({_PAY}) < 4 THEN {_q(0.5)} ELSE {_q(0.75)} END AS z FROM p WHERE coalesce(currency, 'PKR') = 'PKR' GROUP BY 1),
      sk AS (SELECT company_key, skill, count(*) AS c, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, min(ord)) AS r FROM mentions JOIN p ON id = posting_id JOIN taxonomy USING (skill) WHERE taxonomy.category <> 'soft' GROUP BY 1, 2),
      five AS (SELECT company_key, string_agg(skill || ':' || c, ', ' ORDER BY r) AS top_skills FROM sk WHERE r <= 5 GROUP BY 1),
      t AS (SELECT posting_id, string_agg(split_part(skill, ' ', -1), '|' ORDER BY split_part(skill, ' ', -1)) AS tags FROM mentions WHERE posting_id % 11 <> 0 GROUP BY 1),
      tb AS (SELECT company_key, tags, count(*) AS n FROM t JOIN p ON id = posting_id GROUP BY 1, 2), ts AS (SELECT company_key, CAST(sum(n) AS BIGINT) AS tagged, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS templated FROM tb GROUP BY 1)
      SELECT company, posting_count, cities, coalesce(top_skills, '') AS top_skills, coalesce(n, 0) AS n, {MQ._TWO.format('m')} AS median, {MQ._TWO.format('a')} AS q1, {MQ._TWO.format('z')} AS q3, {MQ._TWO.format('z - a')} AS iqr,
        coalesce(tagged, 0) AS tagged, coalesce(templated, 0) AS templated, round(templated / tagged, 4) AS share
      FROM top JOIN nm USING (company_key) LEFT JOIN tw USING (company_key) LEFT JOIN pay USING (company_key) LEFT JOIN five USING (company_key) LEFT JOIN ts USING (company_key) WHERE nm.r = 1""",
    "company_recent": f"""{_W} SELECT id, city, source, detail_url, coalesce((SELECT string_agg(skill, ',' ORDER BY skill) FROM mentions WHERE posting_id = id), '') AS skills
      FROM (SELECT * FROM postings WHERE company_key = 'mega staffing' ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 20)""",
    "foreign_postings": f"""{_W} SELECT id, currency, salary_min, salary_max, company, city, detail_url, coalesce((SELECT string_agg(DISTINCT skill, ',' ORDER BY skill) FROM mentions JOIN taxonomy USING (skill) WHERE posting_id = id AND taxonomy.category <> 'soft'), '') AS skills
      FROM postings WHERE currency IS NOT NULL AND currency <> 'PKR'""",
    "health": f"""{_W} SELECT count(*) FILTER (first_seen_at >= TIMESTAMP '2001-01-01' - INTERVAL 1 DAY) AS added_24h, count(*) FILTER (first_seen_at >= TIMESTAMP '2001-01-01' - INTERVAL 7 DAY) AS added_7d,
      round(count(*) FILTER (source = 'F' AND id % 4 > 1) / count(*) FILTER (source = 'F'), 4) AS enrichment_coverage, round((SELECT count(DISTINCT posting_id) FROM mentions) / count(*), 4) AS extraction_coverage,
      round((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(max(last_seen_at))) / 3600000000.0, 2) AS freshness_hours, count(*) AS postings, (SELECT count(*) FROM mentions) AS skill_mentions FROM postings""",
}
