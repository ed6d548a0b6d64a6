"""Queries of the market operators over the orders lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as M
from ..sources import lenses as L

DOMAINS = ("AUTOMOBILE", "BUILDING", "MACHINERY")
OWN = ["blue bolt", "green gear", "hot nut", "red widget", "small pin", "large plate"]


def _all(spark, d):
    return L.postings(spark, d), L.mentions(spark, d), L.taxonomy(spark, d)


def _pairs(spark, d):
    return M.cooccurrence(*_all(spark, d))


def _covered(spark, d):
    return M.coverage(*_all(spark, d), OWN)


QUERIES = {
    "skills_top": lambda s, d: M.skills_top(*_all(s, d), tasks=L.tasks(s, d)),
    "skills_top_without_bulk": lambda s, d: M.skills_top(*_all(s, d), exclude_bulk=True, include_soft=True, tasks=L.tasks(s, d)),
    "skills_top_category": lambda s, d: M.skills_top(*_all(s, d), category="gear", tasks=L.tasks(s, d)),
    "stats_overview": lambda s, d: M.overview(*_all(s, d)[:2]),
    "postings_per_source": lambda s, d: M.counts_by(L.postings(s, d), "source", "unlabeled"),
    "postings_per_category": lambda s, d: M.counts_by(L.postings(s, d), "category", "unlabeled"),
    "bulk_companies": lambda s, d: M.bulk_companies(L.postings(s, d), ("customer#000000001",)),
    "cities_breakdown": lambda s, d: M.cities(*_all(s, d)[:2]),
    "cities_breakdown_skill": lambda s, d: M.cities(*_all(s, d)[:2], skill="red widget"),
    "salaries_summary": lambda s, d: M.salaries(*_all(s, d)[:2]),
    "postings_recent": lambda s, d: M.recent(*_all(s, d)[:2]),
    "companies_top": lambda s, d: M.companies_top(*_all(s, d)),
    "templated_share": lambda s, d: M.templated_share(L.postings(s, d), L.mentions(s, d).select("posting_id", F.col("skill").alias("tag"))),
    "skills_cooccurrence": _pairs,
    "skill_companions": lambda s, d: M.companions(_pairs(s, d), "red widget"),
    "foreign_currency": lambda s, d: M.foreign_currency(*_all(s, d)),
    "coverage_summary": lambda s, d: M.coverage_summary(_covered(s, d)),
    "coverage_next_skills": lambda s, d: M.next_skills(_covered(s, d)),
    "system_health": lambda s, d: M.system_health(*_all(s, d)[:2], "2001-01-01 00:00:00"),
    "curriculum_alignment": lambda s, d: M.curriculum_alignment(*_all(s, d), L.curriculum(s, d), DOMAINS),
    "family_paths": lambda s, d: M.family_paths(*_all(s, d), tasks=L.tasks(s, d)),
    "paths_match": lambda s, d: M.match_paths(*_all(s, d), OWN, tasks=L.tasks(s, d)),
}

_W = f"WITH {L.SQL}"
_OWN = "(" + ", ".join(f"'{x}'" for x in OWN) + ")"
_BAND = """CASE WHEN e LIKE '%fresh%' OR e LIKE '%entry%' OR e LIKE '%intern%' OR y <= 1 THEN 'Entry (0-1 yrs)'
  WHEN y <= 3 THEN 'Junior (2-3 yrs)' WHEN y <= 6 THEN 'Mid (4-6 yrs)' WHEN y IS NOT NULL THEN 'Senior (7+ yrs)' ELSE 'Unspecified' END"""
_TWO = "CAST(round(CAST({} AS DECIMAL(24, 6)), 2) AS DOUBLE)"
_IQR = f"""count(v) AS n, {_TWO.format("quantile_cont(v, 0.5)")} AS median,
  {_TWO.format("CASE WHEN count(v) < 4 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.25) END")} AS q1,
  {_TWO.format("CASE WHEN count(v) < 4 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.75) END")} AS q3,
  {_TWO.format("CASE WHEN count(v) < 4 THEN 0 ELSE quantile_cont(v, 0.75) - quantile_cont(v, 0.25) END")} AS iqr"""


def _top(where, p="postings", m="mentions"):
    return f"""{_W}, c AS (SELECT skill, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_key) AS company_count
      FROM {m} JOIN {p} ON id = posting_id GROUP BY skill)
    SELECT skill, category, requirement_type, posting_count, company_count, round(posting_count / (SELECT count(*) FROM {p}), 4) AS share
    FROM c JOIN taxonomy USING (skill) WHERE {where} ORDER BY posting_count DESC, ord LIMIT 100"""


_COVER = f"""need AS (SELECT posting_id, count(*) AS needed, count(*) FILTER (skill IN {_OWN}) AS covered, list(skill) FILTER (skill NOT IN {_OWN}) AS missing
  FROM mentions JOIN taxonomy USING (skill) WHERE requirement_type = 'skill' AND category <> 'soft' GROUP BY posting_id)"""
_PAIRS = """m AS (SELECT posting_id, skill FROM mentions JOIN taxonomy USING (skill) WHERE category <> 'soft'),
single AS (SELECT skill, count(*) AS n FROM m GROUP BY skill),
joint AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS joint FROM m a JOIN m b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY 1, 2 HAVING count(*) >= 5),
pairs AS (SELECT skill_a, skill_b, joint, x.n AS count_a, y.n AS count_b, round(joint / x.n, 4) AS p_b_given_a, round(joint / y.n, 4) AS p_a_given_b,
  round(CAST(joint * (SELECT n FROM total) AS DOUBLE) / (x.n * y.n), 3) AS lift FROM joint JOIN single x ON x.skill = skill_a JOIN single y ON y.skill = skill_b)"""
_LEVELS = """lv AS (SELECT * FROM postings WHERE job_family IS NOT NULL AND experience_level IS NOT NULL),
fit AS (SELECT job_family FROM lv GROUP BY 1 HAVING count(*) >= 15 AND count(DISTINCT experience_level) >= 2),
p AS (SELECT * FROM lv WHERE job_family IN (SELECT job_family FROM fit)),
k AS (SELECT job_family, experience_level, skill, count(DISTINCT posting_id) AS k, count(DISTINCT company_key) AS c
  FROM mentions JOIN p ON id = posting_id JOIN taxonomy USING (skill) WHERE taxonomy.category <> 'soft' GROUP BY 1, 2, 3)"""

ORACLE_SQL = {
    "skills_top": _top("category <> 'soft'"),
    "skills_top_without_bulk": _top("true", "kept", "kept_mentions"),
    "skills_top_category": _top("category = 'gear' AND category <> 'soft'"),
    "stats_overview": f"""{_W} SELECT count(*) AS total_postings, count(DISTINCT nullif(company, '')) AS distinct_companies, count(DISTINCT city) AS distinct_cities,
      CAST(max(last_seen_at) AS DATE) AS last_seen, (SELECT count(*) FROM mentions) AS total_mentions,
      round((SELECT max(n) FROM (SELECT count(*) AS n FROM postings WHERE company_key IS NOT NULL GROUP BY company_key)) / count(*), 4) AS top_company_share FROM postings""",
    "postings_per_source": f"{_W} SELECT coalesce(source, 'unlabeled') AS value, count(*) AS n FROM postings GROUP BY 1",
    "postings_per_category": f"{_W} SELECT coalesce(category, 'unlabeled') AS value, count(*) AS n FROM postings GROUP BY 1",
    "bulk_companies": f"{_W} SELECT company_key FROM bulk UNION SELECT company_key FROM postings WHERE company_key = 'customer#000000001'",
    "cities_breakdown": f"{_W} SELECT nullif(lower(trim(city)), '') AS city_key, count(*) AS posting_count, coalesce(string_agg(DISTINCT city, '|' ORDER BY city), '') AS variants FROM postings GROUP BY 1",
    "cities_breakdown_skill": f"{_W} SELECT nullif(lower(trim(city)), '') AS city_key, count(*) AS posting_count, coalesce(string_agg(DISTINCT city, '|' ORDER BY city), '') AS variants FROM postings WHERE id IN (SELECT posting_id FROM mentions WHERE skill = 'red widget') GROUP BY 1",
    "salaries_summary": f"""{_W}, e AS (SELECT lower(coalesce(experience_raw, '')) AS e, TRY_CAST(regexp_extract(lower(coalesce(experience_raw, '')), '(\\d+)', 1) AS INT) AS y,
        coalesce((salary_min + salary_max) / 2, salary_min, salary_max) AS v FROM postings WHERE coalesce(currency, 'PKR') = 'PKR'),
      b AS (SELECT {_BAND} AS band, v FROM e),
      r AS (SELECT CASE WHEN grouping(band) = 1 THEN 'overall' ELSE band END AS band, count(*) AS postings, {_IQR} FROM b GROUP BY GROUPING SETS ((band), ()))
      SELECT band, postings, n, median, q1, q3, CASE WHEN n = 0 THEN NULL ELSE iqr END AS iqr FROM r""",
    "postings_recent": f"""{_W}, t AS (SELECT * FROM postings ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 50)
      SELECT id, source, company, CAST(first_seen_at AS DATE) AS first_seen, coalesce((SELECT string_agg(DISTINCT skill, ',' ORDER BY skill) FROM mentions WHERE posting_id = id), '') AS skills FROM t""",
    "companies_top": f"""{_W}, top AS (SELECT company_key, count(*) AS posting_count FROM postings WHERE company_key IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50),
      p AS (SELECT * FROM postings WHERE company_key IN (SELECT company_key FROM top)),
      nm AS (SELECT company_key, company, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, company) AS r FROM p GROUP BY 1, 2),
      tw AS (SELECT company_key, string_agg(DISTINCT array_to_string(list_transform(string_split(lower(trim(city)), ' '), lambda x: upper(x[1]) || x[2:]), ' '), '|' ORDER BY array_to_string(list_transform(string_split(lower(trim(city)), ' '), lambda x: upper(x[1]) || x[2:]), ' ')) AS cities FROM p GROUP BY 1),
      pay AS (SELECT company_key, count(coalesce((salary_min + salary_max) / 2, salary_min, salary_max)) AS salary_n, {_TWO.format('quantile_cont(coalesce((salary_min + salary_max) / 2, salary_min, salary_max), 0.5)')} AS salary_median FROM p WHERE coalesce(currency, 'PKR') = 'PKR' GROUP BY 1),
      sk AS (SELECT company_key, skill, row_number() OVER (PARTITION BY company_key ORDER BY count(DISTINCT posting_id) DESC, min(ord)) AS r FROM mentions JOIN p ON id = posting_id JOIN taxonomy USING (skill) WHERE taxonomy.category <> 'soft' GROUP BY 1, 2),
      five AS (SELECT company_key, string_agg(skill, '|' ORDER BY r) AS top_skills FROM sk WHERE r <= 5 GROUP BY 1)
      SELECT company_key, company AS display_name, posting_count, cities, coalesce(salary_n, 0) AS salary_n, salary_median, coalesce(top_skills, '') AS top_skills
      FROM top JOIN nm USING (company_key) LEFT JOIN tw USING (company_key) LEFT JOIN pay USING (company_key) LEFT JOIN five USING (company_key) WHERE nm.r = 1""",
    "templated_share": f"""{_W}, t AS (SELECT posting_id, string_agg(skill, '|' ORDER BY skill) AS tags FROM mentions GROUP BY 1),
      b AS (SELECT company_key, tags, count(*) AS n FROM t JOIN postings ON id = posting_id WHERE company_key IS NOT NULL GROUP BY 1, 2)
      SELECT company_key, CAST(sum(n) AS BIGINT) AS tagged, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS templated_share FROM b GROUP BY 1""",
    "skills_cooccurrence": f"{_W}, {_PAIRS} SELECT * FROM pairs",
    "skill_companions": f"""{_W}, {_PAIRS} SELECT companion, joint, p_companion, lift FROM (
      SELECT skill_b AS companion, joint, p_b_given_a AS p_companion, lift FROM pairs WHERE skill_a = 'red widget'
      UNION ALL SELECT skill_a, joint, p_a_given_b, lift FROM pairs WHERE skill_b = 'red widget') ORDER BY p_companion DESC, companion LIMIT 50""",
    "foreign_currency": f"{_W} SELECT skill, count(DISTINCT posting_id) AS posting_count FROM mentions JOIN postings ON id = posting_id JOIN taxonomy USING (skill) WHERE currency IS NOT NULL AND currency <> 'PKR' AND taxonomy.category <> 'soft' GROUP BY skill",
    "coverage_summary": f"{_W}, {_COVER} SELECT count(*) AS technical, count(*) FILTER (covered >= 0.7 * needed) AS strong, count(*) FILTER (covered = needed) AS \"full\", round(100 * count(*) FILTER (covered >= 0.7 * needed) / count(*), 1) AS strong_pct FROM need",
    "coverage_next_skills": f"{_W}, {_COVER} SELECT skill, count(*) AS unlocks FROM (SELECT unnest(missing) AS skill FROM need WHERE covered < 0.7 * needed AND covered + 1 >= 0.7 * needed) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "system_health": f"""{_W}, h AS (SELECT DISTINCT posting_id FROM mentions)
      SELECT source, count(*) AS postings, CAST(max(last_seen_at) AS DATE) AS last_seen,
        count(*) FILTER (first_seen_at >= TIMESTAMP '2001-01-01' - INTERVAL 1 DAY AND first_seen_at <= TIMESTAMP '2001-01-01') AS added_day,
        count(*) FILTER (first_seen_at >= TIMESTAMP '2001-01-01' - INTERVAL 7 DAY AND first_seen_at <= TIMESTAMP '2001-01-01') AS added_week,
        round(count(posting_id) / count(*), 4) AS extracted_share, round((epoch_us(TIMESTAMP '2001-01-01') - epoch_us(max(last_seen_at))) / 3600000000.0, 2) AS freshness_hours
      FROM postings LEFT JOIN h ON posting_id = id GROUP BY source""",
    "curriculum_alignment": f"""{_W}, c AS (SELECT skill, count(DISTINCT posting_id) AS posting_count, count(DISTINCT company_key) AS company_count FROM mentions JOIN postings ON id = posting_id WHERE domain IN {DOMAINS} GROUP BY 1),
      t AS (SELECT skill, count(DISTINCT course_id) AS courses FROM curriculum GROUP BY 1)
      SELECT skill, CASE WHEN courses IS NOT NULL THEN 'taught' ELSE 'gap' END AS status, posting_count, company_count, coalesce(courses, 0) AS courses
      FROM c JOIN taxonomy USING (skill) LEFT JOIN t USING (skill) WHERE requirement_type = 'skill' AND category NOT IN ('soft', 'office_admin') AND (courses IS NOT NULL OR company_count >= 5)""",
    "family_paths": f"""{_W}, {_LEVELS}, n AS (SELECT job_family, experience_level, count(*) AS n, CASE experience_level WHEN 'fresh' THEN 1 WHEN 'junior' THEN 2 WHEN 'mid' THEN 3 ELSE 4 END AS no FROM p GROUP BY 1, 2),
      st AS (SELECT job_family, experience_level AS level_from, n AS n_from, lead(experience_level) OVER w AS level_to, lead(n) OVER w AS n_to FROM n WINDOW w AS (PARTITION BY job_family ORDER BY no))
      SELECT st.job_family, level_from, level_to, h.skill, h.c AS companies, round(h.k / n_to - coalesce(l.k, 0) / n_from, 4) AS delta
      FROM st JOIN k h ON h.job_family = st.job_family AND h.experience_level = level_to LEFT JOIN k l ON l.job_family = st.job_family AND l.experience_level = level_from AND l.skill = h.skill
      WHERE h.k / n_to - coalesce(l.k, 0) / n_from > 0 AND h.c >= 3""",
    "paths_match": f"""{_W}, {_LEVELS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_family, experience_level ORDER BY c DESC, k DESC, skill) AS r FROM k),
      s AS (SELECT job_family, experience_level, count(*) AS size, count(*) FILTER (skill IN {_OWN}) AS covered FROM r WHERE r <= 10 GROUP BY 1, 2)
      SELECT *, round(covered / size, 3) AS fraction, covered >= 0.7 * size AS fits, CAST(row_number() OVER (ORDER BY round(covered / size, 3) DESC, size DESC, job_family, experience_level) AS INT) AS place FROM s""",
}

