"""Queries of the insights, one by one and as published, with raw tags and titles made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import insights as I
from ..session import written
from ..sources import lenses as L

AS_OF = "2001-01-01 00:00:00"


def _inputs(s, d) -> I.Inputs:
    """The postings are made once, with the skills' names as raw tags (none for some) and a title."""
    m = written(L.mentions(s, d))
    tags = m.where("posting_id % 11 <> 0").groupBy(F.col("posting_id").alias("id")).agg(F.collect_list(F.element_at(F.split("skill", " "), -1)).alias("tags"))
    p = L.postings(s, d).join(tags, "id", "left").withColumn("title", F.concat(F.lit("Job "), F.col("id").cast("string")))
    return I.Inputs(written(p), m, L.taxonomy(s, d), AS_OF, tag_source="F")


def _shown(rows: DataFrame) -> DataFrame:
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("value")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "; ")
    return rows.select("generator", "headline", "detail", facts.alias("facts"), "audience", "score", "sample_size")


QUERIES = {
    "insight_values": lambda s, d: _shown(I.generated(_inputs(s, d))[0]),
    "insights_live": lambda s, d: _shown(I.live(_inputs(s, d))[0]),
    "insights_suppressed": lambda s, d: I.live(_inputs(s, d))[1],
}

_ROWS = f"""WITH {L.SQL},
m AS (SELECT posting_id, skill FROM mentions JOIN taxonomy USING (skill) WHERE requirement_type = 'skill' AND category NOT IN ('soft', 'office_admin') AND posting_id IN (SELECT id FROM postings)),
cn AS (SELECT skill, count(*) AS n FROM m GROUP BY 1),
ct AS (SELECT skill, n, array_to_string(list_transform(string_split(skill, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS display, category, ord FROM cn JOIN taxonomy USING (skill)),
jt AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS joint FROM m a JOIN m b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY 1, 2 HAVING count(*) >= 5),
pr AS (SELECT skill_a, skill_b, x.display AS display_a, y.display AS display_b, joint, round(joint / x.n, 4) AS b_a, round(joint / y.n, 4) AS a_b, round(CAST(joint * (SELECT n FROM total) AS DOUBLE) / (x.n * y.n), 3) AS lift
  FROM jt JOIN ct x ON x.skill = skill_a JOIN ct y ON y.skill = skill_b),
wk AS (SELECT id, CAST(date_trunc('week', first_seen_at) AS DATE) AS week FROM postings WHERE date_trunc('week', first_seen_at) < DATE '2001-01-01'),
tw AS (SELECT max(week) AS last, min(week) AS previous, (SELECT count(DISTINCT week) FROM wk) AS weeks FROM (SELECT DISTINCT week FROM wk ORDER BY week DESC LIMIT 2)),
mv AS (SELECT skill, weeks, count(*) FILTER (week = last) AS cur, count(*) FILTER (week = previous) AS prev FROM m JOIN wk ON id = posting_id, tw WHERE weeks >= 3 GROUP BY 1, 2),
tm AS (SELECT mv.*, cur - prev AS delta, display FROM mv JOIN ct USING (skill) WHERE cur <> prev ORDER BY abs(cur - prev) DESC, ord LIMIT 1),
tg AS (SELECT posting_id AS id, list_sort(list(split_part(skill, ' ', -1))) AS tags FROM mentions WHERE posting_id % 11 <> 0 GROUP BY 1),
ts AS (SELECT tags, count(*) AS n FROM postings LEFT JOIN tg USING (id) WHERE source = 'F' GROUP BY 1),
tp AS (SELECT sum(n) FILTER (tags IS NOT NULL) AS total, sum(n) FILTER (tags IS NOT NULL AND n > 1) AS k FROM ts HAVING sum(n) >= 5),
dt AS (SELECT * FROM postings WHERE scrape_run_id IS NOT NULL AND last_seen_at IS NOT NULL AND first_seen_at IS NOT NULL),
gone AS (SELECT city, epoch_us(last_seen_at) / 86400000000.0 - epoch_us(first_seen_at) / 86400000000.0 AS days FROM dt WHERE scrape_run_id <> (SELECT arg_max(scrape_run_id, struct_pack(a := last_seen_at, b := id)) FROM dt)),
cm AS (SELECT regexp_replace(upper(city[1]) || lower(city[2:]), '_', '_') AS city, round(quantile_cont(days, 0.5), 2) AS md FROM gone WHERE city IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
lf AS (SELECT quantile_cont(days, 0.5) AS md, count(*) AS n, (SELECT string_agg(city || ': ' || md, ', ' ORDER BY city || ': ' || md) FROM cm) AS towns FROM gone HAVING count(*) >= 5),
ld AS (SELECT *, first_value({{'s': skill, 'd': display, 'n': n}}) OVER (PARTITION BY category ORDER BY n DESC, ord) AS x FROM ct WHERE n >= 5),
dm AS (SELECT *, x.n / n AS ratio FROM ld WHERE skill <> x.s AND x.n / n >= 1.5 ORDER BY x.n / n DESC, x.s, skill LIMIT 1),
fc AS (SELECT * FROM postings WHERE currency IS NOT NULL AND currency <> 'PKR'),
fb AS (SELECT currency, count(*) AS k FROM fc GROUP BY 1),
zt AS (SELECT count(*) AS k, (SELECT n FROM total) AS n FROM postings WHERE id NOT IN (SELECT posting_id FROM m) HAVING count(*) > 0),
best AS (SELECT * FROM (SELECT * FROM pr ORDER BY lift DESC, skill_a, skill_b LIMIT 1) WHERE joint >= 15),
one AS (SELECT skill, display FROM ct ORDER BY n DESC, ord LIMIT 1),
cp AS (SELECT * FROM (SELECT one.display, one.skill, other, other_display, share, joint FROM one JOIN (SELECT skill_a AS skill, skill_b AS other, display_b AS other_display, b_a AS share, joint FROM pr UNION ALL SELECT skill_b, skill_a, display_a, a_b, joint FROM pr) USING (skill)
  ORDER BY share DESC, other LIMIT 1) WHERE joint >= 5),
sp AS (SELECT company_key, company, count(*) AS k FROM kept WHERE company_key IS NOT NULL GROUP BY 1, 2),
tc AS (SELECT company_key, sum(k) AS n, arg_min(company, {{'a': -k, 'b': company}}) AS name FROM sp GROUP BY 1 HAVING sum(k) >= 20 ORDER BY 2 DESC, 1 LIMIT 1),
r AS (
  SELECT 'top_mover' AS generator, format('Demand for {{}} has {{}} this week', display, CASE WHEN delta > 0 THEN 'risen' ELSE 'fallen' END) AS headline,
    format('{{}} appeared in {{}} postings this week, versus {{}} the week before -- a change of {{}}.', display, cur, prev, abs(delta)) AS detail,
    format('current_week={{}}; delta={{}}; previous_week={{}}; skill={{}}', cur, delta, prev, skill) AS facts, 'market' AS audience, CAST(abs(delta) AS DOUBLE) AS score, CAST(weeks AS BIGINT) AS sample_size FROM tm
  UNION ALL SELECT 'templated', printf('%.0f%% of F postings share an identical skill-tag block with another posting', 100.0 * k / total),
    format('{{}} of {{}} F postings with skill tags have the exact same tag set as at least one other posting -- evidence of templated/duplicated listings from a small number of employers, not independently authored tag choices.', k, total),
    'share=' || round(k / total, 4) || '; templated_postings=' || k || '; total_tagged_postings=' || total, 'system', k / total * 100, total FROM tp WHERE k > 0
  UNION ALL SELECT 'lifespan', printf('Job postings here typically stay listed for about %.0f days', md), format('Based on {{}} postings that have since been taken down or replaced, measured from when each one first appeared to when it was last seen.', n),
    'by_city_median_days=' || towns || '; overall_median_days=' || round(md, 2) || '; sample_size=' || n, 'market', md, n FROM lf
  UNION ALL SELECT 'dominance', x.d || ' is asked for far more often than ' || display, format('{{}} appears in {{}} postings, versus {{}} for {{}} -- roughly ', x.d, x.n, n, display) || printf('%.0f times as many.', ratio),
    'category=' || category || '; leader=' || x.s || '; leader_count=' || x.n || '; ratio=' || round(ratio, 2) || '; runner_up=' || skill || '; runner_up_count=' || n, 'market', ratio, n FROM dm
  UNION ALL SELECT 'foreign_currency', sum(k) || ' postings are priced in a non-PKR currency', 'By currency -- ' || string_agg(currency || ': ' || k, ', ' ORDER BY k DESC, currency) || '. These postings'' salary figures aren''t in PKR; any salary statistic that doesn''t filter or convert by currency first would mix them in with PKR salaries and be wrong.',
    'by_currency=' || string_agg(currency || ': ' || k, ', ' ORDER BY k DESC, currency) || '; count=' || sum(k) || '; examples=' || (SELECT string_agg('Job ' || id || ' | ' || currency || ' | ' || detail_url, '; ' ORDER BY id) FROM (SELECT * FROM fc ORDER BY id LIMIT 10)), 'system', sum(k), sum(k) FROM fb HAVING sum(k) > 0
  UNION ALL SELECT 'zero_technical', printf('%.0f%% of postings don''t list a specific skill requirement', 100.0 * k / n), format('{{}} of {{}} postings mention no particular skill at all -- just a job title and, often, general requirements like experience or education.', k, n),
    'share=' || round(k / n, 4) || '; total_postings=' || n || '; zero_technical_count=' || k, 'market', k / n * 100, k FROM zt
  UNION ALL SELECT 'pairing', display_a || ' and ' || display_b || ' are commonly asked for together', format('{{}} postings mention both {{}} and {{}}.', joint, display_a, display_b),
    'joint_count=' || joint || '; lift=' || lift || '; skill_a=' || skill_a || '; skill_b=' || skill_b, 'market', lift, joint FROM best
  UNION ALL SELECT 'companion', 'Employers asking for ' || display || ' most often also ask for ' || other_display, printf('%.0f%% of postings mentioning ', share * 100) || format('{{}} also mention {{}} ({{}} postings).', display, other_display, joint),
    'companion=' || other || '; joint_count=' || joint || '; p_companion_given_skill=' || share || '; skill=' || skill, 'market', share * 100, joint FROM cp
  UNION ALL SELECT 'top_company', name || ' is the most active hirer tracked right now', format('{{}} distinct postings from {{}} across the tracked window.', n, name), 'company=' || name || '; posting_count=' || n, 'market', n, n FROM tc),
g AS (SELECT *, list_filter(regexp_extract_all(headline || ' ' || detail, '-?\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE) = 0) AS zeros FROM r)"""

ORACLE_SQL = {
    "insight_values": f"{_ROWS} SELECT * FROM r",
    "insights_live": f"{_ROWS} SELECT generator, headline, detail, facts, audience, score, sample_size FROM g WHERE len(zeros) = 0 ORDER BY score DESC, generator LIMIT 6",
    "insights_suppressed": f"{_ROWS} SELECT generator, 'a number shown is zero: ' || zeros[1] AS reason FROM g WHERE len(zeros) > 0",
}
