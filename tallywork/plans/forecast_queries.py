"""Queries on weeks, forecasts and backtests over the events lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as W
from ..sources import lenses as L


def _ev(spark, d):
    return L.event_postings(spark, d), L.event_mentions(spark, d)


def _last(as_of=L.AS_OF):
    return F.date_sub(W.as_of_date(as_of, pkt=True), 7)


def _graded(s, d):
    rows = W.predict(*_ev(s, d), "2024-01-24 00:00:00", scope="view,click")
    return W.grade(rows, *_ev(s, d), L.AS_OF)


QUERIES = {
    "skill_trend_day": lambda s, d: W.skill_trend(*_ev(s, d), ["k1"], "day", "2024-01-30 12:00:00"),
    "skills_compare_week": lambda s, d: W.skill_trend(*_ev(s, d), ["k1", "k2"], "week", "2024-01-30 12:00:00"),
    "week_counts": lambda s, d: W.week_counts(*_ev(s, d)),
    "forecast_predict": lambda s, d: W.predict(*_ev(s, d), "2024-01-24 00:00:00"),
    "forecast_grade": _graded,
    "backtest": lambda s, d: W.backtest(*_ev(s, d), L.AS_OF),
    "backtest_summary": lambda s, d: W.accuracy(W.backtest(*_ev(s, d), L.AS_OF), by_key=True),
    "forecast_accuracy": lambda s, d: W.accuracy(W.backtest(*_ev(s, d), L.AS_OF)),
    "forecast_percent_errors": lambda s, d: W.percent_errors(W.backtest(*_ev(s, d), L.AS_OF)),
    "top_movers": lambda s, d: W.top_movers(*_ev(s, d), None, L.AS_OF),
    "week_top_skills": lambda s, d: W.top_skills(*_ev(s, d), _last()),
    "entered_left": lambda s, d: W.entered_left(*_ev(s, d), L.AS_OF),
    "weekly_facts": lambda s, d: W.weekly_facts(L.event_postings(s, d), L.AS_OF, "2024-01-01 00:00:00"),
}

_PKT = "CAST(date_trunc('week', {} + INTERVAL 5 HOUR) AS DATE)"
_NOW = "DATE '2024-01-29'"
_COUNTS = f"""WITH {L.SQL},
p AS (SELECT id, source, company, {_PKT.format('first_seen_at')} AS week FROM ev),
wc AS (SELECT 'volume' AS target_type, 'all' AS target_key, week, count(*) AS n FROM p GROUP BY week
  UNION ALL SELECT 'skill', skill, week, count(DISTINCT id) FROM em JOIN p ON id = posting_id GROUP BY 2, 3)"""


def _forecast(high: str, past: str) -> str:
    return f"""{_COUNTS}, past AS (SELECT * FROM wc WHERE {past}),
weeks AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM past), {high}, INTERVAL 7 DAY)) AS DATE) AS week),
grid AS (SELECT target_type, target_key, week, coalesce(n, 0) AS n FROM (SELECT DISTINCT target_type, target_key FROM past) CROSS JOIN weeks LEFT JOIN past USING (target_type, target_key, week)),
fc AS (SELECT *, avg(n) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m, 1.5 * coalesce(stddev_samp(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS s,
  CAST(lag(n) OVER w AS DOUBLE) AS baseline_predicted, count(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS trail_sum
  FROM grid WINDOW w AS (PARTITION BY target_type, target_key ORDER BY week)),
rk AS (SELECT *, row_number() OVER (PARTITION BY week, target_type ORDER BY trail_sum DESC, target_key) AS r FROM fc WHERE before > 0),
f AS (SELECT CASE WHEN before < 3 THEN 'trailing-mean-v1_shorthist' ELSE 'trailing-mean-v1' END AS model_version, target_type, target_key, week AS target_week_start, round(m, 4) AS predicted,
  round(greatest(0, m - s), 4) AS interval_low, round(m + s, 4) AS interval_high, baseline_predicted, n FROM rk WHERE target_type = 'volume' OR (r <= 12 AND trail_sum > 0))"""


_BT = f"""{_forecast(_NOW + ' - 7', 'week < ' + _NOW)},
e AS (SELECT * EXCLUDE (n), n AS actual, round(abs(predicted - n), 4) AS abs_error, round(abs(baseline_predicted - n), 4) AS baseline_abs_error FROM f),
bt AS (SELECT *, abs_error < baseline_abs_error AS beat_baseline, CASE WHEN abs_error < baseline_abs_error THEN 'beat' WHEN abs_error = baseline_abs_error THEN 'tie' ELSE 'lost' END AS outcome FROM e)"""
_AGG = "count(*) AS n, count(*) FILTER (outcome = 'beat') AS beat, count(*) FILTER (outcome = 'tie') AS tie, count(*) FILTER (outcome = 'lost') AS lost, round(count(*) FILTER (outcome = 'beat') / count(*), 4) AS beat_rate, round(CAST(sum(CAST(abs_error AS DECIMAL(18, 4))) AS DOUBLE) / count(abs_error), 4) AS mae, count(DISTINCT target_week_start) AS weeks"
_BULK = """eb AS (SELECT company FROM ev GROUP BY 1 HAVING count(*) > 0.25 * (SELECT count(*) FROM ev)), ek AS (SELECT * FROM p WHERE company NOT IN (SELECT company FROM eb))"""
_TOPW = "SELECT skill, count(DISTINCT id) AS n, count(DISTINCT company) AS companies FROM em JOIN ek ON id = posting_id WHERE week = {} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


def _trend(trunc: str, step: str, now: str, skills: str) -> str:
    return f"""WITH {L.SQL}, p AS (SELECT id, CAST(date_trunc('{trunc}', first_seen_at) AS DATE) AS bucket FROM ev),
t AS (SELECT bucket, count(*) AS total FROM p GROUP BY 1),
b AS (SELECT CAST(unnest(generate_series((SELECT min(bucket) FROM t), (SELECT max(bucket) FROM t), INTERVAL {step})) AS DATE) AS bucket),
h AS (SELECT skill, bucket, count(DISTINCT id) AS n FROM em JOIN p ON id = posting_id WHERE skill IN {skills} GROUP BY 1, 2)
SELECT s.skill, bucket, coalesce(n, 0) AS with_skill, coalesce(total, 0) AS total, lag(coalesce(n, 0)) OVER (PARTITION BY s.skill ORDER BY bucket) AS baseline, bucket = DATE '{now}' AS is_partial
FROM b CROSS JOIN (SELECT unnest({skills.replace('(', '[').replace(')', ']')}) AS skill) s LEFT JOIN t USING (bucket) LEFT JOIN h USING (skill, bucket)"""


ORACLE_SQL = {
    "skill_trend_day": _trend("day", "1 DAY", "2024-01-30", "('k1')"),
    "skills_compare_week": _trend("week", "7 DAY", "2024-01-29", "('k1', 'k2')"),
    "week_counts": f"{_COUNTS} SELECT * FROM wc",
    "forecast_predict": f"{_forecast(chr(68) + 'ATE ' + repr('2024-01-22'), 'week < DATE ' + repr('2024-01-22'))} SELECT * EXCLUDE (n), 'all' AS source_scope FROM f WHERE target_week_start = DATE '2024-01-22'",
    "forecast_grade": f"""{_forecast(chr(68) + 'ATE ' + repr('2024-01-22'), 'week < DATE ' + repr('2024-01-22'))},
      ac AS (SELECT 'volume' AS target_type, 'all' AS target_key, count(DISTINCT id) AS a FROM p WHERE week = DATE '2024-01-22' AND source IN ('view', 'click')
        UNION ALL SELECT 'skill', skill, count(DISTINCT id) FROM em JOIN p ON id = posting_id WHERE week = DATE '2024-01-22' AND source IN ('view', 'click') GROUP BY 2),
      g AS (SELECT f.* EXCLUDE (n), 'view,click' AS source_scope, coalesce(a, 0) AS actual FROM f LEFT JOIN ac USING (target_type, target_key) WHERE target_week_start = DATE '2024-01-22'),
      e AS (SELECT *, round(abs(predicted - actual), 4) AS abs_error, round(abs(baseline_predicted - actual), 4) AS baseline_abs_error FROM g)
      SELECT *, abs_error < baseline_abs_error AS beat_baseline, CASE WHEN abs_error < baseline_abs_error THEN 'beat' WHEN abs_error = baseline_abs_error THEN 'tie' ELSE 'lost' END AS outcome FROM e""",
    "backtest": f"{_BT} SELECT * FROM bt",
    "backtest_summary": f"{_BT} SELECT coalesce(target_type, 'overall') AS target_type, coalesce(target_key, 'overall') AS target_key, {_AGG} FROM bt GROUP BY GROUPING SETS ((target_type, target_key), ())",
    "forecast_accuracy": f"{_BT} SELECT coalesce(target_type, 'overall') AS target_type, {_AGG} FROM bt GROUP BY GROUPING SETS ((target_type), ())",
    "forecast_percent_errors": f"{_BT} SELECT target_type, target_key, target_week_start, predicted, actual, round(100 * abs_error / nullif(actual, 0), 2) AS pct_error FROM bt",
    "top_movers": f"""WITH {L.SQL}, p AS (SELECT id, CAST(date_trunc('week', first_seen_at) AS DATE) AS week FROM ev WHERE CAST(date_trunc('week', first_seen_at) AS DATE) < DATE '2024-01-29')
      SELECT skill, count(*) FILTER (week = DATE '2024-01-22') AS n_last, count(*) FILTER (week = DATE '2024-01-15') AS n_before, count(*) FILTER (week = DATE '2024-01-22') - count(*) FILTER (week = DATE '2024-01-15') AS delta
      FROM em JOIN p ON id = posting_id WHERE week >= DATE '2024-01-15' GROUP BY 1""",
    "week_top_skills": f"{_COUNTS}, {_BULK} {_TOPW.format(_NOW + ' - 7')}",
    "entered_left": f"""{_COUNTS}, {_BULK}, a AS ({_TOPW.format(_NOW + ' - 7')}), b AS ({_TOPW.format(_NOW + ' - 14')})
      SELECT skill, 'entered' AS move FROM a WHERE skill NOT IN (SELECT skill FROM b) UNION ALL SELECT skill, 'left' FROM b WHERE skill NOT IN (SELECT skill FROM a)""",
    "weekly_facts": f"""{_COUNTS} SELECT {_NOW} - 7 AS week, count(*) FILTER (week = {_NOW} - 7) AS volume, count(*) FILTER (week = {_NOW} - 14) AS volume_before,
      count(*) FILTER (week = {_NOW} - 7) - count(*) FILTER (week = {_NOW} - 14) AS change,
      round(100 * (count(*) FILTER (week = {_NOW} - 7) - count(*) FILTER (week = {_NOW} - 14)) / count(*) FILTER (week = {_NOW} - 14), 1) AS change_pct FROM p""",
}
