"""Queries of what the market's pages show and of structured extraction over made-up sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..operators import forecast as W
from ..operators import market as M
from ..operators import views as V
from ..sources import lenses as L
from . import forecast_queries as FQ
from . import market_queries as MQ

def _all(s, d):
    return L.postings(s, d), L.mentions(s, d), L.taxonomy(s, d)


def _ev(s, d):
    return L.event_postings(s, d), L.event_mentions(s, d)


def _names(s, d):
    """Display names of the even event skills."""
    m = L.event_mentions(s, d).select("skill").distinct()
    return m.where(F.substring("skill", 2, 9).cast("int") % 2 == 0).select("skill", F.upper("skill").alias("display"))


def _pending(s, d):
    f = W.predict(*_ev(s, d), "2024-01-24 00:00:00").withColumn("graded_at", F.when(F.col("target_key") == "k1", F.lit("2024-02-01").cast("timestamp")))
    return V.pending_forecasts(f, _names(s, d), ("2024-01-22",)).select("target_type", "target_key", "display", "predicted", "collection_regime_note")


def _knows(s, d):
    """Skills of someone who knows all but what ends in ``bolt``."""
    return [r["skill"] for r in L.taxonomy(s, d).where("NOT endswith(skill, 'bolt')").select("skill").collect()]


#: Sentences by the remainder of the id, {n} and {m} being numbers made from it, with what stands in them: degree, field, certification, least and most years, and the level if not by the years.
SENTENCES = [
    ("BS Computer Science or equivalent. Minimum {n} years of experience required.", "bachelors", None, False, "{n}", "NULL", None),
    ("Proficiency in MS Office and MS Excel is required.", None, None, False, "NULL", "NULL", None),
    ("MS in Computer Science required.", "masters", "computer science", False, "NULL", "NULL", None),
    ("Candidates must be able to work independently. {n}-{m} years of experience.", None, None, False, "{n}", "{m}", None),
    ("We are a company with {n} years of history.", None, None, False, "NULL", "NULL", None),
    ("Requirements: good manners, {n}+ years.", None, None, False, "{n}", "NULL", None),
    ("Requirements: manners. Responsibilities: to keep {n} years of files.", None, None, False, "NULL", "NULL", None),
    ("BA degree or equivalent experience considered. A certification is a plus.", "bachelors", None, True, "NULL", "NULL", None),
    ("Fresh graduate programme of our own.", None, None, False, "NULL", "NULL", "fresh"),
    ("", None, None, False, "NULL", "NULL", None),
    ("Intermediate in science is required.", "intermediate", None, False, "NULL", "NULL", None),
    ("Intermediate level English skills are required.", None, None, False, "NULL", "NULL", None),
    ("PhD in physics required. At least {m} years of experience.", "phd", "physics", False, "{m}", "NULL", None),
    ("You support a senior accountant. {n} years of experience required.", None, None, False, "{n}", "{n}", None),
    ("Senior cook wanted, {n} years of experience.", None, None, False, "{n}", "{n}", "senior"),
    ("An entry level role, {m}+ years of experience.", None, None, False, "{m}", "NULL", "fresh"),
    ("Diploma or master’s degree. Candidates aged {n} years or older.", "diploma", None, False, "NULL", "NULL", None),
]


def _sentences(s, d):
    n, m = (F.col("id") % 4 + 1).cast("int"), (F.col("id") % 4 + 3).cast("int")
    text = F.element_at(F.array(*[F.lit(x[0]) for x in SENTENCES]), (F.col("id") % len(SENTENCES) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{n}"), n.cast("string")), F.lit("{m}"), m.cast("string"))
    own = F.when(F.col("id") % 5 == 0, F.concat((F.col("id") % 9).cast("string"), F.lit(" Years"))).when(F.col("id") % 5 == 1, "2 - 4 Years").when(F.col("id") % 5 == 2, "Not stated")
    return L.postings(s, d).select("id", text.alias("description"), own.alias("experience_raw"))


def _fields(s, d):
    x = _sentences(s, d).withColumn("x", X.extracted(F.col("description"), F.col("experience_raw")))
    return x.select("id", "x.degree_level", "x.degree_field", "x.has_certification", F.col("x.experience_min_years").alias("low"), F.col("x.experience_max_years").alias("high"), F.col("x.experience_level").alias("level"))


def _texts(s, d):
    now = F.lit("2000-01-01 00:00:00")
    return L.postings(s, d).select("id", V.number_text(F.col("salary_min")).alias("number"), V.percent_text((F.col("id") % 8) / 8, 1).alias("percent"), V.relative_time(F.col("first_seen_at"), now).alias("ago"), V.scope_text(F.concat(F.col("source"), F.lit(", "), F.lower("source"))).alias("scope"))


def _answers(s, d):
    k = F.col("skill")
    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return L.taxonomy(s, d).select(
        "skill", V.json_array_text(said("Sure:\n```json\n[\"", k, "\"]\n```\nDone [1]")).alias("fenced"), V.json_array_text(said("so [", k, "] it is")).alias("bare"),
        V.last_json_array(said("First\n```json\n[\"no\"]\n```\nrather\n```\n[\"", k, "\"]\n```\n[3]")).alias("last_fence"),
        V.last_json_array(said("It is [[\"a ] \\\" ] ", k, "\"], [1]] and then [2]")).alias("scanned"), V.last_json_array(said("open [\"", k, " ]")).alias("unclosed"), V.last_json_array(said(k, " none ")).alias("plain"),
    )


QUERIES = {
    "forecasts_pending": _pending,
    "backtest_by_target": lambda s, d: V.by_target(W.accuracy(W.backtest(*_ev(s, d), L.AS_OF), by_key=True), _names(s, d)).select("target_type", "target_key", "display", "n", "beat", "place"),
    "backtest_detail": lambda s, d: V.backtest_detail(W.backtest(*_ev(s, d), L.AS_OF), _names(s, d)).select("target_week_start", "target_type", "target_key", "display", "actual"),
    "curriculum_gaps": lambda s, d: V.curriculum_gaps(M.curriculum_alignment(*_all(s, d), L.curriculum(s, d), MQ.DOMAINS)),
    "ignored_skills": lambda s, d: V.ignored_skills(L.taxonomy(s, d), _knows(s, d)),
    "coverage_strong_matches": lambda s, d: V.strong_matches(L.postings(s, d), M.coverage(*_all(s, d), _knows(s, d))),
    "paths_next_level": lambda s, d: V.next_level(*_all(s, d), _knows(s, d), tasks=L.tasks(s, d)),
    "experience_bands": lambda s, d: V.experience_share(L.postings(s, d)),
    "structured_fields": _fields,
    "display_texts": _texts,
    "course_titles": lambda s, d: L.taxonomy(s, d).select("skill", V.course_title(F.concat(F.upper(F.left("skill", F.lit(3))), F.lit(" "), F.initcap("skill"))).alias("title"), V.course_title(F.upper("skill")).alias("capitals")),
    "json_answers": _answers,
}

_W = f"WITH {L.SQL}"


def _case(i: int) -> str:
    def of(x):
        v = x[i]
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if i in (4, 5):
            return v.replace("{n}", "(o_orderkey % 4 + 1)").replace("{m}", "(o_orderkey % 4 + 3)")
        return f"'{v}'"

    return f"CASE o_orderkey % {len(SENTENCES)} " + " ".join(f"WHEN {k} THEN {of(x)}" for k, x in enumerate(SENTENCES)) + " END"


_NAME = "CASE WHEN target_type = 'volume' THEN 'All postings (Mustakbil)' WHEN target_key LIKE 'k%' AND CAST(substr(target_key, 2) AS INT) % 2 = 0 THEN upper(target_key) ELSE target_key END AS display"
_KNOWN = "(SELECT skill FROM taxonomy WHERE skill NOT LIKE '%bolt')"
_SIG = f"""{MQ._LEVELS}, sig AS (SELECT job_family, experience_level, skill FROM k WHERE c >= 3),
best AS (SELECT job_family, experience_level AS your_level, count(*) AS size, count(*) FILTER (skill IN {_KNOWN}) AS covered FROM sig GROUP BY 1, 2),
b AS (SELECT *, round(covered / size, 3) AS match_fraction FROM best WHERE covered >= 0.7 * size
  ORDER BY match_fraction DESC, size DESC, job_family, CASE your_level WHEN 'fresh' THEN 1 WHEN 'junior' THEN 2 WHEN 'mid' THEN 3 ELSE 4 END LIMIT 1)"""

ORACLE_SQL = {
    "forecasts_pending": f"""{FQ._forecast("DATE '2024-01-22'", "week < DATE '2024-01-22'")}
      SELECT target_type, target_key, {_NAME}, predicted, true AS collection_regime_note FROM f WHERE target_week_start = DATE '2024-01-22' AND target_key <> 'k1'""",
    "backtest_by_target": f"""{FQ._BT}, a AS (SELECT target_type, target_key, count(*) AS n, count(*) FILTER (outcome = 'beat') AS beat FROM bt GROUP BY 1, 2)
      SELECT target_type, target_key, {_NAME}, n, beat, CAST(row_number() OVER (ORDER BY target_type, n DESC, target_key) AS INT) AS place FROM a""",
    "backtest_detail": f"{FQ._BT} SELECT target_week_start, target_type, target_key, {_NAME}, actual FROM bt",
    "curriculum_gaps": f"WITH a AS ({MQ.ORACLE_SQL['curriculum_alignment']}) SELECT skill, company_count, posting_count, CAST(row_number() OVER (ORDER BY company_count DESC, posting_count DESC, skill) AS INT) AS place FROM a WHERE status = 'gap'",
    "ignored_skills": f"{_W} SELECT skill, CASE WHEN category = 'soft' THEN 'soft' ELSE 'non_skill' END AS ignored FROM taxonomy WHERE skill NOT LIKE '%bolt' AND (category = 'soft' OR requirement_type <> 'skill')",
    "coverage_strong_matches": f"""{_W}, need AS (SELECT posting_id, count(*) AS needed, count(*) FILTER (skill NOT LIKE '%bolt') AS covered FROM mentions JOIN taxonomy USING (skill) WHERE requirement_type = 'skill' AND category <> 'soft' GROUP BY 1)
      SELECT id, company, city, detail_url FROM postings WHERE id IN (SELECT posting_id FROM need WHERE covered >= 0.7 * needed) ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 50""",
    "paths_next_level": f"""{_W}, {_SIG},
      n AS (SELECT job_family, experience_level, count(*) AS n, CASE experience_level WHEN 'fresh' THEN 1 WHEN 'junior' THEN 2 WHEN 'mid' THEN 3 ELSE 4 END AS no FROM p GROUP BY 1, 2),
      st AS (SELECT job_family, experience_level AS level_from, n AS n_from, lead(experience_level) OVER w AS level_to, lead(n) OVER w AS n_to FROM n WINDOW w AS (PARTITION BY job_family ORDER BY no)),
      gr AS (SELECT st.job_family, level_from, level_to, h.skill, round(h.k / n_to - coalesce(l.k, 0) / n_from, 4) AS delta
        FROM st JOIN k h ON h.job_family = st.job_family AND h.experience_level = level_to LEFT JOIN k l ON l.job_family = st.job_family AND l.experience_level = level_from AND l.skill = h.skill
        WHERE h.k / n_to - coalesce(l.k, 0) / n_from > 0 AND h.c >= 3)
      SELECT b.job_family, your_level, match_fraction, level_to AS next_level, skill, delta FROM b LEFT JOIN gr ON gr.job_family = b.job_family AND level_from = your_level""",
    "experience_bands": f"""WITH e AS (SELECT CASE o_orderkey % 10 WHEN 9 THEN 'Unspecified' WHEN 0 THEN 'Entry (0-1 yrs)' WHEN 1 THEN 'Entry (0-1 yrs)' WHEN 2 THEN 'Junior (2-3 yrs)' WHEN 3 THEN 'Junior (2-3 yrs)'
        WHEN 4 THEN 'Mid (4-6 yrs)' WHEN 5 THEN 'Mid (4-6 yrs)' WHEN 6 THEN 'Mid (4-6 yrs)' ELSE 'Senior (7+ yrs)' END AS band FROM orders)
      SELECT band, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 4) AS share FROM e GROUP BY 1""",
    "structured_fields": f"""WITH x AS (SELECT o_orderkey AS id, {_case(1)} AS degree_level, {_case(2)} AS degree_field, {_case(3)} AS has_certification, CAST({_case(4)} AS INT) AS l, CAST({_case(5)} AS INT) AS h, {_case(6)} AS named FROM orders),
      y AS (SELECT *, CASE id % 5 WHEN 0 THEN CAST(id % 9 AS INT) WHEN 1 THEN 2 ELSE l END AS low, CASE id % 5 WHEN 0 THEN CAST(id % 9 AS INT) WHEN 1 THEN 4 ELSE h END AS high FROM x)
      SELECT id, degree_level, degree_field, has_certification, low, high, CASE WHEN named IS NOT NULL THEN named WHEN coalesce(low, high) <= 0 THEN 'fresh' WHEN coalesce(low, high) <= 2 THEN 'junior' WHEN coalesce(low, high) <= 5 THEN 'mid' WHEN coalesce(low, high) > 5 THEN 'senior' END AS level FROM y""",
    "display_texts": f"""{_W}, t AS (SELECT *, greatest(0, CAST(floor(epoch_us(TIMESTAMP '2000-01-01') / 3600000000.0 - epoch_us(first_seen_at) / 3600000000.0 + 0.5) AS BIGINT)) AS h FROM postings)
      SELECT id, format('{{:,}}', CAST(floor(salary_min + 0.5) AS BIGINT)) AS number, printf('%.1f%%', 100 * (id % 8) / 8.0) AS percent,
        CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago' WHEN h // 24 < 7 THEN (h // 24) || 'd ago' ELSE (h // 24 // 7) || 'w ago' END AS ago, source || ' + ' || source AS scope FROM t""",
    "course_titles": f"{_W} SELECT skill, array_to_string(list_transform(string_split(skill, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title, upper(skill) AS capitals FROM taxonomy",
    "json_answers": f"""{_W} SELECT skill, '["' || skill || '"]' AS fenced, '[' || skill || ']' AS bare, '["' || skill || '"]' AS last_fence,
      '[["a ] \\" ] ' || skill || '"], [1]]' AS scanned, '["' || skill || ' ]' AS unclosed, skill || ' none' AS plain FROM taxonomy""",
}
