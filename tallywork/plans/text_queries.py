"""Queries on texts, classification and drift over the documents and orders lenses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as T
from ..operators import drift as D
from ..session import written
from ..sources import lenses as L

#: A vocabulary of function words, one key a language.
WORDS = [("en", ["the", "and", "of", "to"]), ("fr", ["le", "la", "les", "et", "de la"]), ("de", ["der", "die", "und", "ein"]), ("es", ["el", "los", "que", "y"]), ("none", [])]
FILLERS = ["the", "of", "and", "a", "to", "de", "la", "le", "der", "die", "und", "el", "los", "que"]


def _docs(s, d):
    return L.document_postings(s, d)


def _found(s, d):
    return _docs(s, d).select("id", "source", "company", "domain", F.explode(T.matched(T.matching_text(F.col("description")), WORDS)).alias("skill"))


def _classified(s, d):
    p = _docs(s, d).drop("domain")
    return K.classify_domains(p, WORDS).select("id", "domain", "domain_method", "domain_confidence")


def _grams(s, d):
    return D.posting_grams(_docs(s, d), FILLERS, most=2)


def _details(s, d, top: int = 50):
    """The report's full detail: its top candidates with splits and excerpts."""
    docs, grams = _docs(s, d), _grams(s, d)
    first = D.candidates(grams, values_of=docs).orderBy(F.desc("companies"), F.desc("postings"), "gram").limit(top)
    out = D.details(grams, docs, written(first))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat_ws(":", k, F.element_at(c, k)["postings"].cast("string"), F.element_at(c, k)["companies"].cast("string"))), ", ")
    return out.select("gram", "postings", "companies", text(F.col("by_source")).alias("by_source"), text(F.col("by_domain")).alias("by_domain"), "excerpts")


def _depth(s, d):
    return D.with_depth(L.postings(s, d), D.substantive_counts(L.mentions(s, d), L.taxonomy(s, d)))


def _lift(s, d):
    docs = _docs(s, d)
    part = docs.where("domain = 'en'")
    c = lambda p: D.candidates(D.posting_grams(p, FILLERS, most=2), values_of=docs)
    return D.lift(c(part), c(docs), part.count(), docs.count())


QUERIES = {
    "extract_skills": lambda s, d: _found(s, d).select("id", "skill"),
    "classify_domains": _classified,
    "domain_distribution": lambda s, d: K.distribution(_classified(s, d), "domain_method"),
    "confidence_bins": lambda s, d: K.confidence_bins(_classified(s, d)),
    "depth_by_source": lambda s, d: D.depth_stats(_depth(s, d), "source"),
    "depth_by_domain": lambda s, d: D.depth_stats(_depth(s, d), "domain"),
    "blind_spots": lambda s, d: D.blind_spots(_depth(s, d)).groupBy("source").agg(F.count("*").alias("n")),
    "drift_candidates": lambda s, d: D.candidates(_grams(s, d), values_of=_docs(s, d)),
    "drift_details": _details,
    "drift_segments": lambda s, d: D.segments(_grams(s, d), "domain"),
    "drift_lift": _lift,
    "source_split": lambda s, d: D.split_text(_found(s, d), "skill", "domain"),
    "totals_by_domain": lambda s, d: D.totals_by(_found(s, d), "domain", "skill"),
    "salary_text": lambda s, d: L.postings(s, d).select("id", T.money_range(F.concat((F.col("id") % 90 + 10).cast("string"), F.lit("K - "), (F.col("id") % 7 + 1).cast("string"), F.lit(".5M"))).alias("m")).select("id", "m.low", "m.high"),
    "merge_groups": lambda s, d: D.merge_groups(L.taxonomy(s, d).select(F.col("skill").alias("phrase")).unionByName(L.taxonomy(s, d).select(F.element_at(F.split("skill", " "), -1).alias("phrase"))), []),
    "html_to_text": lambda s, d: L.read(s, d, "pages").select("page_id", F.length(T.html_to_text(F.col("html"))).alias("n")),
}

_RE = {k: "|".join(sorted(w, key=lambda x: (-len(x), x))).replace(" ", "\\s+") for k, w in WORDS if w}


def _has(text: str, alt: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])(?:{alt})($|[^\\p{{L}}\\p{{N}}_])')"


def _hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST({_has(text, w.replace(' ', chr(92) + 's+'))} AS INT)" for w in words) + ")" if words else "0"


_FOUND = " UNION ALL ".join(f"SELECT doc_id AS id, source, lang AS domain, '{k}' AS skill FROM documents WHERE {_has('lower(text)', alt)}" for k, alt in _RE.items())


def _best(text: str) -> str:
    rows = ", ".join(f"{{'n': -{_hits(text, w)}, 'o': {i}, 'k': '{k}'}}" for i, (k, w) in enumerate(WORDS))
    return f"list_sort([{rows}])"


_CLASS = f"""WITH c AS (SELECT doc_id AS id, {_best('lower(substr(text, 1, 60))')} AS t, {_best('lower(text)')} AS d FROM documents),
r AS (SELECT id, CASE WHEN t[1].n < 0 AND t[1].n < t[2].n THEN t[1].k END AS tk,
  CASE WHEN -d[1].n >= 2 AND d[2].n - d[1].n >= 2 THEN d[1].k END AS dk, round(d[1].n / (d[1].n + d[2].n), 2) AS dc FROM c),
cl AS (SELECT id, coalesce(tk, dk, 'other') AS domain, CASE WHEN tk IS NOT NULL THEN 'rule_title' WHEN dk IS NOT NULL THEN 'rule_description' ELSE 'unclassified' END AS domain_method,
  CASE WHEN tk IS NOT NULL THEN 1.0 WHEN dk IS NOT NULL THEN dc END AS domain_confidence FROM r)"""
_FILL = "(" + ", ".join(f"'{w}'" for w in FILLERS) + ")"
_GRAMS = f"""WITH tk AS (SELECT doc_id AS id, source AS company, lang AS domain, source, regexp_extract_all(lower(text), '([\\p{{L}}]+(?:[''’\\-/][\\p{{L}}]+)*|\\d+\\+?)', 1) AS t FROM documents),
one AS (SELECT id, company, domain, source, unnest(t) AS gram FROM tk),
two AS (SELECT id, company, domain, source, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM tk WHERE len(t) > 1),
g AS (SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
  WHERE split_part(gram, ' ', 1) NOT IN {_FILL} AND split_part(gram, ' ', -1) NOT IN {_FILL} AND NOT regexp_full_match(gram, '\\d+\\+?( \\d+\\+?)?'))"""


def _cand(where: str = "true") -> str:
    return f"SELECT gram, count(*) AS postings, count(DISTINCT company) AS companies, count(DISTINCT source) AS sources, count(DISTINCT domain) AS domains FROM g WHERE {where} GROUP BY gram HAVING count(*) >= 8 AND count(DISTINCT company) >= 3"


def _depth_sql(by: str) -> str:
    return f"""WITH {L.SQL}, k AS (SELECT posting_id, count(*) AS n FROM mentions JOIN taxonomy USING (skill) WHERE requirement_type = 'skill' AND category NOT IN ('soft', 'office_admin') GROUP BY 1),
d AS (SELECT {by} AS value, coalesce(n, 0) AS s FROM postings LEFT JOIN k ON posting_id = id)
SELECT value, count(*) AS n, round(quantile_cont(s, 0.5), 2) AS median, round(avg(s), 2) AS mean, round(100 * count(*) FILTER (s <= 1) / count(*), 1) AS pct_le1, round(100 * count(*) FILTER (s = 0) / count(*), 1) AS pct_0 FROM d GROUP BY 1"""


ORACLE_SQL = {
    "extract_skills": f"SELECT id, skill FROM ({_FOUND})",
    "classify_domains": f"{_CLASS} SELECT * FROM cl",
    "domain_distribution": f"{_CLASS} SELECT domain_method AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM cl), 1) AS pct FROM cl GROUP BY 1",
    "confidence_bins": f"""{_CLASS} SELECT CASE WHEN domain_confidence < 0.7 THEN '[0.6,0.7)' WHEN domain_confidence < 0.8 THEN '[0.7,0.8)' WHEN domain_confidence < 0.9 THEN '[0.8,0.9)' ELSE '[0.9,1]' END AS bin,
      count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM cl WHERE domain_confidence >= 0.6 GROUP BY 1""",
    "depth_by_source": _depth_sql("source"),
    "depth_by_domain": _depth_sql("domain"),
    "blind_spots": f"""WITH {L.SQL}, k AS (SELECT posting_id, count(*) AS n FROM mentions JOIN taxonomy USING (skill) WHERE requirement_type = 'skill' AND category NOT IN ('soft', 'office_admin') GROUP BY 1)
      SELECT source, count(*) AS n FROM postings LEFT JOIN k ON posting_id = id WHERE coalesce(n, 0) <= 1 GROUP BY 1""",
    "drift_candidates": f"{_GRAMS} {_cand()}",
    "drift_details": f"""{_GRAMS}, top AS ({_cand()} ORDER BY companies DESC, postings DESC, gram LIMIT 50), mine AS (SELECT g.* FROM g JOIN top USING (gram)),
      s AS (SELECT gram, string_agg(source || ':' || p || ':' || c, ', ' ORDER BY source) AS by_source FROM (SELECT gram, source, count(*) AS p, count(DISTINCT company) AS c FROM mine GROUP BY 1, 2) GROUP BY 1),
      m AS (SELECT gram, string_agg(domain || ':' || p || ':' || c, ', ' ORDER BY domain) AS by_domain FROM (SELECT gram, domain, count(*) AS p, count(DISTINCT company) AS c FROM mine GROUP BY 1, 2) GROUP BY 1),
      low AS (SELECT doc_id AS id, text, regexp_replace(lower(text), '\\s+', ' ', 'g') AS one, regexp_replace(text, '\\s+', ' ', 'g') = regexp_replace(text, '\\s', ' ', 'g') AS single FROM documents),
      q AS (SELECT gram, id, text, CASE WHEN single THEN string_split(one, gram) ELSE error('a text with white space side by side') END AS p FROM mine JOIN low USING (id)),
      h AS (SELECT gram, id, text, p, list_filter(range(1, len(p)), lambda i: (p[i] = '' AND i = 1 OR NOT regexp_matches(p[i], '(^|[\\p{{L}}\\p{{N}}_])$')) AND NOT regexp_matches(p[i + 1], '^[\\p{{L}}\\p{{N}}_]') AND (p[i + 1] <> '' OR i + 1 = len(p)))[1] AS i FROM q),
      b AS (SELECT gram, id, text, CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * length(gram) AS BIGINT) AS a FROM h WHERE i IS NOT NULL),
      e AS (SELECT gram, id, CASE WHEN a > 40 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(a - 40, 0) + 1, a + length(gram) + 40 - greatest(a - 40, 0)), '\\s+', ' ', 'g')) || CASE WHEN length(text) - a - length(gram) > 40 THEN '…' ELSE '' END AS t FROM b),
      f AS (SELECT gram, t, min(id) AS id FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY id, t) AS n FROM f),
      ex AS (SELECT gram, list(t ORDER BY n) AS excerpts FROM r WHERE n <= 3 GROUP BY 1)
      SELECT gram, postings, companies, by_source, by_domain, excerpts FROM top JOIN s USING (gram) JOIN m USING (gram) LEFT JOIN ex USING (gram)""",
    "drift_segments": f"""{_GRAMS}, n AS (SELECT domain AS value, gram, count(DISTINCT company) AS companies, count(*) AS postings FROM g GROUP BY 1, 2 HAVING count(DISTINCT company) >= 3),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY value ORDER BY companies DESC, postings DESC, gram) AS INT) AS place FROM n) SELECT * FROM r WHERE place <= 30""",
    "drift_lift": f"""{_GRAMS}, w AS ({_cand()}), p AS ({_cand("domain = 'en'")})
      SELECT gram, p.postings AS part_postings, w.postings AS whole_postings, round((p.postings / (SELECT count(*) FROM documents WHERE lang = 'en')) / (w.postings / (SELECT count(*) FROM documents)), 3) AS lift FROM p JOIN w USING (gram)""",
    "source_split": f"SELECT skill, string_agg(domain || ':' || n, ', ' ORDER BY n DESC, domain) AS split FROM (SELECT skill, domain, count(*) AS n FROM ({_FOUND}) GROUP BY 1, 2) GROUP BY 1",
    "totals_by_domain": f"SELECT CASE WHEN grouping(domain) = 1 THEN 'TOTAL' ELSE domain END AS \"group\", skill AS value, count(*) AS n FROM ({_FOUND}) GROUP BY GROUPING SETS ((domain, skill), (skill))",
    "salary_text": "SELECT o_orderkey AS id, (o_orderkey % 90 + 10) * 1000 AS low, CAST((o_orderkey % 7 + 1.5) * 1000000 AS BIGINT) AS high FROM orders",
    "html_to_text": r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?i)<br\s*/?>', chr(10), 'g') AS t FROM pages),
      b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)</(?:li|p|div|ul|ol|h[1-6])>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
      c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
      d AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x NOT IN ('', '-')) AS l FROM c)
      SELECT page_id, CAST(length(array_to_string(l, chr(10))) AS INT) AS n FROM d""",
    "merge_groups": "SELECT DISTINCT p_name AS phrase, split_part(p_name, ' ', 2) AS canonical FROM part UNION SELECT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part",
}
