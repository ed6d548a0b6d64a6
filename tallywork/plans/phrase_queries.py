"""Queries on proposed phrases, merged passes, categories and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as U
from ..operators import market as M
from ..operators import phrases as P
from ..session import written
from ..sources import lenses as L

#: What is said of every posting, next to its own fifth and sixth words; the spellings differ from the texts'.
SAID = ["Of  the", "de LA", "und der", "that the", "never there", "la le"]
HEURISTICS = [(0, "substring", "f th", "soft"), (1, "phrase", "de la", "office_admin"), (2, "regex", r"^la\b", "soft"), (3, "substring", "de l", "soft")]
SYNONYMS = {"soft_skills": "soft", "cat_1": "one"}
BUCKETS = [("round", ["ring", "widget"]), ("metal", ["steel", "st"]), ("small", ["small", "rod"]), ("all", ["a"])]
OVERRIDES = [(0, "phrase", "red", "forced red"), (1, "substring", "ring", "forced ring"), (2, "regex", r"b.*d\b", "forced b")]


def _proposals(s, d):
    docs = L.document_postings(s, d)
    words = F.split("description", " ")
    own = F.concat_ws(" ", F.get(words, F.lit(4)), F.get(words, F.lit(5)))
    said = F.array(*map(F.lit, SAID), F.when(F.get(words, F.lit(5)).isNotNull(), own))
    return docs.select("id", F.explode(said).alias("phrase"))


def _pairs(s, d):
    return P.confirmed(_proposals(s, d), L.document_postings(s, d))


def _groups(s, d):
    pairs = written(_pairs(s, d))
    groups = pairs.select("key", F.concat(F.lit("g"), (F.length("key") % 5).cast("string")).alias("group")).distinct()
    return P.aggregate_groups(pairs, groups)


def _merged(s, d):
    docs = L.document_postings(s, d)
    tagged = docs.where("id % 3 = 0").join(_proposals(s, d).groupBy("id").agg(F.collect_list("phrase").alias("tags")), "id")
    tags = P.tag_pairs(tagged, [("und", ["und"])])
    texts = written(_pairs(s, d).where("id % 3 <> 0"))
    good = P.surviving(texts, 2, 3).select("key")
    return P.merged(tags, texts.join(good, "key", "left_semi"), 3)


def _asked(s, d):
    """(candidates, answers): answers come from outside in two batches; here they follow from the candidates themselves."""
    c = written(_merged(s, d).select("key", "phrase"))
    n = F.length("phrase")
    one = c.where(n % 3 != 0).select("phrase", F.concat(F.lit("Cat-"), (n % 4).cast("string")).alias("proposed_category"), F.when(n % 2 == 0, "language").alias("proposed_requirement_type"), F.lit(1).alias("batch"))
    two = c.where(n % 5 == 0).select("phrase", F.lit("Soft Skills").alias("proposed_category"), F.lit("skill").alias("proposed_requirement_type"), F.lit(2).alias("batch"))
    return c, one.unionByName(two).unionByName(c.select(F.concat("phrase", F.lit("?")), F.lit("x"), F.lit("y"), F.lit(1)).toDF("phrase", "proposed_category", "proposed_requirement_type", "batch"))


def _categories(s, d):
    c, a = _asked(s, d)
    return P.categorised(c, HEURISTICS, a, SYNONYMS)


def _ledger(s, d):
    c, a = _asked(s, d)
    return P.answered(a, c)[1].groupBy("state").agg(F.count("*").alias("n"))


def _reviewed(s, d):
    """Parts' names as answered phrases: the answers' categories, types and confidences come from their sizes and keys."""
    k = F.col("p_partkey")
    cat = F.when(k % 5 == 0, None).when(k % 5 == 1, " GEAR").when(k % 5 == 2, "gear").otherwise("Fresh")
    a = L.read(s, d, "part").select(F.concat("p_name", F.lit(" "), (k % 300).cast("string")).alias("phrase"), cat.alias("proposed_category"), F.when(k % 3 == 0, "SKILL ").when(k % 3 == 1, "attribute").alias("proposed_requirement_type"), F.when(k % 4 == 0, "high").otherwise(((k % 10) / 10).cast("string")).alias("confidence"), F.when(k % 11 == 0, True).when(k % 11 == 1, False).alias("is_new_category"), k.alias("batch"))
    return P.reviewed(a, [(0, "phrase", "ring", "attribute")], ["Gear", "bolt"])


QUERIES = {
    "proposals_reviewed": _reviewed,
    "mentions_typed": lambda s, d: M.typed(L.mentions(s, d), L.taxonomy(s, d).where("ord % 3 <> 0")),
    "phrases_surviving": lambda s, d: P.surviving(_pairs(s, d), 2, 3),
    "phrase_counts": lambda s, d: P.proposal_counts(_pairs(s, d)),
    "phrase_groups": _groups,
    "merged_candidates": _merged,
    "phrase_categories": _categories,
    "answer_ledger": _ledger,
    "rule_buckets": lambda s, d: L.taxonomy(s, d).select("skill", U.first_rule(F.col("skill"), U.literal_rules(BUCKETS), "other").alias("bucket"), U.with_overrides(F.upper("skill"), U.literal_rules(BUCKETS), OVERRIDES, "other").alias("forced")),
}

_SAID = ", ".join(f"'{x}'" for x in SAID)
_PAIRS = f"""WITH low AS (SELECT doc_id AS id, source AS company, lang AS domain, text, regexp_replace(lower(text), '\\s+', ' ', 'g') AS one, string_split(text, ' ') AS w FROM documents),
said AS (SELECT id, unnest([{_SAID}, CASE WHEN len(w) > 5 THEN w[5] || ' ' || w[6] END]) AS phrase FROM low),
k AS (SELECT id, regexp_replace(lower(trim(phrase)), '\\s+', ' ', 'g') AS key, min(trim(phrase)) AS phrase FROM said WHERE trim(coalesce(phrase, '')) <> '' GROUP BY 1, 2),
pairs AS (SELECT id, key, phrase, company, domain, strpos(one, key) AS pos, text FROM k JOIN low USING (id)),
ok AS (SELECT *, CASE WHEN pos > 61 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(pos - 60, 1), pos + length(key) + 60 - greatest(pos - 60, 1)), '\\s+', ' ', 'g')) || CASE WHEN length(text) >= pos + length(key) + 60 THEN '…' ELSE '' END AS excerpt FROM pairs WHERE pos > 0)"""


def _surviving(rows: str) -> str:
    return f"""n AS (SELECT key, min({{'id': id, 'phrase': phrase}}).phrase AS phrase, count(*) AS postings, count(DISTINCT company) AS companies FROM {rows} GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT company) >= 3)"""


_MERGED = f"""{_PAIRS}, t AS (SELECT id, key, phrase, company, 'tag' AS pass, '(tag) ' || phrase AS example FROM (SELECT id, company, trim(phrase) AS phrase, regexp_replace(lower(trim(phrase)), '\\s+', ' ', 'g') AS key FROM said JOIN low USING (id))
    WHERE id % 3 = 0 AND trim(coalesce(phrase, '')) <> '' AND NOT regexp_matches(lower(phrase), '(^|[^\\p{{L}}\\p{{N}}_])und($|[^\\p{{L}}\\p{{N}}_])')),
  tx AS (SELECT * FROM ok WHERE id % 3 <> 0), {_surviving("tx")},
  u AS (SELECT * FROM t UNION ALL SELECT id, key, phrase, company, 'text', '(verbatim) ' || excerpt FROM tx WHERE key IN (SELECT key FROM n)),
  m AS (SELECT key, min({{'p': pass, 'i': id, 's': phrase}}).s AS phrase, CASE WHEN count(DISTINCT pass) = 2 THEN 'both' ELSE min(pass) END AS passes, count(DISTINCT id) AS postings, count(DISTINCT company) AS companies, max({{'p': pass, 'i': -id, 'e': example}}).e AS example
        FROM u GROUP BY key HAVING count(DISTINCT company) >= 3)"""
_ASKED = f"""{_MERGED}, c AS (SELECT key, phrase, length(phrase) AS n FROM m),
  a AS (SELECT phrase, 'Cat-' || (n % 4) AS cat, CASE WHEN n % 2 = 0 THEN 'language' END AS typ, 1 AS batch FROM c WHERE n % 3 <> 0 UNION ALL SELECT phrase, 'Soft Skills', 'skill', 2 FROM c WHERE n % 5 = 0 UNION ALL SELECT phrase || '?', 'x', 'y', 1 FROM c)"""

ORACLE_SQL = {
    "proposals_reviewed": """WITH a AS (SELECT *, p_name || ' ' || (p_partkey % 300) AS phrase, p_partkey AS k FROM part QUALIFY row_number() OVER (PARTITION BY p_name || ' ' || (p_partkey % 300) ORDER BY p_partkey DESC) = 1),
      b AS (SELECT phrase, k, CASE k % 5 WHEN 0 THEN '(uncategorized)' WHEN 1 THEN ' GEAR' WHEN 2 THEN 'gear' ELSE 'Fresh' END AS cat, CASE k % 11 WHEN 0 THEN true WHEN 1 THEN false ELSE k % 5 NOT IN (1, 2) END AS is_new,
        CASE WHEN regexp_matches(phrase, '\\bring\\b') THEN 'attribute' ELSE 'skill' END AS heuristic, CASE k % 3 WHEN 0 THEN 'SKILL ' WHEN 1 THEN 'attribute' END AS t, CASE WHEN k % 4 <> 0 THEN (k % 10) / 10 END AS confidence FROM a)
      SELECT phrase, CASE WHEN NOT is_new AND k % 5 IN (1, 2) THEN 'Gear' ELSE cat END AS category, is_new, heuristic, coalesce(t, heuristic) AS proposed_type, confidence, coalesce(confidence < 0.6, false) OR lower(trim(coalesce(t, heuristic))) <> heuristic AS flagged FROM b""",
    "mentions_typed": f"WITH {L.SQL} SELECT posting_id, skill, CASE WHEN ord % 3 <> 0 THEN category END AS category, CASE WHEN ord % 3 <> 0 THEN requirement_type ELSE 'skill' END AS requirement_type FROM mentions JOIN taxonomy USING (skill)",
    "phrases_surviving": f"""{_PAIRS}, {_surviving("ok")}, f AS (SELECT key, excerpt, min(id) AS id FROM ok GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id, excerpt) AS p FROM f)
      SELECT key, phrase, postings, companies, (SELECT list(excerpt ORDER BY p) FROM r WHERE r.key = n.key AND p <= 3) AS excerpts FROM n""",
    "phrase_counts": f"{_PAIRS}, s AS (SELECT key, max(pos) > 0 AS seen FROM pairs GROUP BY 1) SELECT count(*) AS proposed, count(*) FILTER (seen) AS confirmed, count(*) FILTER (NOT seen) AS dropped FROM s",
    "phrase_groups": f"""{_PAIRS}, g AS (SELECT *, 'g' || (length(key) % 5) AS grp FROM ok), d AS (SELECT grp, domain, count(DISTINCT id) AS n FROM g GROUP BY 1, 2)
      SELECT grp AS "group", count(DISTINCT key) AS phrases, count(DISTINCT id) AS postings, count(DISTINCT company) AS companies, (SELECT string_agg(domain || ':' || n, ', ' ORDER BY n DESC, domain) FROM d WHERE d.grp = g.grp) AS domains FROM g GROUP BY grp""",
    "merged_candidates": f"{_MERGED} SELECT * FROM m",
    "phrase_categories": f"""{_ASKED}, h AS (SELECT *, CASE WHEN key LIKE '%f th%' THEN 'soft' WHEN regexp_matches(key, '(^|[^\\p{{L}}\\p{{N}}_])de la($|[^\\p{{L}}\\p{{N}}_])') THEN 'office_admin' WHEN regexp_matches(key, '^la($|[^\\p{{L}}\\p{{N}}_])') THEN 'soft' WHEN key LIKE '%de l%' THEN 'soft' END AS rule FROM c),
      la AS (SELECT phrase, max({{'b': batch, 'c': cat, 't': coalesce(typ, 'skill')}}) AS x FROM a GROUP BY 1),
      j AS (SELECT key, h.phrase, rule, CASE WHEN rule IS NULL THEN x END AS x FROM h LEFT JOIN la USING (phrase)),
      o AS (SELECT key, phrase, CASE WHEN rule IS NOT NULL THEN 'skill' ELSE x.t END AS requirement_type, coalesce(rule, CASE x.c WHEN 'Soft Skills' THEN 'soft' WHEN 'Cat-1' THEN 'one' ELSE x.c END) AS category, CASE WHEN rule IS NOT NULL THEN 'heuristic' WHEN x IS NOT NULL THEN 'llm' ELSE 'uncategorized' END AS source FROM j)
      SELECT key, phrase, requirement_type, category, category NOT IN ('soft', 'office_admin') AS substantive, source FROM o""",
    "answer_ledger": f"""{_ASKED}, o AS (SELECT phrase, count(*) AS k FROM a GROUP BY 1), w AS (SELECT DISTINCT phrase, true AS w FROM c)
      SELECT CASE WHEN w IS NULL THEN 'unknown' WHEN k IS NULL THEN 'unanswered' WHEN k > 1 THEN 'repeated' ELSE 'answered' END AS state, count(*) AS n FROM w FULL JOIN o USING (phrase) GROUP BY 1""",
    "rule_buckets": f"""WITH {L.SQL}, b AS (SELECT skill, CASE WHEN contains(skill, 'ring') OR contains(skill, 'widget') THEN 'round' WHEN contains(skill, 'steel') OR contains(skill, 'st') THEN 'metal'
        WHEN contains(skill, 'small') OR contains(skill, 'rod') THEN 'small' WHEN contains(skill, 'a') THEN 'all' ELSE 'other' END AS bucket FROM taxonomy)
      SELECT skill, bucket, CASE WHEN regexp_matches(skill, '\\bred\\b') THEN 'forced red' WHEN contains(skill, 'ring') THEN 'forced ring' WHEN regexp_matches(skill, 'b.*d\\b') THEN 'forced b' ELSE bucket END AS forced FROM b""",
}
