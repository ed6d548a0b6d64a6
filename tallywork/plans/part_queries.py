"""Queries of the smaller parts: scans, merges, filters, texts, reviews, each over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import cols as C
from ..functions import text as T
from ..operators import drift as D
from ..operators import insights as I
from ..session import shared_folder
from ..sources import lenses as L
from ..sources import parse as P
from ..sources import sinks as S
from ..sources import tables as B
from ..streaming import stream as ST


def _k():
    return F.col("o_orderkey")


def _orders(s, d):
    return L.read(s, d, "orders")


# --- texts -----------------------------------------------------------------------------------------------------------


def _places(s, d):
    """Customers' places: a region without marks or with, a nation's number, an abroad one or none."""
    k = F.col("c_custkey")
    place = F.when(k % 6 == 0, None).when(k % 6 == 1, F.concat(F.lit("Lāhore, "), F.lit("Punjab, PAKISTAN"))).when(k % 6 == 2, " karachi ").when(k % 6 == 3, F.concat(F.lit("Oslo "), k.cast("string"), F.lit(", Norway"))).when(k % 6 == 4, ", PK").otherwise("Karāchi, Sindh")
    return L.read(s, d, "customer").select(k.alias("id"), place.alias("location"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).alias("posting_date"))


def _geo(s, d):
    return P.geo_filtered(_places(s, d), ["pakistan", "pk"], ["karachi", "lahore"], "2024-01-31").select("id", "is_stale", T.strip_marks(F.col("location")).alias("bare"), T.first_place(F.col("location")).alias("city"))


def _words(s, d):
    t = F.col("text")
    return L.read(s, d, "documents").select("doc_id", F.size(T.words(t)).alias("n"), F.get(T.words(t), F.lit(0)).alias("first"))


def _urls(s, d):
    q = T.query_string(F.col("url"))
    return L.read(s, d, "pages").select("page_id", F.try_element_at(q, F.lit("page")).alias("page"), F.try_element_at(q, F.lit("utm_source")).alias("source"), T.normal_url(F.concat(F.lit(" "), F.regexp_replace("url", "^https?:", ""))).alias("whole"))


def _titles(s, d):
    """Parts as titles with leading seniority, once or more."""
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 4 == 0, "Senior ").when(k % 4 == 1, "sr.  lead - ").when(k % 4 == 2, "Junior: Senior ").otherwise(""), F.initcap("p_name"))
    t = F.concat(F.initcap("p_name"), F.lit(" is "), F.col("p_retailprice").cast("string"), F.lit(" of 1,200.50. Then "), F.col("p_brand"), F.lit(" for Acme."))
    return L.read(s, d, "part").select(
        k.alias("id"), T.strip_prefixes(raw, ["senior", "sr", "lead", "junior"]).alias("title"), T.canonical(F.concat(F.lit(" "), F.upper("p_name")), {"red ring": "ruby ring"}).alias("canonical"), F.array_join(T.numerals(t), "|").alias("numerals"), F.array_join(T.names_in(t, ["Ring"]), "|").alias("names"),
        F.array_join(F.array_sort(T.word_set(F.concat("p_name", F.lit(" (of it) the "), F.col("p_name")), ["the"])), "|").alias("word_set"),
    )


def _dates(s, d):
    o = F.col("o_orderdate")
    form = F.when(_k() % 5 == 0, F.date_format(o, "yyyy-MM-dd")).when(_k() % 5 == 1, F.date_format(o, "MMM d, yyyy")).when(_k() % 5 == 2, F.date_format(o, "MMMM d, yyyy")).when(_k() % 5 == 3, F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return _orders(s, d).select(_k().alias("id"), T.posting_date(F.concat(F.lit(" "), form)).alias("day"))


def _snippets(s, d):
    return L.read(s, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("THE"), 10).alias("snippet"))


# --- tags and their emptiness ----------------------------------------------------------------------------------------

#: Raw tags by the remainder of the id: the JSON or text, whether it is empty, and its text.
TAGS = [(None, True, ""), ("", True, ""), ("[]", True, ""), ('["sql", "python"]', False, "sql python"), ('{"required_skills_text": "excel"}', False, "excel"), ('{"required_skills_text": " "}', True, " "), ('{"other": 1}', True, ""), ("plain, text", False, "plain, text"), (" ", True, " ")]


def _tagged(s, d):
    raw = F.element_at(F.array(*[F.lit(t[0]).cast("string") for t in TAGS]), (_k() % len(TAGS) + 1).cast("int"))
    return _orders(s, d).select(_k().alias("id"), F.col("o_orderpriority").alias("source"), raw.alias("skills_raw"), F.when(_k() % 2 == 0, F.lit("  ")).when(_k() % 5 == 0, None).otherwise(F.concat(F.lit("text "), F.repeat(F.lit("w "), (_k() % 200).cast("int")))).alias("description"), F.when(_k() % 3 == 0, None).otherwise("PKR").alias("currency"))


# --- merges ----------------------------------------------------------------------------------------------------------


def _halves(s, d):
    """(old, new): the table before, and updates for a third of its rows and some of none."""
    old = _orders(s, d).select(_k().alias("id"), F.when(_k() % 2 == 0, F.col("o_orderpriority")).alias("description"), F.lit("[]").alias("skills_raw"), F.when(_k() % 4 == 0, "PKR").alias("currency"))
    new = _orders(s, d).where(_k() % 3 == 0).select(F.when(_k() % 9 == 0, -_k() - 1).otherwise(_k()).alias("id"), F.when(_k() % 2 == 1, "new").alias("description"), F.when(_k() % 5 == 0, '["x"]').alias("skills_raw"), F.lit(None).cast("string").alias("currency"))
    return old, new


def _upserted(s, d):
    """Orders before a day as the table, those after as a batch with repeats, by customer."""
    o = _orders(s, d)
    row = ["id", "source", "detail_url", "first_seen_at", "last_seen_at", "scraped_at", "scrape_run_id", "category"]
    at = F.col("o_orderdate")
    r = o.select(_k().alias("id"), F.col("o_orderstatus").alias("source"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("detail_url"), at.alias("first_seen_at"), at.alias("last_seen_at"), at.alias("scraped_at"), F.concat(F.lit("r"), _k().cast("string")).alias("scrape_run_id"), F.when(_k() % 4 == 0, "all").when(_k() % 4 == 1, F.col("o_orderpriority")).alias("category"), _k().alias("ingest_seq"))
    old = P.last_wins(r.where("first_seen_at < '1998-01-01'"), ["source", "detail_url"]).select(*row)
    return S.upsert_postings(old, r.where("first_seen_at >= '1998-01-01'"))


def _absent(s, d):
    m = L.read(s, d, "lineitem").select(F.col("l_orderkey").alias("posting_id"), F.when(F.col("l_partkey") % 17 == 0, None).otherwise(F.concat(F.lit("s"), F.col("l_partkey").cast("string"))).alias("skill"), F.lit("m").alias("extraction_method"))
    return S.insert_absent(m.where("posting_id % 2 = 0"), m, S.MENTION_KEY)


def _grades(s, d):
    """Forecasts of which some are graded, and grades for all of them."""
    key = [F.lit("v").alias("model_version"), F.lit("skill").alias("target_type"), _k().cast("string").alias("target_key"), F.to_date("o_orderdate").alias("target_week_start")]
    f = _orders(s, d).select(*key, *[F.when(_k() % 3 == 0, F.lit(1.0)).alias(c) for c in ("actual", "abs_error", "baseline_abs_error")], F.when(_k() % 3 == 0, F.col("o_orderdate")).alias("graded_at"), F.when(_k() % 3 == 0, True).alias("beat_baseline"))
    g = _orders(s, d).where(_k() % 2 == 0).select(*key, *[F.col("o_totalprice").alias(c) for c in ("actual", "abs_error", "baseline_abs_error")], F.lit("2024-01-01").cast("timestamp").alias("graded_at"), F.lit(False).alias("beat_baseline"))
    return S.grade_once(f, g)


def _log(s, d):
    """Answers of a batch log, written as JSON lines to the shared folder and read again: the last of each posting."""
    path = f"{shared_folder(s)}/log-{uuid.uuid4().hex}"
    b = _orders(s, d).select((_k() % 7).cast("int").alias("batch"), F.struct((_k() % 500).alias("id"), F.array(F.col("o_orderpriority")).alias("phrases")).alias("r"))
    P.last_wins(b.select("batch", "r.id", "r.phrases"), ["id", "batch"], "phrases").groupBy("batch").agg(F.collect_list(F.struct("id", "phrases")).alias("responses")).write.json(path)
    return P.extraction_log(s, path).select("id", "batch", F.array_join("phrases", "|").alias("phrases"))


def _search_pages(s, d):
    """Orders as a search's answers, by customer; some pages have no state, one that can't be read, or another one only."""
    quoted = lambda name, v: F.concat(F.lit(f'"{name}": "'), v, F.lit('"'))
    fields = [quoted("title", F.col("o_orderpriority")), quoted("company", F.when(_k() % 3 == 0, "").otherwise("C")), F.concat(F.lit('"salaryMin": '), (_k() % 1000).cast("string"))]
    job = F.concat(F.lit("{"), F.when(_k() % 7 != 0, F.concat(F.lit('"id": '), _k().cast("string"), F.lit(", "))).otherwise(""), F.concat_ws(", ", *fields), F.lit("}"))
    own = _orders(s, d).select("o_custkey", _k().alias("k"), job.alias("job")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "job"))), lambda x: x["job"]), ", ").alias("jobs"))
    c = F.col("o_custkey")
    key = F.concat(F.lit("httpCacheKey/ws/jobs/"), F.when(c % 5 == 1, "other").otherwise("search"), F.lit("/?city=New%20Town&page="), c.cast("string"))
    state = F.concat(F.lit('{"a": [1], "'), key, F.lit('": {"body": {"list": ['), "jobs", F.lit("]}}"), F.when(c % 5 == 2, "").otherwise("}"))
    html = F.when(c % 5 == 3, "<p>none</p>").otherwise(F.concat(F.lit('<html><script type="x" id="mustakbil-state">'), state, F.lit("</script></html>")))
    return own.select(F.concat(F.lit("https://x.example/"), c.cast("string")).alias("url"), html.alias("html"))


def _search(s, d):
    r = P.search_rows(_search_pages(s, d))
    return r.select(F.col("source_job_id").cast("long").alias("id"), "title", "company", "salary_min", F.element_at("params", "city").alias("city"), F.element_at("params", "page").alias("page"), F.col("ingest_seq.n").alias("n"))


# --- reviews and filters ---------------------------------------------------------------------------------------------


def _classes(s, d):
    """Documents' ids with confidences as text, and two opinions."""
    k = F.col("doc_id")
    return L.read(s, d, "documents").select(k.alias("id"), F.when(k % 5 == 0, "high").when(k % 5 == 1, None).otherwise(((k % 10) / 10).cast("string")).alias("sure"), F.when(k % 3 == 0, "a").alias("heuristic"), F.when(k % 4 == 0, "a").otherwise("b").alias("proposed"), F.when(k % 2 == 0, "llm").otherwise("rule_title").alias("domain_method"), F.when(k % 7 == 0, None).when(k % 7 == 1, " ").otherwise("text").alias("description"), F.when(k % 11 == 0, None).otherwise((k % 10) / 10).alias("domain_confidence"))


def _drafts(s, d):
    n = (_k() % 7 + 100).cast("string")
    body = F.concat(F.lit("There were "), n, F.lit(" postings. "), F.repeat(F.lit("word "), F.when(_k() % 5 == 0, 3).otherwise(110)), F.when(_k() % 4 == 0, "It was a synergy.").otherwise(""), F.when(_k() % 9 == 0, "We met Mordor today.").otherwise(""))
    rows = _orders(s, d).select(_k().alias("id"), body.alias("body"), F.concat(F.lit("postings: "), F.when(_k() % 6 == 0, "7").otherwise(n)).alias("facts"))
    return I.verify_draft(rows, ["synergy"], ["There", "It", "We"]).select("id", "blocked")


def _scans(s, d):
    p = _tagged(s, d).withColumn("domain", F.when(F.col("id") % 4 == 0, "x")).withColumn("scrape_run_id", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")))
    n = lambda name, df: df.agg(F.lit(name).alias("scan"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    first = p.columns[0]
    out = n("to_extract", B.to_extract(p, "r1"))
    for name, df in (("unclassified", B.unclassified(p)), ("needing_enrichment", B.needing_enrichment(p, "5-LOW", 120)), ("source_scan", B.scan(s, f"{d}/orders.parquet", ["o_orderkey"], F.col("o_custkey") < 500).withColumnRenamed("o_orderkey", first))):
        out = out.unionByName(n(name, df))
    return out


def _routes(s, d):
    a, b = ST.routed(L.event_postings(s, d).withColumn("source", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("source"))), ["view", "click"])
    return a.groupBy("source").agg(F.count("*").alias("n")).withColumn("target", F.lit(True)).unionByName(b.groupBy("source").agg(F.count("*").alias("n")).withColumn("target", F.lit(False)))


QUERIES = {
    "geo_filtered": _geo,
    "plain_words": _words,
    "url_queries": _urls,
    "title_texts": _titles,
    "posting_dates": _dates,
    "snippets": _snippets,
    "text_availability": lambda s, d: D.text_availability(_tagged(s, d)),
    "tag_texts": lambda s, d: _tagged(s, d).select("id", C.skills_raw_empty(F.col("skills_raw")).alias("empty"), C.skills_raw_text(F.col("skills_raw")).alias("text"), C.blank(F.col("description")).alias("blank"), C.text_bucket(F.col("description"), F.col("skills_raw")).alias("bucket")),
    "refill_cost": lambda s, d: D.refill_cost(_tagged(s, d)),
    "enriched": lambda s, d: S.enrich(*_halves(s, d)),
    "columns_set": lambda s, d: S.set_columns(*_halves(s, d), ["description", "currency"]),
    "upserted": _upserted,
    "inserted_absent": _absent,
    "graded_once": _grades,
    "extraction_log": _log,
    "search_rows": _search,
    "stratified_sample": lambda s, d: D.stratified_sample(L.document_postings(s, d).select("id", "domain"), "domain", 50, 7).select("id", "domain", "turn"),
    "unmatched_titles": lambda s, d: D.unmatched_titles(L.read(s, d, "part").select(F.concat(F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise("")).alias("title"), F.when(F.col("p_size") > 25, "f").alias("job_family"))),
    "needs_review": lambda s, d: _classes(s, d).select("id", K.needs_review(F.col("sure"), F.col("heuristic"), F.col("proposed")).alias("review")),
    "title_only_relabel": lambda s, d: K.title_only_relabel(_classes(s, d)).select("id", "domain_method", "domain_confidence"),
    "verified_drafts": _drafts,
    "scans": _scans,
    "routed": _routes,
}

_PLACE = "CASE c_custkey % 6 WHEN 1 THEN 'Lāhore, Punjab, PAKISTAN' WHEN 2 THEN ' karachi ' WHEN 3 THEN 'Oslo ' || c_custkey || ', Norway' WHEN 4 THEN ', PK' WHEN 5 THEN 'Karāchi, Sindh' END"


def _case(of: int) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v + "'"
    return f"CASE o_orderkey % {len(TAGS)} " + " ".join(f"WHEN {k} THEN {show(t[of])}" for k, t in enumerate(TAGS)) + " END"


_TAGGED = f"""WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS source, {_case(1)} AS empty, {_case(2)} AS text, {_case(0)} AS raw, CASE WHEN o_orderkey % 3 <> 0 THEN 'PKR' END AS currency,
  o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 AS blank, o_orderkey % 200 + 1 AS words, o_custkey FROM orders), b AS (SELECT *, CASE WHEN NOT blank THEN 'A' WHEN NOT empty THEN 'B' ELSE 'C' END AS bucket FROM t)"""
_HALVES = """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS description, '[]' AS skills_raw, CASE WHEN o_orderkey % 4 = 0 THEN 'PKR' END AS currency FROM orders),
  n AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 2 = 1 THEN 'new' END AS d, CASE WHEN o_orderkey % 5 = 0 THEN '["x"]' END AS s, true AS hit FROM orders WHERE o_orderkey % 3 = 0)"""
_CLASSES = """WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 IN (0, 1) THEN NULL ELSE (doc_id % 10) / 10 END AS sure, CASE WHEN doc_id % 3 = 0 THEN 'a' END AS heuristic, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS proposed,
  CASE WHEN doc_id % 2 = 0 THEN 'llm' ELSE 'rule_title' END AS m, doc_id % 7 IN (0, 1) AS bare, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 10) / 10 END AS c FROM documents)"""

ORACLE_SQL = {
    "geo_filtered": f"""WITH p AS (SELECT c_custkey AS id, {_PLACE} AS l, DATE '2024-01-01' + CAST(c_custkey % 40 AS INT) AS d FROM customer)
      SELECT id, DATE '2024-01-31' - d > 14 AS is_stale, strip_accents(lower(l)) AS bare, nullif(trim(split_part(l, ',', 1)), '') AS city FROM p WHERE id % 6 IN (1, 2, 4, 5)""",
    "plain_words": "SELECT doc_id, CAST(len(w) AS INT) AS n, w[1] AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z.''-]*') AS w FROM documents)",
    "url_queries": "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS source, regexp_replace(url, '^http:', 'https:') AS whole FROM pages",
    "title_texts": """WITH t AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM part)
      SELECT p_partkey AS id, n AS title, CASE WHEN p_name = 'red ring' THEN 'ruby ring' ELSE p_name END AS canonical, regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') || '|1200.5|' || regexp_extract(p_brand, '\\d+') AS numerals,
        CASE WHEN split_part(n, ' ', 2) = 'Ring' THEN '' ELSE split_part(n, ' ', 2) || '|' END || 'Brand|Acme' AS names, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS word_set FROM t""",
    "posting_dates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "snippets": """WITH p AS (SELECT doc_id, text, strpos(lower(text), 'the') AS a FROM documents)
      SELECT doc_id, CASE WHEN a > 0 THEN CASE WHEN a > 11 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(a - 10, 1), a + 13 - greatest(a - 10, 1)), '\\s+', ' ', 'g')) || CASE WHEN a + 13 <= length(text) THEN '…' ELSE '' END END AS snippet FROM p""",
    "text_availability": f"{_TAGGED} SELECT source AS value, count(*) AS n, count(*) FILTER (bucket = 'A') AS a, count(*) FILTER (bucket = 'B') AS b, count(*) FILTER (bucket = 'C') AS c, round(100 * count(*) FILTER (bucket <> 'C') / count(*), 1) AS measurable_pct FROM b GROUP BY 1",
    "tag_texts": f"{_TAGGED} SELECT id, empty, text, blank, bucket FROM b",
    "refill_cost": f"{_TAGGED} SELECT count(*) FILTER (blank) AS blank, round(count(*) FILTER (blank) * 7.0 / 3600, 2) AS hours_low, round(count(*) FILTER (blank) * 12.0 / 3600, 2) AS hours_high FROM b",
    "enriched": f"{_HALVES} SELECT id, coalesce(d, description) AS description, coalesce(s, skills_raw) AS skills_raw, currency FROM o LEFT JOIN n USING (id)",
    "columns_set": f"{_HALVES} SELECT id, CASE WHEN hit THEN d ELSE description END AS description, skills_raw, CASE WHEN hit THEN NULL ELSE currency END AS currency FROM o LEFT JOIN n USING (id)",
    "upserted": """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS source, 'u' || o_custkey AS detail_url, o_orderdate AS ts, 'r' || o_orderkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN o_orderpriority END AS cat, o_orderdate < DATE '1998-01-01' AS past FROM orders),
      l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, detail_url, past ORDER BY id DESC) = 1)
      SELECT source, detail_url, coalesce(o.id, n.id) AS id, coalesce(o.ts, n.ts) AS first_seen_at, coalesce(n.ts, o.ts) AS last_seen_at, coalesce(n.ts, o.ts) AS scraped_at, coalesce(n.run, o.run) AS scrape_run_id,
        CASE WHEN o.id IS NULL THEN n.cat WHEN n.cat IS NOT NULL AND coalesce(o.cat, 'all') = 'all' THEN n.cat ELSE o.cat END AS category, CASE WHEN n.id IS NOT NULL THEN o.id IS NULL END AS was_insert
      FROM (SELECT * FROM l WHERE past) o FULL JOIN (SELECT * FROM l WHERE NOT past) n USING (source, detail_url)""",
    "inserted_absent": "SELECT DISTINCT l_orderkey AS posting_id, 's' || l_partkey AS skill, 'm' AS extraction_method FROM lineitem WHERE l_partkey % 17 <> 0 AND l_orderkey % 2 <> 0",
    "graded_once": """SELECT 'v' AS model_version, 'skill' AS target_type, CAST(o_orderkey AS VARCHAR) AS target_key, CAST(o_orderdate AS DATE) AS target_week_start, x AS actual, x AS abs_error, x AS baseline_abs_error,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-01' END AS graded_at, CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 2 = 0 THEN false END AS beat_baseline
      FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS x FROM orders)""",
    "extraction_log": "SELECT o_orderkey % 500 AS id, CAST(o_orderkey % 7 AS INT) AS batch, max(o_orderpriority) AS phrases FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch DESC) = 1",
    "search_rows": """WITH j AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS n FROM orders)
      SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 <> 0 THEN 'C' END AS company, o_orderkey % 1000 AS salary_min, 'New Town' AS city, CAST(o_custkey AS VARCHAR) AS page, n FROM j WHERE o_custkey % 5 IN (0, 4) AND o_orderkey % 7 <> 0""",
    "stratified_sample": "SELECT doc_id AS id, lang AS domain, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) AS INT) AS turn FROM documents ORDER BY turn, domain LIMIT 50",
    "unmatched_titles": """WITH t AS (SELECT p_name AS cluster, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE '' END AS title FROM part WHERE p_size <= 25)
      SELECT cluster, count(*) AS n, array_to_string(list_sort(list(DISTINCT title))[:3], ' | ') AS samples FROM t GROUP BY 1 HAVING count(*) >= 5""",
    "needs_review": f"{_CLASSES} SELECT id, coalesce(sure < 0.6, false) OR coalesce(heuristic <> proposed, false) AS review FROM c",
    "title_only_relabel": f"{_CLASSES} SELECT id, CASE WHEN m = 'llm' AND bare THEN 'llm_title_only' ELSE m END AS domain_method, CASE WHEN m = 'llm' AND bare THEN least(coalesce(c, 0.6), 0.6) ELSE c END AS domain_confidence FROM c",
    "verified_drafts": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'number not in facts: ' || (o_orderkey % 7 + 100) WHEN o_orderkey % 9 = 0 THEN 'name not in facts: Mordor' WHEN o_orderkey % 4 = 0 THEN 'banned phrase: synergy' WHEN o_orderkey % 5 = 0 THEN 'word count' END AS blocked FROM orders""",
    "scans": f"""{_TAGGED} SELECT 'to_extract' AS scan, count(*) AS n, sum(id) AS ids FROM b WHERE id % 3 = 1 UNION ALL SELECT 'unclassified', count(*), sum(id) FROM b WHERE id % 4 <> 0
      UNION ALL SELECT 'needing_enrichment', count(*), sum(id) FROM b WHERE source = '5-LOW' AND (CASE WHEN blank THEN 0 ELSE words END < 120 OR empty OR currency IS NULL) UNION ALL SELECT 'source_scan', count(*), sum(id) FROM b WHERE o_custkey < 500""",
    "routed": "SELECT s AS source, count(*) AS n, coalesce(s IN ('view', 'click'), false) AS target FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN event_type END AS s FROM events) GROUP BY 1",
}
