"""Queries on state that grows by batches, and on listings read page by page."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import lenses as L
from ..sources import parse as P
from ..streaming import stream as ST

WEEKS = ["2024-01-08", "2024-01-15", "2024-01-22"]


def _sightings(s, d):
    """Events as sightings of postings: a user's page in a source, seen again and again."""
    e = L.read(s, d, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"), F.col("event_type").alias("source"), F.concat(F.lit("https://jobs.example/"), (F.col("user_id") % 97).cast("string")).alias("detail_url"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("company"),
        F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), F.col("ts").alias("scraped_at"), F.concat(F.lit("r"), k.cast("string")).alias("scrape_run_id"),
        F.when(k % 3 == 0, "all").when(k % 7 == 0, F.concat(F.lit("cat"), (k % 4).cast("string"))).alias("category"), k.alias("ingest_seq"),
    )


def _log(s, d):
    """Four weekly batches, the second one repeated, with a merge of the touched buckets between."""
    log = ST.postings_log(s, f"{shared_folder(s)}/log-{uuid.uuid4().hex}", buckets=16)
    rows, edges = _sightings(s, d), [None, *WEEKS, None]
    for n, (a, z) in enumerate(zip(edges, edges[1:])):
        part = rows if a is None else rows.where(F.col("first_seen_at") >= F.lit(a).cast("timestamp"))
        part = part if z is None else part.where(F.col("first_seen_at") < F.lit(z).cast("timestamp"))
        for _ in range(2 if n == 1 else 1):
            log.append(part, n)
        if n == 2:
            log.compact()
    return log.read()


def _pages(s, d):
    """Customers' orders as cards of listings, twenty a page; one listing lacks a page, one repeats one, one has an empty page, one begins late."""
    w = "PARTITION BY o_custkey % 7 ORDER BY o_orderkey"
    c = L.read(s, d, "orders").selectExpr("o_custkey % 7 AS listing", "o_orderkey AS k", f"row_number() OVER ({w}) - 1 AS at")
    cards = c.select("listing", (F.floor(F.col("at") / 20) + 1).alias("page_no"), "at", F.concat(F.lit("u"), F.when((F.col("listing") == 4) & (F.col("at") % 20 == 19), F.col("at") % 3).otherwise(F.col("k")).cast("string")).alias("detail_url"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "detail_url"))), lambda x: F.struct(x["detail_url"].alias("detail_url")))
    p = cards.groupBy("listing", "page_no").agg(whole.alias("cards"))
    gone = ((F.col("listing") == 1) & (F.col("page_no") == 4)) | ((F.col("listing") == 6) & (F.col("page_no") == 1))
    again = p.where("listing = 2 AND page_no = 3").select("listing", F.lit(4).cast("long").alias("page_no"), "cards")
    empty = p.where("listing = 3 AND page_no = 2").select("listing", "page_no", F.slice("cards", 1, 0).alias("cards"))
    return p.where(~gone & ~((F.col("listing") == 2) & (F.col("page_no") == 4)) & ~((F.col("listing") == 3) & (F.col("page_no") == 2))).unionByName(again).unionByName(empty)


QUERIES = {
    "postings_log": _log,
    "paged_listings": lambda s, d: P.paged(_pages(s, d), most=10)[1],
    "paged_cards": lambda s, d: P.paged(_pages(s, d), most=10)[0],
}

_SEEN = """WITH e AS (SELECT event_id AS id, event_type AS source, 'https://jobs.example/' || (user_id % 97) AS detail_url, 'c' || (event_id % 5) AS company, ts, 'r' || event_id AS run,
    CASE WHEN event_id % 3 = 0 THEN 'all' WHEN event_id % 7 = 0 THEN 'cat' || (event_id % 4) END AS category, CASE WHEN ts < DATE '2024-01-08' THEN 0 WHEN ts < DATE '2024-01-15' THEN 1 WHEN ts < DATE '2024-01-22' THEN 2 ELSE 3 END AS b FROM events),
  o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source, detail_url, b ORDER BY id DESC) = 1)"""
_CARDS = """WITH c AS (SELECT o_custkey % 7 AS listing, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS pos FROM orders),
  d AS (SELECT listing, pos // 20 + 1 AS page_no, CAST(pos % 20 AS INT) AS n, 'u' || CASE WHEN listing = 4 AND pos % 20 = 19 THEN pos % 3 ELSE k END AS detail_url FROM c),
  m AS (SELECT listing, max(page_no) AS last FROM d GROUP BY 1),
  f AS (SELECT listing, CASE listing WHEN 1 THEN least(last, 3) WHEN 2 THEN least(last, 3) WHEN 3 THEN 1 WHEN 6 THEN 0 ELSE least(last, 10) END AS fetched, last FROM m),
  k AS (SELECT d.* FROM d JOIN f USING (listing) WHERE page_no <= fetched)"""

ORACLE_SQL = {
    "postings_log": f"""{_SEEN} SELECT source, detail_url, arg_min(id, b) AS id, arg_min(company, b) AS company, arg_min(ts, b) AS first_seen_at, arg_max(ts, b) AS last_seen_at, arg_max(ts, b) AS scraped_at, arg_max(run, b) AS scrape_run_id,
      coalesce(arg_min(category, b) FILTER (category <> 'all'), max(category) FILTER (category = 'all')) AS category FROM o GROUP BY 1, 2""",
    "paged_cards": f"{_CARDS} SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY listing, detail_url ORDER BY page_no, n) = 1",
    "paged_listings": f"""{_CARDS} SELECT listing, fetched AS pages_fetched, (SELECT count(*) FROM k WHERE k.listing = f.listing) AS cards, (SELECT count(DISTINCT detail_url) FROM k WHERE k.listing = f.listing) AS new_cards,
      CASE WHEN listing = 6 OR listing = 1 AND last > 4 THEN 'a page is missing' WHEN listing = 2 AND last >= 3 THEN 'the same first card as the page before' WHEN listing = 3 AND last >= 2 THEN 'a page without cards' WHEN last > 10 THEN 'reached the most pages' ELSE 'no more pages' END AS stop_reason FROM f""",
}
