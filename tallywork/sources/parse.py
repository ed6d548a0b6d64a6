"""Pages and documents into rows (SRC-13..21, 23, 24, 28; JSN-01; SET-06).

Fetching is outside: pages arrive as a table (url, html).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def embedded_state(html: Column, marker: str = "__STATE__") -> Column:
    """SRC-13: the JSON after ``marker =`` in a script, as a variant; null if there is none or it can't be read."""
    return F.try_parse_json(F.regexp_extract(html, rf"(?s){marker}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1))


def listing_rows(pages: DataFrame, path: str = "$.jobs") -> DataFrame:
    """SRC-13, SRC-14: postings of listing pages' embedded JSON; rows without an id go.

    ``ingest_seq`` is where a row stands: its page (column page_no, if the pages have it, else their url) and its place there.
    """
    jobs = F.try_variant_get(embedded_state(F.col("html")), path, "array<variant>")
    page = F.col("page_no").cast("long") if "page_no" in pages.columns else F.lit(None).cast("long")
    j = pages.select("url", page.alias("page_no"), F.posexplode(jobs).alias("n", "j"))
    get = lambda k, t="string": F.try_variant_get("j", f"$.{k}", t)
    rows = j.select(
        get("id").alias("source_job_id"), T.normal_url(get("url")).alias("detail_url"), get("title").alias("title"), get("company").alias("company"), get("city").alias("city"), get("salary").alias("salary_raw"), T.query_string(F.col("url")).alias("query"),
        F.struct("page_no", "url", "n").alias("ingest_seq"),
    )
    return rows.where("source_job_id IS NOT NULL")


# Where a listing page of this kind keeps its state, the key of the search's answer in it, and the address of a posting.
STATE_ID, SEARCH_KEY, DETAIL_URL = "mustakbil-state", r"httpCacheKey/ws/jobs/search/\?(.*)", "https://www.mustakbil.com/jobs/job/"


def search_rows(pages: DataFrame, state_id: str = STATE_ID, key: str = SEARCH_KEY, detail_url: str = DETAIL_URL) -> DataFrame:
    """SRC-13, SRC-14: postings of the answer to a search that listing pages carry in a script of a given id, and what was asked (``params``).

    The answer is found by its key, whatever else the state holds; of several the first in the alphabet counts.  Pages without a
    state, without an answer, or with one that can't be read have no rows; nor have jobs without an id.  Empty texts are null.
    """
    page = F.col("page_no").cast("long") if "page_no" in pages.columns else F.lit(None).cast("long")
    text = F.regexp_extract("html", rf'(?s)<script[^>]*id="{state_id}"[^>]*>(.*?)</script>', 1)
    entries = F.map_entries(F.map_filter(F.try_variant_get(F.try_parse_json(text), "$", "map<string, variant>"), lambda k, _: k.rlike(key)))
    keys = F.array_sort(F.transform(entries, lambda e: e["key"]))
    p = pages.select("url", page.alias("page_no"), entries.alias("entries"), F.get(keys, F.lit(0)).alias("key")).where("key IS NOT NULL")
    body = F.get(F.filter("entries", lambda e: e["key"] == F.col("key")), F.lit(0))["value"]
    query = F.regexp_extract("key", key, 1)
    params = F.when(query != "", F.transform_values(F.str_to_map(query, F.lit("&"), F.lit("=")), lambda _, v: F.try_url_decode(v)))
    j = p.select("url", "page_no", params.alias("params"), F.posexplode(F.try_variant_get(body, "$.body.list", "array<variant>")).alias("n", "j"))
    given = lambda k: F.nullif(F.try_variant_get("j", f"$.{k}", "string"), F.lit(""))
    number = lambda k: F.try_variant_get("j", f"$.{k}", "double").cast("long")
    rows = j.select(
        F.try_variant_get("j", "$.id", "string").alias("source_job_id"), given("title").alias("title"), given("company").alias("company"), given("city").alias("city"), given("postedOn").alias("posting_date"), given("experienceLevel").alias("experience_raw"),
        number("salaryMin").alias("salary_min"), number("salaryMax").alias("salary_max"), given("description").alias("description"), "params", F.struct("page_no", "url", "n").alias("ingest_seq"),
    )
    return rows.where("source_job_id IS NOT NULL").withColumn("detail_url", F.concat(F.lit(detail_url), "source_job_id"))


def cards(pages: DataFrame, card: str = r'(?s)<div class="card[^"]*">(.*?)</div>\s*<!--/card-->') -> DataFrame:
    """SRC-18, SRC-19: cards of a listing page; those without title or link go."""
    c = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(card), F.lit(1))).alias("c"))
    one = lambda p: F.nullif(F.trim(F.regexp_extract("c", p, 1)), F.lit(""))
    rows = c.select(T.normal_url(one(r'<a[^>]*href="([^"]+)"')).alias("detail_url"), one(r"(?s)<h\d[^>]*>\s*(?:<a[^>]*>)?([^<]+)").alias("title"), one(r'class="company"[^>]*>([^<]+)').alias("company"), one(r'class="city"[^>]*>([^<]+)').alias("city"), one(r'class="salary"[^>]*>([^<]+)').alias("salary_raw"), F.regexp_extract_all("c", F.lit(r'class="tag"[^>]*>([^<]+)'), F.lit(1)).alias("tags"))
    m = T.money_range(F.coalesce("salary_raw", F.lit("")))
    return rows.where("title IS NOT NULL AND detail_url IS NOT NULL").withColumn("salary_min", m["low"]).withColumn("salary_max", m["high"])


def paged(pages: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """SRC-21: (cards, listings) of numbered pages of listings, read as far as someone who turns pages would come.

    pages: listing, page_no (from 1), cards: array of structs with detail_url.  A listing ends before its first page that is
    missing, has no cards, or begins with the card that the page before began with, or after ``most`` pages.  cards: listing,
    page_no, n and the card's fields, of one url the first; listings: listing, pages_fetched, cards, new_cards, stop_reason.
    A page number given twice counts once, with the larger cards.  Listings without a first page have no pages.
    """
    first = F.get("cards", F.lit(0))["detail_url"]
    p = pages.where("listing IS NOT NULL AND page_no IS NOT NULL").groupBy("listing", F.col("page_no").cast("long").alias("page_no")).agg(F.max(F.coalesce("cards", F.slice("cards", 1, 0))).alias("cards"))
    w = Window.partitionBy("listing").orderBy("page_no")
    p = p.withColumn("no", F.row_number().over(w)).withColumn("head", first).withColumn("before", F.lag(first).over(w)).withColumn("whole", F.count("*").over(Window.partitionBy("listing")))
    stop = (
        F.when(F.col("page_no") > most, "reached the most pages").when(F.col("page_no") != F.col("no"), "a page is missing").when(F.coalesce(F.size("cards"), F.lit(0)) <= 0, "a page without cards").when((F.col("no") > 1) & (F.col("head") == F.col("before")), "the same first card as the page before")
    )
    # the first page that stops, carried on to all later ones
    marked = p.withColumn("stop", stop).withColumn("ended", F.first("stop", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked.where("ended IS NULL")
    rows = kept.select("listing", "page_no", F.posexplode("cards").alias("n", "card")).select("listing", "page_no", "n", "card.*")
    once = Window.partitionBy("listing", "detail_url").orderBy("page_no", "n")
    new = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    ends = marked.groupBy("listing").agg(F.count_if(F.col("ended").isNull()).alias("pages_fetched"), F.sum(F.when(F.col("ended").isNull(), F.size("cards")).otherwise(0)).alias("cards"), F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("page_no"))).alias("stop"))
    counts = ends.join(new.groupBy("listing").agg(F.count("*").alias("new_cards")), "listing", "left")
    return new, counts.select("listing", "pages_fetched", "cards", F.coalesce("new_cards", F.lit(0)).alias("new_cards"), F.coalesce("stop", F.lit("no more pages")).alias("stop_reason"))


def last_wins(rows: DataFrame, keys: list[str], seq: str = "ingest_seq") -> DataFrame:
    """SRC-21, SRC-23, SET-06: of rows with the same keys the last to arrive; of equal sequence numbers the larger row by its columns' text."""
    rest = [F.desc_nulls_last(F.col(c).cast("string")) for c, t in rows.dtypes if c not in {*keys, seq} and not t.startswith(("map", "variant", "struct", "array"))]
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(seq), *rest)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pooled(streams: list[DataFrame]) -> DataFrame:
    """SRC-23, SET-06: streams together, the last row of a url winning: that of the later stream, inside a stream that of the larger ``ingest_seq``."""
    rows = [(s if "ingest_seq" in s.columns else s.withColumn("ingest_seq", F.lit(None).cast("long"))).withColumn("_stream", F.lit(i)) for i, s in enumerate(streams)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return last_wins(out.withColumn("_at", F.struct("_stream", F.coalesce(F.col("ingest_seq").cast("long"), F.lit(-1)))), ["detail_url"], "_at").drop("_stream", "_at")


def geo_filtered(rows: DataFrame, countries: list[str], cities: list[str], as_of: str, stale_days: int = 14) -> DataFrame:
    """SRC-24, FLT-08, STM-04: rows in the countries, with a mark on stale ones."""
    return rows.where(T.resolves_to(F.col("location"), countries, cities)).withColumn("is_stale", F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.col("posting_date")) > stale_days, F.lit(False)))


def extraction_log(spark, path: str) -> DataFrame:
    """SRC-28: answers of a JSON-lines batch log, the last of each posting."""
    log = spark.read.schema("batch int, responses array<struct<id:long,phrases:array<string>>>").json(path)
    return last_wins(log.select("batch", F.explode("responses").alias("r")).select("batch", "r.id", "r.phrases"), ["id"], "batch")
