"""URL filter by a tree of path templates, in DataFrame operations only.

Per host, path segments that look variable (numbers, hashes, dates, long or mixed ones) become wildcards at once.  Then,
level by level from the root, sibling branches whose share of bad labels does not differ significantly from that of
their siblings are merged into a wildcard.  A template is rejected if its purity, the share of bad among its labelled
pages, smoothed towards its host's and the host's towards the whole, is above a bar.  Rules on hosts and path prefixes
come before the templates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Segments that vary, after the ending: numbers, hex strings, dates, very long ones, letters mixed with digits.
_VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F-]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|.{40,}|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_-]{6,})$"


def host_of(url):
    """Between the first ``://`` and the path, A-Z in lower case; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _AZ, _AZ.lower())


def path_of(url):
    """From the end of the host to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def segments_of(path):
    """The generalised segments of a path."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s):
        stem, ending = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        return F.when(stem.rlike(_VARIABLE), F.concat(F.lit("*"), ending)).otherwise(s)

    return F.transform(parts, general)


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, ``host/path``) pairs as a table: a rule's host ends at its first slash."""
    return spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules], "rule string, rule_host string, rule_path string, rule_verdict string")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (host, path) with the longest fitting rule and its verdict, null where none fits.

    A rule fits its host and all its subdomains where the path starts with the rule's.  Of equally long rules the first
    in the alphabet counts.  Rules are found by an equi-join on the suffixes of the distinct hosts.
    """
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fitting = (
        hosts.withColumn("rule_host", suffix).join(rules, "rule_host").groupBy("host").agg(F.array_sort(F.collect_set(F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "rule_verdict"))).alias("fits"))
    )
    fitting = small(checkpointed(fitting), 10_000)
    first = F.element_at(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])), 1)
    out = pages.join(fitting, "host", "left").withColumn("_fit", F.when(F.exists("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])), first))
    return out.select(*pages.columns, F.col("_fit.rule").alias("rule"), F.col("_fit.rule_verdict").alias("rule_verdict"))


def template_counts(pages: DataFrame) -> DataFrame:
    """(host, template, n, bad): labelled pages of each host and generalised path; ``label`` is 1 for bad, 0 for good."""
    return pages.where(F.col("label").isNotNull()).groupBy("host", segments_of(F.col("path")).alias("template")).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))


def merge_branches(counts: DataFrame, similar: float = 2.0) -> DataFrame:
    """``counts`` with a column ``merged``: from the root on, siblings whose bad share is within ``similar`` standard errors of the other siblings' are one wildcard."""
    now = counts.withColumn("merged", F.col("template"))
    depth = counts.agg(F.max(F.size("template"))).first()[0] or 0  # of the labelled pages' longest path
    for level in range(depth):
        head = F.slice("merged", 1, level)
        node = now.where(F.size("merged") > level).groupBy("host", head.alias("head"), F.element_at("merged", level + 1).alias("segment")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        parent = node.groupBy("host", "head").agg(F.sum("n").alias("pn"), F.sum("bad").alias("pb"), F.count("*").alias("siblings"))
        j = node.join(parent, ["host", "head"])
        others, rest = F.col("pn") - F.col("n"), F.col("pb") - F.col("bad")
        p = (F.col("pb") + 1) / (F.col("pn") + 2)
        z = F.abs((F.col("bad") + 0.5) / (F.col("n") + 1) - (rest + 0.5) / (others + 1)) / F.sqrt(p * (1 - p) * (1 / (F.col("n") + 1) + 1 / (others + 1)))
        alike = checkpointed(j.where((F.col("siblings") > 1) & (z < similar) & ~F.col("segment").startswith("*")).select("host", "head", "segment", F.lit(True).alias("alike")))
        keyed = now.withColumn("head", head).withColumn("segment", F.when(F.size("merged") > level, F.element_at("merged", level + 1)))
        wild = F.concat(F.slice("merged", 1, level), F.array(F.lit("*")), F.slice("merged", level + 2, depth + 1))
        now = keyed.join(alike, ["host", "head", "segment"], "left").withColumn("merged", F.when(F.col("alike"), wild).otherwise(F.col("merged"))).select("host", "template", "n", "bad", "merged")
    return now


def judge_urls(pages: DataFrame, rules: DataFrame, strength: float = 10.0, bar: float = 0.5, id_col: str = "page_id", url_col: str = "url", label_col: str = "label") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    verdict is the longest fitting rule's, else block if the purity of the page's template is above ``bar``, else allow.
    purity is (bad + strength * host share) / (labelled + strength); a page whose template has no labelled pages takes
    its host's share, and a host without any the whole's.  ``label_col`` is 1 (bad), 0 (good) or null.  Null urls and
    such without ``://`` have an empty host and path.  Repeated rows stay; an empty table gives no rows.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(label_col).cast("long").alias("label"))
    counts = checkpointed(merge_branches(checkpointed(template_counts(split))))
    whole = counts.agg(F.coalesce((F.sum("bad") + 1) / (F.sum("n") + 2), F.lit(0.0)).alias("share")).first()["share"]
    hosts = counts.groupBy("host").agg(((F.sum("bad") + strength * whole) / (F.sum("n") + strength)).alias("host_share"))
    merged = counts.groupBy("host", "merged").agg(F.sum("n").alias("mn"), F.sum("bad").alias("mb")).join(hosts, "host").withColumn("purity", (F.col("mb") + strength * F.col("host_share")) / (F.col("mn") + strength))
    judged = counts.select("host", "template", "merged").join(merged.select("host", "merged", "purity"), ["host", "merged"]).select("host", "template", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("_merged"), "purity")
    judged = small(checkpointed(judged), 10_000)
    hosts = small(checkpointed(hosts), 10_000)
    keyed = with_rules(split, rules).withColumn("template", segments_of(F.col("path")))
    out = keyed.join(judged, ["host", "template"], "left").join(hosts, "host", "left")
    purity = F.coalesce("purity", "host_share", F.lit(whole))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(purity > bar, "block").otherwise("allow")).alias("verdict"), F.coalesce("_merged", F.concat(F.lit("/"), F.array_join("template", "/"))).alias("template"), purity.alias("purity"))


# Words that, as a part of a host or path, speak for pages that nobody wants in a corpus.
UNWANTED = ("ad", "ads", "adult", "bet", "bets", "betting", "bingo", "casino", "escort", "loan", "loans", "pharma", "pill", "pills", "poker", "porn", "slots", "spam", "viagra", "warez", "xxx")


def weak_label(url, html, unwanted=UNWANTED, junk_share: float = 0.3, least: int = 5):
    """1 if the url has an unwanted word between signs or over ``junk_share`` of the page's words carry runs of signs, 0 if neither, null if the page has under ``least`` words.

    The words of the url and those of the page are two weak labelers; either may speak against a page, and a page of
    any length that has neither counts as good.
    """
    named = F.lower(F.coalesce(url, F.lit(""))).rlike(rf"(?:^|[^a-z])(?:{'|'.join(unwanted)})(?:[^a-z]|$)")
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>|&amp;", "&")
    words = F.regexp_count(text, F.lit(r"[^\s&]+"))
    junk = F.regexp_count(text, F.lit(r"[%*$#!&]{2,}(?=[\s<&]|$)"))
    return F.when(named, 1).when(words >= least, F.when(junk > junk_share * words, 1).otherwise(0))
