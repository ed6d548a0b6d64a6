"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def with_least(rows: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    """``rows``, of which there are about ``n``, with the least ``value`` of their ``key`` as ``name``; null keys go.

    Keys of over 1/25,000 of the rows are fewer than 25,000, so theirs are broadcast and their rows stay where they are;
    no other key can fill a task.
    """
    least = rows.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(name), F.count("*").alias("_n"))
    hubs = F.broadcast(least.where(F.col("_n") > max(64, n // 25_000)).select("_key", F.col(name).alias("_hub"), F.lit(True).alias("_is")))
    tagged = rows.join(hubs, rows[key] == hubs["_key"], "left").drop("_key")
    rest = tagged.where("_is IS NULL").drop("_hub", "_is").join(least.select("_key", name), F.col(key) == F.col("_key")).select(*rows.columns, name)
    return tagged.where("_is").select(*rows.columns, F.col("_hub").alias(name)).unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node that it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_least(both, "u", "v", 2 * n, "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them.  ``edges`` run from larger to smaller."""
    joined = with_least(edges, "u", "v", n, "m")
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node of its component.

    Edges of hubs stay where they are and get the hub's least neighbour by a broadcast.  Every round is written: the estimates
    of sizes that a checkpoint carries along would multiply from join to join.
    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    now = written(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        middle = written(_large_star(now, mark[0]))
        now = written(_small_star(middle, mark[0]).where("u <> v").distinct())
