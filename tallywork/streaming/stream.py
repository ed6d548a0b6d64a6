"""Streaming forms (STM-01..08): weekly and sliding counts, sessions, upserts and incremental classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cols as C
from ..sources.deltalog import POSTING_KEY, POSTING_MERGE, DeltaLog

#: Weeks begin on Monday at midnight in UTC+5, which is Sunday 19:00 UTC; windows count from the epoch, a Thursday.
WEEK_START = "3 days 19 hours"


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """STM-02, STM-03: tumbling weeks of each source; in append mode only closed ones come out."""
    w = F.window("first_seen_at", "7 days", "7 days", WEEK_START)
    return events.withWatermark("first_seen_at", late).groupBy(w.alias("w"), "source").agg(F.count("*").alias("n")).select(F.to_date(F.col("w.start") + F.expr(f"INTERVAL {C.PKT_HOURS} HOURS")).alias("week"), "source", "n")


def trailing_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """STM-05: sliding windows of four weeks."""
    w = F.window("first_seen_at", "28 days", "7 days", WEEK_START)
    return events.withWatermark("first_seen_at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """STM-06: sessions of each company."""
    return events.withWatermark("first_seen_at", late).groupBy(F.session_window("first_seen_at", gap).alias("w"), "company").agg(F.count("*").alias("n")).select("company", "w.start", "w.end", "n")


def first_sightings(events: DataFrame, late: str = "7 days") -> DataFrame:
    """STM-01: each posting once, within the watermark."""
    return events.withWatermark("first_seen_at", late).dropDuplicatesWithinWatermark(["source", "detail_url"])


def upsert_batches(folder: str, compact_every: int = 20, buckets: int = 64) -> Callable:
    """STM-01, SNK-12: for foreachBatch: each batch is appended to the postings' log, a batch that is repeated is not; every so many batches the buckets they touched are merged."""

    def run(batch: DataFrame, epoch: int) -> None:
        log = postings_log(batch.sparkSession, folder, buckets)
        if log.append(batch, epoch) and (epoch + 1) % compact_every == 0:
            log.compact()

    return run


def postings_log(spark: SparkSession, folder: str, buckets: int = 64) -> DeltaLog:
    """The postings under ``folder``, merged as :func:`sources.sinks.upsert_postings` does."""
    return DeltaLog(spark, folder, POSTING_KEY, POSTING_MERGE, buckets, order="ingest_seq")


def routed(events: DataFrame, target_sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """STM-04: rows of sources that count as targets, and the others."""
    hit = F.col("source").isin(*target_sources)
    return events.where(hit), events.where(~hit | hit.isNull())
