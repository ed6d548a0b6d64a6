"""Mutations as merges into new versions (SNK-01..11, 13; STM-01).

Parquet has no MERGE: each mutation is a join that gives the table's next state, and :func:`publish` writes it as a new
version before the pointer moves, so a reader never sees half a write and a lost executor costs a task, not the table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import last_wins

KEY = ["source", "detail_url"]


def upsert_postings(old: DataFrame, batch: DataFrame) -> DataFrame:
    """SNK-01: the table after a batch, with ``was_insert`` (null on rows that the batch does not touch).

    Of the batch's rows with one key the last (by ingest_seq) counts.  A known posting gets only last_seen_at, scraped_at,
    scrape_run_id, and its category if the new one is not null and the old is null or ``all``.
    """
    new = last_wins(batch, KEY).drop("ingest_seq")
    refreshed = ["last_seen_at", "scraped_at", "scrape_run_id"]
    j = old.alias("o").join(new.alias("n"), KEY, "full")
    has_old, has_new = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    out = []
    for c in old.columns:
        if c in KEY:
            out.append(F.col(c))
        elif c in refreshed:
            out.append(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c == "category":
            take = ~has_old | (F.col("n.category").isNotNull() & (F.col("o.category").isNull() | (F.col("o.category") == "all")))
            out.append(F.when(has_new & take, F.col("n.category")).otherwise(F.col("o.category")).alias(c))
        else:
            out.append(F.when(has_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in new.columns else F.lit(None)).alias(c))
    return j.select(*out, F.when(has_new, ~has_old).alias("was_insert"))


def enrich(old: DataFrame, details: DataFrame, columns: tuple[str, ...] = ("description", "skills_raw", "currency")) -> DataFrame:
    """SNK-02: new values where there are any, else the old."""
    d = details.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(d, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def set_columns(old: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-03..05: on rows with an update every named column is set, nulls too."""
    u = updates.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(u, "id", "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-06, SNK-07: the rows of ``new`` with all keys whose keys are not there yet, each once."""
    whole = new.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).dropDuplicates(keys)
    return whole.join(old.select(*keys), keys, "left_anti").select(*new.columns)


MENTION_KEY = ["posting_id", "skill", "extraction_method"]
FORECAST_KEY = ["model_version", "target_type", "target_key", "target_week_start"]
_GRADES = ("actual", "graded_at", "abs_error", "baseline_abs_error", "beat_baseline")


def grade_once(forecasts: DataFrame, grades: DataFrame) -> DataFrame:
    """SNK-08: grades fill rows that have none; graded rows stay as they are."""
    g = grades.select(*FORECAST_KEY, *[F.col(c).alias(f"_{c}") for c in _GRADES])
    return forecasts.join(g, FORECAST_KEY, "left").select(*[F.when(F.col("graded_at").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in _GRADES else F.col(c) for c in forecasts.columns])


def supersede(briefings: DataFrame, old_id: int, new_id: int) -> DataFrame:
    """SNK-11: the one change a briefing may have: from no successor to one; anything else is an error."""
    if briefings.where((F.col("id") == old_id) & F.col("superseded_by").isNull()).isEmpty():
        raise ValueError(f"briefing {old_id} is missing or superseded already")
    return briefings.withColumn("superseded_by", F.when(F.col("id") == old_id, F.lit(new_id).cast("long")).otherwise(F.col("superseded_by")))


def check_locked(before: DataFrame, after: DataFrame, keys: list[str], locked: list[str]) -> None:
    """Rows may not vanish and locked columns may not change; else an error."""
    a = after.select(*keys, *[F.col(c).alias(f"_{c}") for c in locked], F.lit(True).alias("_there"))
    differs = F.col("_there").isNull()
    for c in locked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    if not before.join(a, keys, "left").where(differs).isEmpty():
        raise ValueError("a locked column changed or a row is gone")


def publish(df: DataFrame, folder: str, version: int) -> str:
    """SNK-09, SNK-10, SNK-12: ``df`` as version ``version`` of a table, then the pointer to it.

    Each try writes a folder of its own and only the pointer makes it the version, so a try that was cut off between the
    two can be repeated.  A version that has a pointer is an error.
    """
    if published(df.sparkSession, folder, version):
        raise ValueError(f"version {version} of {folder} is published already")
    path = f"{folder}/v{version:06d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(version, path)], "version int, path string").coalesce(1).write.mode("append").json(f"{folder}/_versions")
    return path


def _versions(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema("version int, path string").json(f"{folder}/_versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, folder: str, version: int) -> bool:
    """Whether a table has this version."""
    found = _versions(spark, folder)
    return found is not None and not found.where(F.col("version") == version).isEmpty()


def any_published(spark: SparkSession, folder: str) -> bool:
    """Whether a table has any version."""
    found = _versions(spark, folder)
    return found is not None and not found.isEmpty()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published version of a table."""
    newest = spark.read.schema("version int, path string").json(f"{folder}/_versions").orderBy(F.desc("version")).first()
    return spark.read.parquet(newest["path"])


def publish_all(frames: dict[str, DataFrame], folder: str, version: int) -> None:
    """ORC-05: several tables of one run as one version: all are written first, then one pointer names them all, so a reader sees all or none.

    A version that has a pointer is an error; one that was cut off before can be tried again.
    """
    spark = next(iter(frames.values())).sparkSession
    if published(spark, folder, version):
        raise ValueError(f"version {version} of {folder} is published already")
    base = f"{folder}/v{version:06d}-{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    spark.createDataFrame([(version, base, sorted(frames))], "version int, path string, names array<string>").coalesce(1).write.mode("append").json(f"{folder}/_versions")


def current_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version that :func:`publish_all` completed."""
    newest = spark.read.schema("version int, path string, names array<string>").json(f"{folder}/_versions").orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{newest['path']}/{name}") for name in newest["names"]}


def write_report(rows: DataFrame, path: str, title: str, limit: int = 100) -> None:
    """SNK-13: the first rows of a ranked result as a Markdown table."""
    head = rows.limit(limit)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    body = [r[0] for r in head.select(line).collect()]
    text = "\n".join([f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns), *body])
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
