"""Table schemas and projected scans (SRC-01..12, 25; schemas of postings, mentions, forecasts, curricula, briefings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cols as C

POSTINGS = (
    "id string, source string, detail_url string, source_job_id string, first_seen_at timestamp, last_seen_at timestamp, title string, company string, city string, posting_date date, experience_raw string, salary_min int, salary_max int, salary_raw string, currency string, skills_raw string, description string, scraped_at timestamp, scrape_run_id string, category string, "
    "degree_level string, degree_field string, has_certification boolean, experience_min_years int, experience_max_years int, experience_level string, domain string, domain_method string, domain_confidence double, job_family string, family_method string, family_confidence double"
)
MENTIONS = "posting_id string, skill string, category string, extraction_method string, extracted_at timestamp, requirement_type string"
FORECASTS = "run_id string, created_at timestamp, model_version string, target_type string, target_key string, target_week_start date, predicted double, interval_low double, interval_high double, baseline_predicted double, actual double, graded_at timestamp, abs_error double, baseline_abs_error double, beat_baseline boolean, source_scope string"
COURSES = "document string, program string, code string, title string, credit_hours int, topics_raw string"
BRIEFINGS = "id long, week_start date, created_at timestamp, body string, source string, facts_json string, model_version string, blocked_reason string, superseded_by long"
TAXONOMY = "skill string, display string, category string, requirement_type string, aliases array<string>, ord int"


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """SRC-01, 02, 05, 09: a projected, filtered scan; both reach the reader."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.format(form).load(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def active_mentions(mentions: DataFrame, method: str) -> DataFrame:
    """SRC-03."""
    return mentions.where(F.col("extraction_method") == method)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: a taxonomy from JSON lines; its order is the column ``ord``."""
    return spark.read.schema(TAXONOMY).json(path)


def to_extract(postings: DataFrame, run_id: str | None = None) -> DataFrame:
    """SRC-06."""
    return postings if run_id is None else postings.where(F.col("scrape_run_id") == run_id)


def unclassified(postings: DataFrame, column: str = "domain") -> DataFrame:
    """SRC-07, SRC-08, STM-07: rows that have no value yet (``domain`` or ``family_method``)."""
    return postings.where(F.col(column).isNull())


def needing_enrichment(postings: DataFrame, source: str, least_words: int = 120) -> DataFrame:
    """SRC-10: short or missing description, no tags, or no currency."""
    words = F.when(C.blank(F.col("description")), 0).otherwise(F.size(F.split(F.trim("description"), r"\s+")))
    return postings.where((F.col("source") == source) & ((words < least_words) | C.skills_raw_empty(F.col("skills_raw")) | F.col("currency").isNull()))


def graded(forecasts: DataFrame, is_graded: bool = True, week: str | None = None) -> DataFrame:
    """SRC-11, FLT-11."""
    f = forecasts.where(F.col("graded_at").isNotNull() if is_graded else F.col("graded_at").isNull())
    return f if week is None else f.where(F.col("target_week_start") == F.lit(week).cast("date"))


def briefing_of(briefings: DataFrame, week: str) -> DataFrame:
    """SRC-12."""
    return briefings.where((F.col("week_start") == F.lit(week).cast("date")) & F.col("superseded_by").isNull()).limit(1)


def clean_scraped(rows: DataFrame) -> DataFrame:
    """SRC-25: not-a-number as null, whole salaries, texts trimmed with the empty one as null."""
    num = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)).cast("int").alias(c)
    text = lambda c: F.when(F.trim(c).isin("", "nan", "None"), None).otherwise(F.trim(c)).alias(c)
    return rows.select(*[num(c) if c.startswith("salary_m") else text(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
