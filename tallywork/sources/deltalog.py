"""A keyed table that grows by small changes: a log of deltas over a bucketed base (STM-01, SNK-01, SNK-12).

A batch appends its own rows and one entry of the log, whatever the table's size; nothing else is read or written.  A reader
merges base and deltas by key with aggregates that can be combined in parts.  Compaction merges the buckets that the deltas
touch into new files; the other buckets keep theirs.  An entry is one file, so it is there whole or not at all, and what a
lost try wrote has no entry and is never read.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import last_wins

_ENTRY = "seq long, kind string, path string, buckets array<int>, rows long"
#: By column name and order (a column that grows with time): an aggregate that merges a key's rows.
Merge = Callable[[str, Column], Column]


def first(column: str, order: Column) -> Column:
    """The value of the first row, null too."""
    return F.min_by(F.struct(F.col(column).alias("v")), order)["v"]


def last(column: str, order: Column) -> Column:
    """The value of the last row, null too."""
    return F.max_by(F.struct(F.col(column).alias("v")), order)["v"]


def last_given(column: str, order: Column) -> Column:
    """The last value that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def first_named(column: str, order: Column) -> Column:
    """The first value that is neither null nor ``all``, else ``all`` if it occurs."""
    named = F.col(column).isNotNull() & (F.col(column) != "all")
    return F.coalesce(F.min_by(column, F.when(named, order)), F.max(F.when(F.col(column) == "all", "all")))


#: SNK-01: what a later sighting of a posting may change.
POSTING_MERGE: dict[str, Merge] = {"last_seen_at": last, "scraped_at": last, "scrape_run_id": last, "category": first_named}
POSTING_KEY = ["source", "detail_url"]


class DeltaLog:
    """The table in ``folder``, which driver and executors share.  Columns that ``merge`` does not name are merged by ``default``: those of a key's first row.

    Rows without a whole key are refused by :meth:`append`.  Of a batch's rows with one key the last counts, by ``order`` (a
    column of the batch, which is not kept), then by the larger text of the row.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], merge: dict[str, Merge] | None = None, buckets: int = 64, order: str | None = None, default: Merge = first):
        self.spark, self.folder, self.key, self.merge, self.buckets, self.order, self.default = spark, folder, key, merge or {}, buckets, order, default

    def _entries(self) -> list:
        try:
            return self.spark.read.schema(_ENTRY).json(f"{self.folder}/_log").orderBy("seq", F.col("kind") == "base").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _enter(self, seq: int, kind: str, path: str, buckets: list[int], rows: int) -> None:
        self.spark.createDataFrame([(seq, kind, path, buckets, rows)], _ENTRY).coalesce(1).write.mode("append").json(f"{self.folder}/_log")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def has(self, seq: int) -> bool:
        return any(e["seq"] == seq and e["kind"] == "delta" for e in self._entries())

    def next_seq(self) -> int:
        """The number after the last batch."""
        return max((e["seq"] for e in self._entries()), default=-1) + 1

    def append(self, batch: DataFrame, seq: int) -> bool:
        """Adds a batch as number ``seq``; one that is there already is left as it is, and the answer is False.  Numbers grow."""
        entries = self._entries()
        if any(e["kind"] == "delta" and e["seq"] == seq for e in entries):
            return False
        if any(e["seq"] > seq for e in entries):
            raise ValueError(f"a batch after {seq} is in the log already")
        whole = F.lit(True)
        for k in self.key:
            whole = whole & F.col(k).isNotNull()
        checked = batch.withColumn("_bucket", F.when(whole, self._bucket()).otherwise(F.raise_error(F.lit("a row without its whole key")).cast("int")))
        once = last_wins(checked.withColumn("_order", F.col(self.order) if self.order else F.lit(0)), self.key, "_order").drop("_order", *([self.order] if self.order else []))
        path = f"{self.folder}/delta-{seq:012d}-{uuid.uuid4().hex}"
        once.withColumn("_at", F.lit(seq).cast("long")).write.parquet(path)
        written = self.spark.read.parquet(path).groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # at most a row a bucket
        self._enter(seq, "delta", path, sorted(r["_bucket"] for r in written), sum(r["n"] for r in written))
        return True

    def _merged(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in (*self.key, "_at", "_bucket")]
        order = F.col("_at")
        out = [self.merge.get(c, self.default)(c, order).alias(c) for c in columns]
        # the first sighting stays the first when it is merged again
        return rows.groupBy(*self.key).agg(*out, F.min("_bucket").alias("_bucket"), F.min("_at").alias("_at"))

    def _parts(self) -> tuple[dict[int, str], int, list]:
        """(each bucket's base, the last batch in the bases, entries of the deltas after it)."""
        bases, upto, entries = {}, -1, self._entries()
        for e in entries:
            if e["kind"] == "base":
                bases |= {b: e["path"] for b in e["buckets"]}
                upto = max(upto, e["seq"])
        return bases, upto, [e for e in entries if e["kind"] == "delta" and e["seq"] > upto]

    def _read(self, bases: dict[int, str], deltas: list, buckets: set[int] | None = None) -> DataFrame | None:
        frames = []
        by_path: dict[str, list[int]] = {}
        for b, path in bases.items():
            if buckets is None or b in buckets:
                by_path.setdefault(path, []).append(b)
        for path, own in by_path.items():
            frames.append(self.spark.read.parquet(path).where(F.col("_bucket").isin(*own)))
        frames += [self.spark.read.parquet(e["path"]) for e in deltas if e["rows"]]
        if not frames:
            return None
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """The table as of the last batch; None if it never had one with rows."""
        bases, _, deltas = self._parts()
        rows = self._read(bases, deltas)
        return None if rows is None else self._merged(rows).drop("_bucket", "_at")

    def compact(self, least: int = 1) -> list[int]:
        """Merges the buckets that at least ``least`` waiting deltas touch into new files; returns them.  Other buckets' files stay."""
        bases, _, deltas = self._parts()
        if len(deltas) < least:
            return []
        touched = {b for e in deltas for b in e["buckets"]}
        rows = self._read(bases, deltas, touched)
        seq = max(e["seq"] for e in deltas)
        path = f"{self.folder}/base-{seq:012d}-{uuid.uuid4().hex}"
        if rows is not None:
            self._merged(rows).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        self._enter(seq, "base", path, sorted(touched), 0)
        return sorted(touched)
