"""Benchmark decontamination by Wu-Manber search over words.

The patterns are windows of benchmark words.  For each pattern length the search keeps a shift table on blocks of two
words, buckets of patterns by their last block, and inside a bucket patterns by their first block; what is left is
compared word by word.  Documents are searched where they are: there is no shuffle.  The patterns are sent to the tasks
in blocks of a bounded number of windows, one pass over the documents for each block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, text_bytes

#: ASCII other than 0-9 and a-z (after lower-casing) parts words; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(WORD_BYTES).split() if raw else []


class Searcher:
    """Wu-Manber tables over sequences of words, all of one length."""

    def __init__(self, patterns: list[tuple]):
        self.m = len(patterns[0])
        self.block = min(2, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, self.m + 1):
                at = p[end - self.block : end]
                self.shift[at] = min(self.shift.get(at, self.far), self.m - end)
            self.bucket[p[-self.block :]][p[: self.block]].append(p)
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def find(self, words: list[bytes]):
        """(start, pattern) of every occurrence."""
        m, far, shift, block, bucket = self.m, self.far, self.shift.get, self.block, self.bucket
        end, n = m, len(words)
        pairs = block == 2
        while end <= n:
            key = (words[end - 2], words[end - 1]) if pairs else (words[end - 1],)
            s = shift(key, far)
            if s:
                end += s
                continue
            start = end - m
            for p in bucket[key].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == p:
                    yield start, p
            end += 1


def windows_of(words: list[bytes], window: int) -> list[tuple]:
    if not words:
        return []
    n = min(window, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching ones are joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


OUT = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, n_words, spans, items) for every document row, and the column ``carry`` of that row if one is named.

    spans are the word spans [start, end) that occurrences of benchmark windows cover, merged; items are the ids, as
    sorted distinct strings, of the items that have an occurring window.  A null or empty text has no words; an item
    without words has no windows; a null item id is the empty string.  Repeated document rows are returned as often as
    given; repeated items count once.  An empty benchmark finds nothing.
    """
    key = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    items = benchmark.select(key.alias("item"), text_bytes(item_text_col).alias("b")).distinct()
    total = items.agg(F.sum(F.octet_length("b") / 2 + 1)).first()[0] or 0  # no more windows than this
    blocks = max(1, ceil(total / max_windows))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"), F.lit(0).cast("long").alias("n_words"), F.expr("CAST(array() AS array<struct<start:long,end:long>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"), *([carry] if carry else []))
    context = docs.sparkSession.sparkContext
    for k in range(blocks):
        of: dict[tuple, set] = defaultdict(set)
        for r in items.where(F.pmod(F.xxhash64("item", "b"), F.lit(blocks)) == k).toLocalIterator():
            for w in windows_of(words_of(bytes(r["b"])), window):
                of[w].add(r["item"])
        last = k == blocks - 1
        sent = context.broadcast(dict(of))
        schema = StructType.fromDDL("doc_id long, " + ("" if last else "b binary, ") + OUT)
        out = out.mapInArrow(_search(sent, last), schema.add(carry, docs.schema[carry].dataType) if carry else schema)
    return out


def _search(sent, last: bool):
    def run(batches):
        of = sent.value
        by_length = defaultdict(list)
        for p in of:
            by_length[len(p)].append(p)
        searchers = [Searcher(p) for p in by_length.values()]
        for b in batches:
            n_words, spans, items = [], [], []
            for raw, had, known in zip(b.column(1), b.column(3).to_pylist(), b.column(4).to_pylist()):
                words = words_of(raw.as_py())
                hits, found = [(x["start"], x["end"]) for x in had], set(known)
                for s in searchers:
                    for at, p in s.find(words):
                        hits.append((at, at + s.m))
                        found |= of[p]
                n_words.append(len(words))
                spans.append([{"start": x, "end": y} for x, y in merged(hits)])
                items.append(sorted(found))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            new += b.columns[5:]
            names = ["n_words", "spans", "items", *b.schema.names[5:]]
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), *new], ["doc_id", *names])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *new], ["doc_id", "b", *names])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, carry: str | None = None, **how) -> DataFrame:
    """:func:`find_windows` with the counts and the verdict: n_hit words are hit, and ``share`` * n_hit >= n_words is contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return find_windows(docs, benchmark, carry=carry, **how).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", *([carry] if carry else [])
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose own text is contaminated; all columns stay, and ids (null or repeated) play no part."""
    packed = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    return contamination(packed, benchmark, carry="row", **how).where(~F.col("contaminated")).select("row.*")
