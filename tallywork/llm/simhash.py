"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share at
least four positional bytes.  A list keyed by one positional byte would hold 1/256 of all fingerprints, and reading
such lists is quadratic; the lists here are keyed by ``seed_bytes`` positional bytes together.  A pair that shares four
of eight bytes shares three of the first seven, so the 35 triples of seven positions find every qualifying pair.
Each pair that meets in a list is tallied over all eight positions, kept at four shared bytes, and verified by its bits.

Equal fingerprints are one entry.  Lists that a sample shows to be long are cut into blocks of bounded size, and each
two blocks meet in a task of their own.  What a task returns is a spanning forest of its links, not all pairs, so a
group of n near copies costs O(n) rows; components of the forest are components of the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, small, text_bytes
from .graph import connected_components, with_least

#: Shingles hashed at once, so that a very long text needs bounded memory besides itself.
CHUNK = 1 << 16


def simhash(raw: bytes | None, shingle: int = 4) -> int:
    """Fingerprint of a text in UTF-8, as a signed 64-bit number; 0 if it has no words."""
    words = raw.translate(LOWER).split() if raw else []
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + k - 1]
        joined = b" ".join(part)
        length = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(length + 1) - 1
        start = (end - length)[: len(part) - k + 1].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(start, end[k - 1 :].tolist())], np.uint64, len(start))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text; null and empty texts have 0."""

    def run(batches):
        for b in batches:
            fp = pa.array([simhash(x, shingle) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b")).mapInArrow(run, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """For each xor of two fingerprints: how many of the eight positional bytes are the same."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def _linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Which xors of pairs are links: pairs tallied at too few shared bytes are out, the rest are verified by their bits."""
    out = shared_bytes(x) >= 8 - max_bits
    out[out] = np.bitwise_count(x[out]) <= max_bits
    return out


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one list's fingerprints: each found node is compared with those not yet found."""
    left, out = np.unique(fp), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            hit = _linked(left ^ queue.pop(), max_bits)
            if hit.any():
                found = left[hit].tolist()
                queue.extend(np.uint64(y) for y in found)
                out.extend((int(root), y) for y in found)
                left = left[~hit]
    return out


def _forests(key: np.ndarray, fp: np.ndarray, max_bits: int, few: int = 8) -> list[tuple[int, int]]:
    """Links of many lists, sorted by list; short lists are compared together, by shifts."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    out = []
    for a, n in zip(start[size > few].tolist(), size[size > few].tolist()):
        out += _forest(fp[a : a + n], max_bits)
    each = np.repeat(size, size)
    short = (each <= few) & (each > 1)
    k, f = key[short], fp[short]
    for d in range(1, min(few, len(f))):
        same = k[d:] == k[:-d]
        a, b = f[:-d][same], f[d:][same]
        ok = _linked(a ^ b, max_bits)
        out += zip(a[ok].tolist(), b[ok].tolist())
    return out


def _links(max_bits: int):
    """Over rows sorted by list: the links, list by list; a list may run over the end of a batch."""

    def run(batches):
        rest = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            # number the lists from 0 on
            change = np.zeros(len(cols[0]), bool)
            for c in cols[:-1]:
                change[1:] |= c[1:] != c[:-1]
            key = np.cumsum(change)
            last = int(np.searchsorted(key, key[-1]))
            rest = [c[last:] for c in cols]
            if last:
                yield _edges(key[:last], cols[-1][:last], max_bits)
        if rest is not None:
            yield _edges(np.zeros(len(rest[0]), np.int64), rest[-1], max_bits)

    return run


def _edges(key: np.ndarray, fp: np.ndarray, max_bits: int) -> pa.RecordBatch:
    out = np.array(_forests(key, fp.view(np.uint64), max_bits), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, seed_bytes: int = 3, block: int = 4096, sample: int = 64) -> DataFrame:
    """(u, v): links among the distinct fingerprints (column fp) whose components are those of all links within ``max_bits``."""
    need = 8 - max_bits
    if not 1 <= seed_bytes <= need:
        raise ValueError("seed_bytes is from 1 to 8 - max_bits")
    positions = 8 - (need - seed_bytes)
    masks = [sum(0xFF << 8 * p for p in c) for c in combinations(range(positions), seed_bytes)]
    entry = F.array(*[F.struct(F.lit(i).cast("byte").alias("list"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("bytes")) for i, m in enumerate(masks)])
    index = lambda df: df.select(F.explode(entry).alias("e"), "fp").select("e.list", "e.bytes", "fp")
    # Long lists by a sample: this only spreads work, it decides nothing about results.
    long = index(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0)).groupBy("list", "bytes").count().where(F.col("count") * sample >= block)
    long = small(checkpointed(long.select("list", "bytes", F.ceil(F.col("count") * sample / block).cast("int").alias("blocks"))), 100_000)
    block_of = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = (
        index(distinct)
        .join(long, ["list", "bytes"], "left")
        .withColumn("own", F.coalesce(block_of, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        .select("list", "bytes", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    by = ["list", "bytes", "lo", "hi"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links(max_bits), "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed_bytes: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits.  Null and empty
    texts have the fingerprint zero and are linked like any other.  Rows with a null id are returned; they carry links
    but no component takes its name from them (a component of such rows alone has a null id).  Repeated rows are
    returned as often as given; other columns are ignored; an empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    comps = connected_components(fingerprint_links(classes.select("fp"), max_bits, seed_bytes))
    linked = checkpointed(comps.join(classes, comps["node"] == classes["fp"]).select("fp", "root", "least_id"))
    joined = with_least(linked, "root", "least_id", linked.count(), "component_id").select("fp", "component_id")
    place = checkpointed(classes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")))
    return fps.join(place, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Of rows that repeat an id one stays.  Rows without an id can't be told apart, so all of them stay.
    """
    comps = simhash_components(docs, id_col=id_col, **how)
    ids = comps.where("doc_id = component_id").select(F.col("component_id").alias("_keep")).distinct()
    own = docs[id_col].cast("long")
    named = docs.where(own.isNotNull()).join(ids, own == ids["_keep"], "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(own.isNull()))
