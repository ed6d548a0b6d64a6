"""Periodic runs of words: Lyndon arrays under both orders of the alphabet, extensions matched before being used again.

A run is a stretch of consecutive words with smallest period q and at least two periods long that no neighbouring word
extends.  Each run has a Lyndon root under one of two opposite orders of the words: a sequence [i, j) where j
starts the next smaller suffix after i.  :func:`next_smaller` finds those for all i, with the length that the suffixes at
i and j have in common.  It compares words only, without suffix structures or hashes: where a stretch was matched against
an earlier one, what was found inside the earlier one holds in the later one too, and matching goes on where it ended.

Words that lie in no pair of neighbours that the document repeats are in no run of at least four words: in a run of period
q, each pair has its like q words before or after, save one pair in the middle, whose words belong to other repeated pairs.
They are left out first, by one sort of a chunk's pairs; the rest, whole, goes through the arrays.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_bytes

#: Bytes of texts whose runs are looked for together, unless one text is longer.
CHUNK_BYTES = 8 << 20
RUNS_DDL = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def next_smaller(t: list[int]) -> tuple[list[int], list[int]]:
    """For each i the start of the next smaller suffix (a suffix that ends first is smaller; len(t) if none), and how many words both share.

    Candidates j before i are a stack, each the nearest smaller suffix before the one above it.  The window is the match that
    reaches furthest: words from ``r - (r - i)`` up to r equal those ``d`` words before.  Inside, the pair ``d`` words before gives the
    answer unless its match reaches the window's end; then words are compared from there on, which moves the end.
    """
    n = len(t)
    nss, shared, before, shared_before = [n] * n, [0] * n, [-1] * n, [0] * n
    r = d = 0
    for i in range(1, n):
        j = i - 1
        k = 0
        if i < r:
            m, left = i - d, r - i
            while True:
                c = j - d
                popped = nss[c] == m
                x = shared[c] if popped else shared_before[m]
                if x >= left:
                    k = left
                    break
                if not popped:
                    before[i], shared_before[i], k = j, x, -1
                    break
                nss[j], shared[j] = i, x
                j = before[j]
            if k < 0:
                continue
        scan = True
        while scan:
            while i + k < n and t[i + k] == t[j + k]:
                k += 1
            r, d = i + k, i - j
            if r < n and t[r] > t[j + k]:
                before[i], shared_before[i] = j, k
                break
            while True:
                nss[j], shared[j] = i, k
                x, j = shared_before[j], before[j]
                if j < 0:
                    scan = False
                elif x < k:
                    before[i], shared_before[i], scan = j, x, False
                elif x > k:
                    continue
                break
    return nss, shared


def runs_of(t: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``least`` words in a sequence of word numbers, by start, then period."""
    n, found = len(t), []
    for order in (t, -t):
        nss, shared = (np.array(x, np.int64) for x in next_smaller(order.tolist()))
        i = np.arange(n)
        # matches of one period that end at the same word are one stretch: its first root gives where it starts
        ends = nss + shared
        _, first = np.unique(np.stack([nss - i, ends], 1), axis=0, return_index=True) if n else (None, i)
        a, b, end = i[first], nss[first], ends[first]
        back = np.zeros(len(a), np.int64)
        live = np.flatnonzero(a > 0)
        while len(live):
            live = live[t[a[live] - back[live] - 1] == t[b[live] - back[live] - 1]]
            back[live] += 1
            live = live[a[live] > back[live]]
        start, period = a - back, b - a
        ok = (end - start >= 2 * period) & (end - start >= least)
        found.append(np.stack([start, end - start, period], 1)[ok])
    out = np.unique(np.concatenate(found), axis=0) if n else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _repeated_pairs(doc: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
    """Which words are in a pair of neighbours that occurs again in the same document."""
    kept = np.zeros(len(word), bool)
    if len(word) < 2:
        return kept
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    if (int(doc[-1]) + 1) * n_words**2 < 2**63:
        key = (doc[inside] * n_words + word[inside]) * n_words + word[inside + 1]
    else:
        key = np.unique(np.stack([doc[inside], word[inside], word[inside + 1]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    at = inside[np.concatenate([order[1:][same], order[:-1][same]])]
    kept[at] = kept[at + 1] = True
    return kept


def chunk_runs(texts: pa.Array, least: int = 12) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text its runs, and which of its words to keep when repeats are collapsed."""
    lists = pc.ascii_split_whitespace(texts)
    values, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    some = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty piece
    coded, doc = values.filter(pa.array(some)).dictionary_encode(), doc[some]
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, n_words = len(word), len(coded.dictionary)
    begins = np.searchsorted(doc, np.arange(len(texts) + 1))
    stay = _repeated_pairs(doc, word, max(1, n_words)) if least >= 4 else np.ones(n, bool)
    change = np.ones(n + 1, bool)
    change[1:n] = (stay[1:] != stay[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(change)
    a, z = edge[:-1], edge[1:]
    long = stay[a] & (z - a >= least) if len(a) else np.zeros(0, bool)
    a, z = a[long], z[long]
    # stretches one after another, parted by numbers that occur once
    size = z - a + 1
    stops = np.cumsum(size) - 1
    at = np.repeat(a - (stops - (size - 1)), size) + np.arange(size.sum())
    seq = np.append(word, 0)[at]
    seq[stops] = n_words + np.arange(len(stops))
    found = runs_of(seq, least)
    drop = np.zeros(n + 1, np.int64)
    start = at[found[:, 0]] if len(found) else found[:, 0]
    np.add.at(drop, start + found[:, 2], 1)
    np.add.at(drop, start + found[:, 1], -1)
    kept = np.cumsum(drop)[:n] == 0
    of = doc[start] if len(found) else start
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    rows = np.stack([start - begins[of], found[:, 1], found[:, 2]], 1) if len(found) else found
    return [rows[cuts[i] : cuts[i + 1]] for i in range(len(texts))], [kept[begins[i] : begins[i + 1]] for i in range(len(texts))]


def _search(least: int):
    def run(batches):
        for keys, texts in pieces(batches, CHUNK_BYTES):
            runs, kept = chunk_runs(texts.cast(pa.string()), least)
            sizes, flat = [len(x) for x in runs], np.concatenate(runs)
            words = [x.as_py().split() for x in texts]
            collapsed = [b" ".join(w if k.all() else compress(w, k.tolist())).decode() for w, k in zip(words, kept)]
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
            for i in range(0, len(words), 1024):
                yield pa.RecordBatch.from_arrays([keys.slice(i, 1024), column.slice(i, 1024), pa.array(collapsed[i : i + 1024], pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) of each row: the runs of at least ``least`` words by start, then period, and the text without their repeats.

    Words are runs of bytes other than ASCII white space, compared as they stand.  ``collapsed`` has the words that no run
    contains after its first period, joined by one space.  A null or empty text has no runs and an empty text.  Rows
    are answered one by one, repeated rows and null ids too; other columns are ignored; an empty table gives no rows.
    No row leaves its task, and memory is that of one chunk of texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"))
    return rows.mapInArrow(_search(least), f"doc_id long, runs {RUNS_DDL}, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the ids (by crc32) have their words from some place on replaced by a repeated stretch; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("_w"))
    g = F.floor(F.col("_h") / 10)
    sized = words.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", g)
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))
    placed = sized.withColumn("_a", a.cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = (F.col("_n") - F.col("_a")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    made = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(cycle, F.lit(1), rest)), " ")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of each row of :func:`periodic_runs`: the number of runs, the longest (ties: smallest start, then period) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.l"), -F.col("best.p")
    return rows.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
