"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, so that all have the same length and the largest inner product is the least distance.
Centroids are fitted on a bounded sample.  Every vector is put in the list of its nearest centroid, and one near a
boundary in the lists of several.  A query searches the centroids by a graph that is held in memory, and reads the
lists whose centroid is at most ``1 + prune`` times as far as the nearest.  Lists are read in blocks of bounded size, as
are the queries of a list, so neither a popular list nor a vector that many rows repeat falls to one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small


def usable_like(rows: DataFrame, length: int | None, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the finite vectors of ``length`` (None: any) that are not zero."""
    v = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.lit(True) if length is None else F.size("v") == length) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    )


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of the most frequent length that are finite and not zero, as doubles; rows without an id take no part."""
    good = usable_like(rows, None, id_col, vector_col)
    first = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (first["n"] if first else 0))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over ``longest`` with a component that makes their length one."""
    y = x / longest
    return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]


def far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds; a centroid that loses all rows starts again from a row of the largest cluster, which keeps lists balanced."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = np.concatenate([far(p, c).argmin(1) for p in np.array_split(x, max(1, len(x) // 2048))])
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for empty in np.flatnonzero(n == 0):
            c[empty] = x[rng.choice(np.flatnonzero(own == n.argmax()))]
    return c


class Graph:
    """Centroids linked to their nearest ones; a beam search from a few entries finds those near a query."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        d = np.min(degree + 1) if len(c) > degree else len(c) - 1
        near = np.concatenate([np.argsort(far(p, c), 1, kind="stable")[:, 1 : d + 1] for p in np.array_split(c, max(1, len(c) // 512))]) if d else np.zeros((1, 0), int)
        # links both ways, and a ring, so that every centroid can be reached
        links = [set(r.tolist()) for r in near]
        for i, r in enumerate(near.tolist()):
            for j in r:
                links[j].add(i)
            links[i].add((i + 1) % len(c))
        self.links = [np.array(sorted(x), int) for x in links]
        self.entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of about ``beam`` nearest centroids, nearest first."""
        seen = np.zeros(len(self.c), bool)
        done = np.zeros(len(self.c), bool)
        ids = self.entries
        seen[ids] = True
        dist = ((self.c[ids] - q) ** 2).sum(1)
        while True:
            todo = np.flatnonzero(~done[ids])
            if not len(todo):
                return ids, dist
            at = ids[todo[:8]]
            done[at] = True
            new = np.unique(np.concatenate([self.links[i] for i in at]))
            new = new[~seen[new]]
            seen[new] = True
            ids = np.r_[ids, new]
            dist = np.r_[dist, ((self.c[new] - q) ** 2).sum(1)]
            best = np.argsort(dist, kind="stable")[:beam]
            ids, dist = ids[best], dist[best]


def _post(sent, copies: int, slack: float):
    """Each vector to the list of its nearest centroid, and to those at most ``1 + slack`` times as far."""

    def run(batches):
        c, longest = sent.value["graph"].c, sent.value["longest"]
        for b in batches:
            if not b.num_rows:
                continue
            d = far(lifted(matrix(b.column(1)), longest), c)
            near = np.argsort(d, 1, kind="stable")[:, :copies]
            dist = np.take_along_axis(d, near, 1)
            row, col = np.nonzero(dist <= dist[:, :1] * (1 + slack) ** 2)
            t = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int32)), b.column(0).take(t), b.column(1).take(t)], ["list", "id", "v"])

    return run


def _route(sent, probes: int, prune: float | None):
    """Each query to the lists that distance-ratio pruning leaves; without pruning to its ``probes`` nearest lists, all of them compared."""

    def run(batches):
        graph, longest = sent.value["graph"], sent.value["longest"]
        for b in batches:
            lists, rows = [], []
            for i, q in enumerate(matrix(b.column(1)) if b.num_rows else ()):
                q = np.r_[q / np.sqrt((q * q).sum()), 0.0]  # a query's length does not matter
                if prune is None:
                    keep = np.argsort(((graph.c - q) ** 2).sum(1), kind="stable")[:probes]
                else:
                    ids, d = graph.search(q, probes)
                    keep = ids[d <= d[0] * (1 + prune) ** 2]
                lists += keep.tolist()
                rows += [i] * len(keep)
            t = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0).take(t), b.column(1).take(t)], ["list", "id", "v"])

    return run


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _distinct(p: np.ndarray, pid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that repeat both id and vector, so that k rows are k candidates."""
    if len(np.unique(pid)) == len(pid):
        return p, pid
    at = np.array(list({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(pid.tolist(), p))}.values()))
    return p[at], pid[at]


def _scan(k: int):
    """Over rows sorted by block, vectors before queries: each query's best k of the block's vectors, its own row excepted."""

    def best(out, q, qid, p, pid):
        if not len(pid):
            return
        s = q @ p.T
        s[qid[:, None] == pid] = -np.inf
        for i in range(len(qid)):
            row = s[i]
            if len(row) > k:
                bar = np.partition(row, -k)[-k]
                at = np.flatnonzero(row >= bar - 1e-9 * max(1.0, abs(bar) if np.isfinite(bar) else 1.0))
            else:
                at = np.arange(len(row))
            at = at[np.isfinite(row[at])]
            exact = (p[at] * q[i]).sum(1)  # row by row, so that equal vectors have equal scores
            t = _top(exact, pid[at], k)
            out.append((np.full(len(t), qid[i]), pid[at][t], exact[t]))

    def run(batches):
        key, ps, pids, p, pid = None, [], [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            ids, v = b.column(4).to_numpy(zero_copy_only=False), matrix(b.column(5))
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            out: list = []
            for a, z in zip(cuts[:-1], cuts[1:]):
                if key != (block := tuple(keys[a, :3].tolist())):
                    key, ps, pids, p = block, [], [], None
                if keys[a, 3] == 0:
                    ps.append(v[a:z])
                    pids.append(ids[a:z])
                elif ps:
                    if p is None:
                        p, pid = _distinct(np.concatenate(ps), np.concatenate(pids))
                    for y in range(a, z, 256):
                        best(out, v[y : min(z, y + 256)], ids[y : min(z, y + 256)], p, pid)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def nearest(
    rows: DataFrame, is_query, k: int = 20, list_size: int = 128, sample: int = 32_768, most_lists: int = 4096, copies: int = 4, slack: float = 0.1, probes: int = 128, prune: float = 0.6, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest to each row that ``is_query`` (a Column) picks.

    Nearest is the largest inner product in double precision, ties to the smaller id; a query's own id is no candidate.
    Null, zero and non-finite vectors, vectors of another length than most and rows without an id take no part.  Rows that
    repeat an id count as one candidate where their vectors are equal.  A query has fewer than ``k`` rows only if there are
no more candidates.  An empty table gives no rows.  ``sample`` bounds
    what centroids are fitted on, ``most_lists`` how many there are; all rows are indexed.
    """
    good = usable(rows, id_col, vector_col)
    stats = good.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    spark = rows.sparkSession
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = max(1, round(stats["n"] / sample))
    fit = np.array([r["v"] for r in good.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(part)) == 0).orderBy(F.xxhash64("id"), "id").limit(sample).collect()] or [good.first()["v"]])
    lists = int(min(most_lists, max(1, stats["n"] // list_size), len(fit)))
    sent = spark.sparkContext.broadcast({"graph": Graph(fit_centroids(lifted(fit, stats["longest"]), lists)), "longest": stats["longest"]})
    posts = good.mapInArrow(_post(sent, copies, slack), "list int, id long, v array<double>")
    asked = rows.where(is_query)
    asked = usable_like(asked, len(fit[0]), id_col, vector_col)
    count = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["list", "bv", "bq"]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame, probes: int, prune: float | None) -> DataFrame:
        routes = asked.mapInArrow(_route(sent, probes, prune), "list int, id long, v array<double>")
        # lists and their queries in blocks; one row for each list, so their number is bounded
        sizes = small(checkpointed(count(posts, "nv").join(count(routes, "nq"), "list")), most_lists)
        left = posts.join(sizes, "list").select("list", own("nv").alias("bv"), every("nq").alias("bq"), F.lit(0).alias("kind"), "id", "v")
        right = routes.join(sizes, "list").select("list", every("nv").alias("bv"), own("nq").alias("bq"), F.lit(1).alias("kind"), "id", "v")
        found = left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(_scan(k), "query_id long, vec_id long, score double")
        # a vector that stands in several lists has one dense rank
        return checkpointed(found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["query_id", "vec_id", "rank"]).select("query_id", "rank", "vec_id", "score"))

    out = searched(asked, probes, prune)
    while probes < lists or prune is not None:
        # queries whose lists hold fewer than k others are sent to more lists, at last to all
        full = out.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = checkpointed(asked.join(full, "id", "left_anti"))
        if short.isEmpty():
            break
        probes, prune = min(lists, 4 * probes), None
        out = out.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(searched(short, probes, prune))
    return out
