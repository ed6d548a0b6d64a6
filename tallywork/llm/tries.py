"""The trie of conversations' prefixes, as succinct level-order tries of shards of prefixes.

Conversations are sequences of labels (one for each turn).  A node is a distinct prefix, named by a 16-byte digest of its
labels.  Nodes with many rows below them (``heavy``) form the upper levels; what hangs under them are shards, each small.
Shards are dealt out and built as forests in numpy: nodes in level order, the LOUDS bits (for each node a 1 for each child,
then a 0), the labels in the same order.  Parents are read off the bits, and values go up the tree by one ``add.at`` for
each level, the last first.  The upper levels are merged apart: counts by node, and the shards' sums added to every heavy node on
the path of the shard's first member.  Only rows of counts and digests move.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import small

#: Most rows (turns of members) that a shard may have, and the share of all rows.
SHARD_ROWS, SHARD_SHARE = 100_000, 1 / 4_000
#: Rows of whole shards that are built as one forest.
FOREST_ROWS = 200_000
#: Bytes of joined ids in one row of a node's list.
LIST_BYTES = 1 << 20
#: Heavy nodes that are broadcast at most; beyond that they are joined by shuffle.
MOST_HEAVY = 200_000

_ROOT = b"\0" * 16


def label(role: Column, text: Column) -> Column:
    """The digest of a turn; null parts count as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))


def numbered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, k, label, n_chars, n): turns numbered from 1 in the order of turn (null first), then role, then label; n turns in all.

    Rows without a conversation's id are of no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    t = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), label(role, text).alias("label"), F.length(text).cast("long").alias("n_chars"))
    whole = Window.partitionBy("conv_id")
    k = F.row_number().over(whole.orderBy(F.col("_turn").asc_nulls_first(), "_role", "label"))
    return t.select("conv_id", k.cast("long").alias("k"), "label", "n_chars").withColumn("n", F.max("k").over(whole))


def rebuilt(turns: DataFrame, base: Column, shared: Column) -> DataFrame:
    """(conv_id, depth, label, n_chars, n), where each conversation takes the first ``shared`` turns of conversation ``base`` (all if fewer, none if
    absent) in place of its own first ``shared``.  ``base`` and ``shared`` are functions of conv_id; a conversation left without turns has one row of depth 0.
    """
    turns = written(turns)
    convs = turns.where("k = 1").select("conv_id", F.col("n").alias("own"), base.cast("long").alias("base"), shared.cast("long").alias("shared"))
    most = convs.agg(F.max("shared")).first()[0] or 0
    heads = turns.where(F.col("k") <= most).select(F.col("conv_id").alias("base"), "k", "label", "n_chars", F.col("n").alias("base_n"))
    lengths = turns.where("k = 1").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    sized = convs.join(lengths, "base", "left").withColumn("taken", F.least("shared", F.coalesce("base_n", F.lit(0)))).withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).drop("base_n")
    sized = written(sized)
    out = ["conv_id", "depth", "label", "n_chars", "n"]
    taken = sized.where("taken > 0").join(heads.drop("base_n"), "base").where("k <= taken").withColumn("depth", F.col("k")).select(*out)
    kept = turns.drop("n").join(sized.select("conv_id", "shared", "taken", "n"), "conv_id").where("k > shared").withColumn("depth", F.col("taken") + F.col("k") - F.col("shared")).select(*out)
    none = sized.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("n_chars"), "n")
    return taken.unionByName(kept).unionByName(none)


_PATHS = "conv_id long, depth long, n_chars long, below long, node binary, parent binary"


def _paths(batches):
    """Over turns sorted by conversation and depth: the nodes on each conversation's path, the root first; ``below`` counts the turns from there on."""
    now, at = None, _ROOT
    for b in batches:
        rows = []
        for conv, depth, name, chars, n in zip(*(b.column(i).to_pylist() for i in range(5))):
            if conv != now:
                now, at = conv, _ROOT
                rows.append((conv, 0, 0, n + 1, _ROOT, None))
            if depth:
                node = hashlib.blake2b(at + name, digest_size=16).digest()
                rows.append((conv, depth, chars, n - depth + 1, node, at))
                at = node
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()] * 2)], ["conv_id", "depth", "n_chars", "below", "node", "parent"])


def louds(parent: np.ndarray) -> np.ndarray:
    """The bits of a tree in level order, of which ``parent`` has each node's parent (the root's is -1): a 1 for each child, then a 0."""
    degree = np.bincount(parent[1:], minlength=len(parent))
    bits = np.ones(len(parent) + int(degree.sum()), np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """Each node's parent by the bits: the k-th 1 is node k, and the zeros before it tell whose child it is."""
    return np.concatenate([[-1], np.cumsum(bits == 0)[bits == 1]])


def forest(depth: np.ndarray, node: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, first, of, levels): LOUDS bits of rows' nodes under one root, a row for each node in level order, each row's node, where levels begin.

    Node 0 is the root that holds the shards together; ``node`` and ``above`` are digests as S16, ``depth`` as in the whole trie.
    """
    order = np.lexsort((node, depth))
    d, name, up = depth[order], node[order], above[order]
    new = np.ones(len(order), bool)
    new[1:] = name[1:] != name[:-1]
    head = order[new]
    rank = np.cumsum(new) - 1
    of = np.empty(len(order), np.int64)
    of[order] = rank
    d, name, up = d[new], name[new], up[new]
    # level order: nodes of a level by their parents' places; shards start at different depths, so levels count from a shard's top
    by_name = np.argsort(name)
    at = np.minimum(np.searchsorted(name, up, sorter=by_name), len(name) - 1)
    above_at = np.where(name[by_name[at]] == up, by_name[at], -1)
    level = np.zeros(len(d), np.int64)
    begins = np.flatnonzero(np.diff(d, prepend=-1))
    for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(d)]):
        level[a:z] = np.where(above_at[a:z] >= 0, level[above_at[a:z]] + 1, 0)
    place, parent, levels, before = np.zeros(len(d), np.int64), [np.array([-1])], [1], 1
    for x in range(int(level.max(initial=-1)) + 1):
        here = np.flatnonzero(level == x)
        p = np.where(above_at[here] >= 0, place[above_at[here]], 0)
        sorted_ = np.argsort(p, kind="stable")
        place[here[sorted_]] = before + np.arange(len(here))
        parent.append(p[sorted_])
        before += len(here)
        levels.append(before)
    by_place = np.empty(len(d), np.int64)
    by_place[place - 1] = head
    return louds(np.concatenate(parent)), by_place, place[of], np.array(levels)


_NODES = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "S16")


def _binary(digests: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary())


def _rollup(conv, depth, chars, below, node, above) -> pa.RecordBatch:
    bits, head, of, levels = forest(depth, node, above)
    parent, n = parents(bits), len(head) + 1
    members = np.bincount(of, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, of, conv)
    children = np.bincount(parent[1:], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), np.zeros(n, np.int64)
    saved[1:] = (members[1:] - 1) * chars[head]
    for a, z in zip(levels[-2::-1].tolist(), levels[:0:-1].tolist()):
        np.add.at(leaves, parent[a:z], leaves[a:z])
        np.add.at(saved, parent[a:z], saved[a:z])
    end = np.flatnonzero(below == 1)
    end = end[np.lexsort((conv[end], of[end]))]
    cuts = np.searchsorted(of[end], np.arange(1, n + 1)).tolist()
    ids, none = conv[end].tolist(), hashlib.sha256(b"").hexdigest()
    ends = [hashlib.sha256(",".join(map(str, ids[a:z])).encode()).hexdigest() if a < z else none for a, z in zip(cuts, cuts[1:])]
    up = np.where(parent[1:] > 0, least[parent[1:]], 0)
    return pa.RecordBatch.from_arrays(
        [_binary(node[head]), _binary(above[head]), pa.array(least[1:]), pa.array(depth[head]), pa.array(up, pa.int64(), mask=parent[1:] == 0),
         *(pa.array(x[1:].astype(np.int64)) for x in (members, children, leaves, saved)), pa.array(ends, pa.string())], ["node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    )


def _shards(most: int):
    """Over light rows sorted by shard: their nodes, whole shards of about ``most`` rows at a time."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        have = 0

        def build():
            return _rollup(*(np.concatenate([h[i] for h in held]) for i in range(1, 7)))

        for b in batches:
            if not b.num_rows:
                continue
            part = [_digests(b.column(i)) if i in (0, 5, 6) else b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            if have >= most:
                # rows of the shard that is open stay with it
                last = held[-1][0][-1]
                cut = int(np.searchsorted(part[0] != last, True))
                if cut:
                    held.append([x[:cut] for x in part])
                if cut < b.num_rows:
                    yield build()
                    held, have = [], 0
                part = [x[cut:] for x in part]
            if len(part[0]):
                held.append(part)
                have += len(part[0])
        if held:
            yield build()

    return run


def _lists(batches):
    """Over (node, conv_id) in order: each node's ids joined, a bounded part of them in a row: (node, conv_id of the first, ids)."""
    rows, now, first, ids, size = [], None, None, [], 0
    for b in batches:
        for node, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (node != now or size >= LIST_BYTES):
                rows.append((now, first, ",".join(ids).encode()))
                ids, size = [], 0
            if not ids:
                now, first = node, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(rows) >= 16:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], ["node", "first", "ids"])
            rows = []
    if ids:
        rows.append((now, first, ",".join(ids).encode()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], ["node", "first", "ids"])


def _hashed(batches):
    """Over lists in order: the digest of each node's whole list."""
    rows, now, h = [], None, None
    for b in batches:
        for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if node != now:
                if h:
                    rows.append((now, h.hexdigest()))
                now, h = node, hashlib.sha256(ids)
            else:
                h.update(b"," + ids)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.string()))], ["node", "ends_sha256"])
            rows = []
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends_sha256"])


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """One row for each node of the trie of conversations' prefixes, of turns (conv_id, depth, label, n_chars, n) as :func:`rebuilt` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes in the
    subtree), saved_tokens (over the subtree, characters of a node's turn for each member but one), ends_sha256 (of the
    members that end there, ascending, comma-joined).  The root has depth 0; an empty table gives no rows.
    A node whose subtree has more than ``shard_rows`` rows, or ``SHARD_SHARE`` of all, is heavy.
    A conversation's path is hashed in order, so its turns stream through one task; only a digest of it is held.
    """
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "depth", "label", "n_chars", "n")
    paths = written(dealt.mapInArrow(_paths, _PATHS))
    limit = min(shard_rows, max(16, int(paths.count() * SHARD_SHARE)))
    # every node whose sum is over the limit, and the root; its values come with it
    upper = paths.groupBy("node").agg(
        F.sum("below").alias("rows"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("n_chars").alias("n_chars"), F.first("parent").alias("parent")
    )
    heavy = written(upper.where((F.col("rows") > limit) | (F.col("depth") == 0)))
    names = small(heavy.select("node", F.lit(True).alias("heavy")), MOST_HEAVY)
    tagged = paths.join(names, "node", "left")
    top = F.min_by("node", F.when(F.col("heavy").isNull(), F.col("depth"))).over(Window.partitionBy("conv_id"))
    split = written(tagged.withColumn("shard", top).select("shard", "conv_id", "depth", "n_chars", "below", "node", "parent", "heavy"))
    light = split.where("heavy IS NULL").drop("heavy")
    nodes = written(light.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(forest_rows), _NODES))
    # what each heavy node's own children give, then what goes up to all heavy nodes above
    tops = nodes.where("parent_conv_id IS NULL")
    below = tops.select("parent").unionByName(heavy.where("parent IS NOT NULL").select("parent")).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    own = heavy.join(below, "node", "left").select("node", "conv_id", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "depth")
    own = written(own)
    gives = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens").unionByName(own.select("conv_id", "depth", "n_leaves", "saved_tokens"))
    gives = gives.groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    path = split.where("heavy").select("conv_id", "node", "depth").join(gives.select("conv_id").distinct(), "conv_id", "left_semi").join(gives, ["conv_id", "depth"], "left")
    path = path.select("node", F.sum("n_leaves").over(upward).alias("n_leaves"), F.sum("saved_tokens").over(upward).alias("saved_tokens"))
    sums = path.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ending = split.where("heavy AND below = 1").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    lists = ending.mapInArrow(_lists, "node binary, first long, ids binary").repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")
    up = small(heavy.select(F.col("node").alias("parent"), F.col("conv_id").alias("_up")), MOST_HEAVY)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    heads = heavy.join(sums, "node").join(own.select("node", "n_children"), "node").join(lists, "node", "left").join(up, "parent", "left")
    heads = heads.select("conv_id", "depth", F.col("_up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return nodes.join(up, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up")).select(*out).unionByName(heads)
