"""The prefix trie against dictionaries of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import tries
from tallywork.llm.common import fold_of

COLUMNS = "conv_id long, turn long, role string, text string, label int, depth string, node int, heavy int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], COLUMNS)


def trie(spark, rows, deal=100):
    conv = F.col("conv_id")
    return tries.prefix_trie(tries.rebuilt(tries.numbered_turns(frame(spark, rows)), conv - conv % deal, fold_of("conv_id", 6)))


def brute(rows, deal=100):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % deal, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def case(seed, n, deal):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(5 * n, n, replace=False).tolist():
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t if rng.random() < 0.97 else None if t == 0 else t, ["user", "assistant", None][int(rng.integers(0, 3))] if t else "user", f"t{int(rng.integers(0, 3))}é" * int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("seed,n,deal", [(1, 300, 100), (2, 40, 1000), (3, 5, 10)])
def test_against_prefixes(spark, seed, n, deal):
    rows = case(seed, n, deal)
    # one order only: rows of a conversation that share a turn
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert got(trie(spark, rows, deal)) == brute(rows, deal)


def test_hot_prefixes_are_split(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 900) for t in range(3)] + [(c, t, "user", f"own {c % 50} {t}") for c in range(900, 1200) for t in range(4)]
    rows += [(5000, t, "u", f"deep {t}") for t in range(300)] + [(5001, t, "u", f"deep {t}") for t in range(299)]
    assert got(trie(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = [(7, None, None, None), (7, 1, "", ""), (8, 0, "user", "x" * 50_000), (9, 2, "a:", "b"), (10, 2, "a", ":b"), (None, 1, "user", "lost")]
    assert got(trie(spark, rows)) == brute(rows)
    assert trie(spark, []).count() == 0
    repeated = [(c, 0, "user", "twice") for c in (600, 600, 601)]
    root = [r for r in got(trie(spark, repeated)) if r[1] == 0]
    assert len(root) == 1 and root[0][3] == 2


def test_louds_bits_give_the_parents():
    parent = np.array([-1, 0, 0, 1, 1, 2, 4])
    bits = tries.louds(parent)
    assert bits.tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0] and tries.parents(bits).tolist() == parent.tolist()


@pytest.mark.parametrize("shard_rows,forest_rows", [(1, 1), (5, 7), (10_000, 1)])
def test_shards_and_forests_of_few_rows(spark, shard_rows, forest_rows):
    rows = list({(r[0], r[1]): r for r in case(4, 60, 100)}.values())
    conv = F.col("conv_id")
    turns = tries.rebuilt(tries.numbered_turns(frame(spark, rows)), conv - conv % 100, fold_of("conv_id", 6))
    assert got(tries.prefix_trie(turns, shard_rows, forest_rows)) == brute(rows)
