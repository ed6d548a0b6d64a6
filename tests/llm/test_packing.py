"""Packing: every piece once, in place, against the tokenizer's own ids; and the number of sequences against a lower bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywork.llm import packing
from tallywork.llm.common import table

from .test_operators import DATA, EDGE, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_pieces(texts, capacity):
    tok, out = Tokenizer.from_file(PATH), []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        out += [(i, k, a, ids[a:z]) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    return out


def hold(rows, capacity):
    """Sequences without gaps, none too long; returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [1024, 7])
def test_pieces_and_places(spark, capacity):
    texts = [*EDGE[:7], (9, "a <|endoftext|>  <|endoftext|>b"), (10, "\n\n   x\t　 y " * 400), (11, "it's 12½ — né'LL"), (None, None)]
    rows = packing.pack_documents(frame(spark, texts), PATH, capacity).collect()
    got = sorted(((r.doc_id, r.piece, r.start, list(r.ids)) for r in rows), key=str)
    assert got == sorted(brute_pieces(texts, capacity), key=str)
    assert all(r.length == len(r.ids) for r in rows)
    hold(rows, capacity)


def test_query_over_documents(spark):
    docs = table(spark, DATA, "documents")
    rows = packing.pack_documents(docs, PATH, result=packing.crc).collect()
    want = brute_pieces([(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((i, k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, k, a, x in want)
    n, total = hold(rows, 1024), sum(r.length for r in rows)
    assert n <= -(-total // 1024) * 1.05 + 2


def test_long_text_that_the_fast_library_gives_up(spark):
    text = " " * 2_000_000 + "a"
    enc = packing.Encoder(PATH)
    assert enc(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids and enc.slow is not None


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
    assert packing.pack(spark.createDataFrame([], "key long, length int"), 10).count() == 0


@pytest.mark.parametrize("block", [200_000, 1_000])
@pytest.mark.parametrize("kind", ["uniform", "large", "tiny", "two"])
def test_rounds_come_near_the_bound(spark, kind, block, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = np.random.default_rng(5)
    n = 20_000
    lengths = {"uniform": rng.integers(1, 1024, n), "large": rng.integers(600, 1025, n), "tiny": rng.integers(1, 4, n), "two": np.where(rng.random(n) < 0.5, 700, 300)}[kind]
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "key long, length int").repartition(16)
    sizes = dict(enumerate(lengths.tolist()))
    placed = packing.pack(items, 1024).collect()
    assert sorted(r.key for r in placed) == list(range(n))
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, sizes[r.key]))
    for places in by.values():
        at = 0
        for o, x in sorted(places):
            assert o == at
            at += x
        assert at <= 1024
    alone = packing.best_fit(lengths.astype(np.int64), 1024)[0].max() + 1
    assert len(by) <= alone * (1.001 if block > n else 1.015) + 3


def test_many_tasks_in_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MEMBERS", 500)
    lengths = np.random.default_rng(6).integers(1, 900, 6_000)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "key long, length int").repartition(40)
    placed = packing.pack(items, 1024).select("key", "sequence_id").collect()
    assert len({r.key for r in placed}) == 6_000 and len({r.sequence_id for r in placed}) <= lengths.sum() / 1024 * 1.02


@pytest.mark.parametrize("row", [(1, 0), (1, 11), (None, 3), (1, None)])
def test_wrong_items_are_an_error(spark, row):
    with pytest.raises(Exception, match="from 1 to 10"):
        packing.pack(spark.createDataFrame([row], "key long, length int"), 10).collect()


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([6, 8, 2, 4, 1]), 10)
    assert bins.tolist() == [1, 0, 0, 1, 2] and offsets.tolist() == [0, 0, 8, 6, 0]
