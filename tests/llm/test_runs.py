"""Periodic runs against their definition, and Lyndon arrays against comparing suffixes."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tallywork.llm import runs
from tallywork.llm.common import table

from .test_operators import DATA, EDGE, frame


def brute_runs(t, least=12):
    """Maximal stretches of each period from the smallest up; a stretch that a smaller period explains is none."""
    n, out = len(t), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and t[j] == t[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(t[x] == t[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_digest(w):
    found = brute_runs(w)
    drop = {x for s, n, q in found for x in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def digest_rows(df):
    return [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()]


def test_lyndon_arrays_and_runs():
    rng = random.Random(7)
    for _ in range(1500):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 2, 3, 5])
        t = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.4:
            p = rng.randint(1, max(1, n // 3))
            t = [t[i % p] if i > 3 else t[i] for i in range(n)]
        nss, shared = runs.next_smaller(t)
        assert nss == [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n)]
        for i, j in enumerate(nss):
            assert shared[i] == next((x for x in range(n - j) if t[i + x] != t[j + x]), n - j)
        for least in (1, 5, 12):
            assert [tuple(x) for x in runs.runs_of(np.array(t, np.int64), least).tolist()] == brute_runs(t, least)


@pytest.mark.parametrize("kind", ["one", "fib", "steps", "two"])
def test_time_grows_with_length(kind):
    def make(n):
        if kind == "fib":
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            return b[:n]
        return {"one": [0] * n, "steps": ([0] * 300 + [1]) * (n // 301), "two": [0] * (n // 2) + [1] + [0] * (n // 2)}[kind]

    began = time.time()
    runs.next_smaller(make(500_000))
    assert time.time() - began < 20  # squared, it would take hours


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("ab") if i % 2 else rng.choice(["x", "y", "zz", "é"]) for _ in range(rng.randrange(90)))) for i in range(150)]
    texts += [(1000 + i, (f"p{i} q r s t " * i + "end")) for i in range(9)] + [(None, "a b " * 20), (7, None), (7, ""), (8, " \t\n")]
    got = digest_rows(runs.run_digests(runs.periodic_runs(runs.with_planted_repeats(frame(spark, texts)))))
    assert sorted(got, key=str) == sorted(((i, *brute_digest(brute_words(i, t))) for i, t in texts), key=str)


def test_given_documents(spark):
    docs = table(spark, DATA, "documents").where("length(text) < 1500")
    got = digest_rows(runs.run_digests(runs.periodic_runs(runs.with_planted_repeats(docs))))
    assert sorted(got) == sorted((r.doc_id, *brute_digest(brute_words(r.doc_id, r.text))) for r in docs.collect()) and any(r[1] for r in got)


def test_edges(spark):
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in runs.periodic_runs(frame(spark, EDGE)).collect()}
    assert got[1, ""] == got[2, ""] == got[3, ""] == []
    assert got[7, "word"] == [(0, 30_000, 1)] and got[6, "é ü 中文 😀"] == [(0, 200, 4)]
    assert runs.periodic_runs(frame(spark, [])).count() == 0
    assert runs.run_digests(runs.periodic_runs(frame(spark, EDGE))).count() == len(EDGE)
    short = runs.periodic_runs(frame(spark, [(1, "a a b a a b")]), least=2).first()
    assert [tuple(x) for x in short.runs] == [(0, 6, 3), (0, 2, 1), (3, 2, 1)] or sorted(tuple(x) for x in short.runs) == [(0, 2, 1), (0, 6, 3), (3, 2, 1)]


def test_runs_stay_inside_their_documents(spark):
    got = runs.periodic_runs(frame(spark, [(i, "a b c d e f") for i in range(6)])).collect()
    assert all(not r.runs for r in got)
