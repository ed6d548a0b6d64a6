"""Operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywork.llm import bpe, chat, decontaminate, lm, neighbours, passages, pii, queries, recurrent, simhash, toxicity, urls
from tallywork.llm.common import TOKENIZERS, fold_of, table
from tallywork.llm.graph import connected_components

DATA = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns whose names operators use inside.
CLASH = "doc_id long, text string, fp string, b int, score string, base int, added int, spans string, component_id int, _text int, _keep int, _bad int"


def frame(spark, texts, extra=True):
    rows = [(i, t, "x", 1, "y", 2, 3, "z", 4, 5, 6, 7) for i, t in texts]
    df = spark.createDataFrame(rows, CLASH)
    return df if extra else df.select("doc_id", "text")


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two three four FIVE six seven eight nine ten"), (5, "One two three four FIVE six seven eight nine ten"), (6, "é ü 中文 😀 " * 50), (7, "word " * 30_000), (8, "x" * 200_000), (None, "no id here at all")]


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_edges(spark):
    got = sorted(simhash.simhash_components(frame(spark, EDGE)).collect(), key=str)
    want = [(i, f"{brute_fingerprint(t):016x}") for i, t in EDGE]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter(want)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[3, "0" * 16] == 1
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    kept = simhash.keep_one(frame(spark, EDGE))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame(spark, []).columns and 2 not in ids and ids.count(None) == 1 and ids.count(5) == 1


@pytest.mark.parametrize("block", [4096, 16])
def test_links_are_whole(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centre for _ in range(60)} | {int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    comps = {r.node % 2**64: r.root for r in connected_components(simhash.fingerprint_links(df, block=block, sample=1)).collect()}
    want = brute_components(fps)
    groups = lambda label: {frozenset(g) for g in _groups(fps, label) if len(g) > 1}
    assert groups(lambda i: comps.get(fps[i], ("single", i))) == groups(lambda i: want[i])


def _groups(items, label):
    out = {}
    for i, x in enumerate(items):
        out.setdefault(label(i), []).append(x)
    return out.values()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got[i] for i in range(61)) == {0} and set(got[i] for i in range(1000, 1050)) == {1000} and got[2001] == 2000


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(700, None, "a"), (720, [0.0] * 8, "a"), (740, [float("nan")] * 8, "a"), (760, [1.0], "a"), (None, [1.0] * 8, "a"), (780, [None] * 8, "a"), (60, x[60].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, list_size=32, block=50).collect()
    s = x @ x.T
    hit = n = 0
    for q in range(0, 600, 20):
        own = [(-round(float((x[q] * x[j]).sum()), 9), j) for j in range(600) if j != q]
        want = [j for _, j in sorted(own)[:5]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(v - s[q, j]) < 1e-9 for _, j, v in mine)
        hit, n = hit + len(set(want) & {j for _, j, _ in mine}), n + 5
    assert hit / n >= 0.9 and {r.query_id for r in got} == set(range(0, 600, 20))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r.rank)][:2] == [101, 102]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_neighbours_with_repeats_and_small_clusters(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    x[:3] = [50.0, 0, 0, 0, 0, 0] + rng.normal(size=(3, 6)) * 1e-3  # a small tight cluster far from the others
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(30 if i % 3 == 1 else 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id").isin(0, 60), k=20, list_size=8, prune=0.0, probes=2).collect()
    assert Counter(r.query_id for r in got) == {0: 20, 60: 20} and len({(r.query_id, r.vec_id) for r in got}) == 40
    whole = neighbours.nearest(df, F.col("vec_id") == 60, k=20, list_size=10**6).orderBy("rank").collect()
    assert [r.vec_id for r in whole] == sorted((j for j in range(300) if j != 60), key=lambda j: (-round(float((x[60] * x[j]).sum()), 9), j))[:20]


def test_a_very_common_vector_and_far_groups_have_whole_results(spark):
    rng = np.random.default_rng(15)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    one, rest = unit(rng.normal(size=8)), unit(rng.normal(size=(30, 8)))
    rows = [(i, one.tolist()) for i in range(1500)] + [(1500 + i, v.tolist()) for i, v in enumerate(rest)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 20)).collect()
    for q in (0, 20):  # ties of equal vectors go to the smaller ids
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(21) if i != q]
    x = np.concatenate([unit(rng.normal(size=(12, 8)) * 0.01 + np.eye(8)[0]), unit(rng.normal(size=(1500, 8)) * 0.1 - np.eye(8)[0])])
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    want = sorted(range(1, len(x)), key=lambda j: -float((x[0] * x[j]).sum()))[:20]
    assert len(got) == 20 and len({r.vec_id for r in got} & set(want)) >= 18


# --- chat --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b\\\\", "<s>[user]\nhi</s>\n", "", None, "x" * 100_000, "]\n</s>", "\\"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)] + [(2, 0, None, "t"), (2, 0, None, "t"), (None, 1, "as]sis[tant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seg = chat.format_conversations(chat.message_events(df))
    whole = "".join(r.segment for r in sorted(seg.where("conv_id = 1").collect(), key=lambda r: r["at"]))
    assert chat.parse(whole) == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    got = {r.conv_id: r for r in chat.digests(seg).collect()}
    assert got[1].loss_sha256 == hashlib.sha256("".join((t or "") for i, t in enumerate(texts) if i % 2).encode()).hexdigest()
    assert got[1].formatted_chars == len(whole) and got[1].n_turns == 8 and got[2].n_turns == 2 and got[None].n_turns == 1
    assert chat.digests(chat.format_conversations(chat.message_events(df.limit(0)))).count() == 0


def test_chat_folds_events(spark):
    ev = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "He"), (1, 3, 2, "delta", None, "llo"), (1, 4, 3, "message", "user", "more"), (1, 5, 4, "message", "assistant", "old"),
        (1, 6, 1, "edit", "user", "hi!"), (1, 7, 2, "regenerate", "assistant", "He"), (1, 8, 2, "delta", None, "y"), (1, 9, 5, "message", "user", "next"), (2, 1, 1, "delta", "assistant", "a"), (2, 2, 1, "delta", None, "b"),
    ]
    got = chat.fold(spark.createDataFrame(ev, "conv_id long, seq long, message_id long, kind string, role string, text string")).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(1, "user", "hi!"), (1, "assistant", "Hey"), (1, "user", "next"), (2, "assistant", "ab")]
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold(spark.createDataFrame([(1, 1, 1, "zap", "u", "t")], "conv_id long, seq long, message_id long, kind string, role string, text string")).collect()


# --- language model ----------------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 12, 40) for _ in range(6)]
    p = recurrent.initial(np.arange(1.0, 13.0), 4, 5)
    before = recurrent.score(p, docs, 0).sum()
    for _ in range(30):
        recurrent.train(p, docs, 0)
    assert recurrent.score(p, docs, 0).sum() > before
    h = rng.normal(size=(1, 5)).astype(np.float32)
    assert abs(sum(np.exp(recurrent.log_probs(p, np.repeat(h, 12, 0), np.arange(12)))) - 1) < 1e-4


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 12, n) for n in (50, 3, 17, 0, 1)]
    p = recurrent.initial(np.arange(1.0, 13.0), 4, 5)
    assert np.allclose(recurrent.score(p, docs, 0, window=4), recurrent.score(p, docs, 0, window=64), atol=1e-5)
    assert np.allclose(recurrent.score(p, docs, 0), np.concatenate([recurrent.score(p, [d], 0) for d in docs]), atol=1e-5)


def test_language_model(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").unionByName(frame(spark, [(i and i + 10**6, t) for i, t in EDGE], False))
    got = lm.score_documents(docs, fold_of("doc_id", 7) == 2, vocabulary=500).collect()
    toks = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(AZ)) + [""]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in toks), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == want
    own = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert lm.score_documents(docs.limit(0), F.lit(False)).count() == 0
    assert all(r.score <= 0 for r in lm.score_documents(docs.limit(5), F.lit(True)).collect())


# --- decontamination ---------------------------------------------------------------------------------------------------


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "One two three four FIVE six seven eight nine ten eleven twelve thirteen fourteen"), (2, "one"), (3, None), (4, "!!"), (None, "中文")], "item_id long, text string")
    docs = frame(spark, [*EDGE, (9, "a b " * 100 + " one, two; three four five six seven eight nine ten eleven twelve thirteen")])
    for windows in (500_000, 5):
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, max_windows=windows).collect()}
        assert (got[1].n_words, got[2].n_hit, got[3].contaminated) == (0, 0, False)
        assert (got[4].n_hit, got[4].n_items, got[4].contaminated) == (1, 1, True)
        assert (got[9].n_words, got[9].n_hit, got[9].n_items) == (213, 13, 2)
        assert got[6].n_hit == 50 and got[9].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_searcher_against_brute_force():
    rng = np.random.default_rng(5)
    words = [b"%d" % x for x in rng.integers(0, 3, 3000)]
    for m in (1, 2, 3, 5):
        pats = list({tuple(words[i : i + m]) for i in rng.integers(0, 2900, 20).tolist()})
        want = {(i, p) for p in pats for i in range(len(words) - m + 1) if tuple(words[i : i + m]) == p}
        assert set(decontaminate.Searcher(pats).find(words)) == want


# --- BPE ---------------------------------------------------------------------------------------------------------------


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    odd = ["Hi <|endoftext|> x<|startoftext|>y's don't 12 ½", "e\u0301 \u00a0 \u0345 ﬁ İ ΣΑΣ a\x1cb\x0bc\x85d", "中文 👩‍👩‍👧 'S 's"]
    docs = frame(spark, EDGE + [(20 + i, t) for i, t in enumerate(odd)])
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json").collect())
    assert got == want
    assert bpe.encode_documents(docs.limit(0), f"{TOKENIZERS}/word_bpe_49k.json").count() == 0
    with pytest.raises(ValueError):
        bpe.tokenizer_text(f"{TOKENIZERS}/byte_bpe_50k.json")


# --- URLs --------------------------------------------------------------------------------------------------------------

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = m[1].translate(AZ), m[2]
    fits = [(-len(r), r) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, sorted(fits)[0][1] if fits else None


def test_urls(spark):
    odd = [None, "", "no scheme", "://", "http://A.Com/en/1?x#y", "https://example.com/en/77", "http://xexample.com/en/7", "http://example.com/en", "a://b://c/d", "http://h#/p", "http://h?q/://z", "http://EXAMPLE.net/de/81", "http://example.net/de/9", "x://org/es/", "http://com/en/\nz"]
    rows = [(i, u, i % 2) for i, u in enumerate(odd)] + [(0, None, None)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, label int"), urls.rules_frame(spark, RULES)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *brute_url(u)) for i, u, _ in rows)
    verdict = {r: v for v, r in RULES}
    assert all(r.verdict == verdict[r.rule] for r in got if r.rule)


def test_url_templates(spark):
    rows = [(i, f"http://h.x/{'spam' if i % 2 else 'news'}/{i}", i % 2) for i in range(400)] + [(1000, "http://h.x/spam/77777", None), (1001, "http://h.x/news/5", None), (1002, "http://new.y/a", None)]
    rows += [(2000 + i, f"http://k.x/{'abcd'[i % 4]}/{i}", int(i % 8 < 4)) for i in range(400)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, label int"), urls.rules_frame(spark, RULES)).collect()}
    assert (got[1000].verdict, got[1001].verdict, got[1000].template) == ("block", "allow", "/spam/*")
    assert got[2000].template == "/*/*"  # alike branches are merged
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, label int"), urls.rules_frame(spark, RULES)).count() == 0


def test_deep_url_branches_are_judged_by_themselves(spark):
    rows = [(i, f"http://h.x/a/b/c/d/{'spam' if i % 4 == 0 else 'news'}/{i}", int(i % 4 == 0)) for i in range(400)] + [(1000, "http://h.x/a/b/c/d/spam/77777", None), (1001, "http://h.x/a/b/c/d/news/5", None), (1002, "http://h.x/a/b/c/d/e/f/g/h", None)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, label int"), urls.rules_frame(spark, RULES)).collect()}
    assert (got[1000].verdict, got[1001].verdict, got[1000].template, got[1002].template) == ("block", "allow", "/a/b/c/d/spam/*", "/a/b/c/d/e/f/g/h")


def test_url_query_gives_the_words_of_its_contract(spark, tmp_path):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(0, "http://a.com/en/1", "com/en/"), (1, "http://example.com/en/71", "example.com/en/7"), (2, "http://a.net/de/8", "net/de/"), (3, "http://w.example.net/de/81", "example.net/de/8"), (4, "http://org/es/", "org/es/"), (5, "http://example.net/de/7", "net/de/")]
    spark.createDataFrame([(i, u, "<p>a page of five plain words</p>") for i, u, _ in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, words[rule]) for i, _, rule in rows}


# --- personal data -----------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute_spans(t):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok[k](m[0])))


def test_personal_data(spark):
    odd = ["a@b.com.x_y@z.org q@w.e@r.t", "+1 (953) 555-9811, 4111 1111 1111 1111, 4111-1111-1111-1112", "999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255 1..2.3.4.5", "é😀 me@x.io +49 30 1234567 12 ", "1 " * 5000, "1" * 25, "@@@a@b.c..d x@y", "+1 ().- 2 ++49 30 123456789 1"]
    docs = frame(spark, EDGE + [(20 + i, t) for i, t in enumerate(odd)])
    got = pii.span_digests(docs).collect()
    want = Counter((r.doc_id, hashlib.sha256(brute_spans(r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert pii.span_digests(docs.limit(0)).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(i, f"ein {i} text. token = {i:08x}ab12cd34 end") for i in range(30)] + [(100, "call (212) 555-1234 now"), (101, "isbn 123-45-6789"), (102, "x me@y.zz z")]
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[5] == "ein 5 text. <SECRET> end" and out[102] == "x <EMAIL> z"
    assert pii.redact(frame(spark, EDGE)).columns == frame(spark, []).columns


def test_estimation_finds_the_reliable_labeler():
    votes = [{"kind": 0, "format": int(y if i % 10 else not y), "gazetteer": y, "context": -1, "against": -1, "apart": int(y if i % 5 else not y), "n": 1} for i in range(200) for y in (0, 1)]
    post = pii.estimate(votes)
    agreed = {k: q for k, q in post.items() if k[2] in (k[1], k[5])}  # the gazetteer and another one
    assert len(agreed) >= 4 and all((q > 0.5) == (k[2] == 1) for k, q in agreed.items())


# --- toxicity ----------------------------------------------------------------------------------------------------------


def brute_viterbi(text, model):
    """The best path by trying all of them."""
    best = (-1e9, "")
    for path in itertools.product(*toxicity.lattice(text), [(" ", 0.0)]):
        a = b = c = 0
        score = sum(cost for _, cost in path)
        for ch in "".join(piece for piece, _ in path):
            d = toxicity._char(ch)
            if d or c:
                score += float(model[a, b, c, d])
                a, b, c = b, c, d
        best = max(best, (score, " ".join("".join(p for p, _ in path).split())), key=lambda x: x[0])
    return best


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(9)
    model = np.log10(rng.dirichlet(np.full(28, 0.3), (28, 28, 28)) + 1e-6).astype(np.float32)
    for _ in range(150):
        text = "".join(rng.choice(list("abcst0135@$!.-"), int(rng.integers(1, 8))))
        score, want = brute_viterbi(text, model)
        got = toxicity.viterbi(text, model)
        assert got == want or abs(brute_viterbi(text, model)[0] - score) < 1e-9, text


def test_finder_agrees_with_documents_one_by_one(spark):
    model = toxicity.with_lexicon(np.log10(np.full((28,) * 4, 1 / 28, np.float32)), ["idiot", "stupid", "moron"])
    texts = ["", "You 1d10t, m0r0n!", "s t u p i d  and plain", "plain words " * 50, "İ é 中文 \x1c a\u00a0b", *[t or "" for _, t in EDGE]]
    restorer = toxicity.Restorer(model)
    number = {f: i for i, f in enumerate(sorted({f for t in texts for w in restorer.document(t) for f in toxicity.features(w)}))}
    got = [(int(i), int(f)) for doc, feature in toxicity.Finder(model, number).find(texts, size=500) for i, f in zip(doc, feature)]
    assert sorted(got) == sorted((i, number[f]) for i, t in enumerate(texts) for f in {f for w in restorer.document(t) for f in toxicity.features(w)})


def test_disguised_words_are_restored():
    model = toxicity.with_lexicon(np.log10(np.full((28,) * 4, 1 / 28, np.float32)), ["idiot", "stupid", "moron", "trash", "worthless", "pathetic", "loser"])
    r = toxicity.Restorer(model)
    for disguised, word in (("1d10t", "idiot"), ("m0r0n!", "moron"), ("tr@sh", "trash"), ("stuuuupid", "stupid"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("l0$er", "loser")):
        assert word in r.document(f"you {disguised} there"), disguised
    assert "pathetic" in r.document("so p a t h e t i c ok") and r.document("Plain words, here.") == {"plain", "words", "here"}
    assert r.document("") == set() and r.document("18a0165473c0330c" * 4)


def test_every_marked_token_is_decoded():
    model = toxicity.with_lexicon(np.log10(np.full((28,) * 4, 1 / 28, np.float32)), ["idiot", "stupid", "shit", "ass"])
    r = toxicity.Restorer(model)
    for disguised, word in (
        ("s" + "t" * 40 + "upid", "stupid"), ("s.t.u.p.i.d." * 5, "stupid"), ("$h17", "shit"), ("5h17", "shit"), ("1d107", "idiot"), ("i,d,i,o,t", "idiot"), ("i'd'i'o't", "idiot"), ("i^d^i^o^t", "idiot"), ("i`d\\iot", "idiot"), ("id.iot", "idiot"),
        ("a s s", "ass"), ("$ t u p 1 d", "stupid"), ("x" * 30 + "-" + "qw-" * 2000 + "-1d10t", "idiot"),
    ):
        assert any(word in w for w in r.document(f"you {disguised} there")), disguised
    assert r.document("on 2024-01-02 at 10:30 for $1,500.00 or 1 2 3 4") == {"on", "at", "for", "or", "2024-01-02", "10:30", "1,500.00", "1", "2", "3", "4"}
    assert len(r.document("x" * 200_000)) == 1


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text", F.lit("clash").alias("score")), labels.where(fold_of("doc_id", 5) != 0))
    held = scored.join(labels, "doc_id").where(fold_of("doc_id", 5) == 0).collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in held)
    assert right / len(held) > 0.9 and all(0 <= r.score <= 1 for r in held)
    # better than one answer for all
    found = sum(r.score >= 0.5 for r in held if r.toxic == 1)
    wrong = sum(r.score >= 0.5 for r in held if r.toxic == 0)
    assert found >= 0.8 * sum(r.toxic == 1 for r in held) > 0 and wrong <= 0.05 * len(held)


def test_training_rows_drop_near_copies_only(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    copy = fresh(200)
    texts = [(i, f"are you {fresh(20 + i)} are you") for i in range(200)] + [(1000 + i, copy.upper() if i % 2 else f"{copy} ") for i in range(50)] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "one three")]
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in texts], "doc_id long, toxic int")
    got = sorted((r.id, r.y) for r in toxicity.training_rows(frame(spark, texts), labels, 6000, 10_000, "doc_id", "text").collect())
    assert got == sorted([(i, i % 2) for i in range(200)] + [(1000, 0), (1001, 1), (2000, 0), (2001, 1), (2002, 0), (2003, 1)])
    assert toxicity.training_rows(frame(spark, texts), labels, 30, 20, "doc_id", "text").groupBy("y").count().orderBy("y").collect() == [(0, 20), (1, 30)]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, EDGE)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.rejected(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


# --- passages ----------------------------------------------------------------------------------------------------------


def test_passages(spark):
    rng = np.random.default_rng(2)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    shared, near = fresh(60), fresh(120).split()
    edited = [*near[:60], "edit", *near[61:]]
    texts = [(i, f"{fresh(40 + i)} {shared.upper() if i % 2 else shared} {fresh(30)}") for i in range(30)] + [(100, " ".join(near)), (101, " ".join(edited)), (200, fresh(300)), (201, fresh(49)), (202, "same line " * 400), (203, "same line " * 400)]
    docs = frame(spark, texts + [(None, shared), (300, None), (301, ""), (200, None)])
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect() if r.doc_id != 200 or r.n_links == 0}
    assert {got[i].component_id for i in range(30)} == {0} and all(got[i].n_links for i in range(30))
    assert got[101].component_id == 100 and got[203].component_id == 202
    assert all(got[i].component_id == i and got[i].n_links == 0 and got[i].passages == "" for i in (200, 201, 300, 301))
    a, z = map(int, got[5].passages.split(",")[0].split(":"))
    assert a <= 45 and z >= 45 + 60 and z - a < 60 + 2 * 46
    assert None in got and passages.repeated_passages(docs.limit(0)).count() == 0


def test_windows_are_short_rows(spark):
    low, anchor, high = np.array([0, 7, 2**32]), np.array([0, 52, 2**32 + 45]), np.array([46, 60, 2**32 + 91])
    assert all((a == b).all() for a, b in zip(passages._ends(passages._place(low, anchor, high)), (low, anchor, high)))
    text = " ".join(f"w{x}" for x in np.random.default_rng(4).integers(0, 10**9, 3000))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], ["doc", "t"])
    got = pa.Table.from_batches(passages._windows(5, 46, 2, 4)([batch]))
    assert got.column_names == ["key", "doc", "place"]  # what is shuffled: 24 bytes a window
    h, n = passages.text_shingles(pa.array([text]), 5)
    whole = [passages.compact_windows(h, n, 46, [2 * k, 2 * k + 1]) for k in range(4)]
    assert len(got) == sum(len(w[0]) for w in whole)
    ends = passages._ends(got["place"].to_numpy())
    assert all((np.concatenate([w[i] for w in whole]) == e).all() for i, e in zip((3, 2, 4), ends))
    assert (np.concatenate([w[0] for w in whole]) >> passages.NEAR == got["key"].to_numpy() >> passages.NEAR).all()
    with pytest.raises(ValueError):
        passages.passage_links(frame(spark, [(1, "a")]).select(F.col("doc_id").alias("doc"), F.lit(False).alias("repeats"), F.col("text").alias("t")), words=1 << 16)


def test_links_survive_a_first_document_that_fails(spark):
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shared = fresh(60)
    h, _ = passages.text_shingles(pa.array([" ".join(shared)]), 5)
    held = {p + k for band in passages.banded_windows(h, 46) for p in band[1].tolist() for k in range(5)}  # words of ruling shingles
    edited = list(shared)
    free = [i for i in range(60) if i not in held]
    for i in free[:: max(1, len(free) // 9)]:
        edited[i] = f"edit{i}"
    docs = [(1, " ".join(edited)), (2, " ".join(shared)), (3, " ".join(shared)), (4, " ".join([*fresh(30), *shared, *fresh(40)])), (5, " ".join(fresh(200))), (6, " ".join(shared)), (6, " ".join(fresh(80)))]
    got = [(r.doc_id, r.component_id, r.n_links > 0) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert {g for g in got if g[0] in (2, 3, 4)} == {(2, 2, True), (3, 2, True), (4, 2, True)} and (5, 5, False) in got
    assert sorted(g for g in got if g[0] == 6) == [(6, 2, True), (6, 6, False)]


def test_links_survive_any_number_of_documents_that_fail(spark):
    rng = np.random.default_rng(15)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]

    def seen(words):  # (signature, near) of each band's windows
        h, n = passages.text_shingles(pa.array([" ".join(words)]), 5)
        return [{(int(s), int(x)) for s, x in zip(w[0], w[5])} for w in (passages.compact_windows(h, n, 46, [2 * k, 2 * k + 1]) for k in range(4))]

    while True:  # two texts that differ by a word, meet in some band, and have the words beside the ruling place in common in none
        one = fresh(50)
        h, _ = passages.text_shingles(pa.array([" ".join(one)]), 5)
        bands = [{p + k for f in (2 * b, 2 * b + 1) for p in [int(np.argmin(passages.mixed(h, passages.SEEDS[f] + np.uint64(f)) >> np.uint64(32)))] for k in range(5)} for b in range(4)]
        pairs = [[*one[:i], "other", *one[i + 1 :]] for i in range(5, 45)]
        pairs = [x for x in pairs if not any(a & b for a, b in zip(seen(one), seen(x))) and any({s for s, _ in a} & {s for s, _ in b} for a, b in zip(seen(one), seen(x)))]
        if pairs:
            break
    two = pairs[0]
    held = set().union(*[w for w, a, b in zip(bands, seen(one), seen(two)) if {s for s, _ in a} & {s for s, _ in b}])
    docs = [(100, " ".join(one)), (101, " ".join(two))]
    while len(docs) < 42:  # texts with the same signature and other words
        t = [w if i in held else x for i, (w, x) in enumerate(zip(one, fresh(50)))]
        if any({s for s, _ in a} & {s for s, _ in b} & {s for s, _ in c} for a, b, c in zip(seen(one), seen(two), seen(t))):
            docs.append((len(docs), " ".join(t)))
    got = {r.doc_id: r.component_id for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: min(i, 100) for i, _ in docs}


def test_passages_against_all_pairs(spark):
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line = fresh(20)  # shared by all, and too short
    docs, families = [], [fresh(int(n)) for n in rng.integers(52, 120, 12)]
    for i in range(90):
        own = list(families[i % 12])
        for _ in range(int(rng.integers(0, 3))):
            own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 10**9)}"
        docs.append((i, " ".join([*fresh(int(rng.integers(5, 60))), *line, *fresh(int(rng.integers(0, 30))), *own, *fresh(int(rng.integers(5, 60)))])))
    sets = [[frozenset(w[k : k + 46]) for k in range(len(w) - 45)] for w in ([" ".join(t[k : k + 5]) for k in range(len(t) - 4)] for t in (d.split() for _, d in docs))]
    near = {(i, j) for i in range(90) for j in range(i) if i % 12 == j % 12 and any(len(x & y) >= 0.8 * len(x | y) for x in sets[i] for y in sets[j])}
    got = {r.doc_id: r.component_id for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near) > 100
    assert all(got[i] % 12 == i % 12 for i in range(90))  # nothing is linked over the short line


def test_similar_stretches_where_shingles_repeat():
    rng = np.random.default_rng(20)
    near = lambda x, y: len({*x} & {*y}) >= 0.8 * len({*x} | {*y}) > 0
    seen = set()
    for _ in range(300):
        n, kinds = int(rng.integers(47, 140)), int(rng.integers(4, 60))
        a = rng.integers(0, kinds, n)
        b = np.where(rng.random(n) < rng.random(), a, rng.integers(0, kinds + 8, n))
        want = near(a.tolist(), b.tolist()) or any(near(a[i : i + 46].tolist(), b[i : i + 46].tolist()) for i in range(n - 45))
        assert passages.similar_stretch(a, b, 46, 0.8) == want
        seen.add(want)
    assert seen == {True, False}


def test_joined_passages_keep_their_signatures():
    rng = np.random.default_rng(21)
    n = 3000
    rep, doc, shift, low = rng.integers(0, 6, n), rng.integers(6, 9, n), rng.integers(-1, 2, n), rng.integers(0, 4000, n)
    rows = sorted(zip(rep.tolist(), doc.tolist(), shift.tolist(), low.tolist(), (low + rng.integers(1, 60, n)).tolist(), range(n)))
    want = []
    for *pair, a, z, sig in rows:
        if want and want[-1][:3] == pair and a <= want[-1][4]:
            want[-1][4] = max(want[-1][4], z)
            want[-1][5].append(sig)
        else:
            want.append([*pair, a, z, [sig]])
    whole = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i in (0, 1, 5) else pa.int32()) for i, c in enumerate(zip(*rows))], ["rep", "doc", "shift", "low", "high", "sig"])
    for size in (1, 7, 1000, n):
        got = [list(r.values()) for b in passages._joined(whole.slice(k, size) for k in range(0, n, size)) for r in b.to_pylist()]
        assert got == want
    assert list(passages._joined([])) == []


def test_small_groups_are_compared_where_they_meet():
    rng = np.random.default_rng(22)
    base = rng.integers(0, 2**31 - 1, (5, 60)).astype(np.int32)
    rows = []
    for w in range(120):
        h = base[w % 5].copy()
        h[rng.integers(0, 60, int(rng.integers(0, 20)))] = rng.integers(0, 2**31 - 1)
        rows.append((w // 9, w % 4, w, int(passages._place(np.array(w), np.array(w + 7), np.array(w + 60))[()]), 37, np.unique(h).tolist()))
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32())]
    whole = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["sig", "comp", "doc", "place", "need", "h"])
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and a[0] == b[0] and a[1] != b[1] and len({*a[5]} & {*b[5]}) >= 37}
    for size in (1, 5, 120):
        got = [r for b in passages._alike(46)(whole.slice(k, size) for k in range(0, 120, size)) for r in b.to_pylist()]
        assert len(got) == len(want) > 20 and {(r["rep"], r["doc"]) for r in got} == want
        assert all(r["shift"] == r["doc"] - r["rep"] and (r["low"], r["high"]) == (r["rep"], r["rep"] + 60) for r in got)


def test_links_of_a_group_grow_with_its_windows():
    rng = np.random.default_rng(25)
    base = rng.integers(0, 2**31 - 1, (3, 60)).astype(np.int32)  # three texts that are unlike

    def group(n):
        place = int(passages._place(np.array(0), np.array(7), np.array(60))[()])
        h = [np.where(np.arange(60) == w % 60, w, base[w % 3]).astype(np.int32) for w in range(n)]
        return [(5, w // 4, w, place, 37, x.tolist()) for w, x in enumerate(h)]

    def found(rows, similar, size):
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32())]
        whole = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["sig", "comp", "doc", "place", "need", "h"])
        alike = [(r["rep"], r["doc"], r["shift"], r["low"], r["high"]) for b in passages._alike(46, similar)([whole]) for r in b.to_pylist()]
        # the same group in two blocks, the windows of comp 0 on one side only
        dealt = [(5, k, side, 0, *r[1:]) for k in (0, 1) for side in (0, 1) for r in rows if side or r[1] and r[2] % 2 == k]
        kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32())]
        whole = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*dealt), kinds)], ["sig", "block", "side", "first", "comp", "doc", "place", "need", "h"])
        across = [(r["rep"], r["doc"], r["shift"], r["low"], r["high"]) for b in passages._across(46, similar)(whole.slice(k, size) for k in range(0, len(dealt), size)) for r in b.to_pylist()]
        return alike, across

    def parts(rows, links):
        root = {w: w // 4 for _, _, w, *_ in rows}
        for a, b, *_ in links:
            old, to = max(root[a], root[b]), min(root[a], root[b])
            root = {w: to if c == old else c for w, c in root.items()}
        return root

    rows = group(90)
    every, across = found(rows, None, 7)
    assert len(every) == len(set(every)) == len(across) and set(every) == set(across)
    assert {(a, b) for a, b, *_ in every} == {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3 and a // 4 != b // 4}
    for n in (90, 300):
        rows = group(n)
        for links in found(rows, 0.8, 50):
            assert len(links) <= 4 * n  # all pairs of 300 are 14,700
            assert {w for a, b, *_ in links for w in (a, b)} == set(range(n)) and all(a < b and a % 3 == b % 3 for a, b, *_ in links)
            assert set(parts(rows, links).values()) == {0}


def test_small_and_large_groups_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(23)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    base, docs = words(70), []
    for i in range(60):  # one group of texts that are alike or not, by how many of their words are changed
        t = list(base)
        for k in rng.integers(0, 70, int(rng.integers(0, 9))):
            t[k] = f"e{rng.integers(0, 10**9)}"
        docs.append((i, " ".join(t)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    shown = lambda: sorted((r.doc_id, r.component_id, r.n_links > 0) for r in passages.repeated_passages(frame).collect())
    small = shown()
    monkeypatch.setattr(passages, "GROUP", 1)
    assert shown() == small


def test_copies_have_one_link_each(spark):
    rng = np.random.default_rng(24)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    text, shared, short = fresh(90), fresh(70), fresh(49)
    docs = [(i, text) for i in range(10, 40)] + [(50, f"{fresh(8)} {text}"), (60, f"{shared} {fresh(20)}"), (61, f"{shared} {fresh(20)}"), (70, short), (71, short), (80, f" {text.upper()} ")]
    got = {r.doc_id: (r.component_id, r.n_links, r.passages) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == (10, 1, "0:90") for i in range(11, 40))
    assert got[50][0] == got[80][0] == got[10][0] == 10 and got[10][1] >= 31 and got[61][0] == 60 and got[61][1] == 1
    assert got[70] == (70, 0, "") and got[71] == (71, 0, "")


def test_similar_stretches():
    rng = np.random.default_rng(14)
    for _ in range(300):
        a = rng.integers(0, 10**6, 120)
        b = rng.integers(0, 10**6, 120)
        at, n = int(rng.integers(0, 60)), int(rng.integers(30, 60))
        b[at : at + n] = a[at : at + n]
        j = [len(set(a[i : i + 46]) & set(b[i : i + 46])) / len(set(a[i : i + 46]) | set(b[i : i + 46])) for i in range(75)]
        assert passages.similar_stretch(a, b, 46, 0.8) == (max(j) >= 0.8)


def test_one_word_edits_are_found():
    rng = np.random.default_rng(6)
    for n in (51, 55, 60, 70):
        hit = 0
        for _ in range(300):
            own = [f"w{x}".encode() for x in rng.integers(0, 10**9, n + 120)]
            other = [f"v{x}".encode() for x in rng.integers(0, 10**9, n + 120)]
            other[70 : 70 + n] = own[30 : 30 + n]
            other[70 + n // 2] = b"edit"
            a, b = ({(int(s), int(p)): None for band in passages.banded_windows(passages.shingle_hashes(b" ".join(t), 5), 46) for s, p in zip(band[0], band[1])} for t in (own, other))
            at = {}
            for s, p in a:
                at.setdefault(s, []).append(p)
            hit += any(q - p == 40 for s, q in b for p in at.get(s, ()))
        assert hit >= 285, (n, hit)  # 95 in 100


def test_sliding_least():
    h = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 3, 46, 300):
        assert (passages.sliding_least(h, w) == [h[i : i + w].min() for i in range(len(h) - w + 1)]).all()
