"""Language-model scores of whole documents: counts of all training words, and a recurrent model over the frequent ones.

Texts are tokenised once.  Runs of documents of one task (chunks) become numbers into the chunk's distinct words, which
is written to the shared folder.  A chunk's words go by a hash of the word to where all chunks' counts of it meet, and
the totals come back by position, so a frequent word moves once for each chunk.  The most frequent words and the end
sign are the recurrent model's tokens; every other word is one of a few shapes, its probability that of the shape times
its share in the shape by the exact counts.

The model learns from every training document: in each of a few rounds every chunk trains on its next share of its
documents from the same parameters, and the parameters are averaged, weighted by tokens, in blocks.  A chunk has a
bounded size, so a larger corpus has more chunks, not longer tasks.  A token's probability is the model's mixed with a
little of the base's, which no word has without.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as R
from .common import checkpointed, numbered_words, pieces

SHAPES = 32
#: Token number of the end sign, which also stands before the first word; words come after it.
END = SHAPES
#: Bytes of text in a chunk, unless one text is longer.
CHUNK = 16 << 20
_DIGITS, _SIGNS = frozenset(b"0123456789"), frozenset(b"%*$&#!?;:|)]}\"'=_-/")


#: One of each in a process: a new one for each piece would take its tables' memory anew.
_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(raw: bytes) -> bytes:
    return _PACKER.compress(raw)


def _unpack(packed: bytes) -> bytes:
    return _UNPACKER.decompress(packed)


def shape_of(word: bytes) -> int:
    if not word:
        return 0
    last = word[-1]
    ending = 1 if last == 46 else 2 if last == 44 else 3 if last in _SIGNS else 0
    return ending | (not word.isascii()) << 2 | (not _DIGITS.isdisjoint(word)) << 3 | (len(word) > 8) << 4


def words_of(texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, flat, lengths): the distinct words of texts, A-Z lower-cased, the end sign's empty word last; each text's word numbers, then the end; how many those are."""
    distinct, numbers, n = numbered_words(texts)
    words = [*distinct.cast(pa.binary()).to_pylist(), b""]
    lengths = n + 1
    flat = np.full(int(lengths.sum()), len(words) - 1, np.uint32)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(lengths) - 1] = False
    flat[inside] = numbers
    return words, flat, lengths


_NUMBERED = "kind int, chunk binary, bucket int, at int, words binary, counts binary, ids array<struct<doc_id:long,held:boolean>>, lengths array<long>, packed binary"


def _number(buckets: int):
    """Kind 0: each chunk's distinct words in a bucket, with their counts in its training documents.  Kind 1: its documents as word numbers; ``at`` is the end's number."""
    ids_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_())]))
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.binary()), ("bucket", pa.int32()), ("at", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", ids_type), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])

    def run(batches):
        for ids, texts in pieces(batches, CHUNK):
            words, flat, lengths = words_of(texts)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            flat = place[flat]
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            words = [words[i] for i in order.tolist()]
            ids = ids.to_pylist()
            train = np.repeat([not x["held"] for x in ids], lengths)
            n = np.bincount(flat[train], minlength=len(words)).astype("<u4")
            # the name comes from the content: the same documents give the same, whichever task makes it
            h = hashlib.sha256(repr((ids, lengths.tolist())).encode())
            h.update(flat.tobytes())
            h.update(b" ".join(words))
            name = h.digest()[:16]
            some = [i for i in range(buckets) if starts[i] < starts[i + 1]]
            part = lambda i: slice(starts[i], starts[i + 1])
            rows = [{"kind": 0, "chunk": name, "bucket": i, "at": int(starts[i]), "words": _pack(b" ".join(words[part(i)])), "counts": _pack(n[part(i)].tobytes())} for i in some]
            planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)  # bytes of the same weight together, which packs better
            rows.append({"kind": 1, "chunk": name, "at": int(flat[-1]), "ids": ids, "lengths": lengths.tolist(), "packed": _pack(planes.tobytes())})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


_TOTALS = "kind int, chunk binary, bucket int, at int, n int, counts binary, shapes binary, ranks binary, word binary, rank int, count long, shape_n array<long>, shape_v array<long>"


def _totals(most: int):
    """Over rows sorted by bucket: kind 0, the totals, shapes and ranks of each chunk's words; kind 1, frequent words; kind 2, sums by shape.

    A word's rank is its place among its bucket's ``most`` most frequent, else -1.  A bucket's rows are held as numbers
    until its totals are known; buckets are as many as partitions grow.
    """
    schema = pa.schema(
        [("kind", pa.int32()), ("chunk", pa.binary()), ("bucket", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("counts", pa.binary()), ("shapes", pa.binary()), ("ranks", pa.binary()), ("word", pa.binary()), ("rank", pa.int32()), ("count", pa.int64()), ("shape_n", pa.list_(pa.int64())), ("shape_v", pa.list_(pa.int64()))]
    )

    def close(bucket, held, index, total):
        words, total = list(index), total[: len(index)]
        shape = np.fromiter(map(shape_of, words), np.uint8, len(words))
        top = heapq.nsmallest(most, ((-n, w, i) for i, (w, n) in enumerate(zip(words, total.tolist())) if n))
        rank = np.full(len(words), -1, "<i4")
        rank[[i for _, _, i in top]] = np.arange(len(top))
        pack = lambda x: _pack(x.tobytes())
        rows = []
        for chunk, at, own in held:
            rows.append({"kind": 0, "chunk": chunk, "bucket": bucket, "at": at, "n": len(own), "counts": pack(total[own]), "shapes": pack(shape[own]), "ranks": pack(rank[own])})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        known = total > 0
        sums = {"shape_n": np.bincount(shape, total, SHAPES).astype(np.int64).tolist(), "shape_v": np.bincount(shape[known], minlength=SHAPES).tolist()}
        rows += [{"kind": 1, "bucket": bucket, "word": w, "rank": r, "count": -n} for r, (n, w, _) in enumerate(top)]
        yield pa.RecordBatch.from_pylist([*rows, {"kind": 2} | sums], schema=schema)

    def run(batches):
        now, held, index, total = None, [], {}, np.zeros(1024, np.int64)
        for b in batches:
            for bucket, chunk, at, words, counts in zip(*(b.column(i).to_pylist() for i in range(5))):
                if bucket != now:
                    if held:
                        yield from close(now, held, index, total)
                    now, held, index, total = bucket, [], {}, np.zeros(1024, np.int64)
                own = np.array([index.setdefault(w, len(index)) for w in _unpack(words).split(b" ")], np.int32)
                if len(index) > len(total):
                    total = np.r_[total, np.zeros(max(len(total), len(index) - len(total)), np.int64)]
                total[own] += np.frombuffer(_unpack(counts), "<u4")  # a chunk's words are distinct
                held.append((chunk, at, own))
        if held:
            yield from close(now, held, index, total)

    return run


_CODED = "ids array<struct<doc_id:long,held:boolean>>, lengths array<long>, packed binary, vocab binary, counts binary"


def _coded(sent):
    """Over rows sorted by chunk and word number, the chunk's documents last: its documents with the tokens and counts of its words."""

    def run(batches):
        token_of, none = sent.value, np.zeros(0, "<i4")
        before, chunk, vocab, counts = -1, None, [], []
        for b in batches:
            names, at, bucket = (b.column(i).to_pylist() for i in range(3))
            for i, key in enumerate(names):
                if key != chunk:
                    before, chunk, vocab, counts = -1, key, [], []
                read = lambda j, kind: np.frombuffer(_unpack(b.column(j)[i].as_py()), kind)  # noqa: B023, E731
                if bucket[i] is not None:
                    if at[i] > before:  # chunks that are alike in everything have the same name and words
                        known, rank = token_of.get(bucket[i], none), read(5, "<i4")
                        own = read(4, np.uint8).astype("<i4")
                        hit = np.flatnonzero((rank >= 0) & (rank < len(known)))
                        token = known[rank[hit]]
                        own[hit[token >= 0]] = token[token >= 0]
                        vocab.append(own)
                        counts.append(b.column(3)[i].as_py())
                        before = at[i]
                    continue
                v = np.concatenate(vocab)
                v[at[i]] = END
                c = np.concatenate([np.frombuffer(_unpack(x), np.int64) for x in counts])
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, 1) for j in (6, 7, 8)), pa.array([_pack(v.tobytes())], pa.binary()), pa.array([_pack(c.tobytes())], pa.binary())], ["ids", "lengths", "packed", "vocab", "counts"])

    return run


def _read(b: pa.RecordBatch, i: int):
    """(ids, lengths, numbers, vocab) of a chunk."""
    planes = np.frombuffer(_unpack(b.column(2)[i].as_py()), np.uint8).reshape(4, -1)
    numbers = planes[3].astype(np.uint32)
    for k in (2, 1, 0):
        numbers <<= 8
        numbers |= planes[k]
    return b.column(0)[i].as_py(), np.array(b.column(1)[i].as_py(), np.int64), numbers, np.frombuffer(_unpack(b.column(3)[i].as_py()), "<i4")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(sent, mix: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        m = sent.value
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, numbers, vocab = _read(b, i)
                c = np.frombuffer(_unpack(b.column(4)[i].as_py()), np.int64)
                base = np.log((c + 1.0) / (m["n"] + m["v"] + 1))
                share = np.where(vocab < SHAPES, np.log((c + 1.0) / m["shape"][np.minimum(vocab, SHAPES - 1)]), 0.0)
                first = np.cumsum(lengths) - lengths
                p = R.score(m["p"], np.split(vocab[numbers].astype(np.int64), first[1:]), END) + share[numbers]
                # a token's probability under the model is far above what a double can't hold
                p = np.log10((1 - mix) * np.exp(p) + (mix * np.exp(base))[numbers])
                base = base[numbers]
                over = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731  every document has its end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["doc_id"] for x in ids], pa.int64()), pa.array([x["held"] for x in ids]), pa.array(lengths), pa.array(over((c > 0)[numbers].astype(np.int64))), pa.array(np.full(len(ids), m["n"], np.int64)), pa.array(over(base) / np.log(10)), pa.array(over(p))],
                    schema=schema,
                )

    return run


def _train(sent, part: int, rounds: int, blocks: int):
    """A task's mean parameters after each of its chunks has trained on its ``part`` of ``rounds``, in blocks, with the number of tokens."""

    def run(batches):
        like = sent.value
        total, n = None, 0
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, numbers, vocab = _read(b, i)
                cut = np.r_[0, np.cumsum(lengths)].tolist()
                mine = [j for j in range(part, len(ids), rounds) if not ids[j]["held"]]
                p = R.from_vector(like, R.to_vector(like))
                k = R.train(p, [vocab[numbers[cut[j] : cut[j + 1]]] for j in mine], END)
                if k:
                    total = k * R.to_vector(p).astype(np.float64) + (0 if total is None else total)
                    n += k
        if n:
            parts = np.array_split((total / n).astype(np.float32), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([n] * blocks, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "n", "values"])

    return run


def _mean(batches):
    """Over rows sorted by block: the mean of each block, weighted."""
    now, total, n = None, None, 0
    done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["block", "values"])
    for b in batches:
        for block, k, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if block != now:
                if n:
                    yield done()
                now, total, n = block, 0.0, 0
            total = total + k * np.frombuffer(values.as_py(), np.float32).astype(np.float64)
            n += k
    if n:
        yield done()


def score_documents(docs: DataFrame, held_out, vocabulary: int = 4096, classes: int = 48, hidden: int = 24, rounds: int = 3, mix: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text, in log10.

    All rows of which ``held_out`` (a Column) is not true are counted, and the recurrent model learns from each of them
    once, a share in each of ``rounds``.  Null texts are empty: their only token is the end.  Rows are returned as often
    as given; other columns are ignored; an empty table gives no rows; without training rows every word has probability
    one of the base, and the model's is that of its start.  A task holds a chunk of texts, 16 MB or one longer text.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    held = F.coalesce(held_out, F.lit(False))
    source = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), held.alias("held")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = checkpointed(source.mapInArrow(_number(buckets), _NUMBERED))
    counted = numbered.where("kind = 0").select("bucket", "chunk", "at", "words", "counts").repartition("bucket").sortWithinPartitions("bucket")
    totals = checkpointed(counted.mapInArrow(_totals(vocabulary), _TOTALS))
    by_shape = totals.where("kind = 2").select(F.posexplode(F.arrays_zip("shape_n", "shape_v")).alias("s", "x")).groupBy("s").agg(F.sum("x.shape_n").alias("n"), F.sum("x.shape_v").alias("v")).collect()
    n_of, v_of = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in by_shape:
        n_of[r["s"]], v_of[r["s"]] = r["n"], r["v"]
    n, v = int(n_of.sum()), int(v_of.sum())
    top = totals.where("kind = 1").orderBy(F.desc("count"), "word").limit(vocabulary).select("bucket", "rank", "word", "count").collect()
    words = [r for r in top if r["word"]]
    of_rank: dict[int, dict[int, int]] = {}
    for i, r in enumerate(words):
        of_rank.setdefault(r["bucket"], {})[r["rank"]] = END + 1 + i
    # by bucket the token of each rank, -1 for those that have none
    token_of = {b: np.array([own.get(k, -1) for k in range(max(own) + 1)], "<i4") for b, own in of_rank.items()}
    for r in top:
        s = shape_of(bytes(r["word"]))
        n_of[s] -= r["count"]
        v_of[s] -= 1
    ends = sum(r["count"] for r in top if not r["word"])
    shape_total = n_of + v_of + 1
    p = R.initial(np.array([*shape_total, ends + 1, *(r["count"] + 1 for r in words)], float), classes, hidden)
    # a few chunks to a partition at most, so that no task has many more than others
    chunks = numbered.where("kind = 1").count()
    dealt = max(1, min(4 * chunks, max(20_000, chunks // 16)))
    words_in = totals.where("kind = 0").select("chunk", "at", "bucket", "counts", "shapes", "ranks")
    both = words_in.unionByName(numbered.where("kind = 1").select("chunk", "at", "ids", "lengths", "packed", F.lit(1).alias("last")), allowMissingColumns=True)
    both = both.repartition(dealt, "chunk").sortWithinPartitions("chunk", F.col("last").asc_nulls_first(), "at").select("chunk", "at", "bucket", "counts", "shapes", "ranks", "ids", "lengths", "packed")
    coded = checkpointed(both.mapInArrow(_coded(context.broadcast(token_of)), _CODED))
    if dealt > chunks:  # partitions without chunks would cost a worker's call in each round
        coded = coded.coalesce(max(1, chunks))
    blocks = max(64, min(4096, dealt // 4))
    for r in range(rounds if n else 0):
        trained = coded.mapInArrow(_train(context.broadcast(p), r, rounds, blocks), "block int, n long, values binary")
        mean = {x["block"]: np.frombuffer(bytes(x["values"]), np.float32) for x in trained.repartition("block").sortWithinPartitions("block").mapInArrow(_mean, "block int, values binary").collect()}
        if mean:
            p = R.from_vector(p, np.concatenate([mean[i] for i in range(blocks)]))
    model = context.broadcast({"p": p, "n": n, "v": v, "shape": shape_total})
    return coded.mapInArrow(_score(model, mix), _SCORES)
