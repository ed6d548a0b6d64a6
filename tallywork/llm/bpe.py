"""BPE encoding and decoding over a table of distinct words.

A word is a run of bytes other than ASCII white space.  Of the tokenizers this is meant for, no piece, normalisation or
special token reaches over such white space, so words can be encoded apart; :func:`word_split_is_safe` says for which
files that holds.  Runs of documents of one task (chunks) are written as numbers into the chunk's list of distinct words.
A chunk's words, dealt by a hash of the word, meet those of the other chunks; each distinct word is encoded once, and
its ids go back to the chunks, where the documents' word numbers are replaced by ids.  A frequent word thus moves once for each chunk, not for each occurrence.
Decoding joins ids with the pieces of the vocabulary, which is as large as the tokenizer file and no larger.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 32 << 20

_LOADED: dict[str, object] = {}


def word_split_is_safe(spec: dict) -> bool:
    """Whether a tokenizer drops white space between its pre-tokens, so that parting texts there changes nothing."""
    kinds = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [spec.get("pre_tokenizer") or {}])]
    splits = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
    return "Whitespace" in kinds or any(p.get("behavior") == "Removed" and p.get("invert") for p in splits)


def tokenizer_text(path: str) -> str:
    """The tokenizer file without its truncation and padding."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not word_split_is_safe(spec):
        raise ValueError("this tokenizer keeps white space; its texts can't be parted there")
    return json.dumps(spec | {"truncation": None, "padding": None})


def _tokenizer(text: str):
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED.clear()
        _LOADED[key] = Tokenizer.from_str(text)
    return _LOADED[key]


class Chunk:
    """Documents of one task as numbers into their distinct words."""

    def __init__(self, split=bytes.split):
        self.split = split
        self.words: dict[bytes, int] = {}
        self.numbers: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.size = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        words = self.words
        at = [words.setdefault(w, len(words)) for w in self.split(raw)]
        self.numbers.append(np.array(at, np.uint32))
        self.ids.append(doc_id)
        self.size += len(raw)

    def finish(self, buckets: int) -> tuple[bytes, list[bytes], np.ndarray, np.ndarray]:
        """The chunk's name, its words by bucket, where each bucket starts, and the documents' words by those places.

        The name comes from the content: the same documents in the same order give the same, whichever task makes it.
        """
        words = list(self.words)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        flat = place[np.concatenate(self.numbers)] if words else np.zeros(0, np.uint32)
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        h = hashlib.sha256(repr((self.ids, [len(x) for x in self.numbers])).encode())
        h.update(flat.tobytes())
        words = [words[i] for i in order.tolist()]
        h.update(b" ".join(words))
        return h.digest()[:16], words, starts, flat


def chunks_of(batches, split=bytes.split, size: int = CHUNK_BYTES):
    """The chunks of a task's rows (id, text)."""
    now = Chunk(split)
    for b in batches:
        for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1)):
            raw = raw.as_py() or b""
            if now.ids and now.size + len(raw) > size:
                yield now
                now = Chunk(split)
            now.add(doc_id, raw)
    if now.ids:
        yield now


def _words(buckets: int):
    """(bucket, chunk, at, words): the distinct words of each chunk that fall in a bucket, packed, the first being number ``at``."""

    def run(batches):
        for c in chunks_of(batches):
            name, words, starts, _ = c.finish(buckets)
            some = [i for i in range(buckets) if starts[i] < starts[i + 1]]
            packed = [zlib.compress(b" ".join(words[starts[i] : starts[i + 1]]), 1) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([name] * len(some), pa.binary()), pa.array(starts[some].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "chunk", "at", "words"])

    return run


def _texts(buckets: int):
    """(chunk, ids, lengths, packed): each chunk's documents as word numbers, packed."""

    def run(batches):
        for c in chunks_of(batches):
            name, _, _, flat = c.finish(buckets)
            # bytes of the same weight together, which packs better
            planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([c.ids], pa.list_(pa.int64())), pa.array([[len(x) for x in c.numbers]], pa.list_(pa.int64())), pa.array([zlib.compress(planes.tobytes(), 1)], pa.binary())], ["chunk", "ids", "lengths", "packed"]
            )

    return run


def _encode(sent, keep: int = 2_000_000):
    """Over rows sorted by bucket: each distinct word of a bucket is encoded once, and each chunk gets its words' ids.

    ``keep`` bounds memory; only beyond so many distinct words in one bucket would some be encoded again.
    """

    def run(batches):
        tok, now, known = _tokenizer(sent.value), None, {}
        for b in batches:
            out, counts = [], []
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(3)):
                if bucket != now or len(known) > keep:
                    now, known = bucket, {}
                words = zlib.decompress(packed.as_py()).split(b" ")
                new = [w for w in words if w not in known]
                for a in range(0, len(new), 10_000):
                    part = new[a : a + 10_000]
                    coded = tok.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                    known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, coded))
                ids = [known[w] for w in words]
                counts.append(len(ids))
                out.append(zlib.compress(np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids), 1))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary()), pa.array(counts, pa.int32())], ["chunk", "at", "coded", "n"])

    return run


def _spread(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids of the words ``at``, one after another."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _join(pieces, result):
    """Over rows sorted by chunk and word number, the chunk's documents last: the documents with their ids."""

    def run(batches):
        piece = pieces.value
        sizes, flat, have, at_before, chunk = [], [], 0, -1, None
        for b in batches:
            name, at, n = (b.column(i).to_pylist() for i in (0, 1, 3))
            for i, key in enumerate(name):
                if key != chunk:
                    sizes, flat, have, at_before, chunk = [], [], 0, -1, key
                if at[i] is not None:
                    if at[i] == at_before:  # chunks of the same name have the same words
                        continue
                    if at[i] != have:
                        raise ValueError("a chunk's words are not whole: the documents were read in another order")
                    values = np.frombuffer(zlib.decompress(b.column(2)[i].as_py()), "<u4")
                    sizes.append(values[: n[i]])
                    flat.append(values[n[i] :])
                    have, at_before = have + n[i], at[i]
                    continue
                ids, lengths = b.column(4)[i].as_py(), np.array(b.column(5)[i].as_py(), np.int64)
                planes = np.frombuffer(zlib.decompress(b.column(6)[i].as_py()), np.uint8)
                numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
                if len(numbers) and int(numbers.max()) >= have:
                    raise ValueError("a chunk's words are not whole: the documents were read in another order")
                size = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)
                starts = np.cumsum(size) - size
                coded = np.concatenate([np.zeros(0, np.uint32), *flat])
                ends = np.cumsum(lengths)
                for k in range(0, len(ids), 256):
                    rows = [result(d, _spread(starts, size, numbers[e - m : e], coded), piece) for d, m, e in zip(ids[k : k + 256], lengths[k : k + 256], ends[k : k + 256])]
                    yield pa.RecordBatch.from_pylist(rows, schema=result.schema)

    return run


def decode(ids, piece: list[str]) -> str:
    """The pieces of ids, as a tokenizer without a decoder joins them."""
    return " ".join(map(piece.__getitem__, ids))


def digest(doc_id, ids: np.ndarray, piece: list[str]) -> dict:
    text = decode(ids.tolist(), piece)
    return {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()}


digest.schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
digest.ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def whole(doc_id, ids: np.ndarray, piece: list[str]) -> dict:
    return {"doc_id": doc_id, "ids": ids.tolist(), "decoded": decode(ids.tolist(), piece)}


whole.schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])
whole.ddl = "doc_id long, ids array<long>, decoded string"


def encode_documents(docs: DataFrame, tokenizer_path: str, result=whole, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's whole text as token ids and decoded again: (doc_id, ids, decoded), or the digests with ``result=digest``.

    No special tokens are added; those that a text spells are encoded as such.  A null or empty text has no ids.  Rows
    are returned as often as given, with their ids (null too); other columns are ignored; an empty table gives no rows.
    ``docs`` is read twice and must come in the same order each time, as tables do; else the query fails, it never
    returns wrong ids.
    """
    spec = tokenizer_text(tokenizer_path)
    context = docs.sparkSession.sparkContext
    tok = _tokenizer(spec)
    n = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    sent, pieces = context.broadcast(spec), context.broadcast([tok.id_to_token(i) or "" for i in range(n)])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = source.mapInArrow(_words(buckets), "bucket int, chunk binary, at int, words binary")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode(sent), "chunk binary, at int, coded binary, n int")
    texts = source.mapInArrow(_texts(buckets), "chunk binary, ids array<long>, lengths array<long>, packed binary")
    both = coded.unionByName(texts, allowMissingColumns=True).select("chunk", "at", "coded", "n", "ids", "lengths", "packed")
    return both.repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_last()).mapInArrow(_join(pieces, result), result.ddl)
