"""Packing token sequences by hierarchical best fit.

Items of one task are packed best-fit, longest first, a bounded number at a time, without a shuffle.  Bins that are full, or
that have less room than the shortest item left anywhere or than ``slack``, are done.  The others, with what they hold, are the items of the next
round, in as few tasks as their members allow: fewer from round to round, as in a tree.  Rounds end when all fit one task
and it packed them, or when a round saves less than one bin in ``1 / GAIN``.

Capacities are small numbers, so the open bins are stacks by the room they have, and one integer has a bit for each room
that some bin has: the best fit is the lowest of its bits at or above the item's length.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import pieces, text_bytes

#: Items that one task packs at a time, and members of bins that one task of a later round is given.
BLOCK, MEMBERS = 200_000, 1_000_000
#: A round that saves less than this share of its bins is the last.
GAIN = 1e-4
#: Bytes of texts that are encoded at a time, unless one text is longer.
CHUNK_BYTES = 8 << 20


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest items first, each into the open bin with the least room that holds it.  Bins are numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, offsets


_BINS = "length int, n int, keys binary, offsets binary"


def _packed(capacity: int, lengths: np.ndarray, keys: list[bytes], offsets: list[bytes]) -> pa.RecordBatch:
    """Items that may themselves be bins (their members' keys and offsets, packed) as the bins that best fit makes of them."""
    bins, at = best_fit(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    starts = np.searchsorted(bins[order], np.arange(n_bins + 1)).tolist()
    fill = np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int32)
    out_keys, out_offsets = [], []
    order, shift = order.tolist(), at.tolist()
    for b in range(n_bins):
        members = order[starts[b] : starts[b + 1]]
        out_keys.append(b"".join([keys[i] for i in members]))
        out_offsets.append(b"".join([(np.frombuffer(offsets[i], "<i4") + shift[i]).astype("<i4").tobytes() if shift[i] else offsets[i] for i in members]))
    count = [len(x) // 8 for x in out_keys]
    return pa.RecordBatch.from_arrays([pa.array(fill, pa.int32()), pa.array(count, pa.int32()), pa.array(out_keys, pa.binary()), pa.array(out_offsets, pa.binary())], ["length", "n", "keys", "offsets"])


def _pack_task(capacity: int):
    def run(batches):
        lengths, keys, offsets, have = [], [], [], 0
        for b in batches:
            lengths.append(b.column(0).to_numpy(zero_copy_only=False))
            keys += b.column(2).to_pylist()
            offsets += b.column(3).to_pylist()
            have += sum(b.column(1).to_pylist())
            if len(keys) >= BLOCK or have >= 2 * MEMBERS:
                yield _packed(capacity, np.concatenate(lengths).astype(np.int64), keys, offsets)
                lengths, keys, offsets, have = [], [], [], 0
        if keys:
            yield _packed(capacity, np.concatenate(lengths).astype(np.int64), keys, offsets)

    return run


def _first_task(capacity: int):
    """Rows (key, length) as bins of one member, then packed."""

    def run(batches):
        def single():
            for b in batches:
                for i in range(0, b.num_rows, BLOCK):
                    part = b.slice(i, BLOCK)
                    raw = part.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), pa.array(np.ones(n, np.int32)), pa.array([raw[k : k + 8] for k in range(0, 8 * n, 8)], pa.binary()), pa.array([b"\0\0\0\0"] * n, pa.binary())], ["length", "n", "keys", "offsets"]
                    )

        yield from _pack_task(capacity)(single())

    return run


def _members(batches):
    """Bins as rows (key, sequence_id, offset); a sequence is named by its first member's key."""
    for b in batches:
        keys, offsets = np.frombuffer(b"".join(b.column(2).to_pylist()), "<i8"), np.frombuffer(b"".join(b.column(3).to_pylist()), "<i4")
        n = b.column(1).to_numpy(zero_copy_only=False)
        first = keys[np.cumsum(n) - n] if len(n) else keys
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(first, n)), pa.array(offsets.astype(np.int64))], ["key", "sequence_id", "offset"])


def pack(items: DataFrame, capacity: int, slack: int | None = None, key_col: str = "key", length_col: str = "length") -> DataFrame:
    """(key, sequence_id, offset) for each item (key: long, unique; length: 1 to ``capacity``).

    Sequences have no gaps and hold at most ``capacity``; bins with at most ``slack`` room (1/256 of it) go to no further round.  Their numbers are keys of items.  Lengths outside the bounds are
    an error; null keys or lengths too.  No items give no rows.  The driver sees one row of counts a round.
    """
    slack = capacity // 256 if slack is None else slack
    length = F.col(length_col).cast("int")
    wrong = F.col(key_col).isNull() | length.isNull() | (length < 1) | (length > capacity)
    checked = items.select(F.col(key_col).cast("long").alias("key"), F.when(wrong, F.raise_error(F.lit(f"an item needs a key and a length from 1 to {capacity}")).cast("int")).otherwise(length).alias("length"))
    # read by so few tasks that each has about a block: the more items meet, the fewer bins stay open
    now = written(checked.coalesce(max(1, items.count() // BLOCK)).mapInArrow(_first_task(capacity), _BINS))
    done, before = [], None
    while True:
        n, least = now.agg(F.count("*"), F.min("length")).first()
        # no item left is shorter than ``least``, so a bin without room for that much is done
        open_ = F.col("length") <= capacity - max(least or 0, slack + 1)
        n_open, members = now.where(open_).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        tasks = -(-members // MEMBERS)
        last = n_open == 0 or before is not None and (before[0] == 1 or before[1] - n < GAIN * before[1])
        done.append(now if last else now.where(~open_))
        if last:
            break
        before = (tasks, n_open)
        now = written(now.where(open_).repartition(tasks).mapInArrow(_pack_task(capacity), _BINS))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.mapInArrow(_members, "key long, sequence_id long, offset long")


class Encoder:
    """Ids of texts as the byte-level tokenizer file gives them without special tokens added; those that a text spells are encoded as such.

    The same merges run in the ranks' library, which is several times faster; a text that it gives up on goes through the file's own.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a byte-level tokenizer")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) + len(added) != len(spec["model"]["vocab"].keys() | added.keys()):
            raise ValueError("the ranks are of another vocabulary")
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except BaseException as e:  # the library's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow.encode(text, add_special_tokens=False).ids


_LOADED: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end: int, result):
    """Rows (doc_id, text) as the pieces of their token ids: (key, piece, start, length) and what ``result`` makes of the ids."""

    def run(batches):
        encode = _LOADED.get(path) or _LOADED.setdefault(path, Encoder(path))
        key = TaskContext.get().partitionId() << 40
        for docs, texts in pieces(batches, CHUNK_BYTES):
            ids_of, rows, made = [], [], []
            for i, raw in enumerate(texts):
                ids = np.array([*encode(raw.as_py().decode()), end], "<u4")
                n = -(-len(ids) // capacity)
                starts = [0, *(len(ids) - capacity * k for k in range(n - 1, 0, -1))]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    ids_of.append(i)
                    rows.append((key, k, a, z - a))
                    made.append(result(ids[a:z]))
                    key += 1
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(ids_of)), *columns, pa.array(made, result.type)], ["doc_id", "key", "piece", "start", "length", result.name])

    return run


def whole(ids: np.ndarray) -> list[int]:
    return ids.tolist()


whole.name, whole.type, whole.ddl = "ids", pa.list_(pa.int32()), "array<int>"


def crc(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.tobytes())


crc.name, crc.type, crc.ddl = "ids_crc32", pa.int64(), "bigint"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end: int = 2, result=whole, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's whole text as token ids and the id ``end``, placed in sequences of at most ``capacity``: one row for each piece.

    Columns: doc_id, piece, start, length, ids (or what ``result`` makes of them), sequence_id, offset.  Only longer documents
    are cut, from their end into pieces of ``capacity``, so the first may be shorter.  A null or empty text is ``end`` alone.
    Rows are packed one by one, repeated rows and null ids too; other columns are ignored; an empty table gives no rows.
    Pieces are written once, so their keys hold whichever executor is lost later.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"))
    made = written(rows.mapInArrow(_pieces(tokenizer_path, capacity, end, result), f"doc_id long, key long, piece int, start long, length long, {result.name} {result.ddl}"))
    alone = made.where(F.col("length") == capacity).select("*", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = made.where(F.col("length") < capacity)
    placed = short.join(pack(short.select("key", "length"), capacity), "key")
    return placed.unionByName(alone).drop("key")
