"""Chat formatting from event logs.

A log has one row for each event: (conv_id, seq, message_id, kind, role, text).  Kinds: ``message`` opens or replaces a
message, ``delta`` adds text to it, ``edit`` replaces its text, ``regenerate`` replaces its text and withdraws every
message of the conversation that was opened after it and before this event.  The log is partitioned by conversation and
sorted by sequence; folding needs only window functions and one grouping by message.  Messages are then rendered row by
row, so that a long conversation is never held whole: its segments stay sorted rows.

Template: ``<s>[role]``, newline, text, ``</s>``, newline.  In roles and texts the characters ``\\``, ``<``, ``[`` and ``]``
are written with a backslash before them, so no control string can occur there, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
_HEAD, _MID, _END = "<s>[", "]\n", "</s>\n"


def escape(x):
    """As a Column: the control characters of the template made harmless."""
    return F.regexp_replace(x, r"([\\<\[\]])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_SEGMENT = re.compile(r"<s>\[((?:[^\\\[\]<]|\\.)*)\]\n((?:[^\\<]|\\.)*)</s>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; a text that is not of the template is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m:
            raise ValueError("not of this template")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def message_events(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows that are whole messages as events, in the order of turn, then role, then text; repeated rows are messages of their own."""
    raw = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return raw.withColumn("seq", n).select("conv_id", "seq", F.col("seq").alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the messages that an event log leaves, ``at`` being the sequence number that opened each.

    Null texts are empty; null roles are the empty role; events with a null kind count as ``message``; an unknown kind is
    an error.  A null conv_id is a conversation of its own; events of the same sequence number are taken in the order of
    kind and text.  The role is that of the message's last event that gives one.  An empty log gives no rows.
    """
    kind = F.coalesce("kind", F.lit("message"))
    kind = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), kind)))
    e = events.select("conv_id", "seq", "message_id", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id", "message_id")
    e = e.withColumn("opened", F.min("seq").over(whole)).withColumn("reset", F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(whole))
    parts = F.array_sort(F.collect_list(F.when(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")), F.struct("seq", "kind", "text"))))
    # of events that share the sequence number of the last reset, text before a reset does not count
    last = F.aggregate(parts, F.lit(""), lambda s, x: F.when(x["kind"] == "delta", F.concat(s, x["text"])).otherwise(x["text"]))
    messages = e.groupBy("conv_id", "message_id").agg(
        F.first("opened").alias("at"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), last.alias("text")
    )
    before = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("cut", F.max("again").over(before)).where("cut IS NULL OR at > cut").select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, at, segment, loss): each message's part of the formatted text, and its loss mask as [start, end) in it.

    The formatted conversation is its segments one after another, by ``at``.  The mask covers the texts of assistants.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    start = F.length(role) + len(_HEAD) + len(_MID)
    mask = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length(text)).alias("end")))
    return messages.select("conv_id", "at", F.concat(F.lit(_HEAD), role, F.lit(_MID), text, F.lit(_END)).alias("segment"), mask.alias("loss"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Segments of the formatted conversations of an event log; see :func:`fold` and :func:`render`."""
    return render(fold(events))


def _read_back(batches):
    """Over segments sorted by conversation: what the formatted text says, read from it."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, some = None, False
    state: list = []

    def row():
        return pa.RecordBatch.from_pylist([{"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}], schema=schema)

    for b in batches:
        for conv, segment, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not some or conv != now:
                if some:
                    yield row()
                now, some, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss:
                text = unescape(segment[loss["start"] : loss["end"]])
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(segment)
    if some:
        yield row()


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its segments: counts and hashes of turns and of the text under the mask.

    Segments stream through sorted; a hash is the only thing that a conversation, however long, keeps in memory.
    """
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "segment", "loss")
    return dealt.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
