"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations. Sorted by sequence they fold into final messages: streamed deltas extend a
message, edits replace its text, regenerations start it again, deletions drop it. Messages then render to a template
that a reader takes apart again without loss.

The fold is keyed by (conversation, message), so one busy conversation spreads over many tasks; events and messages
stream through sorted partitions, so no task holds a conversation. Only the digest of a conversation, which must see its
turns in order, is made in one place, one message at a time.

Template: ``### role: text </turn>`` and a newline for each message. Backslash, ``#``, ``<``, ``:`` and newline in a role,
and backslash, ``#`` and ``<`` in a text, are preceded by a backslash, so no text can hold a mark.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, DELTA, EDIT, REGENERATE, DELETE = "open", "delta", "edit", "regenerate", "delete"
START, COLON, END = "### ", ": ", " </turn>\n"
LEARNED = "assistant"

_ROLE, _TEXT, _UNESCAPE = re.compile(r"([\\#<:\n])"), re.compile(r"([\\#<])"), re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)

EVENTS = "conv_id bigint, message string, seq bigint, kind string, role string, text string"
MESSAGES = "conv_id bigint, message string, seq bigint, role string, piece string, mask_start bigint, mask_stop bigint"
FORMATTED = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def render(role: str, text: str) -> tuple[str, int, int]:
    """One message in the template, and the span of its text in it: the loss mask, empty for roles that aren't learned."""
    head = START + _ROLE.sub(r"\\\1", role) + COLON
    body = _TEXT.sub(r"\\\1", text)
    return head + body + END, len(head), len(head) + (len(body) if role == LEARNED else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a rendered conversation; raises ValueError for anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold(events) -> tuple[str, str] | None:
    """Final (role, text) of one message from its (kind, role, text) events in order; None if it was deleted.

    The first event that names a role sets it. A delta adds its text, an edit replaces the text, a regeneration drops what
    came before and starts with its own text, a delete drops the message until a later edit or regeneration brings it back.
    Nulls count as empty; an unknown kind raises ValueError.
    """
    speaker, parts, there = "", [], True
    for kind, role, text in events:
        speaker = speaker or role or ""
        if kind in (OPEN, DELTA):
            parts.append(text or "")
        elif kind in (EDIT, REGENERATE):
            parts, there = [text or ""], True
        elif kind == DELETE:
            parts, there = [], False
        else:
            raise ValueError(f"unknown event {kind}")
    return (speaker, "".join(parts)) if there else None


def _rows(batches, names):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batches(rows, schema: pa.Schema, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of a log (EVENTS), rendered: conv_id, message, seq (of the first event), role, piece, mask_start, mask_stop.

    Events of a message are taken by seq, ties by kind, role and text. Null conversations and messages are keys like any
    other. An empty log gives no rows; other columns aren't read.
    """
    names = ["conv_id", "message", "seq", "kind", "role", "text"]
    schema = pa.schema([("conv_id", pa.int64()), ("message", pa.string()), ("seq", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("mask_start", pa.int64()), ("mask_stop", pa.int64())])

    def folded(batches):
        def messages():
            key, own = None, []
            for row in _rows(batches, names):
                if own and row[:2] != key:
                    yield key, own
                    own = []
                key = row[:2]
                own.append(row[2:])
            if own:
                yield key, own

        def rows():
            for (conv, message), own in messages():
                final = fold(e[1:] for e in own)
                if final:
                    yield conv, message, own[0][0], final[0], *render(*final)

        yield from _batches(rows(), schema)

    rank = F.element_at(F.create_map(*[x for i, k in enumerate((OPEN, DELTA, EDIT, REGENERATE, DELETE)) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    dealt = events.select(*names).repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", rank, "role", "text")
    return dealt.mapInArrow(folded, MESSAGES)


def digest(messages: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered messages in order (FORMATTED)."""
    names = ["conv_id", "piece", "mask_start", "mask_stop"]
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read_back(batches):
        def rows():
            none, key = object(), None
            key, n, turns, chars, loss, out = none, 0, None, 0, None, 0
            for conv, piece, start, stop in _rows(batches, names):
                if conv != key or key is none:
                    if key is not none:
                        yield key, n, turns.hexdigest(), chars, loss.hexdigest(), out
                    key, n, turns, chars, loss, out = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in parse(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                learned = unescape(piece[start:stop])
                chars, out = chars + len(learned), out + len(piece)
                loss.update(learned.encode())
            if key is not none:
                yield key, n, turns.hexdigest(), chars, loss.hexdigest(), out

        yield from _batches(rows(), schema)

    dealt = messages.select("conv_id", "seq", "message", "piece", "mask_start", "mask_stop").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message")
    return dealt.mapInArrow(read_back, FORMATTED)


def events_of(rows: DataFrame) -> DataFrame:
    """A log of finished turns (conv_id, turn, role, text): each row opens a message with its role and streams its text in one delta.

    Rows of one turn are messages of their own, in order of role and text, nulls as empty; equal rows are as many messages.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    each = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    # Messages of a turn sort as role, text, copy do: bytes below the separator don't occur in hex.
    message = F.concat(F.hex(F.encode("role", "UTF-8")), F.lit(" "), F.sha2("text", 256), F.lit(" "), F.lpad(F.col("copy").cast("string"), 12, "0"))
    first = F.struct(F.lit(0).alias("k"), F.lit(OPEN).alias("kind"), F.col("role"), F.lit("").alias("text"))
    second = F.struct(F.lit(1).alias("k"), F.lit(DELTA).alias("kind"), F.col("role"), F.col("text"))
    return each.select("conv_id", message.alias("message"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**62))).alias("turn"), F.explode(F.array(first, second)).alias("e")).select("conv_id", "message", (F.col("turn") * 2 + F.col("e.k")).alias("seq"), "e.kind", "e.role", "e.text")


def format_chats(rows: DataFrame) -> DataFrame:
    """FORMATTED for a table of turns: see events_of(), reconstruct() and digest(). An empty table gives no rows."""
    return digest(reconstruct(events_of(rows)))
