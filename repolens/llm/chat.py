"""Chat formatting (operator 1): event-sourced reconstruction of conversations.

Events (conv_id, message, seq, kind, role, text) are partitioned by conversation, sorted by sequence and folded:

* ``message`` opens a message with a whole text, ``start`` opens an empty one;
* ``delta`` appends to the message opened last under the same number (opens one if there is none);
* ``edit`` replaces its text, ``regenerate`` empties it for new deltas, ``delete`` drops it.

The fold streams over the sorted partition and holds one message and one part of the output at a time, so a
conversation of any length passes in bounded memory. Messages of one number that ``message`` or ``start``
open anew stay messages of their own; ties of (message, seq) are taken in the order of role, then text.
Null roles are the empty role and null texts the empty text; null conversations form one conversation. A very long
turn is held whole, as one message; extra columns play no part; an empty table gives no rows.

Rendering: ``[SYS] `` text `` [/SYS]``, ``[INST] `` text `` [/INST]``, ``[BOT] `` text `` </s>`` for system, user and
assistant, ``[ROLE=name] `` text `` [/ROLE]`` for others. A backslash goes before every backslash, ``[`` and ``<`` of
a text (and ``]`` of a role's name), so that no text holds a control string and unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "[BOT] "}
CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": " </s>"}
#: Characters of formatted text in one output row at most, unless a single turn is longer.
PART_CHARS = 1 << 20

_ESCAPE = re.compile(r"[\\\[<]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"(?:\[SYS\] (?P<sys>(?:[^\\\[<]|\\.)*) \[/SYS\]|\[INST\] (?P<inst>(?:[^\\\[<]|\\.)*) \[/INST\]|\[BOT\] (?P<bot>(?:[^\\\[<]|\\.)*) </s>|\[ROLE=(?P<role>(?:[^\\\]]|\\.)*)\] (?P<text>(?:[^\\\[<]|\\.)*) \[/ROLE\])\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text starts and ends in it."""
    head = OPEN.get(role) or "[ROLE=" + re.sub(r"[\\\]]", lambda m: "\\" + m[0], role) + "] "
    body = escape(text)
    return head + body + CLOSE.get(role, " [/ROLE]") + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text. Raises where it is not one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        for group, role in (("sys", "system"), ("inst", "user"), ("bot", "assistant"), ("text", None)):
            if m[group] is not None:
                out.append((unescape(m["role"]) if role is None else role, unescape(m[group])))
        at = m.end()
    return out


EVENTS = ("conv_id", "message", "seq", "kind", "role", "text")
RESULT = "part int, formatted string, loss array<struct<start:int,end:int>>, last boolean"


def _folded(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, role, text) of each final message, from sorted events; (conv, None, None) after each conversation."""
    conv = number = role = None
    pieces: list[str] | None = None
    begun = False
    for c, m, kind, r, t in rows:
        if begun and (c != conv or m != number or kind in ("message", "start")):
            if pieces is not None:
                yield conv, role, "".join(pieces)
            pieces = None
            if c != conv:
                yield conv, None, None
        if not begun or c != conv or m != number:
            role = None
        begun, conv, number = True, c, m
        if kind in ("message", "start"):
            role, pieces = r or "", [t or ""] if kind == "message" else []
        elif kind == "delta":
            pieces = [] if pieces is None else pieces
            role = r or "" if role is None else role
            pieces.append(t or "")
        elif kind in ("edit", "regenerate"):
            role = r or "" if role is None else role
            pieces = [t or ""] if kind == "edit" else []
        elif kind == "delete":
            pieces = None
    if begun:
        if pieces is not None:
            yield conv, role, "".join(pieces)
        yield conv, None, None


def format_events(events: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows (conv_id, part, formatted, loss, last): the concatenated parts of a conversation are its formatted text,
    ``loss`` has the spans of assistant texts within the part, escapes included. Parts follow each other in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

        out: list[tuple] = []
        text: list[str] = []
        loss: list[dict] = []
        size = part = held = 0
        for conv, role, body in _folded(rows()):
            if role is None or size >= part_chars:
                out.append((conv, part, "".join(text), loss, role is None))
                held += size + 1
                text, loss, size, part = [], [], 0, 0 if role is None else part + 1
            if role is not None:
                turn, a, b = render(role, body)
                if role == "assistant":
                    loss.append({"start": size + a, "end": size + b})
                text.append(turn)
                size += len(turn)
            if len(out) >= 2000 or held > 4 * part_chars:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out), types)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = events.schema["conv_id"].dataType
    names = ["conv_id", "part", "formatted", "loss", "last"]
    types = [to_arrow_type(kind), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.bool_()]
    dealt = events.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "message", "seq", "role", "text")
    return dealt.select("conv_id", "message", "kind", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, {RESULT}")


def as_events(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Whole messages, a row each, as events."""
    turn = F.col(turn_col).cast("long")
    return conversations.select(F.col(conv_col).alias("conv_id"), turn.alias("message"), turn.alias("seq"), F.lit("message").alias("kind"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from format_events' output: turns, their digest, the masked text and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        for batch in batches:
            out = []
            for conv, text, spans, last in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for role, body in parse(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for span in spans:
                    body = unescape(text[span["start"] : span["end"]])
                    loss.update(body.encode())
                    loss_chars += len(body)
                chars += len(text)
                if last:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.select("conv_id", "formatted", "loss", "last").mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
