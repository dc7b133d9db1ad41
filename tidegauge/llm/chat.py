"""Chat formatting with a grammar round trip.

A turn is rendered between an opening and a closing mark that depend on its role. The rendered turn is parsed again by
the parser that readers of the output use; if what comes back is not the turn, its text is escaped and the turn is
rendered anew until both are identical. Turns are self-delimiting, so a conversation is the plain concatenation of
its turns, and both writer and reader work on a sorted stream: a conversation of any length needs the memory of a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's marks.
OPENING = {"user": "[INST] ", "assistant": " ", "system": "<<SYS>>\n"}
CLOSING = {"user": " [/INST]", "assistant": "</s>", "system": "\n<</SYS>>\n\n"}
OTHER_OPENING, OTHER_BETWEEN, OTHER_CLOSING = "<<ROLE ", ">>", "<</ROLE>>"
#: Strings that only the template may write; a text's own are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>")

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TO_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
#: What the scanner meets within a text: an escaped character, or a control string.
_MET = re.compile(r"\\(.)?|" + _CONTROL.pattern, re.DOTALL)
_ROLE_ESCAPE = re.compile(r"[\\<>\[]")


class Malformed(ValueError):
    """The formatted text isn't of the grammar."""


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def _wrapped(role: str, text: str) -> str:
    if role in OPENING:
        return OPENING[role] + text + CLOSING[role]
    return OTHER_OPENING + _ROLE_ESCAPE.sub(lambda m: "\\" + m[0], role) + OTHER_BETWEEN + text + OTHER_CLOSING


def _scan(data: str, at: int, closing: str) -> tuple[str, int]:
    """The unescaped text from ``at`` up to the first ``closing``, and where that ends."""
    mark = closing.strip() or closing
    out: list[str] = []
    close = data.find(closing, at)
    while True:
        if 0 <= close < at:
            close = data.find(closing, at)
        met = _MET.search(data, at)
        if met and met[0][0] == "\\" and (close < 0 or met.start() < close):
            if met[1] is None:
                raise Malformed("the text ends within an escape")
            out += [data[at : met.start()], met[1]]
            at = met.end()
            continue
        if close < 0:
            raise Malformed("a turn isn't closed")
        if met and met.start() < close + closing.find(mark):
            raise Malformed("a control string within a text")
        return "".join(out) + data[at:close], close + len(closing)


def parse_turn(data: str, at: int = 0) -> tuple[str, str, int]:
    """The turn that begins at ``at``: role, text, where it ends."""
    for role, opening in OPENING.items():
        if data.startswith(opening, at):
            text, end = _scan(data, at + len(opening), CLOSING[role])
            return role, text, end
    if not data.startswith(OTHER_OPENING, at):
        raise Malformed("no turn begins here")
    role, begin = _scan_role(data, at + len(OTHER_OPENING))
    text, end = _scan(data, begin, OTHER_CLOSING)
    return role, text, end


def _scan_role(data: str, at: int) -> tuple[str, int]:
    out: list[str] = []
    while at < len(data):
        if data[at] == "\\":
            out.append(data[at + 1 : at + 2])
            at += 2
        elif data.startswith(OTHER_BETWEEN, at):
            return "".join(out), at + len(OTHER_BETWEEN)
        else:
            out.append(data[at])
            at += 1
    raise Malformed("a role isn't closed")


def parse(data: str) -> list[tuple[str, str]]:
    """All turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(data):
        role, text, at = parse_turn(data, at)
        turns.append((role, text))
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn, escaped only if it would not parse back to itself otherwise."""
    for candidate in (text, escape(text)):
        piece = _wrapped(role, candidate)
        try:
            got = parse_turn(piece)
        except Malformed:
            continue
        if got == (role, text, len(piece)):
            return piece
    raise Malformed(f"role {role!r} can't be written")


def mask_span(piece: str) -> tuple[int, int] | None:
    """Where the text under the loss mask lies in a rendered turn (code points, escapes included); None: nothing does."""
    opening, closing = OPENING["assistant"], CLOSING["assistant"]
    if parse_turn(piece)[0] != "assistant":
        return None
    return len(opening), len(piece) - len(closing)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_PIECES = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("loss_spans", _SPANS), ("last", pa.bool_())])
_READ = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_DDL = {
    "piece": "conv_id long, seq long, piece string, loss_spans array<struct<start:int,stop:int>>, last boolean",
    "read": "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
}
_BEGIN = object()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text), sorted by conversation and turn → pieces; a piece is held until it is known whether it is the last."""
    held: tuple | None = None
    for batch in batches:
        done = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seq = held[1] + 1 if held and held[0] == conv else 0
            if held:
                done.append((*held, seq == 0))
            piece = render_turn(role, text)
            span = mask_span(piece)
            held = conv, seq, piece, [] if span is None else [{"start": span[0], "stop": span[1]}]
        if done:
            yield pa.record_batch(list(map(list, zip(*done, strict=True))), schema=_PIECES)
    if held:
        yield pa.record_batch([[x] for x in (*held, True)], schema=_PIECES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order → a row per conversation, from incremental digests."""
    now, due, state = _BEGIN, None, []
    turns = loss = hashlib.sha256()

    def row() -> tuple:
        if due is not None:
            raise Malformed(f"conversation {now}: piece {due} is missing")
        return now, state[0], turns.hexdigest(), state[1], loss.hexdigest(), state[2]

    for batch in batches:
        done = []
        for conv, seq, piece, spans, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is _BEGIN or conv != now:
                if now is not _BEGIN:
                    done.append(row())
                now, due, state, turns, loss = conv, 0, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
            if seq != due:
                raise Malformed(f"conversation {conv}: piece {seq} where {'none' if due is None else due} is due")
            due = None if last else seq + 1
            for role, text in parse(piece):
                state[0] += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in spans:
                learnt = unescape(piece[span["start"] : span["stop"]])
                state[1] += len(learnt)
                loss.update(learnt.encode())
            state[2] += len(piece)
        if done:
            yield pa.record_batch(list(map(list, zip(*done, strict=True))), schema=_READ)
    if now is not _BEGIN:
        yield pa.record_batch([[x] for x in row()], schema=_READ)


def render_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted conversations as rows (conv_id, seq, piece, loss_spans, last).

    A conversation's formatted text is its pieces joined with nothing between, in the order of seq from 0; ``last``
    marks the one that ends it. ``loss_spans`` are the stretches of a piece (code points from start to before stop)
    under the loss mask: the text of an assistant turn, as it is escaped.

    * Null texts and null roles are empty strings. A null conv_id is a conversation of its own.
    * Turns go by number, null first, then by role and text; rows that repeat a turn are turns of their own.
    * Any role can be written; only ``assistant`` texts are under the loss mask.
    * No rows give no rows; other columns aren't looked at; a text of any length is one piece.

    One conversation's turns are read one after another by one task (its digests and its text are sequential), which
    holds a batch of them at a time: a conversation that holds a third of all rows takes time there, not memory.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    in_order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_order.select("conv_id", "role", "text").mapInArrow(_render, _DDL["piece"])


def read_conversations(pieces: DataFrame) -> DataFrame:
    """What the grammar's parser reads back from :func:`render_conversations`, however its rows lie: a row per conversation.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars and loss_sha256 (of all text
    under the loss mask, in order, unescaped, nothing between), formatted_chars (code points of the formatted text).
    A piece that is missing, repeated or not of the grammar raises :class:`Malformed`.
    """
    in_order = pieces.select("conv_id", "seq", "piece", "loss_spans", "last").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return in_order.mapInArrow(_read_back, _DDL["read"])
