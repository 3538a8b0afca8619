"""Chat formatting from event logs: fold each conversation's events in sequence, then render its final messages.

Events have ``conv_id``, ``seq``, ``kind``, ``turn``, ``role``, ``text``. Kinds:

* ``message`` sets role and text of a turn; without a turn it opens the next one;
* ``delta`` appends text to a turn, the last one if none is named (opened if missing), as streamed answers do;
* ``edit`` replaces a turn's text and drops the turns after it;
* ``regenerate`` empties a turn, keeps its role and drops the turns after it; deltas follow.

Logs are dealt by conversation and sorted within the partition; a task reads them as a stream and holds the final
messages of one conversation at a time, so a partition may be larger than memory. The output has one row per message, so
no conversation has to fit into one row: its text is the rows' segments, joined in the order of ``n``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
#: First characters of control strings: those of the template, and those of other common templates.
CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"([\\<\[])\\")
LEARNED = "assistant"
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20  # of an output batch
EVENT = ["conv_id", "seq", "kind", "turn", "role", "text"]


def escape(text: str) -> str:
    """A backslash goes behind every backslash and behind the first character of every control string."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """Segment of one message, and the range of the text in it (code points)."""
    head = f"{OPEN}{escape(role)}{SAYS}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment; the inverse of ``render``."""
    role, _, rest = segment[len(OPEN):].partition(SAYS)
    return unescape(role), unescape(rest[: -len(CLOSE)])


class Conversation:
    """Final messages so far: turn -> [role, parts of the text], and the turns in order.

    An event costs the logarithm of the number of turns: an edit cuts the end of the order, and what is cut once is gone.
    """

    def __init__(self):
        self.turns: dict[int, list] = {}
        self.order: list[int] = []

    def apply(self, kind: str | None, turn: int | None, role: str | None, text: str | None) -> None:
        turns, order, text = self.turns, self.order, text or ""
        if kind == "message":
            self.open(order[-1] + 1 if turn is None and order else turn or 0)[:] = [role or "", [text]]
            return
        turn = (order[-1] if order else 0) if turn is None else turn
        if kind == "delta":
            if turn not in turns:
                self.open(turn)[:] = [role or LEARNED, []]
            turns[turn][1].append(text)
        elif kind in ("edit", "regenerate") and turn in turns:
            turns[turn][1] = [text] if kind == "edit" else []
            end = bisect_right(order, turn)
            for later in order[end:]:
                del turns[later]
            del order[end:]

    def open(self, turn: int) -> list:
        if turn not in self.turns:
            self.turns[turn] = []
            insort(self.order, turn)
        return self.turns[turn]

    def messages(self) -> Iterator[tuple[str, str]]:
        for turn in self.order:
            role, parts = self.turns[turn]
            yield role, "".join(parts)


def format_events(events: DataFrame) -> DataFrame:
    """``conv_id``, ``n`` (from 0), ``segment``, ``loss_from``, ``loss_to``: one row per final message.

    The loss range (code points in the segment) covers assistant texts and is null for other roles. Rows of a conversation
    come out together and in order. Null texts count as empty, a null role as an empty name (for a delta: assistant), null
    or unknown kinds and edits of turns that don't exist change nothing. Events without ``conv_id`` form one conversation.
    Null sequence numbers come first; equal ones follow turn, kind, role and text, so repeated rows are applied twice. A
    conversation that ends without messages has no row. Other columns are ignored; an empty table gives no rows.
    """
    log = events.select(
        F.col("conv_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("turn").cast("long"), "role", "text")
    ordered = log.repartition("conv_id").sortWithinPartitions(*EVENT)

    def flush(conv: int | None, state: Conversation) -> Iterator[tuple]:
        for n, (role, text) in enumerate(state.messages()):
            segment, start, end = render(role, text)
            yield (conv, n, segment, *((start, end) if role == LEARNED else (None, None)))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, state = None, None
        for batch in batches:
            for conv, _, kind, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != now:
                    if state is not None:
                        yield from flush(now, state)
                    now, state = conv, Conversation()
                state.apply(kind, turn, role, text)
        if state is not None:
            yield from flush(now, state)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in finished(batches):
            out.append(row)
            size += len(row[2])
            if len(out) == BATCH_ROWS or size >= BATCH_CHARS:  # a conversation may be larger than a batch
                yield rows(out)
                out, size = [], 0
        yield rows(out)

    kinds = {"conv_id": pa.int64(), "n": pa.int64(), "segment": pa.string(), "loss_from": pa.int64(),
             "loss_to": pa.int64()}

    def rows(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    return ordered.mapInArrow(fold, "conv_id long, n long, segment string, loss_from long, loss_to long")


def digests(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``.

    ``segments`` as ``format_events`` returns them, with the rows of a conversation together and in order; they are hashed
    as a stream.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for conv, _, segment, start, end in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != now:
                    if state is not None:
                        out.append(done(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(segment[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(segment)
            yield rows(out)
        if state is not None:
            yield rows([done(now, state)])

    def done(conv: int | None, s: list) -> tuple:
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
             "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def rows(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    return segments.select("conv_id", "n", "segment", "loss_from", "loss_to").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
