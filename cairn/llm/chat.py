"""Chat formatting in budgeted windows.

Prefix sums of turn tokens (subword ids of the formatted turn, by the BPE encoder of this package) are searched for spans of whole turns: a window
holds the conversation's system turn, as much history as fits a limit (repeated, whole turns, the latest; the oldest of it goes first where the next
new turn wouldn't fit the budget), then new turns up to the budget. New assistant texts are under the loss mask; repeated turns and all other roles
are not, so each assistant text is learned from once. A turn is never cut: one that is over the budget even alone with the system turn gets a
window without history.

Template: a turn is its mark, its escaped text and its end mark (MARKS). Inside texts a backslash is doubled and a control string
gets a backslash after its first character, so that no control string is left and the escape can be taken back.

Rows are dealt by conversation, sorted, and worked through as they come: memory holds one window and its history, however
long a conversation is.

Defined cases: null text is empty, a null role is the empty role, null turns come first, rows with equal turn are ordered by role and text, and
repeated rows are turns of their own; null conv_ids are one conversation; a very long text is one turn, held whole; a conversation is one task's stream, as its
digests are; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import vocabulary
from cairn.llm.common import small_batches

BUDGET, HISTORY = 1024, 256
#: Start and end of a turn by role; any other role is named inside it: [ROLE]name[TEXT]text[/ROLE].
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
CONTROL = r"</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]"
_ESCAPE = re.compile(rf"\\|(?={CONTROL})[<\[]")
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"(?:<<SYS>>\n(?P<system>.*?)\n<</SYS>>|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[TEXT\](?P<text>.*?)\[/ROLE\])\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its escaped text starts and ends."""
    body = escape(text)
    start, end = MARKS.get(role) or (f"[ROLE]{escape(role)}[TEXT]", "[/ROLE]")
    return f"{start}{body}{end}\n", len(start), len(start) + len(body)


class Windows:
    """Takes turns one by one, gives windows: (text, turns repeated, loss spans). count: the tokens of a formatted turn."""

    def __init__(self, count: Callable[[str], int], budget: int = BUDGET, history: int = HISTORY):
        self.count, self.budget, self.history = count, budget, history
        self.system: tuple | None = None  # once it has had its window
        self.turns: list[tuple] = []  # role, formatted, start and end of its text: history and new turns
        self.prefix = [0]  # tokens before each of them, and of all
        self.new = 0  # where new turns begin
        self.begun = False

    def _room(self) -> int:
        return self.budget - (self.system[4] if self.system else 0)

    def _from(self) -> int:
        """Where the window's history begins: by its limit, and so that the first new turn fits."""
        least = bisect_left(self.prefix, self.prefix[self.new] - self.history)
        return min(self.new, max(least, bisect_left(self.prefix, self.prefix[self.new + 1] - self._room())))

    def add(self, role: str, text: str) -> Iterator[tuple]:
        made, start, end = turn_text(role, text)
        self.turns.append((role, made, start, end, self.count(made)))
        self.prefix.append(self.prefix[-1] + self.turns[-1][4])
        while self.new < len(self.turns):
            most = max(self.new + 1, bisect_right(self.prefix, self.prefix[self._from()] + self._room()) - 1)
            if most >= len(self.turns):
                break
            yield self._close(most)

    def end(self) -> Iterator[tuple]:
        if self.new < len(self.turns):
            yield self._close(len(self.turns))

    def _close(self, upto: int) -> tuple:
        again = ([self.system] if self.system else []) + self.turns[self._from() : self.new]
        parts, spans, at = [], [], 0
        for i, (role, made, start, end, _) in enumerate([*again, *self.turns[self.new : upto]]):
            if role == "assistant" and i >= len(again):
                spans.append((at + start, at + end))
            parts.append(made)
            at += len(made)
        if not self.begun and self.turns[0][0] == "system":
            self.system = self.turns.pop(0)  # from now on in front of each window, and not part of the history
            self.prefix = [x - self.system[4] for x in self.prefix[1:]]
            upto -= 1
        self.begun, self.new = True, upto
        gone = bisect_left(self.prefix, self.prefix[upto] - self.history)
        self.turns, self.prefix, self.new = self.turns[gone:], [x - self.prefix[gone] for x in self.prefix[gone:]], upto - gone
        return "".join(parts), len(again), spans


def read_window(text: str, repeated: int) -> list[tuple[str, str]]:
    """The new turns of a formatted window, unescaped."""
    out = []
    for m in list(_TURN.finditer(text))[repeated:]:
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
    return out


def _sorted(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(rows: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, window, text, repeated (turns seen before), loss: array of (start, end) code points.

    path: the vocabulary file that tokens are counted by, present on every machine.
    A partition's rows are in order of conv_id and window.
    """
    schema = "conv_id long, window long, text string, repeated int, loss array<struct<start:int,end:int>>"
    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        ids, numbers, texts, repeated, loss = zip(*out, strict=True)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(repeated, pa.int32()), pa.array([[{"start": a, "end": b} for a, b in x] for x in loss], loss_type)], ["conv_id", "window", "text", "repeated", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        size = lambda made: len(known.encode(made))
        now, state, count, out = None, None, 0, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if state is None or conv != now:
                    for x in state.end() if state else ():
                        out.append((now, count, *x))
                    now, state, count = conv, Windows(size, budget, history), 0
                for x in state.add(role, text):
                    out.append((now, count, *x))
                    count += 1
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        for x in state.end() if state else ():
            out.append((now, count, *x))
        if out:
            yield batch_of(out)

    return _sorted(rows).mapInArrow(run, schema)


def digests(windows: DataFrame) -> DataFrame:
    """Reads windows back, as format_conversations deals and orders them: one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, out = None, False, []
        n = chars = size = 0
        turns = loss = None
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv, number, text, repeated, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != now:
                    if started:
                        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows))
                    now, started, n, chars, size, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                windows = number + 1
                for role, said in read_window(text, repeated):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learned = unescape(text[s["start"] : s["end"]])
                    chars += len(learned)
                    loss.update(learned.encode())
                size += len(text)
            if len(out) >= 1024:
                yield batch_of()
                out = []
        if started:
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size, windows))
        if out:
            yield batch_of()

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
