"""Chat formatting in windows of a token budget.

A conversation's turns are put in order and cut into windows.  Prefix sums of
the turns' token counts choose, by binary search, the longest span of turns
that fits; a window repeats the system turn and at most ``HISTORY`` turns (as
far as ``HISTORY_SHARE`` of the budget allows) before its own span.  Repeated
targets are masked: each assistant text counts for the loss once.

Template: ``<|turn|>role\\ntext<|end|>\\n``.  Control strings of this and of other
common templates are escaped inside texts and roles by a backslash after the
first character (one more if some stand there already), which is reversible.

Rows are ordered by (turn, role, text), NULLs first; a NULL text is empty, a
NULL role is the empty role, rows without conv_id form one conversation.
Repeated rows are turns of their own.  A turn that is larger than the budget
gets a window of its own, marked ``over_budget``; nothing is dropped or cut.
Rows arrive sorted and are read as a stream: a task holds one window and the
history, never a whole conversation.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hazardlake.session import ship_package

BUDGET = 512                 # tokens of a window
HISTORY = 2                  # repeated turns
HISTORY_SHARE = 0.25         # of the budget that they may take
OVERHEAD = 4                 # tokens of a turn's markers
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TARGET = "assistant"
#: Control strings (fixed values): this template's, then those of other public templates.
CONTROLS = ["<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
_HEAD = re.escape("<") + "|" + re.escape("[")
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"({_HEAD})(\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"({_HEAD})\\(\\*)(?={_TAILS})")
_WORD = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2" + "\\\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    """The role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(text: str) -> int:
    """Words and marks: an estimate that needs no vocabulary; pass another counter if one is at hand."""
    return sum(1 for _ in _WORD.finditer(text))


@dataclass
class Turn:
    role: str
    text: str
    tokens: int = 0
    shown: str = field(default="", repr=False)
    head: int = 0            # characters before the text
    size: int = 0            # characters of the escaped text

    @staticmethod
    def of(role, text, counter):
        role, text = role or "", text or ""
        head = f"{OPEN}{escape_role(role)}\n"
        body = escape(text)
        return Turn(role, text, counter(text) + counter(role) + OVERHEAD, head + body + CLOSE, len(head), len(body))


@dataclass
class Window:
    turns: list
    n_repeated: int
    over_budget: bool

    def render(self):
        """Text, and the character spans of the targets that are not repeated."""
        out, at, spans = [], 0, []
        for k, t in enumerate(self.turns):
            if k >= self.n_repeated and t.role == TARGET and t.size:
                spans += [at + t.head, at + t.head + t.size]
            out.append(t.shown)
            at += len(t.shown)
        return "".join(out), spans


class Windower:
    """Cuts one conversation, given turn by turn, into windows."""

    def __init__(self, budget=BUDGET, history=HISTORY, history_share=HISTORY_SHARE):
        self.budget, self.history, self.room = budget, history, int(budget * history_share)
        self.system: Turn | None = None
        self.past: list[Turn] = []            # the last turns of earlier windows
        self.wait: list[Turn] = []            # turns that no window holds yet
        self.started = False

    def add(self, turn: Turn):
        """Yields the windows that are complete now that ``turn`` is known."""
        if not self.started and turn.role == "system":
            self.system = turn
        self.started = True
        self.wait.append(turn)
        if sum(t.tokens for t in self.wait) > self.budget:
            yield from self._emit(last=False)

    def end(self):
        while self.wait:
            yield from self._emit(last=True)

    def _emit(self, last: bool):
        own_system = self.wait[0] is self.system
        lead = [] if self.system is None or own_system else [self.system]
        kept, used = [], 0
        for t in reversed(self.past[-self.history:] if self.history else []):
            if t is self.system or used + t.tokens > self.room:
                break
            kept.insert(0, t)
            used += t.tokens
        lead += kept
        sums = list(accumulate(t.tokens for t in self.wait))
        left = self.budget - sum(t.tokens for t in lead)
        n = bisect_right(sums, left)          # turns of the span
        if n == 0:
            lead, n = lead[:0] if sums[0] > self.budget else lead[:1], 1
            if lead and lead[0] is not self.system:
                lead = []
        elif n == len(sums) and not last:
            return
        span, self.wait = self.wait[:n], self.wait[n:]
        self.past = (self.past + span)[-max(self.history, 1):]
        turns = lead + span
        yield Window(turns, len(lead), sum(t.tokens for t in turns) > self.budget)


WINDOW_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("window", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss_spans", T.ArrayType(T.IntegerType())), T.StructField("n_turns", T.IntegerType()),
    T.StructField("n_repeated", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("over_budget", T.BooleanType())])
FLUSH_CHARS = 4_000_000


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Turns in order; a conversation's rows lie together in one partition, streamed and never gathered."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return conversations.select(*cols).repartition("conv_id").sortWithinPartitions(*order)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
            history_share: float = HISTORY_SHARE, counter=count_tokens) -> DataFrame:
    """One row per window: formatted text, loss spans, numbers of turns and of repeated turns.

    Windows of a conversation follow each other in their partition, in order.
    """
    ship_package(conversations.sparkSession)

    def run(batches):
        rows: list = []
        held = 0
        current, cutter, number = object(), None, 0

        def take(found):
            nonlocal number, held
            for w in found:
                text, spans = w.render()
                rows.append((current, number, text, spans, len(w.turns), w.n_repeated, sum(t.tokens for t in w.turns), w.over_budget))
                number += 1
                held += len(text)

        for batch in batches:
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv, role, text in zip(ids, roles, texts):
                if cutter is None or conv != current:
                    if cutter is not None:
                        take(cutter.end())
                    current, cutter, number = conv, Windower(budget, history, history_share), 0
                take(cutter.add(Turn.of(role, text, counter)))
                if held > FLUSH_CHARS:
                    yield _batch(rows)
                    rows, held = rows[:0], 0
        if cutter is not None:
            take(cutter.end())
        yield _batch(rows)

    return sorted_turns(conversations).mapInArrow(run, WINDOW_SCHEMA)


_ARROW = [("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int32())),
          ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int32()), ("over_budget", pa.bool_())]


def _batch(rows):
    cols = list(zip(*rows)) or [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _ARROW)], names=[n for n, _ in _ARROW])


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted window."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part[len(OPEN):].partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out
