"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words (A-Z lowered; letters, digits and non-ASCII
characters) and compiled into one suffix automaton per block of at most
``BLOCK_WORDS`` item words; a block is broadcast, further blocks take further
passes, so no broadcast grows with the benchmark.  Training texts stream
through the automaton, which tracks the longest suffix read so far that some
item contains.  Where that length reaches the window (13 words, or a whole
shorter item) the window's words are hit.

Only runs whose neighbouring words all occur as neighbours in some item are
walked; nothing else can hold a window of two or more words.

NULL and empty texts have no words and are never contaminated.  Items without
words are ignored; items with equal ids count once.  A NULL item id is the
empty string.
"""
from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import add_columns, ASCII_LOWER, forget
from hazardlake.session import ship_package

WINDOW = 13
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SQL_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """All factors of the items; ``windows`` and ``short`` name the items whose window a state ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(ws for _, ws in items)))}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        held: dict[int, set] = {}
        whole: dict[int, list] = {}
        shortest = window
        pairs = set()
        for item, ws in items:
            ids = [self.words[w] for w in ws]
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = self._extend(last, c)
                if len(ids) >= window:
                    held.setdefault(last, set()).add(item)
            if len(ids) < window:
                shortest = min(shortest, len(ids))
                whole.setdefault(len(ids), []).append((item, ids))
        self.shortest = shortest
        order = sorted(range(len(self.go)), key=self.length.__getitem__, reverse=True)
        # the state of a match's last `window` words, and the items that hold them
        self.windows: list = [None] * len(self.go)
        for s in order:
            up = self.link[s]
            if up >= 0 and self.length[up] >= window and s in held:
                held.setdefault(up, set()).update(held[s])
        for s in reversed(order):
            if self.length[s] >= window:
                up = self.link[s]
                self.windows[s] = self.windows[up] if self.length[up] >= window else tuple(sorted(held[s]))
        # short items that end in a state, with their lengths
        ends: dict[int, list] = {}
        for n, found in whole.items():
            for item, ids in found:
                s = 0
                for c in ids:
                    s = self.go[s][c]
                ends.setdefault(s, []).append((n, item))
        self.short: list = [()] * len(self.go)
        for s in reversed(order):
            up = self.link[s]
            self.short[s] = (self.short[up] if up >= 0 else ()) + tuple(sorted(ends.get(s, ())))
        n = len(self.words)
        self.pairs = np.unique(np.array([a * n + b for a, b in pairs], np.int64)) if pairs else np.zeros(0, np.int64)

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """A state of its own for the shorter factors of q that end as p's do."""
        go, link, length = self.go, self.link, self.length
        twin = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = twin
            p = link[p]
        return twin

    def runs(self, words: list[bytes]):
        """(start, end, ids) of the stretches that could hold a window."""
        n = len(words)
        if n < self.shortest or not self.words:
            return
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, n)
        ok = ids >= 0
        if self.shortest > 1:
            key = ids[:-1] * len(self.words) + ids[1:]
            both = np.flatnonzero(ok[:-1] & ok[1:])
            at = np.minimum(np.searchsorted(self.pairs, key[both]), max(len(self.pairs) - 1, 0))
            both = both[self.pairs[at] == key[both]] if len(self.pairs) else both[:0]
            ok = np.zeros(n - 1, bool)
            ok[both] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        more = 1 if self.shortest > 1 else 0
        for a, b in zip(edges[::2].tolist(), (edges[1::2] + more).tolist()):
            if b - a >= self.shortest:
                yield a, ids[a:b].tolist()

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [start, end) word spans that are hit, and the items with occurring windows."""
        go, link, length, window = self.go, self.link, self.length, self.window
        spans: list[list[int]] = []
        items: set = set()
        for start, ids in self.runs(words):
            state = matched = 0
            for i, c in enumerate(ids, start):
                while state and c not in go[state]:
                    state = link[state]
                    matched = length[state]
                if c in go[state]:
                    state = go[state][c]
                    matched += 1
                reach = 0
                if matched >= window:
                    reach = window
                    items.update(self.windows[state])
                for n, item in self.short[state]:
                    if n <= matched:
                        reach = max(reach, n)
                        items.add(item)
                if reach:
                    low = i + 1 - reach
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append([low, i + 1])
        return spans, items


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast automata of the benchmark, one per block of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (2 * block_words)          # a word and its separator are two characters at least
    out = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = [(r.item, words_of((r.text or "").encode())) for r in part.collect()]
        rows = sorted(r for r in rows if r[1])
        if rows:
            out.append(spark.sparkContext.broadcast(SuffixAutomaton(rows, window)))
    return out


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(ASCII_LOWER))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end:places[a][0]])
        end = places[b - 1][1]
    return "".join(out) + text[end:]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
          T.StructField("contaminated", T.BooleanType()), T.StructField("clean_text", T.StringType())]


def find_contamination(df: DataFrame, benchmark: DataFrame, column: str = "text", window: int = WINDOW,
                       min_percent: int = 5, max_span: int | None = None, want_text: bool = True, prefix: str = "") -> DataFrame:
    """Append (each name after ``prefix``) n_words, n_hit, item_ids (sorted), hit_spans (start, end, ... in words), contaminated, clean_text.

    ``contaminated``: hit words are ``min_percent`` of the words or more, or a
    span is longer than ``max_span``.  ``clean_text`` is the text without its
    hit spans (NULL where nothing is hit, or unless ``want_text``).
    """
    ship_package(df.sparkSession)
    parts = automata(benchmark, window)

    def make():
        forget()
        found = [p.value for p in parts]

        def run(texts):
            cols: list[list] = [[] for _ in FIELDS]
            for text in texts:
                words = words_of((text or "").encode())
                spans, items = [], set()
                for a in found:
                    s, i = a.matches(words)
                    spans += s
                    items |= i
                spans = merged(spans)
                hit = sum(b - a for a, b in spans)
                bad = hit > 0 and (100 * hit >= min_percent * len(words)
                                   or max_span is not None and max(b - a for a, b in spans) > max_span)
                row = (len(words), hit, sorted(items), list(chain.from_iterable(spans)), bad,
                       cut(text, spans) if spans and want_text else None)
                for c, v in zip(cols, row):
                    c.append(v)
            return cols
        return run

    return add_columns(df, [column], [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], make)


def decontaminate(df: DataFrame, benchmark: DataFrame, column: str = "text", mode: str = "documents", **limits) -> DataFrame:
    """Remove contaminated documents (``mode="documents"``) or the hit spans of contaminated ones (``"spans"``).

    All columns of ``df`` stay as they are, those named like the operator's measures too.
    """
    marked = find_contamination(df, benchmark, column, want_text=mode == "spans", prefix="__found_", **limits)
    if mode == "spans":
        marked = marked.withColumn(column, F.when(F.col("__found_contaminated"), F.col("__found_clean_text")).otherwise(F.col(column)))
    else:
        marked = marked.where(~F.col("__found_contaminated"))
    return marked.select(*df.columns)
