"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

* One Spark job counts the white-space separated pieces of *all* texts; the
  ``lexicon_words`` most frequent give the words of the lexicon.
* The driver encodes these (a bounded list) and compiles them into a minimal
  acyclic automaton: suffixes are shared, every arc carries the number of
  words that sort before it, so the sum along a path is the word's number and
  indexes its ids.  The automaton is one ``.npy`` file that executors fetch
  with ``addFile`` and map into memory.
* Tasks look up the new words of a batch in the automaton, all words at once,
  and merge the unseen ones exactly (lowest rank, leftmost first), again all
  at once.  Results are remembered per piece in a dictionary of bounded size.

The lexicon only saves work: a word gets the same ids with any lexicon.
NULL and empty texts have no ids.  Special tokens named in the vocabulary file
are matched in the raw text, as the file says.
"""
from __future__ import annotations

import gc
import heapq
import json
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import add_columns, materialise, most_frequent, slices, worker_memory
from hazardlake.session import ship_package

LEXICON_WORDS = 50_000       # frequent pieces compiled into the automaton
MEMO_PIECES = 300_000        # pieces a worker remembers before it starts anew
MEMO_BYTES = 48 << 20        # and their bytes, about
GROUP_PIECES = 120_000       # pieces of the texts that are learnt together
COUNT_PIECES = 200_000       # distinct pieces a counting task holds before it hands them on
NEVER = np.int32(2**31 - 1)
SPACES = regex.compile(r"\s+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 0
    for b in range(256):
        if b in shown:
            names[b] = chr(b)
        else:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file (BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in chain(self.ids.items(), self.special.items()):
            self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        end = model["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([self.ids[c] for c in chars], np.int32)
        self.last = np.array([self.ids[c + end] for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([self.ids[a] << 20 | self.ids[b] for a, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int32)
        self.pairs = PairTable(keys, np.arange(len(keys), dtype=np.int32), made)
        self.hint = os.path.commonprefix(list(self.special))           # what every special token holds, perhaps nothing
        self.marker = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def pieces(self, text: str) -> list[str]:
        """The normalised text, cut at white space (which the word pattern never crosses)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")   # lower case of each character by itself
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):                  # white space to split(), not to the pattern
            return SPACES.sub(" ", text).lower().split(" ")
        return text.lower().split()


class PairTable:
    """Hash table from a pair of symbols to (rank, merged symbol), probed for whole arrays."""

    def __init__(self, keys, ranks, made):
        self.bits = max(10, (2 * len(keys)).bit_length())          # at most half full
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NEVER, np.int32)
        self.made = np.zeros(size, np.int32)
        for k, slot, r, m in zip(keys.tolist(), self.slot(keys).tolist(), ranks.tolist(), made.tolist()):
            while self.keys[slot] >= 0 and self.keys[slot] != k:
                slot = (slot + 1) & (size - 1)
            if self.keys[slot] < 0:
                self.keys[slot], self.ranks[slot], self.made[slot] = k, r, m

    def slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a, b):
        """Slots of the pairs (a, b); slots of unknown pairs have rank NEVER."""
        keys = a.astype(np.int64) << 20 | b
        slot = self.slot(keys)
        held = self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return slot


def merge_words(vocab: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """Ids of words by exact BPE merging; words of like length are merged together in one array."""
    out: list = [None] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for high in (4, 8, 12, 16, 24, 32, 48):
        at = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        for start in range(0, at.size, 16384):
            part = at[start:start + 16384]
            for i, ids in zip(part.tolist(), _merge_block(vocab, [words[i] for i in part.tolist()], sizes[part], high)):
                out[i] = ids
    for i in np.flatnonzero(sizes > low).tolist():
        out[i] = _merge_long(vocab, words[i])
    return out


def _merge_block(vocab, words, sizes, width):
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    cols = np.arange(width)
    sym = np.where(cols < sizes[:, None], vocab.inner[raw], -1).astype(np.int32)
    rows = np.arange(len(words))
    sym[rows, sizes - 1] = vocab.last[raw[rows, sizes - 1]]
    slot = np.zeros((len(words), width), np.int64)
    rank = np.full((len(words), width), NEVER, np.int32)
    there = cols[:-1] < (sizes - 1)[:, None]
    r, c = np.nonzero(there)
    slot[r, c] = vocab.pairs.find(sym[r, c], sym[r, c + 1])
    rank[r, c] = vocab.pairs.ranks[slot[r, c]]
    left = sizes.copy()
    live = rows
    while live.size:
        at = rank[live].argmin(axis=1)
        best = rank[live, at]
        go = best < NEVER
        live, at = live[go], at[go]
        if not live.size:
            break
        new = vocab.pairs.made[slot[live, at]]
        # close the gap to the right of the merged pair
        take = cols[None, :] + (cols[None, :] > at[:, None])
        np.minimum(take, width - 1, out=take)
        for m in (sym, slot, rank):
            m[live] = np.take_along_axis(m[live], take, axis=1)
        left[live] -= 1
        sym[live, at] = new
        rank[live, np.maximum(left[live] - 1, 0)] = NEVER
        for side in (at - 1, at):
            ok = (side >= 0) & (side < left[live] - 1)
            r, c = live[ok], side[ok]
            slot[r, c] = s = vocab.pairs.find(sym[r, c], sym[r, c + 1])
            rank[r, c] = vocab.pairs.ranks[s]
    flat = sym.tolist()
    return [row[:n] for row, n in zip(flat, left.tolist())]


def _merge_long(vocab, word):
    """The same merges for a very long word, with a heap: near-linear in its length."""
    raw = np.frombuffer(word, np.uint8)
    first = vocab.inner[raw].copy()
    first[-1] = vocab.last[raw[-1]]
    sym = first.tolist()
    n = len(sym)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    pairs = vocab.pairs
    known: dict = {}

    def look(a, b):
        if (a, b) not in known:
            s = int(pairs.find(np.array([a], np.int32), np.array([b], np.int32))[0])
            known[a, b] = (int(pairs.ranks[s]), int(pairs.made[s]))
        return known[a, b]

    heap = [(look(sym[i], sym[i + 1])[0], i, sym[i], sym[i + 1]) for i in range(n - 1)]
    heap = [h for h in heap if h[0] < NEVER]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i] = look(a, b)[1]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for k in (prev[i], i):
            if k >= 0 and nxt[k] < n:
                r = look(sym[k], sym[nxt[k]])[0]
                if r < NEVER:
                    heapq.heappush(heap, (r, k, sym[k], sym[nxt[k]]))
    return [s for s, ok in zip(sym, alive) if ok]


# ---------------------------------------------------------------- lexicon

class Lexicon:
    """Minimal acyclic automaton over bytes; a path's summed outputs number the word, which indexes its ids."""

    def __init__(self, flat: np.ndarray):
        n_arcs, n_states, n_words, self.root, self.longest = (int(x) for x in flat[:5])
        cut = np.cumsum([5, n_arcs, n_arcs, n_arcs, n_states, n_words + 1])
        self.arcs, self.goes, self.adds, self.final, self.starts = (flat[a:b] for a, b in zip(cut, cut[1:]))
        self.ids = flat[cut[-1]:]

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> np.ndarray:
        """Insert the words in order, replacing each finished suffix by an equal state that exists."""
        known: dict = {}
        states: list = []                      # (final, ((byte, state), ...)) of finished states

        def finish(node):
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        path, last = [[False, []]], b""
        ordered = sorted(words)
        for w in ordered:
            same = len(os.path.commonprefix((w, last)))
            for i in range(len(last), same, -1):
                done = finish(path.pop())
                path[-1][1].append((last[i - 1], done))
            path += [[False, []] for _ in range(len(w) - same)]
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            done = finish(path.pop())
            path[-1][1].append((last[i - 1], done))
        root = finish(path.pop())
        below = []                             # words from each state; its targets are finished before it
        for final, arcs in states:
            below.append(int(final) + sum(below[s] for _, s in arcs))
        keys, goes, adds = [], [], []
        for s, (final, arcs) in enumerate(states):
            add = int(final)
            for b, t in arcs:
                keys.append(s << 8 | b)
                goes.append(t)
                adds.append(add)
                add += below[t]
        ids = [words[w] for w in ordered]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
        head = [len(keys), len(states), len(ids), root, max(map(len, ordered), default=0)]
        return np.concatenate([np.array(x, np.int64) for x in (
            head, keys, goes, adds, [f for f, _ in states], starts, list(chain.from_iterable(ids)))])

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the lexicon lacks it; all words walk the automaton together."""
        out = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(sizes <= self.longest)
        if not live.size or not len(self.arcs):
            return out
        width = int(sizes[live].max())
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in live.tolist()), np.uint8).reshape(-1, width)
        row = np.arange(live.size)
        state = np.full(live.size, self.root, np.int64)
        total = np.zeros(live.size, np.int64)
        for i in range(width + 1):
            ends = sizes[live[row]] == i
            done = row[ends]
            hit = self.final[state[ends]] > 0
            out[live[done[hit]]] = total[ends][hit]
            row, state, total = row[~ends], state[~ends], total[~ends]
            if not row.size:
                break
            key = state << 8 | raw[row, i]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[at] == key
            row, at = row[ok], at[ok]
            state, total = self.goes[at], total[ok] + self.adds[at]
        return out

    def word_ids(self, number: int) -> list[int]:
        return self.ids[int(self.starts[number]):int(self.starts[number + 1])].tolist()


def piece_counts(texts: DataFrame, vocab_path: str, column: str = "text") -> DataFrame:
    """(piece, n): the white-space separated pieces of all normalised texts."""
    ship_package(texts.sparkSession)

    def run(batches):
        vocab, counts = vocabulary(vocab_path), Counter()
        for batch in chain.from_iterable(map(slices, batches)):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(vocab.pieces(text))
                    if len(counts) > COUNT_PIECES:
                        yield _counted(counts)
                        counts = Counter()
        yield _counted(counts)

    parts = texts.select(column).mapInArrow(run, "piece string, n long")
    return parts.where("piece != ''").groupBy("piece").agg(F.sum("n").alias("n"))


def _counted(counts):
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                       pa.array(list(counts.values()), pa.int64())], names=["piece", "n"])


def build_lexicon(texts: DataFrame, vocab_path: str, column: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``texts``; returns the name of the file that tasks map into memory."""
    spark = texts.sparkSession
    counts = materialise(piece_counts(texts, vocab_path, column), "pieces")
    top = most_frequent(counts, "n", words).select("piece").collect()
    return ship_lexicon(spark, compile_lexicon(vocabulary(vocab_path), [r.piece for r in top]))


def compile_lexicon(vocab: Vocabulary, pieces: list[str]) -> np.ndarray:
    plain = sorted({w.encode() for p in pieces for w in vocab.words.findall(p)})
    return Lexicon.compile(dict(zip(plain, merge_words(vocab, plain))))


def ship_lexicon(spark: SparkSession, flat: np.ndarray) -> str:
    folder = tempfile.mkdtemp(prefix="lexicon-")
    name = os.path.basename(folder) + ".npy"
    np.save(os.path.join(folder, name), flat)
    spark.sparkContext.addFile(os.path.join(folder, name))   # executors fetch it from the driver
    return name


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes and decodes batches of texts; holds a bounded memory of pieces.

    The ids of all pieces lie in one array, beside where each piece's begin; only the piece itself is a Python
    object.  The memory starts anew beyond ``memo_bytes`` or ``memo_pieces``.
    """

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, memo_pieces: int = MEMO_PIECES, memo_bytes: int = MEMO_BYTES):
        self.vocab, self.lexicon, self.limit, self.most = vocab, lexicon, memo_pieces, memo_bytes
        self._forget()

    def _forget(self):
        self.index: dict = {"": 0}             # special tokens are in it by their id
        self.flat, self.starts, self.bytes = array("i"), array("q", [0, 0]), 0

    def _remember(self, piece, ids):
        self.index[piece] = len(self.starts) - 1
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.bytes += 4 * len(ids) + 8 + 150 + (len(piece) if piece.__class__ is str else 0)

    def _learn(self, pieces):
        fresh = [p for p in pieces if p not in self.index]
        new = [p for p in fresh if p.__class__ is str]
        for token in fresh:
            if token.__class__ is int:
                self._remember(token, [token])
        if not new:
            return
        split = [[p] if p.isascii() and p.isalpha() else self.vocab.words.findall(p) for p in new]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        raw = [w.encode() for w in words]
        at = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        ids = {w: self.lexicon.word_ids(i) for w, i in zip(words, at.tolist()) if i >= 0}
        unseen = [i for i, n in enumerate(at.tolist()) if n < 0]
        for i, merged in zip(unseen, merge_words(self.vocab, [raw[i] for i in unseen])):
            ids[words[i]] = merged
        for p, ws in zip(new, split):
            self._remember(p, ids[ws[0]] if len(ws) == 1 else [t for w in ws for t in ids[w]])

    def _pieces(self, text):
        """Pieces of a text between white space; a special token is given as its id."""
        if not text:
            return []
        if self.vocab.special and self.vocab.hint in text and self.vocab.marker.search(text):
            out, end = [], 0
            for m in self.vocab.marker.finditer(text):
                out += self.vocab.pieces(text[end:m.start()])
                out.append(self.vocab.special[m.group()])
                end = m.end()
            return out + self.vocab.pieces(text[end:])
        return self.vocab.pieces(text)

    def encode(self, texts: list[str | None]):
        """Yields the ids of each text, as a list."""
        for ids in self.arrays(texts):
            yield ids.tolist()

    def arrays(self, texts):
        """Yields the ids of each text, as an array.  Pieces are learnt for some texts at a time, to bound memory."""
        group, held = [], 0
        for text in texts:
            group.append(self._pieces(text))
            held += len(group[-1])
            if held > GROUP_PIECES:
                yield from self._flush(group)
                group, held = [], 0
        yield from self._flush(group)

    def _flush(self, group):
        if len(self.index) > self.limit or self.bytes > self.most:
            self._forget()
        gc.disable()        # many small lists, none of them cyclic
        try:
            self._learn(set(chain.from_iterable(group)))
        finally:
            gc.enable()
        out = []
        flat, starts = np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64)
        get = self.index.__getitem__
        for pieces in group:
            k = np.fromiter(map(get, pieces), np.int64, len(pieces))
            begin, sizes = starts[k], starts[k + 1] - starts[k]
            ends = np.cumsum(sizes)
            out.append(flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        del flat, starts    # views would keep the arrays from growing
        return out

    def decode(self, ids: list[int] | None) -> str:
        """Tokens joined by one space: the vocabulary file names no decoder."""
        return " ".join(map(self.vocab.tokens.__getitem__, ids or ()))


def encoder(vocab_path: str, lexicon_name: str) -> Encoder:
    """The encoder of a worker, kept for its later tasks; the automaton stays a memory map of the fetched file."""
    return worker_memory(("bpe", vocab_path, lexicon_name), lambda: Encoder(
        vocabulary(vocab_path), Lexicon(np.load(SparkFiles.get(lexicon_name), mmap_mode="r"))))


def encode(df: DataFrame, vocab_path: str, column: str = "text", out: str = "ids",
           lexicon: str | None = None) -> DataFrame:
    """Append ``ids`` (array<int>); rows are kept as they are.  NULL and empty texts get an empty array."""
    lexicon = lexicon or build_lexicon(df, vocab_path, column)

    def make():
        enc = encoder(vocab_path, lexicon)
        return lambda texts: [_lists(list(enc.arrays(texts)))]

    return add_columns(df, [column], [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def _lists(rows: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.int32()))


def decode(df: DataFrame, vocab_path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the decoded text of an array of ids (NULL: empty text)."""
    def make():
        enc = Encoder(vocabulary(vocab_path))
        return lambda rows: [[enc.decode(ids) for ids in rows]]

    return add_columns(df, [column], [T.StructField(out, T.StringType())], make)
