"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One inserted or deleted letter moves a word's vector of letter counts by an L1 distance of one, one replaced
letter by at most two (by two, or by none if both letters share a dimension).  So the near words of a word of length L lie within distance 2 among the words of length
L and within distance 1 among those of length L + 1 (and L - 1, seen from the other side).

1. ``word_counts``: the runs of every text are counted in tasks, summed by a shuffle with map-side combine.
2. ``near_words``: for each length a k-d tree over letter counts is fitted on a bounded sample (it only decides
   balance); every word is sent to the cell it lies in and, as a visitor, to the cells within reach of its
   vector, each unordered pair of words to one cell.  A task streams sorted cells: it holds one cell's words, at most about
   ``CELL_WORDS``, in a finer tree of tight boxes and searches it for batches of visitors.  Equal vectors are
   one point.  Candidates are verified letter by letter.  What leaves a task are not pairs but, by word, the
   number of near words and the best of them.
3. ``with_roots``: forms are followed by pointer doubling; n at least doubles with each step, so the rounds grow with
   the logarithm of the logarithm of the largest count.

Nothing of the size of the vocabulary reaches the driver or one task.  NULL and empty texts have no words; a NULL
id counts as the empty string in the hash; repeated rows count each; ties of n go to the smallest word in code-point
order; empty tables give no words.  Further columns of the documents are not read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardlake.llm.common import ASCII_LOWER, materialise
from hazardlake.session import ship_package

RUN_RE = re.compile("[A-Za-zÀ-ÿ]+")
MODULUS = 97
MIN_CHARS, MIN_N = 5, 3
#: Words of a task's counter before it is handed on.
HELD_WORDS = 200_000
#: Words of a cell, and letters of a cell (cells of long words hold fewer).
CELL_WORDS, CELL_LETTERS = 30_000, 2_000_000
#: Words that the cell boundaries are fitted on.
SAMPLE_WORDS = 100_000
#: Vectors of a box at the bottom of a cell's tree; pairs that are verified at once; visitors searched at once.
BOX_POINTS, PAIRS, BATCH = 48, 1 << 20, 20_000
#: Letter a to z, then six dimensions that the other letters share (sharing can only lower a distance).
DIMS = 32
_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)


# ----------------------------------------------------------------------------------------------------- words
def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(ASCII_LOWER)


def text_words(doc_id, text: str, modulus: int = MODULUS) -> Counter:
    """Counts of a text's words; the runs that the hash of id and run picks lose one letter each time they occur."""
    runs: Counter = Counter()
    for run, n in Counter(RUN_RE.findall(text)).items():
        runs[lowered(run)] += n
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    picked = [(run, h) for run in runs if not (h := zlib.crc32(run.encode(), start)) % modulus]
    moved = [(run[:h % len(run)] + run[h % len(run) + 1:], runs.pop(run)) for run, h in picked]
    for word, n in moved:
        runs[word] += n
    return runs


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text", modulus: int = MODULUS, min_chars: int = MIN_CHARS,
                min_n: int = MIN_N) -> DataFrame:
    """(word, n) of the words of at least ``min_chars`` letters that occur ``min_n`` times or more in all texts."""
    ship_package(docs.sparkSession)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    for word, n in text_words(doc_id, text, modulus).items():
                        if len(word) >= min_chars:
                            held[word] += n
                    if len(held) > HELD_WORDS:
                        yield batch_of(held)
                        held.clear()
        yield batch_of(held)

    found = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


# ----------------------------------------------------------------------------------------------------- vectors and trees
def letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points (all lie below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), DIMS), np.int32)
    rows = np.arange(len(codes))
    for j in range(codes.shape[1]):
        out[rows, _DIM[codes[:, j]]] += 1
    return out


def distance_to_box(v, lo, hi):
    return np.maximum(np.maximum(lo - v, v - hi), 0).sum(axis=1)


def best_cut(v: np.ndarray):
    """(dimension, threshold) that halves the points best, or None if all are equal; counts up to the threshold go left."""
    best, at = 0, None
    for dim in np.flatnonzero(v.max(axis=0) > v.min(axis=0)):
        column = np.sort(v[:, dim])
        middle = column[len(column) // 2]
        for t in (middle - 1, middle):
            left = int(np.searchsorted(column, t, side="right"))
            if min(left, len(column) - left) > best:
                best, at = min(left, len(column) - left), (int(dim), int(t))
    return at


def fit_cells(v: np.ndarray, most: float) -> list:
    """k-d tree as a list of nodes: (dimension, threshold, left node, right node), or a cell's number."""
    nodes: list = []
    n_cells = 0

    def grow(part):
        nonlocal n_cells
        at = len(nodes)
        nodes.append(None)
        cut = best_cut(part) if len(part) > most else None
        if cut is None:
            nodes[at], n_cells = n_cells, n_cells + 1
        else:
            left = part[:, cut[0]] <= cut[1]
            nodes[at] = (*cut, grow(part[left]), grow(part[~left]))
        return at

    grow(v)
    return nodes


def cells_in_reach(nodes: list, v: np.ndarray, reach: int):
    """Yields (cell, rows of ``v`` whose vector lies within ``reach`` of the cell, their distances to it)."""
    top = np.iinfo(np.int32).max

    def walk(at, rows, lo, hi):
        d = distance_to_box(v[rows], lo, hi)
        rows, d = rows[d <= reach], d[d <= reach]
        if not len(rows):
            return
        if isinstance(nodes[at], int):
            yield nodes[at], rows, d
            return
        dim, t, left, right = nodes[at]
        under, over = hi.copy(), lo.copy()
        under[dim], over[dim] = min(hi[dim], t), max(lo[dim], t + 1)
        yield from walk(left, rows, lo, under)
        yield from walk(right, rows, over, hi)

    yield from walk(0, np.arange(len(v)), np.zeros(DIMS, np.int32), np.full(DIMS, top, np.int32))


class BoxTree:
    """k-d tree with tight boxes over points; ``search`` prunes boxes for many queries at once."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows):
        part = self.points[rows]
        cut = best_cut(part) if len(rows) > BOX_POINTS else None
        kids = None
        if cut is not None:
            left = part[:, cut[0]] <= cut[1]
            kids = (self._grow(rows[left]), self._grow(rows[~left]))
        return part.min(axis=0), part.max(axis=0), rows if kids is None else None, kids

    def search(self, queries: np.ndarray, reach: int):
        """Yields (query rows, point rows) of the pairs within this L1 distance."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            (lo, hi, rows, kids), asked = stack.pop()
            asked = asked[distance_to_box(queries[asked], lo, hi) <= reach]
            if not len(asked):
                continue
            if kids is not None:
                stack += [(kids[0], asked), (kids[1], asked)]
                continue
            for i in range(0, len(asked), 512):
                some = asked[i:i + 512]
                d = np.abs(queries[some][:, None, :] - self.points[rows][None, :, :]).sum(axis=2)
                q, p = np.nonzero(d <= reach)
                if len(q):
                    yield some[q], rows[p]


class Words:
    """Words of one length, sorted by vector: points (distinct vectors) and the words that share each."""

    def __init__(self, words: list[str], n: list[int]):
        codes = letters(words)
        v = vectors(codes)
        order = np.lexsort(v.T)
        v, self.codes, self.n = v[order], codes[order], np.asarray(n, np.int64)[order]
        new = np.r_[True, (v[1:] != v[:-1]).any(axis=1)]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(v)])
        self.points = v[self.first]
        self.text = np.ascontiguousarray(self.codes).view(f"S{codes.shape[1]}").ravel()
        by_rank = np.lexsort((self.text, -self.n))       # larger n first, then the smaller word
        self.rank = np.empty(len(v), np.int64)
        self.rank[by_rank] = np.arange(len(v))
        self.by_rank = by_rank
        self.n_near = np.zeros(len(v), np.int64)
        self.best_n = np.zeros(len(v), np.int64)
        self.best = np.full(len(v), None, object)

    def note(self, at: np.ndarray, others: "Words", partner: np.ndarray):
        """Each word ``at[i]`` has the near word ``partner[i]`` of ``others``."""
        self.n_near += np.bincount(at, minlength=len(self.n))
        least = np.full(len(self.n), len(others.n), np.int64)
        np.minimum.at(least, at, others.rank[partner])
        some = np.flatnonzero(least < len(others.n))
        found = others.by_rank[least[some]]
        n, text = others.n[found], others.text[found]
        for i, m, w in zip(some, n, text):
            if m > self.best_n[i] or m == self.best_n[i] and w < self.best[i]:
                self.best_n[i], self.best[i] = m, w

    def batch(self):
        """Arrow rows of the words that have near words."""
        k = self.n_near > 0
        columns = [[w.decode("latin-1") for w in self.text[k]], self.n_near[k], self.best_n[k], [w.decode("latin-1") for w in self.best[k]]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "n_near", "best_n", "best"])


def one_replaced(a, b):
    return (a != b).sum(axis=1) == 1


def one_inserted(short, long):
    """Whether the longer word is the shorter one with one more letter."""
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= short.shape[1]


def word_pairs(a: Words, p: np.ndarray, b: Words, q: np.ndarray):
    """Word numbers of all words of points ``p`` beside those of points ``q``, at most about PAIRS at once."""
    sizes = a.size[p] * b.size[q]
    ends = np.cumsum(sizes)
    start = 0
    while start < len(p):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        k, s = slice(start, end), sizes[start:end]
        within = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        width = np.repeat(b.size[q[k]], s)
        yield np.repeat(a.first[p[k]], s) + within // width, np.repeat(b.first[q[k]], s) + within % width
        start = end


def match(asked: Words, home: Words, tree: BoxTree):
    """Notes every near pair of a word asked and a word of the cell, on both sides (once if both are the cell)."""
    longer = home.codes.shape[1] > asked.codes.shape[1]
    test = one_inserted if longer else one_replaced
    for q, p in tree.search(asked.points, 1 if longer else 2):
        for i, j in word_pairs(asked, q, home, p):
            k = test(asked.codes[i], home.codes[j])
            if k.any():
                asked.note(i[k], home, j[k])
                if asked is not home:
                    home.note(j[k], asked, i[k])


# ----------------------------------------------------------------------------------------------------- on Spark
def _trees(vocab: DataFrame, cell_words: int) -> dict:
    """By word length the k-d tree of its cells; one row a length and a bounded sample of words reach the driver."""
    count = {r["chars"]: r["words"] for r in vocab.groupBy(F.length("word").alias("chars")).agg(F.count("*").alias("words")).collect()}
    total = sum(count.values())
    most = {c: max(64, min(cell_words, CELL_LETTERS // c)) for c in count}
    large = [c for c in count if count[c] > most[c]]
    if not large:
        return {c: [0] for c in count}
    share = min(1.0, SAMPLE_WORDS / total)
    of = defaultdict(list)
    pick = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    for r in vocab.where(F.length("word").isin(large) & pick).select("word").collect():
        of[len(r["word"])].append(r["word"])
    return {c: fit_cells(vectors(letters(sorted(of[c]))), len(of[c]) * most[c] / count[c]) if of[c] else [0] for c in count}


def _route(trees: dict):
    """Sends each word home (role 0), to cells of its length with a higher number (1) and to cells of the next length (2)."""
    def run(batches):
        for batch in batches:
            by_length: dict = defaultdict(list)
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for i, w in enumerate(words):
                by_length[len(w)].append(i)
            cell, role, at = [], [], []
            for c, rows in by_length.items():
                rows = np.array(rows)
                v = vectors(letters([words[i] for i in rows]))
                home = np.empty(len(rows), np.int64)
                near = list(cells_in_reach(trees[c], v, 2))
                for k, some, d in near:
                    home[some[d == 0]] = k
                for k, some, d in near:
                    own = some[d == 0]
                    away = some[(d > 0) & (home[some] < k)]
                    for which, r in ((own, 0), (away, 1)):
                        cell.append(np.full(len(which), (c << 32) + k)), role.append(np.full(len(which), r)), at.append(rows[which])
                if c + 1 in trees:
                    for k, some, _ in cells_in_reach(trees[c + 1], v, 1):
                        cell.append(np.full(len(some), ((c + 1) << 32) + k)), role.append(np.full(len(some), 2)), at.append(rows[some])
            if at:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(role), pa.int32()),
                     batch.column(0).take(pa.array(at)), pa.array(n[at], pa.int64())], names=["cell", "role", "word", "n"])
    return run


def _search(batches):
    """Streams cells in order; of each, the words that live there come first, then its visitors in batches."""
    cell, home, tree = None, None, None
    living: tuple = ([], [])

    def settle():
        nonlocal home, tree
        if home is None and living[0]:
            home = Words(*living)
            tree = BoxTree(home.points)
            match(home, home, tree)

    for batch in batches:
        cells, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(cells)]) if len(cells) else ():
            if cells[start] != cell:
                settle()
                if home is not None:
                    yield home.batch()
                cell, home, tree, living = cells[start], None, None, ([], [])
            part = batch.slice(start, end - start)
            if roles[start] == 0:
                living[0].extend(part.column(2).to_pylist())
                living[1].extend(part.column(3).to_pylist())
                continue
            settle()
            for i in range(0, part.num_rows if home is not None else 0, BATCH):
                asked = Words(part.column(2).slice(i, BATCH).to_pylist(), part.column(3).slice(i, BATCH).to_pylist())
                match(asked, home, tree)
                yield asked.batch()
    settle()
    if home is not None:
        yield home.batch()


def near_words(vocab: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``vocab`` (word, n) that have a word one edit apart.

    ``best`` is the near word of the largest n, the smallest of equal ones.
    """
    spark = vocab.sparkSession
    ship_package(spark)
    trees = _trees(vocab, cell_words)
    sent = vocab.select("word", "n").mapInArrow(_route(trees), "cell long, role int, word string, n long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * sum(isinstance(x, int) for t in trees.values() for x in t) // 10)
    dealt = sent.repartition(tasks, "cell").sortWithinPartitions("cell", "role")
    parts = dealt.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("__b")).select(
        "word", "n_near", (-F.col("__b.m")).alias("best_n"), F.col("__b.best").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form) by pointer doubling; ``form`` must never lead back."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = materialise(at.join(ahead, on="root", how="left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(vocab: DataFrame, factor: float = 2.0, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocab`` (word, n).

    A word's form is its best near word if that has at least ``factor`` (above 1) times its n.
    """
    if factor <= 1:
        raise ValueError("factor must be above 1, or forms could lead back")
    vocab = materialise(vocab.select("word", "n"), "vocabulary")
    near = near_words(vocab, cell_words)
    has = F.col("best_n") >= F.lit(factor) * F.col("n")
    rows = materialise(vocab.join(near, on="word", how="left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"),
        F.when(has, F.col("best_n")).alias("form_n")), "near")
    roots = with_roots(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, on="word", how="left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
