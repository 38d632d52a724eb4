"""Hashed maximum-entropy language model with class-factored softmax.

p(word | history) = p(class | history) * p(word | class).

* Classes: the most frequent words by themselves, other words by their last
  two characters, and the end of a text.
* p(class | history) is a softmax over hashed features of the two words
  before: bigram feature (previous word), skip feature (the word before it)
  and trigram feature (both).  Histories are hashed to ``BUCKETS ** 2``
  contexts, so the counts of (context, class) over *all* training tokens are
  the sufficient statistics of the likelihood.
* Training: every task computes gradient and curvature of its contexts, the
  driver sums them and sends new weights; full data in every step.
* p(word | class) is a softmax over unigram features, whose optimum are the
  (add-one) relative counts inside the class.  Counts cover all training texts.
* Scoring: tasks hold the weights, the normaliser of every context and the
  ``LEXICON`` most frequent words; a batch's tokens are scored in sparse numpy
  operations.  All other words are handed on with their documents and joined
  with the counts by word, so no table of all words is ever broadcast.

Words: A-Z lowered, cut at white space; every text ends with one end token.
NULL and empty texts consist of the end token.  Rows that repeat an id are
texts of their own.  Without training texts every count is 0 and the model is
uniform over classes.
"""
from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hazardlake.llm.common import materialise, most_frequent, worker_memory
from hazardlake.session import ship_package

BUCKETS = 256
FREQUENT_BUCKETS = 120       # frequent words with a bucket of their own
BOS = BUCKETS - 1
CLASSES = 64
FREQUENT_CLASSES = 24        # frequent words with a class of their own
SUFFIX_CLASSES = 35
END = CLASSES - 1
HASHED = 4096                # rows of the trigram feature
LEXICON = 50_000             # words that tasks hold with their counts
MEMO_WORDS = 300_000
COUNT_WORDS = 300_000
STEPS = 15
RIDGE = 1.0
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def suffix(word: bytes) -> str:
    return word.decode("utf-8", "replace")[-2:]


@dataclass
class Layout:
    """Buckets and classes of words."""

    frequent: list[bytes]
    suffixes: list[str]
    buckets: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)
    endings: dict = field(default_factory=dict)

    def __post_init__(self):
        self.buckets = {w: i for i, w in enumerate(self.frequent[:FREQUENT_BUCKETS])}
        self.classes = {w: i for i, w in enumerate(self.frequent[:FREQUENT_CLASSES])}
        self.endings = {s: FREQUENT_CLASSES + i for i, s in enumerate(self.suffixes[:SUFFIX_CLASSES])}

    def of(self, word: bytes) -> tuple[int, int]:
        s = suffix(word)
        h = crc32(s.encode())
        other = FREQUENT_CLASSES + SUFFIX_CLASSES
        b, c = self.buckets.get(word), self.classes.get(word)
        if b is None:
            b = FREQUENT_BUCKETS + h % (BOS - FREQUENT_BUCKETS)
        if c is None:
            c = self.endings.get(s)
        return b, c if c is not None else other + h % (END - other)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all rows of (text)."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
                if len(counts) > COUNT_WORDS:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts):
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                      names=["word", "n"])


def class_totals(counts: DataFrame, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""
    def run(batches):
        tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            cls = np.fromiter((layout.of(w)[1] for w in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            tokens += np.bincount(cls, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            kinds += np.bincount(cls, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(tokens), pa.array(kinds)],
                                         names=["cls", "tokens", "kinds"])

    rows = (counts.select("word", "n").mapInArrow(run, "cls int, tokens long, kinds long")
            .groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect())
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows:
        tokens[r.cls], kinds[r.cls] = r.tokens, r.kinds
    return tokens, kinds


class Reader:
    """Turns texts into arrays of buckets and classes; remembers words up to a bound."""

    def __init__(self, layout: Layout, lexicon: dict[bytes, tuple] | None = None):
        self.layout, self.lexicon = layout, lexicon or {}
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.bucket = np.zeros(1024, np.int32)
        self.cls = np.zeros(1024, np.int32)
        self.base = np.zeros(1024)
        self.own = np.zeros(1024)
        self.listed = np.zeros(1024, bool)

    def ids(self, words: list[bytes]) -> np.ndarray:
        index = self.index
        new = {w for w in words if w not in index} if words else ()
        if new:
            n = len(index) + len(new)
            for name in ("bucket", "cls", "base", "own", "listed"):
                a = getattr(self, name)
                if n > len(a):
                    setattr(self, name, np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)]))
            for w in new:
                i = len(index)
                index[w] = i
                self.bucket[i], self.cls[i] = self.layout.of(w)
                known = self.lexicon.get(w)
                if known is not None:
                    self.base[i], self.own[i], self.listed[i] = known[0], known[1], True
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def batch(self, texts: list):
        """Groups of texts as (texts' words, ids, contexts, classes, places of the ends); some 200,000 words each."""
        group, held = [], 0
        for text in texts:
            group.append(words_of(text))
            held += len(group[-1])
            if held > 200_000:
                yield self._arrays(group)
                group, held = [], 0
        if group:
            yield self._arrays(group)

    def _arrays(self, group):
        if len(self.index) > MEMO_WORDS:
            self._reset()
        ids = [self.ids(ws) for ws in group]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.cumsum(sizes + 1) - 1                     # places of the end tokens
        total = int(ends[-1]) + 1
        inside = np.ones(total, bool)
        inside[ends] = False
        flat = np.concatenate(ids)
        bucket = np.full(total + 2, BOS, np.int64)
        cls = np.full(total, END, np.int64)
        bucket[2:][inside] = self.bucket[flat]
        cls[inside] = self.cls[flat]
        one, two = bucket[1:-1].copy(), bucket[:-2].copy()  # the word before, the word before that
        starts = ends - sizes
        one[starts] = BOS
        two[starts] = BOS
        second = starts[sizes > 0] + 1
        two[second] = BOS
        return group, flat, inside, one * BUCKETS + two, cls, starts, ends


def contexts(texts: DataFrame, layout: Layout) -> DataFrame:
    """(ctx, cls, n): the sufficient statistics of all tokens."""
    def run(batches):
        reader = Reader(layout)
        cells = np.zeros(BUCKETS * BUCKETS * CLASSES, np.int32)
        for batch in batches:
            for _, _, _, ctx, cls, _, _ in reader.batch(batch.column(0).cast(pa.binary()).to_pylist()):
                at, n = np.unique(ctx * CLASSES + cls, return_counts=True)
                cells[at] += n.astype(np.int32)
            if cells.max(initial=0) > 2**30:
                yield _cells(cells)
                cells[:] = 0
        yield _cells(cells)

    return texts.mapInArrow(run, "ctx int, cls int, n long").groupBy("ctx", "cls").agg(F.sum("n").alias("n"))


def _cells(cells):
    at = np.flatnonzero(cells)
    return pa.RecordBatch.from_arrays([pa.array((at // CLASSES).astype(np.int32)), pa.array((at % CLASSES).astype(np.int32)),
                                       pa.array(cells[at].astype(np.int64))], names=["ctx", "cls", "n"])


# ------------------------------------------------------------ the softmax over classes

def feature_rows(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table: bigram, skip and (hashed) trigram feature of each context."""
    one, two = ctx // BUCKETS, ctx % BUCKETS
    both = ((ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)
    return one, BUCKETS + two, 2 * BUCKETS + both


N_ROWS = 2 * BUCKETS + HASHED + 1        # and the bias


def logits(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    a, b, c = feature_rows(ctx)
    return weights[-1] + weights[a] + weights[b] + weights[c]


def log_normaliser(weights: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    z = logits(weights, ctx)
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


def train(cells: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights by damped diagonal Newton steps; tasks sum over their contexts, the driver over the tasks."""
    spark = cells.sparkSession
    rows = materialise(cells.groupBy("ctx").agg(F.collect_list("cls").alias("cls"), F.collect_list("n").alias("n"))
                       .coalesce(4), "contexts")      # BUCKETS ** 2 contexts of CLASSES counts at most, whatever the input
    weights = np.zeros((N_ROWS, CLASSES), np.float32)
    loss, rate = np.inf, 0.5
    best = weights
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches):
            w = shared.value
            grad, curve, total = np.zeros(w.shape, np.float32), np.zeros(w.shape, np.float32), 0.0
            for batch in batches:
                ctx = batch.column(0).to_numpy().astype(np.int64)
                y = np.zeros((len(ctx), CLASSES))
                sizes = np.diff(batch.column(1).offsets.to_numpy())
                y[np.repeat(np.arange(len(ctx)), sizes), batch.column(1).flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
                z = logits(w, ctx).astype(np.float64)
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                norm = p.sum(axis=1, keepdims=True)
                p /= norm
                n = y.sum(axis=1, keepdims=True)
                total -= float((y * (z - np.log(norm))).sum())
                g, h = (n * p - y).astype(np.float32), (n * p * (1 - p)).astype(np.float32)
                for r in feature_rows(ctx):
                    np.add.at(grad, r, g)
                    np.add.at(curve, r, h)
                grad[-1] += g.sum(axis=0)
                curve[-1] += h.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([grad.tobytes()], pa.binary()),
                                              pa.array([curve.tobytes()], pa.binary())], names=["loss", "grad", "curve"])

        found = rows.mapInArrow(run, "loss double, grad binary, curve binary").collect()
        shared.destroy()
        now = sum(r.loss for r in found) + 0.5 * RIDGE * float((weights.astype(np.float64) ** 2).sum())
        if now > loss:                   # too long a step: go back half of it
            rate *= 0.5
            weights = best + 0.5 * (weights - best)
            continue
        loss, best = now, weights
        grad, curve = RIDGE * best.astype(np.float64), np.full(best.shape, RIDGE)
        for r in found:
            grad += np.frombuffer(r.grad, np.float32).reshape(best.shape)
            curve += np.frombuffer(r.curve, np.float32).reshape(best.shape)
        weights = (best - rate * np.clip(grad / curve, -2, 2)).astype(np.float32)
    return best


# ------------------------------------------------------------ the model

@dataclass
class Model:
    layout: Layout
    weights: np.ndarray
    norm: np.ndarray             # of every context
    lexicon: dict                # word -> (log10 base, log10 p(word | class))
    denominator: float           # N + V + 1
    in_class: np.ndarray         # N_c + V_c + 1
    end: int                     # training texts
    n: int                       # training tokens
    token: str = field(default_factory=lambda: uuid.uuid4().hex)   # names the model in a worker

    def reader(self) -> Reader:
        """The worker's reader of this model; that of an earlier model goes."""
        return worker_memory(("lm", self.token), lambda: Reader(self.layout, self.lexicon))


def fit(texts: DataFrame, lexicon: int = LEXICON) -> tuple[Model, DataFrame]:
    """The model of all ``texts`` (one column) and the counts of their words."""
    ship_package(texts.sparkSession)
    counts = materialise(word_counts(texts), "words")
    n_texts = texts.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = most_frequent(counts, "n", lexicon).select("word", "n").toArrow()
    top = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    frequent = sorted(top, key=lambda w: (-top[w], w))[:FREQUENT_BUCKETS]
    by_suffix: Counter = Counter()
    for w, c in top.items():
        by_suffix[suffix(w)] += c
    layout = Layout(frequent, [s for s, _ in sorted(by_suffix.items(), key=lambda x: (-x[1], x[0]))[:SUFFIX_CLASSES]])
    tokens, kinds = class_totals(counts, layout)
    cells = materialise(contexts(texts, layout), "cells")
    weights = train(cells)
    every = np.arange(BUCKETS * BUCKETS)
    norm = np.concatenate([log_normaliser(weights, part) for part in np.array_split(every, 16)]).astype(np.float32)
    total, distinct = n_words + n_texts, n_kinds + (n_texts > 0)
    denominator = total + distinct + 1
    in_class = tokens + kinds + 1
    table = {w: (log10((c + 1) / denominator), log10((c + 1) / float(in_class[layout.of(w)[1]]))) for w, c in top.items()}
    return Model(layout, weights, norm, table, denominator, in_class, n_texts, total), counts


RARE = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("cls", T.IntegerType()),
                                 T.StructField("tf", T.LongType())]))
PARTS = [T.StructField("__rid", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
         T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("__rare", RARE)]


def rare_column(reader: Reader, group: list, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """By text, the words outside the lexicon with class and frequency; built by column, without an object for each."""
    words, tf, sizes = [], [], []
    for ws, miss in zip(group, np.split(~reader.listed[flat], np.cumsum(ends - starts)[:-1])):
        found = Counter([ws[i] for i in np.flatnonzero(miss).tolist()])
        words += found
        tf += found.values()
        sizes.append(len(found))
    cls = reader.cls[np.fromiter(map(reader.index.__getitem__, words), np.int64, len(words))]
    rows = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(cls, pa.int32()), pa.array(tf, pa.int64())],
                                      names=["word", "cls", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), rows)


def score_groups(model: Model, texts: list):
    """By group of texts: n_tokens; known tokens, base and model scores without the rare words; the rare words."""
    reader = model.reader()
    w, end_base = model.weights, np.log10((model.end + 1) / model.denominator)
    for group, flat, inside, ctx, cls, starts, ends in reader.batch(texts):
        a, b, c = feature_rows(ctx)
        token = (w[-1, cls] + w[a, cls] + w[b, cls] + w[c, cls] - model.norm[ctx]).astype(np.float64) / np.log(10)
        base = np.full(len(ctx), end_base)
        listed = np.full(len(ctx), int(model.end > 0))
        base[inside] = reader.base[flat]
        token[inside] += reader.own[flat]
        listed[inside] = reader.listed[flat]
        yield (ends - starts + 1, *(np.add.reduceat(x, starts) for x in (listed, base, token)),
               rare_column(reader, group, flat, starts, ends))


def score(df: DataFrame, model: Model, counts: DataFrame, column: str = "text") -> DataFrame:
    """Replace the text by n_tokens, n_known, train_tokens, base_score and score (log10); other columns stay."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)         # bounded: weights, contexts and LEXICON words
    new = {f.name for f in PARTS} | {"train_tokens", column}
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(keep + PARTS)
    kinds = [to_arrow_type(f.dataType) for f in PARTS]

    def run(batches):
        row = TaskContext.get().partitionId() << 40      # numbers rows; fixed once the table is written
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist(), 0
            for n_tokens, *sums, rare in score_groups(shared.value, texts):
                n = len(n_tokens)
                parts = (np.arange(row, row + n), n_tokens, *sums)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, n) for i in range(len(keep))] +
                                                 [pa.array(v, k) for v, k in zip(parts, kinds)] + [rare], names=schema.names)
                at, row = at + n, row + n

    parts = materialise(df.select(*[f.name for f in keep], F.col(column).cast("string").alias("__text")).mapInArrow(run, schema), "scores")
    # the words outside the lexicon, with their documents, meet the counts by word
    per_class = F.element_at(F.split(F.lit(",".join(str(int(x)) for x in model.in_class)), ","), F.col("r.cls") + 1).cast("double")
    rare = parts.select("__rid", F.explode("__rare").alias("r")).select("__rid", "r.word", "r.tf", per_class.alias("in_class"))
    c = F.coalesce(F.col("n"), F.lit(0))
    more = (rare.join(counts.select("word", "n"), "word", "left").groupBy("__rid").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(model.denominator)))).alias("b"),
        F.sum(F.col("tf") * F.log10((c + 1) / F.col("in_class"))).alias("s")))
    zero = F.lit(0.0)
    return parts.join(more, "__rid", "left").select(
        *[f.name for f in keep], "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"))
