"""Toxicity by class-conditional Kneser-Ney models.

Two models of the characters of a word (order ``ORDER``, one for toxic, one for
ordinary documents) share their lower orders: the highest order has counts by
class, everything below is one Kneser-Ney model over the continuation counts
of both classes.  An expression that training hardly saw is therefore scored
alike by both models.  A document's features are its length-normalised
log-likelihood ratio (mean over all words) and that of its most toxic stretch
of ``STRETCH`` words; a logistic function fitted on labelled rows kept out of
the counts turns them into a score from 0 to 1.

Fitting uses ``SAMPLE`` labelled training documents of each class
(at most about that many, picked by a hash of the id) and keeps the ``MAX_GRAMS`` most
frequent grams, so the broadcast model is bounded (about 100 MB at that limit).
Scoring reads every whole text.

NULL and empty texts score as texts without evidence (all features 0), labels
with NULL ids or values are ignored, a document with several labels is toxic
if one of them says so.  With no labelled rows of a class every score is 0.
"""
from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hazardlake.llm.common import add_columns, materialise, most_frequent, slices, worker_memory
from hazardlake.session import ship_package

ORDER = 6                 # characters of a gram
BITS = 10                 # of a character's code; code points from 1000 on share the codes from WIDE on
WIDE = 256                # any 768 neighbouring code points from 1000 on have codes of their own, so those of an alphabet do
DISCOUNT = 0.75           # of the shared lower orders
CLASS_DISCOUNT = 1.0      # of the counts by class: what a class showed only once is left to the shared orders
SAMPLE = 8_000            # labelled documents of each class that the counts and the calibration use
MAX_GRAMS = 2_000_000
STRETCH = 30
TOP = 3
MEMO_WORDS = 400_000
EDGES = ".,;:!?%$&*#\"'()[]|<>-"
START, END = 0, 1


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams of all words (each character and the end once), and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.where(points < 1000, points, WIDE + (points - 1000) % ((1 << BITS) - WIDE))
    slots = sizes + 1 + (ORDER - 1)                        # pads, characters, end
    ends = np.cumsum(slots)
    flat = np.zeros(int(ends[-1]) if len(words) else 0, np.int64)
    starts = ends - slots
    inside = np.arange(points.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[np.repeat(starts + ORDER - 1, sizes) + inside] = points
    flat[ends - 1] = END
    code = np.zeros(max(flat.size - ORDER + 1, 0), np.int64)
    for k in range(ORDER):
        code |= flat[k:k + code.size] << (BITS * (ORDER - 1 - k))
    place = np.repeat(starts, sizes + 1) + np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    return code[place], np.repeat(np.arange(len(words)), sizes + 1)


def clean(piece: str) -> str:
    return piece.strip(EDGES)


@dataclass
class Level:
    """One order of the model: sorted grams with their discounted shares, sorted contexts with their back-off."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    back: np.ndarray

    @staticmethod
    def of(grams, counts, discount=DISCOUNT):
        ctx, inv = np.unique(grams >> BITS, return_inverse=True)
        total = np.bincount(inv, counts)
        off = np.minimum(counts, discount)
        safe = np.maximum(total, 1e-9)
        return Level(grams, ((counts - off) / safe[inv]).astype(np.float32), ctx,
                     np.where(total > 0, np.bincount(inv, off) / safe, 1).astype(np.float32))

    def mix(self, codes, lower):
        """Probability at this order, given that of the order below."""
        return lookup(self.grams, self.share, codes, 0) + lookup(self.contexts, self.back, codes >> BITS, 1) * lower


def lookup(keys, values, codes, default):
    if not len(keys):
        return np.full(len(codes), default, np.float64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], default).astype(np.float64)


class KneserNey:
    """The pair of models; ``ratio`` gives each word's log-likelihood under toxic minus that under ordinary."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        self.token = uuid.uuid4().hex                          # names the model in a worker
        order = np.argsort(grams)
        grams, toxic, ordinary = grams[order], toxic[order], ordinary[order]
        self.levels = []                                       # shared, from the shortest grams on
        mask = (1 << BITS * (ORDER - 1)) - 1
        seen = grams
        for k in range(ORDER - 1, 0, -1):                      # how many different characters precede the shorter gram
            seen, kinds = np.unique(seen & mask, return_counts=True)
            self.levels.insert(0, Level.of(seen, kinds.astype(np.float64)))
            mask >>= BITS
        self.classes = [Level.of(grams, c.astype(np.float64), CLASS_DISCOUNT) for c in (toxic, ordinary)]

    def ratios(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        codes, owner = gram_codes(words)
        distinct, inv = np.unique(codes, return_inverse=True)
        p = np.full(len(distinct), 1 / 1024)
        for k, level in enumerate(self.levels, 1):
            p = level.mix(distinct & ((1 << BITS * k) - 1), p)
        t, o = (level.mix(distinct, p) for level in self.classes)
        return np.bincount(owner, (np.log(t) - np.log(o))[inv], len(words))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Length-normalised log-likelihood ratio of the whole text, of its most toxic stretch and of its ``TOP`` most
        toxic words; a word counts wherever it stands."""
        pieces = text.lower().split() if text else []
        if not pieces:
            return 0.0, 0.0, 0.0
        memo = worker_memory(("toxicity", self.token), dict)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = [p for p in set(pieces) if p not in memo]
        if new:
            words = [clean(p) for p in new]
            known = list(dict.fromkeys(words))
            ratio = dict(zip(known, self.ratios(known).tolist()))
            memo.update(zip(new, map(ratio.__getitem__, words)))
        v = np.fromiter(map(memo.__getitem__, pieces), np.float64, len(pieces))
        top = float((np.partition(v, -TOP)[-TOP:] if len(v) > TOP else v).sum() / TOP)
        if len(v) <= STRETCH:
            return float(v.mean()), float(v.sum() / STRETCH), top
        run = np.concatenate([[0.0], np.cumsum(v)])
        return float(v.mean()), float((run[STRETCH:] - run[:-STRETCH]).max() / STRETCH), top


def inputs(whole: float, stretch: float, top: float) -> np.ndarray:
    return np.array([1.0, whole, stretch, top])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Newton's method; the ridge keeps the weights finite where the classes can be separated."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            return w
    return w


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) of the words of (text, toxic) rows."""
    ship_package(texts.sparkSession)

    def run(batches):
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for part in slices(batch):
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts[y].update(map(clean, (text or "").lower().split()))
            for y, c in counts.items():
                if not c:
                    continue
                codes, owner = gram_codes(list(c))
                distinct, inv = np.unique(codes, return_inverse=True)
                n = np.bincount(inv, np.fromiter(c.values(), np.int64, len(c))[owner]).astype(np.int64)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n if y else none), pa.array(none if y else n)],
                                                 names=["gram", "toxic", "ordinary"])

    parts = texts.select("text", "toxic").mapInArrow(run, "gram long, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Model:
    kn: KneserNey | None
    weights: np.ndarray | None

    def score(self, text) -> float:
        if self.kn is None:
            return 0.0
        z = float(inputs(*self.kn.features(text)) @ self.weights)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, calibrate): about ``sample`` labelled documents of each class at most, whole texts."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    known = materialise(known, "labels")
    have = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("toxic") == y, F.lit(sample / n)) for y, n in have.items()], F.lit(0.0))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < share * 2**32)
    return (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")      # 2 * sample ids at most
            .select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("calibrate")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from the labelled rows of ``docs``; the caller leaves held-out rows out of ``labels``."""
    rows = labelled_sample(docs, labels, sample)
    counts = gram_counts(rows.where("not calibrate")).withColumn("n", F.col("toxic") + F.col("ordinary"))
    top = most_frequent(materialise(counts, "grams"), "n", max_grams).select("gram", "toxic", "ordinary").toArrow()
    grams, toxic, ordinary = (top.column(i).to_numpy() for i in range(3))
    if not toxic.sum() or not ordinary.sum():
        return Model(None, None)
    kn = KneserNey(grams, toxic, ordinary)
    shared = rows.sparkSession.sparkContext.broadcast(kn)
    fields = [T.StructField("whole", T.DoubleType()), T.StructField("stretch", T.DoubleType()),
              T.StructField("top", T.DoubleType())]

    def make():
        return lambda texts: list(zip(*(shared.value.features(t) for t in texts))) or [[], [], []]

    cal = add_columns(rows.where("calibrate"), ["text"], fields, make).select("whole", "stretch", "top", "toxic").toPandas()
    x = np.array([inputs(*r) for r in zip(cal["whole"], cal["stretch"], cal["top"])]).reshape(-1, 4)
    y = cal["toxic"].to_numpy(float)
    return Model(kn, fit_logistic(x, y) if 0 < y.sum() < len(y) else np.array([-5.0, 0.0, 1.0, 1.0]))


def score(df: DataFrame, model: Model, column: str = "text", out: str = "score") -> DataFrame:
    """Append the toxicity score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [[m.score(t) for t in texts]]

    return add_columns(df, [column], [T.StructField(out, T.DoubleType())], make)


def reject_toxic(df: DataFrame, model: Model, column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with their columns as they are."""
    return score(df, model, column, "__score").where(F.col("__score") < threshold).select(*df.columns)
