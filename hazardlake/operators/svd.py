"""Text columns as dense components: character n-gram TF-IDF projected by a truncated SVD (M9), shared by sweeps.

``TextCorpus`` counts the n-grams of every distinct text once, in the DataFrame engine, and keeps one sparse row a
text: term ranks and counts, packed.  Terms are ranked by corpus frequency, so a smaller vocabulary is a prefix
of a larger one and one count serves every vocabulary size.  A power step of the randomised SVD (Halko, Martinsson and Tropp,
2011) is one pass: tasks multiply their sparse rows with the broadcast (terms x columns) matrix Q, and back, and the
products X'XQ are added in a tree of tasks.  No row is ever repeated for a component, and components of a smaller
rank are the first ones of a larger.  The driver holds terms x columns numbers, bounded by the parameters.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .binning import add_up
from .textvec import char_ngrams

#: Products (non-zero entries x columns) that a task holds at once; non-zero entries of a task.
PRODUCTS = 4_000_000
TASK_ENTRIES = 2_000_000
OVERSAMPLES, POWER_STEPS = 10, 5


def sparse_rows(texts: DataFrame, terms: DataFrame, *keep) -> DataFrame:
    """(__txt, keep..., idx, tf): each distinct text's terms of the vocabulary, as ranks and counts."""
    tf = char_ngrams(texts, "__txt", "__txt").join(F.broadcast(terms), on="term")       # terms: at most max_features rows
    packed = tf.groupBy("__txt").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("tf").cast("double").alias("tf")))).alias("__e"))
    none = F.array()
    return texts.join(packed, on="__txt", how="left").select(
        "__txt", *keep, F.coalesce(F.col("__e.rank"), none.cast("array<int>")).alias("idx"),
        F.coalesce(F.col("__e.tf"), none.cast("array<double>")).alias("tf"))


def entries(idx, tf, idf: np.ndarray):
    """Flat (row, term, weight) of two Arrow list columns: TF-IDF with L2 rows over the first ``len(idf)`` terms."""
    lengths = np.diff(idx.offsets.to_numpy())
    row = np.repeat(np.arange(len(lengths)), lengths)
    i, w = idx.flatten().to_numpy(), tf.flatten().to_numpy()
    k = i < len(idf)
    row, i, w = row[k], i[k].astype(np.int64), w[k]
    w = w * idf[i]
    norm = np.sqrt(np.bincount(row, w * w, len(lengths)))
    return row, i, w / norm[row], len(lengths)


def grouped_sum(key: np.ndarray, values: np.ndarray, out: np.ndarray):
    """Adds rows of ``values`` to ``out`` by sorted ``key``."""
    if len(key):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[key[starts]] += np.add.reduceat(values, starts, axis=0)


def times(row, i, w, n_rows: int, q: np.ndarray) -> np.ndarray:
    """X q for the rows of ``entries``."""
    out = np.zeros((n_rows, q.shape[1]))
    step = max(1, PRODUCTS // q.shape[1])
    for a in range(0, len(i), step):
        k = slice(a, a + step)
        grouped_sum(row[k], w[k][:, None] * q[i[k]], out)
    return out


class TextCorpus:
    """Distinct texts of a column with their multiplicity, and the ranked terms of all of them."""

    def __init__(self, texts: DataFrame, max_features: int):
        self.spark = texts.sparkSession
        ship_package(self.spark)
        texts = cut_lineage(texts.groupBy("__txt").agg(F.count(F.lit(1)).alias("__cnt")))
        counts = char_ngrams(texts, "__txt", "__txt").join(texts, on="__txt")
        top = (counts.groupBy("term").agg(F.sum(F.col("tf") * F.col("__cnt")).alias("ctf"), F.sum("__cnt").alias("df"))
               .orderBy(F.col("ctf").desc(), F.col("term").asc()).limit(max_features).collect())   # max_features rows
        self.terms, self.df = [r["term"] for r in top], np.array([r["df"] for r in top], float)
        self.n_docs = texts.agg(F.sum("__cnt")).first()[0] or 0
        self.rows = cut_lineage(sparse_rows(texts, term_table(self.spark, self.terms), "__cnt"))
        nnz = self.rows.agg(F.sum(F.size("idx"))).first()[0] or 0
        self.tasks = max(1, math.ceil(nnz / TASK_ENTRIES))
        self.rows = self.rows.coalesce(self.tasks) if self.tasks < self.spark.sparkContext.defaultParallelism else self.rows

    def idf(self, features: int) -> np.ndarray:
        return np.log((1.0 + self.n_docs) / (1.0 + self.df[:features])) + 1.0

    def gram_times(self, q: np.ndarray) -> np.ndarray:
        """X'X q, X the weighted rows of all documents over the first ``len(q)`` terms; one pass."""
        idf = self.idf(len(q))
        shared = self.spark.sparkContext.broadcast((q, idf))

        def run(batches):
            q, idf = shared.value
            z = np.zeros(q.shape)
            for batch in batches:
                cnt = batch.column(0).to_numpy(zero_copy_only=False)
                row, i, w, n = entries(batch.column(1), batch.column(2), idf)
                b = times(row, i, w, n, q) * cnt[:, None]
                order = np.argsort(i, kind="stable")
                step = max(1, PRODUCTS // q.shape[1])
                for a in range(0, len(i), step):
                    k = order[a:a + step]
                    grouped_sum(i[k], w[k][:, None] * b[row[k]], z)
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "ll": [0.0], "sums": [z.tobytes()]})

        found = add_up(self.rows.select("__cnt", "idx", "tf").mapInArrow(run, "part long, ll double, sums binary"), self.tasks).collect()
        shared.unpersist()
        return sum((np.frombuffer(r["sums"]).reshape(q.shape) for r in found), np.zeros(q.shape))

    def svd(self, features: int, k: int, seed: int = 42) -> "TextSVD":
        """The first ``k`` right singular vectors over the ``features`` most frequent terms (exact if k + 10 covers them)."""
        features = min(features, len(self.terms))
        if not features or k < 1:
            return TextSVD([], np.zeros(0), np.zeros((0, 0)), [])
        width = min(features, k + OVERSAMPLES)
        if width == features:
            q = np.eye(features)
        else:
            q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))
            for _ in range(POWER_STEPS):
                q, _ = np.linalg.qr(self.gram_times(q))
        m = q.T @ self.gram_times(q)
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        order = np.argsort(values)[::-1][:min(k, features)]
        # components beyond the rank are columns of zeros: they are left out
        order = order[values[order] > 1e-18 * features + 1e-14 * max(values.max(), 0.0)]
        return TextSVD(self.terms[:features], self.idf(features), q @ vectors[:, order], [math.sqrt(max(v, 0.0)) for v in values[order]])


def term_table(spark, terms: list) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, rank int")


class TextSVD:
    """Fitted components: terms by rank, their idf, V (terms x k) and the singular values."""

    def __init__(self, terms, idf, v, singular_values):
        self.terms, self.idf, self.v, self.singular_values = list(terms), np.asarray(idf, float), np.asarray(v, float), list(singular_values)

    @property
    def k(self) -> int:
        return self.v.shape[1]

    def first(self, k: int) -> "TextSVD":
        """The same with the first ``k`` components."""
        return TextSVD(self.terms, self.idf, self.v[:, :k], self.singular_values[:k])

    def project(self, texts: DataFrame) -> DataFrame:
        """(__txt, __svd): components of distinct texts; unknown terms do not count, a text without known ones is zero."""
        spark = texts.sparkSession
        ship_package(spark)
        rows = sparse_rows(texts, term_table(spark, self.terms))
        shared = spark.sparkContext.broadcast((self.v, self.idf))

        def run(batches):
            v, idf = shared.value
            for batch in batches:
                row, i, w, n = entries(batch.column(1), batch.column(2), idf)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(times(row, i, w, n, v)), pa.list_(pa.float64()))], names=["__txt", "__svd"])

        return rows.mapInArrow(run, "__txt string, __svd array<double>")

    def state(self) -> dict:
        return {"terms": self.terms, "idf": self.idf.tolist(), "v": self.v.tolist(), "singular_values": self.singular_values}

    @classmethod
    def from_state(cls, s: dict) -> "TextSVD":
        return cls(s["terms"], s["idf"], np.array(s["v"], float).reshape(len(s["terms"]), -1), s["singular_values"])
