"""Text components against numpy's SVD; multi-start k-means, silhouettes and value filters against direct forms."""
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hazardlake.operators import cluster as K
from hazardlake.operators import svd as V

TEXTS = ["46,XX", "46,xy,del(5)(q13)", "complex", "46,XX", "47,XX,+8", "t(8;21) inv(16)", "no", "", "46,XX  del", "del(5)(q31),-7", "+8,+8", "complex"]


def tfidf(texts, features):
    counts = []
    for t in texts:
        import re
        s = re.sub(r"\s\s+", " ", t).lower()
        counts.append(Counter(s[i:i + n] for n in range(3, 7) for i in range(len(s) - n + 1)))
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    terms = sorted(total, key=lambda g: (-total[g], g))[:features]
    X = np.array([[c[g] * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in terms] for c in counts])
    norm = np.linalg.norm(X, axis=1, keepdims=True)
    return terms, X / np.where(norm > 0, norm, 1)


@pytest.mark.parametrize("features", [1000, 40])
def test_components_and_gram_equal_numpy(spark, monkeypatch, features):
    monkeypatch.setattr(V, "PRODUCTS", 200)              # sparse products in small pieces
    monkeypatch.setattr(V, "TASK_ENTRIES", 60)
    corpus = V.TextCorpus(spark.createDataFrame([(t,) for t in TEXTS], "__txt string"), 1000)
    terms, X = tfidf(TEXTS, features)
    assert corpus.terms[:len(terms)] == terms and corpus.tasks > 1
    q = np.random.default_rng(0).normal(size=(len(terms), 5))
    assert np.allclose(corpus.gram_times(q), X.T @ (X @ q), atol=1e-9)
    k = 4
    fit = corpus.svd(features, k)
    s = np.linalg.svd(X, compute_uv=False)
    assert np.allclose(fit.singular_values, s[:k], atol=1e-6)
    proj = fit.project(spark.createDataFrame([(t,) for t in set(TEXTS) | {"unseen text"}], "__txt string")).collect()
    got = {r["__txt"]: np.array(r["__svd"]) for r in proj}
    P = np.array([got[t] for t in TEXTS])
    assert np.allclose(P.T @ P, np.diag(s[:k] ** 2), atol=1e-6)
    u, d, _ = np.linalg.svd(X, full_matrices=False)
    assert np.allclose(P @ P.T, (u[:, :k] * d[:k] ** 2) @ u[:, :k].T, atol=1e-6)
    assert np.allclose(V.TextSVD.from_state(fit.state()).v, fit.v) and np.allclose(fit.first(2).v, fit.v[:, :2])


def test_components_beyond_the_rank_are_left_out(spark):
    corpus = V.TextCorpus(spark.createDataFrame([("abcdef",)] * 3 + [("xyzuvw",)], "__txt string"), 1000)
    assert corpus.svd(1000, 10).k == 2
    assert V.TextCorpus(spark.createDataFrame([("ab",), ("",)], "__txt string"), 10).svd(10, 3).k == 0


def points(spark, n=150):
    rng = np.random.default_rng(2)
    X = np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    return X, spark.createDataFrame(pd.DataFrame({"i": range(len(X)), "x": list(X)})).repartition(4).select("i", array_to_vector("x").alias("features"))


def test_all_starts_and_k_in_shared_passes(spark):
    X, df = points(spark)
    fits = K.fit_kmeans_all(df, [2, 3, 5], n_init=4)
    assert set(fits) == {2, 3, 5} and fits[2].cost > fits[3].cost > fits[5].cost
    for k, fit in fits.items():
        d = ((X[:, None] - fit.centres) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        assert abs(fit.cost - d.min(axis=1).sum()) < 1e-6 * fit.cost
        assert all(np.linalg.norm(X[at == j].mean(axis=0) - fit.centres[j]) < 0.05 for j in set(at))   # a fixed point
        got = {r["i"]: r["cluster"] for r in fit.assign(df).collect()}
        assert [got[i] for i in range(len(X))] == at.tolist()
    best, s = K.tune_k(df, [2, 3, 5], n_init=4), K.silhouettes(df, fits)
    at = ((X[:, None] - fits[3].centres) ** 2).sum(axis=2).argmin(axis=1)
    D = ((X[:, None] - X) ** 2).sum(axis=2)
    want = []
    for i in range(len(X)):
        a = D[i][at == at[i]].sum() / ((at == at[i]).sum() - 1)
        b = min(D[i][at == j].mean() for j in set(at) - {at[i]})
        want.append((b - a) / max(a, b))
    assert abs(s[3] - np.mean(want)) < 1e-9 and best[1] == 3


def test_kmeans_with_fewer_distinct_rows_than_clusters(spark):
    df = spark.createDataFrame([([1.0],)] * 5 + [([2.0],)] * 2, "x array<double>").select(array_to_vector("x").alias("features"))
    fit = K.fit_kmeans(df, 4, n_init=2)
    assert fit.cost < 1e-12
    with pytest.raises(ValueError):
        K.fit_kmeans(df.limit(0), 2)


def test_value_filter_and_category_bound(spark):
    from hazardlake.operators import encode as E
    from hazardlake.operators import tables as P
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "g string, v int")
    assert {r["v"] for r in P.filter_values(df, "g", ["a", "c", "zz"]).collect()} == {1, 4}
    assert {r["v"] for r in P.filter_values(df, "g", df.where("v > 1").select("g")).collect()} == {2, 4}
    assert P.filter_values(df, "g", []).count() == 0
    with pytest.raises(ValueError):
        E.fit_categories(df, "g", most=2)
    assert E.fit_categories(df, "g", most=3) == ["a", "b", "c"]
