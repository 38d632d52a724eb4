"""Cox fits (gradient zero, KKT), wide paths, stacking and ridge on small data."""
import numpy as np
from pyspark.ml.linalg import Vectors

from hazardlake.operators.linear import CoxProblem, fit_cox, fit_coxnet


def _data(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    t = np.round(rng.exponential(np.exp(-X @ np.array([0.8, -0.5, 0.0]))), 1) + 0.1
    e = rng.random(n) < 0.7
    df = spark.createDataFrame([(Vectors.dense(X[i].tolist()), float(t[i]), bool(e[i])) for i in range(n)],
                               ["features", "time", "event"])
    return df, X, t, e


def _np_grad(X, t, e, b):
    eta = X @ b
    g = np.zeros(X.shape[1])
    for ti in np.unique(t[e]):
        ev, rs = (t == ti) & e, t >= ti
        w = np.exp(eta[rs])
        g += X[ev].sum(0) - ev.sum() * (w[:, None] * X[rs]).sum(0) / w.sum()
    return g


def test_cox_gradient_zero_at_fit(spark):
    df, X, t, e = _data(spark)
    beta = fit_cox(df)
    assert np.abs(_np_grad(X, t, e, beta)).max() < 1e-6


def test_coxnet_kkt(spark):
    df, X, t, e = _data(spark, seed=4)
    l1r = 0.5
    beta, a, _ = fit_coxnet(df, l1_ratio=l1r)
    n = len(t)
    g = -_np_grad(X, t, e, beta) / n + a * (1 - l1r) * beta
    l1 = a * l1r
    for j in range(3):
        if beta[j] != 0:
            assert abs(g[j] + l1 * np.sign(beta[j])) < 1e-5
        else:
            assert abs(g[j]) <= l1 + 1e-6


def test_cox_problem_matches_numpy_gradient(spark):
    df, X, t, e = _data(spark, seed=11)
    b = np.array([0.2, -0.1, 0.3])
    _, g = CoxProblem(df).evaluate(b)
    assert np.allclose(g, _np_grad(X, t, e, b))


def test_stacking_and_l1_selection(spark):
    import pandas as pd
    from hazardlake.plans.select import cox_stacking, select_l1_ratio
    df, X, t, e = _data(spark, n=200, seed=21)
    res, best, beta = select_l1_ratio(df, df, ratios=(0.5, 0.9), tau=None, path_steps=2, max_iter=10)
    assert best in (0.5, 0.9) and res.count() == 2 and beta is not None
    sc = spark.createDataFrame(pd.DataFrame({"time": t, "event": e, "s1": X[:, 0], "s2": X[:, 1] + 1.0}))
    out, b = cox_stacking(sc, sc, ["s1", "s2"])
    assert out.count() == 200 and b[0] > 0 and b[1] < 0


def test_ridge_matches_closed_form(spark):
    from pyspark.sql import functions as F
    from hazardlake.operators.linear import fit_ridge_time, ridge_risk
    df, X, t, _ = _data(spark, n=150, seed=31)
    X2 = np.c_[X, X[:, 0]]                                 # a collinear column: alpha keeps it solvable
    df2 = spark.createDataFrame([(Vectors.dense(X2[i].tolist()), float(t[i])) for i in range(150)], ["features", "time"])
    w, b = fit_ridge_time(df2, alpha=1.0)
    Xc, yc = X2 - X2.mean(0), t - t.mean()
    w_np = np.linalg.solve(Xc.T @ Xc + np.eye(4), Xc.T @ yc)
    assert np.allclose(w, w_np) and abs(b - (t.mean() - X2.mean(0) @ w_np)) < 1e-9
    r = ridge_risk((w, b), df2).select(F.col("risk")).toPandas()["risk"].to_numpy()
    assert np.allclose(r, -(X2 @ w_np + b))


def test_cox_terms_with_many_ranges_and_a_hot_time(spark):
    rng = np.random.default_rng(9)
    n, p = 700, 3
    X = rng.normal(size=(n, p))
    t = np.round(rng.exponential(2, n), 1)
    t[:250] = 1.5                                     # a third at one time
    e = rng.random(n) < 0.5
    df = spark.createDataFrame([(Vectors.dense(X[i].tolist()), float(t[i]), bool(e[i])) for i in range(n)],
                               ["features", "time", "event"])
    b = np.array([0.3, -0.2, 5.0])                     # large predictors: sums are scaled
    for beta in (np.zeros(p), np.array([0.3, -0.2, 0.1]), b):
        eta = X @ beta
        ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
        for s in np.unique(t[e]):
            ev, rs = (t == s) & e, t >= s
            top = eta[rs].max()
            w = np.exp(eta[rs] - top)
            m = w @ X[rs] / w.sum()
            ll += eta[ev].sum() - ev.sum() * (np.log(w.sum()) + top)
            g += X[ev].sum(0) - ev.sum() * m
            h += ev.sum() * ((X[rs] * w[:, None]).T @ X[rs] / w.sum() - np.outer(m, m))
        for buckets in (1, 6):
            prob = CoxProblem(df, n_buckets=buckets)
            got = prob.terms(beta)
            assert np.allclose(got[0], ll) and np.allclose(got[1], g) and np.allclose(got[2], h, atol=1e-8)


def test_wide_path_is_screened_and_meets_its_conditions(spark, monkeypatch):
    """More features than MOST_CURVATURE, mostly zero: strong rules, checks on the full gradient, quasi-Newton steps."""
    from hazardlake.operators import linear as L
    rng = np.random.default_rng(6)
    n, p = 250, 120
    X = rng.normal(size=(n, p)) * (rng.random((n, p)) < 0.15)
    t = np.round(rng.exponential(np.exp(-X[:, :4].sum(axis=1))), 2) + 0.01
    e = rng.random(n) < 0.7
    df = spark.createDataFrame([(Vectors.dense(X[i].tolist()), float(t[i]), bool(e[i])) for i in range(n)], ["features", "time", "event"])
    exact = L.coxnet_path(df, l1_ratio=0.7, n_alphas=8, alpha_min_ratio=0.1)
    monkeypatch.setattr(L, "RANGE_CELLS", 6_000)
    for most in (60, 5):                                # Newton on the active set; quasi-Newton beyond five features
        monkeypatch.setattr(L, "MOST_CURVATURE", most)
        points = L.coxnet_path(df, l1_ratio=0.7, n_alphas=8, alpha_min_ratio=0.1)
        assert len(points) == 8 and points[0]["n_active"] == 0 and points[-1]["n_active"] > 10
        for pt, ref in zip(points, exact):
            assert np.allclose(pt["beta"], ref["beta"], atol=2e-3 if most == 5 else 1e-5)
            g = -_np_grad(X, t, e, pt["beta"]) / n + pt["alpha"] * 0.3 * pt["beta"]
            l1 = pt["alpha"] * 0.7
            gap = np.where(pt["beta"] != 0, np.abs(g + l1 * np.sign(pt["beta"])), np.maximum(np.abs(g) - l1, 0))
            assert gap.max() < 2e-3 * l1 + 1e-6 and pt["kkt"] < 2e-3 * l1 + 1e-6
    table = L.path_table(spark, points, [f"f{j}" for j in range(p)])
    assert table.count() == sum(pt["n_active"] for pt in points)
    assert L.path_summary(spark, points).count() == 8


def test_sparse_blocks_hold_the_same_terms(spark, monkeypatch):
    from hazardlake.operators import linear as L
    rng = np.random.default_rng(8)
    X = rng.normal(size=(90, 7)) * (rng.random((90, 7)) < 0.2)
    t, e = np.round(rng.exponential(1, 90), 1), rng.random(90) < 0.6
    df = spark.createDataFrame([(Vectors.dense(X[i].tolist()), float(t[i]), bool(e[i])) for i in range(90)], ["features", "time", "event"])
    b = rng.normal(size=7)
    got = {}
    for share in (0.0, 1.0):
        monkeypatch.setattr(L, "SPARSE_SHARE", share)
        prob = L.CoxProblem(df, n_buckets=3)
        got[share] = prob.terms(b)
        some = np.array([1, 4, 5])
        ll, g, h = prob.terms(b[some], columns=some)
        only = np.zeros(7)
        only[some] = b[some]
        full = prob.terms(only)
        assert np.allclose(ll, full[0]) and np.allclose(g, full[1][some]) and np.allclose(h, full[2][np.ix_(some, some)])
    assert all(np.allclose(x, y) for x, y in zip(got[0.0], got[1.0])) and np.allclose(got[0.0][1], _np_grad(X, t, e, b))


def test_cox_path_evaluates_points_once_and_ships_small_blocks(spark, monkeypatch):
    import pandas as pd
    from pyspark.ml.functions import array_to_vector

    from hazardlake.operators import linear as L
    rng = np.random.default_rng(2)
    X = np.c_[rng.integers(0, 4, (600, 5)), rng.normal(size=(600, 3)).round(1)]
    t, e = rng.exponential(np.exp(-0.4 * X[:, 5])).round(1) + 0.1, rng.random(600) < 0.6
    df = spark.createDataFrame(pd.DataFrame({"x": list(X), "time": t, "event": e})).select(array_to_vector("x").alias("features"), "time", "event")
    probs, init = [], L.CoxProblem.__init__
    monkeypatch.setattr(L.CoxProblem, "__init__", lambda self, *a, **k: (init(self, *a, **k), probs.append(self))[0])
    monkeypatch.setattr(L, "RANGE_CELLS", 1500)
    points = L.coxnet_path(df, l1_ratio=0.9, n_alphas=20, alpha_min_ratio=0.05)
    assert probs[0].n_ranges > 2 and probs[0].evals <= 2 * len(points)      # a point's start is the end of the one before
    assert all(pt["converged"] and pt["kkt"] < 1e-5 for pt in points)
    beta = points[-1]["beta"]
    eta, ll = X @ beta, 0.0
    info = np.zeros((8, 8))
    for s in np.unique(t[e]):
        at, dead = t >= s, e & (t == s)
        w = np.exp(eta[at])
        m = w @ X[at] / w.sum()
        ll += eta[dead].sum() - dead.sum() * np.log(w.sum())
        info += dead.sum() * ((X[at] * w[:, None]).T @ X[at] / w.sum() - np.outer(m, m))
    got = probs[0].terms(beta)
    assert np.isclose(got[0], ll) and np.allclose(got[2], info, rtol=1e-9, atol=1e-8)
    blocks = probs[0].data.collect()
    assert sum(len(r["x"]) for r in blocks) < 0.6 * X.nbytes


def test_paths_of_several_ratios_share_their_passes(spark, monkeypatch):
    """The points of all ratios are evaluated together, in a fraction of the passes, and end where fits one by one end."""
    import pandas as pd
    from pyspark.ml.functions import array_to_vector

    from hazardlake.operators import linear as L
    rng = np.random.default_rng(5)
    X = np.c_[rng.integers(0, 4, (500, 4)), rng.normal(size=(500, 4)).round(1)]
    t, e = rng.exponential(np.exp(-0.5 * X[:, 5] + 0.2 * X[:, 0])).round(1) + 0.1, rng.random(500) < 0.6
    df = spark.createDataFrame(pd.DataFrame({"x": list(X), "time": t, "event": e})).select(array_to_vector("x").alias("features"), "time", "event")
    probs, init = [], L.CoxProblem.__init__
    monkeypatch.setattr(L.CoxProblem, "__init__", lambda self, *a, **k: (init(self, *a, **k), probs.append(self))[0])
    monkeypatch.setattr(L, "RANGE_CELLS", 1500)
    fits = L.fit_coxnets(df, [0.2, 0.9], n_alphas=60, alpha_min_ratio=0.02)
    assert len(probs) == 1 and probs[0].n_ranges > 2 and probs[0].evals < 60
    assert all(points[0]["n_active"] == 0 for points in L.coxnet_paths(probs[0], [0.2, 0.5, 0.9], n_alphas=3))
    for r, (beta, a, _) in zip((0.2, 0.9), fits):
        one, found = L._minimise(probs[0], np.zeros(8), None, a * r, a * (1 - r), 1e-12, 50)
        assert found["done"] and np.allclose(beta, one, atol=1e-6)


def test_several_points_have_the_terms_of_each(spark):
    rng = np.random.default_rng(12)
    n, p = 400, 4
    X = rng.normal(size=(n, p))
    t = np.round(rng.exponential(2, n), 1)
    t[:150] = 0.7
    e = rng.random(n) < 0.5
    df = spark.createDataFrame([(Vectors.dense(X[i].tolist()), float(t[i]), bool(e[i])) for i in range(n)], ["features", "time", "event"])
    betas = rng.normal(size=(p, 3)) * np.array([0.1, 1.0, 6.0])
    for buckets in (1, 5):
        prob = CoxProblem(df, n_buckets=buckets)
        ll, g, h = prob.many(betas, [2, 0])
        for j in range(3):
            one = prob.terms(betas[:, j])
            assert np.allclose(ll[j], one[0]) and np.allclose(g[:, j], _np_grad(X, t, e, betas[:, j])) and np.allclose(g[:, j], one[1])
            if j in (0, 2):
                assert np.allclose(h[[2, 0].index(j)], one[2])


def test_cross_validation_without_kept_designs_writes_risks_only(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hazardlake import estimators as Es
    from hazardlake.plans import select as Sel
    rng = np.random.default_rng(17)
    x = rng.normal(size=(240, 2))
    rows = [(i, Vectors.dense(x[i]), float(rng.exponential(np.exp(-x[i, 0])) + 0.05), bool(rng.random() < 0.7), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, ["ID", "features", "time", "event", "status"])
    written, cut = [], Sel.cut_lineage
    monkeypatch.setattr("hazardlake.session.cut_lineage", lambda d: written.append(d.columns) or cut(d))
    monkeypatch.setattr(Sel, "cut_lineage", lambda d: written.append(d.columns) or cut(d))

    def scores(keep):
        written.clear()
        out = Sel.cross_validate(df, lambda a, b: Es.RidgeTime(alpha=1.0).fit(a).transform(b), 3, None, strata="status",
                                 prepare=lambda a, b: tuple(d.withColumn("design", F.col("features")) for d in (a, b)), keep_designs=keep)
        return {r["fold"]: r["cindex"] for r in out.collect()}, sum("design" in c for c in written)
    (kept, copies), (lazy, none) = scores(True), scores(False)
    assert copies == 6 and none == 0 and kept.keys() == lazy.keys() == {0, 1, 2}
    assert all(abs(kept[k] - lazy[k]) < 1e-12 for k in kept)
