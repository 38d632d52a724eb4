"""Concordance, Kaplan-Meier and IPCW against numpy recomputations."""
import numpy as np
import pandas as pd
import pytest

from hazardlake.operators.survival import (concordance_sums, concordance_sums_pairs, harrell_pairs,
                                           ipcw_cindex, km_censoring)


def _brute(t, e, r, w, tol, cens):
    lt = le = al = 0.0
    for i in range(len(t)):
        if not (e[i] and w[i] > 0):
            continue
        comp = (t > t[i]) | ((t == t[i]) & ~e) if cens else (t > t[i])
        lt += w[i] * np.sum(comp & (r < r[i] - tol))
        le += w[i] * np.sum(comp & (r <= r[i] + tol))
        al += w[i] * comp.sum()
    return lt, le, al


@pytest.mark.parametrize("cens,tol", [(True, 1e-8), (False, 0.0)])
def test_grid_dominance_equals_pairs_with_hot_values(spark, cens, tol):
    rng = np.random.default_rng(7)
    n = 1500
    t = rng.integers(0, 30, n).astype(float)
    t[:500] = 4.0                                   # a third of the rows share one time
    r = np.round(rng.normal(size=n), 1)
    r[600:1100] = 0.25                              # and a third share one risk
    e = rng.random(n) < 0.6
    w = np.where(e, rng.random(n) + 0.5, 0.0)
    pdf = pd.DataFrame({"time": t, "event": e, "risk": r, "w": w})
    df = spark.createDataFrame(pdf)
    want = _brute(t, e, r, w, tol, cens)
    for nb in (3, 5):
        got = concordance_sums(df, (), tol, cens, n_buckets=nb).collect()[0]
        assert np.allclose([got["lt"], got["le"], got["all"]], want)
    got = concordance_sums_pairs(df, (), tol, cens).collect()[0]
    assert np.allclose([got["lt"], got["le"], got["all"]], want)


def test_hot_time_among_continuous_times_keeps_groups_small(spark, monkeypatch, tmp_path):
    import uuid

    import hazardlake.operators.survival as S
    rng = np.random.default_rng(3)
    n, nb = 6000, 30
    t = rng.random(n) * 10
    t[:2000] = 4.0                                   # a third at one time, the rest continuous
    r = rng.normal(size=n)
    e = rng.random(n) < 0.6
    pdf = pd.DataFrame({"time": t, "event": e, "risk": r, "w": np.where(e, 1.0, 0.0)})
    out, strip = str(tmp_path), S._strip_counts

    def counted(*a):
        fn = strip(*a)

        def run(group):
            with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(int((~group["is_q"]).sum())))
            return fn(group)
        return run

    monkeypatch.setattr(S, "_strip_counts", counted)
    got = S.concordance_sums(spark.createDataFrame(pdf), (), 0.0, False, n_buckets=nb, whole=True).collect()[0]
    assert tuple(int(got[c]) for c in ("lt", "le", "all")) == tuple(int(x) for x in _brute(t, e, r, pdf["w"].to_numpy(), 0.0, False))
    largest = max(int(f.read_text()) for f in tmp_path.iterdir())
    assert 0 < largest <= 2 * n / nb * 1.25           # quantiles are approximate


def test_rows_without_time_event_or_risk_take_no_part(spark):
    rng = np.random.default_rng(4)
    n = 200
    rows = [(float(a), bool(b), float(c), 1.0) for a, b, c in zip(rng.integers(0, 20, n), rng.random(n) < 0.5, rng.normal(size=n))]
    odd = [(1.0, True, None, 1.0), (1.0, True, float("nan"), 1.0), (None, True, 0.0, 1.0), (float("nan"), True, 0.0, 1.0), (2.0, None, 0.1, 1.0)]
    schema = "time double, event boolean, risk double, w double"
    a = concordance_sums(spark.createDataFrame(rows, schema), n_buckets=4).collect()[0]
    b = concordance_sums(spark.createDataFrame(rows + odd, schema), n_buckets=4).collect()[0]
    assert a == b
    none = concordance_sums(spark.createDataFrame(odd, schema)).collect()
    assert none == [] or none[0]["all"] == 0


def _km_censoring_np(t, e):
    times = np.unique(t)
    G, out = 1.0, []
    for s in times:
        r = np.sum(t >= s); d = np.sum((t == s) & e); c = np.sum((t == s) & ~e)
        G *= 1.0 - (c / (r - d) if c > 0 else 0.0)
        out.append(G)
    return times, np.array(out)


def test_km_censoring_matches_numpy(spark):
    rng = np.random.default_rng(2)
    t = rng.integers(1, 15, 400).astype(float)
    e = rng.random(400) < 0.5
    df = spark.createDataFrame(pd.DataFrame({"time": t, "event": e}))
    got = km_censoring(df, n_buckets=4).orderBy("time").toPandas()
    times, G = _km_censoring_np(t, e)
    assert np.allclose(got["time"], times) and np.allclose(got["G"], G)
    assert np.all(np.diff(got["G"]) <= 1e-12)      # non-increasing


def test_ipcw_reference_value_on_fixture(spark):
    """FIXTURES.md: risk = HB, tau = 5, hash hold-out -> 0.488447 at sf0.01."""
    from paths import SF01
    from hazardlake.plans.queries import REGISTRY, registry
    registry()
    got = REGISTRY["ipcw_cindex"](spark, SF01).collect()[0]["cindex"]
    assert abs(got - 0.488447) < 1e-6


def test_ipcw_negated_risk_is_complement_without_ties(spark):
    rng = np.random.default_rng(5)
    n = 300
    tr = pd.DataFrame({"time": rng.exponential(2, n), "event": rng.random(n) < 0.6})
    te = pd.DataFrame({"time": rng.exponential(2, n), "event": rng.random(n) < 0.6, "risk": rng.normal(size=n)})
    te["neg"] = -te["risk"]
    trd, ted = spark.createDataFrame(tr), spark.createDataFrame(te)
    a = ipcw_cindex(trd, ted, "risk", 3.0).collect()[0]["cindex"]
    b = ipcw_cindex(trd, ted, "neg", 3.0).collect()[0]["cindex"]
    assert abs(a + b - 1.0) < 1e-9


def test_harrell_counts(spark):
    pdf = pd.DataFrame({"time": [1.0, 2.0, 2.0, 3.0, 4.0], "event": [True, True, False, True, False],
                        "risk": [5.0, 3.0, 3.0, 1.0, 1.0]})
    r = harrell_pairs(spark.createDataFrame(pdf), "risk").collect()[0]
    # i=0: j=1..4 all lower risk -> 4 conc; i=1 (t=2): j=3,4 lower -> 2; i=3 (t=3): j=4 tie -> 1 tied
    assert (r["concordant"], r["discordant"], r["tied"]) == (6, 0, 1)
    assert abs(r["cindex"] - 6.5 / 7) < 1e-12


def test_no_events_edge_case(spark):
    pdf = pd.DataFrame({"time": [1.0, 2.0, 3.0], "event": [False, False, False], "risk": [1.0, 2.0, 3.0]})
    df = spark.createDataFrame(pdf)
    r = harrell_pairs(df, "risk").collect()
    assert len(r) == 1 and r[0]["cindex"] == 0.5 and r[0]["concordant"] == 0
    c = ipcw_cindex(df, df, "risk", 5.0).collect()
    assert len(c) == 1 and c[0]["cindex"] is None


def test_strips_are_small_enough_for_a_worker(spark, monkeypatch):
    import tracemalloc

    from hazardlake.operators import survival as S
    rng = np.random.default_rng(2)
    n = S.POINTS_PER_BUCKET                               # a column strip with two queries a point, as many as there can be
    time, v = np.tile(rng.integers(0, 2400, n) / 365.25, 3), np.tile(rng.normal(size=n), 3)
    pdf = pd.DataFrame({"is_q": np.arange(3 * n) >= n, "time": time, "cflag": 0, "v": v, "strict": np.arange(3 * n) < 2 * n, "tb": 1,
                        "eb": (v > 0).astype(int), "n": 1.0, "w": 1.0, "kind": 3, "k1": 1, "k2": 1})
    tracemalloc.start()
    out = S._strip_counts([], ["target", "value"], False)(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out["target"]) == {"lt", "le"} and peak < 150e6
    # the same sums whatever the size of a bucket
    rows = spark.createDataFrame(pd.DataFrame({"time": np.round(rng.exponential(1, 300), 1), "event": rng.random(300) < 0.6,
                                               "risk": np.round(rng.normal(size=300), 1), "w": 1.0}))
    want = S.concordance_sums_pairs(rows).first()
    for points in (200_000, 40):
        monkeypatch.setattr(S, "POINTS_PER_BUCKET", points)
        got = S.concordance_sums(rows).first()
        assert all(abs(float(got[t]) - float(want[t])) < 1e-6 for t in ("lt", "le", "all"))
