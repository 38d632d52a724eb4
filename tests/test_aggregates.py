"""Per-entity aggregates against pandas on edge rows."""
import numpy as np
import pandas as pd

from hazardlake.operators.aggregates import entity_features, top_values
from hazardlake.operators.ordered import exact_quantiles, histogram


def test_entity_features_edge_rows(spark):
    rows = [("A", "G1", "E1", "0.5", "10"), ("B", "G1", "E1", None, "5"), ("B", "G2", "E2", "abc", None),
            ("C", "G2", "E1", "0.05", "7"), ("C", "G3", None, "1.5d", "3"), ("C", None, "E2", "0.4", "9"),
            ("D", "G1", "E1", "NaN", "1")]
    df = spark.createDataFrame(rows, "ID string, GENE string, EFFECT string, VAF string, DEPTH string")
    out = {r["ID"]: r.asDict() for r in entity_features(df, gene_list=["G1", "G2"], effect_list=["E1"]).collect()}
    a, b, c, d = out["A"], out["B"], out["C"], out["D"]
    assert a["n_mut"] == 1 and a["vaf_std"] == 0.0 and a["vaf_p90"] == 0.5     # one-row entity
    assert b["vaf_mean"] == 0.0 and b["vaf_max"] == 0.0 and b["n_mut"] == 2    # all VAF unusable
    assert c["n_unique_genes"] == 2 and c["n_unique_effects"] == 2              # NULLs not counted
    assert c["n_mut"] == 3 and c["n_vaf_gt_30"] == 1 and c["n_vaf_lt_10"] == 1
    assert np.isclose(c["vaf_p90"], np.percentile([0.05, 0.4], 90))
    assert np.isclose(c["vaf_std"], pd.Series([0.05, 0.4]).std())
    assert d["vaf_sum"] == 0.0 and d["n_vaf_gt_30"] == 0                        # NaN is not > 0.3
    assert a["GENE__G1"] == 1 and a["GENE__G2"] == 0 and c["EFFECT__E1"] == 1


def test_top_values_tie_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "GENE string")
    assert [r["GENE"] for r in top_values(df, "GENE", 2).collect()] == ["a", "b"]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.integers(0, 20, 300), np.full(200, 7)]).astype(float)
    g = np.repeat([0, 1], 250)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": vals}))
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"], n_buckets=5).collect()}
    for k in (0, 1):
        for p in (0.1, 0.5, 0.9):
            assert np.isclose(got[(k, p)], np.percentile(vals[g == k], p * 100))


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    h = histogram(df, "x", 10).collect()
    assert sum(r["count"] for r in h) == 101 and max(r["bin"] for r in h) == 9


def test_hot_entities_take_their_quantile_from_ranges(spark):
    import random

    from hazardlake.operators.aggregates import entity_sketches, merge_sketches, sketch_estimates
    rng = random.Random(3)
    rows = [(1, "G", "E", rng.random(), 1.0) for _ in range(200)] + [(i, "G", "E", rng.choice([None, rng.random()]), 2.0) for i in range(2, 40) for _ in range(5)]
    df = spark.createDataFrame(rows, "ID long, GENE string, EFFECT string, VAF double, DEPTH double").repartition(4)
    plain = {r["ID"]: r for r in entity_features(df).collect()}
    hot = {r["ID"]: r for r in entity_features(df, hot_rows=50).collect()}
    assert set(plain) == set(hot) and all(abs(plain[i]["vaf_p90"] - hot[i]["vaf_p90"]) < 1e-12 and plain[i]["n_mut"] == hot[i]["n_mut"] for i in plain)
    assert list(entity_features(df).columns) == list(entity_features(df, hot_rows=50).columns)
    assert "vaf_p90" not in entity_features(df, p90=False).columns
    # sketches of parts, merged, say what sketches of the whole say
    whole = {r["ID"]: r for r in sketch_estimates(entity_sketches(df, ["ID"])).collect()}
    parts = entity_sketches(df.selectExpr("*", "hash(VAF) % 3 as day"), ["ID", "day"])
    merged = {r["ID"]: r for r in sketch_estimates(merge_sketches(parts, ["ID"])).collect()}
    assert all(whole[i]["n_unique_genes"] == merged[i]["n_unique_genes"] == 1 and whole[i]["n_mut"] == merged[i]["n_mut"] for i in whole)
    v = sorted(x[3] for x in rows if x[0] == 1)
    rank = sum(x <= merged[1]["vaf_p90"] for x in v) / len(v)
    assert abs(rank - 0.9) < 0.03


def test_rows_of_entities_are_dealt_before_they_are_aggregated_and_masks_tell_many_values(spark):
    rng = np.random.default_rng(5)
    n, genes = 600, [f"g{i:03d}" for i in range(130)]    # more values than one mask has bits
    pdf = pd.DataFrame({"ID": rng.integers(0, 90, n), "GENE": rng.choice(genes + [None], n), "EFFECT": rng.choice(["E1", "E2"], n),
                        "VAF": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)), "DEPTH": rng.random(n)})
    out = entity_features(spark.createDataFrame(pdf).repartition(3), gene_list=genes, effect_list=["E1", "none"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ID") == 1 and plan.index("REPARTITION_BY_COL") > plan.rindex("Aggregate")
    assert "percentile" not in plan
    for r in out.collect():
        mine = pdf[pdf["ID"] == r["ID"]]
        assert all(r[f"GENE__{g}"] == int((mine["GENE"] == g).any()) for g in genes)
        assert r["EFFECT__none"] == 0 and r["EFFECT__E1"] == int((mine["EFFECT"] == "E1").any())
        vaf = mine["VAF"].dropna()
        assert np.isclose(r["vaf_p90"], np.percentile(vaf, 90) if len(vaf) else 0.0)


def test_medians_rank_only_the_middle_bins(spark):
    from hazardlake.operators import encode as E
    rng = np.random.default_rng(9)
    n = 4001
    pdf = pd.DataFrame({"normal": rng.normal(size=n), "skew": np.exp(8 * rng.normal(size=n)), "flag": rng.integers(0, 2, n), "same": np.full(n, 3.5),
                        "inf": np.where(np.arange(n) % 3 == 0, np.inf, rng.normal(size=n)), "tiny": np.where(np.arange(n) == 0, 5e-324, 0.0),
                        "holes": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan)})
    df = spark.createDataFrame(pdf).repartition(3)
    got = E.fit_medians(df, pdf.columns)
    for c in pdf.columns:
        v = pdf[c].dropna()
        assert got[c] is None if c == "none" else np.isclose(got[c], np.median(v), rtol=1e-15), c
    even = E.fit_medians(df.limit(0).union(spark.createDataFrame(pdf[:1000])), ["normal"])
    assert np.isclose(even["normal"], np.median(pdf["normal"][:1000]), rtol=1e-15)
    ranked = []
    whole = E.quantiles_of_counts
    E.quantiles_of_counts = lambda vals, *a, **k: ranked.append(vals.count()) or whole(vals, *a, **k)
    try:
        E.fit_medians(df, ["normal"])
    finally:
        E.quantiles_of_counts = whole
    assert ranked[0] < n // 20                           # not all 4,001 distinct values


def test_means_and_deviations_of_many_columns(spark):
    from hazardlake.operators import encode as E
    pdf = pd.DataFrame({f"c{i}": np.random.default_rng(i).normal(i, 1 + i, 200) for i in range(30)})
    pdf.loc[:50, "c3"] = None
    df = spark.createDataFrame(pdf)
    got = E.fit_scaler(df.selectExpr("*", "cast(null as double) as none"), [*pdf.columns, "none"], {"c3": 7.0, "none": None})
    want = pdf.fillna({"c3": 7.0})
    assert all(np.allclose(got[c], (want[c].mean(), want[c].std(ddof=0))) for c in pdf.columns) and got["none"] == (None, None)
