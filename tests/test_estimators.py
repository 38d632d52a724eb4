"""Estimators and Models: params, param maps, pipelines, saving and loading; selection on top of them."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from hazardlake import estimators as Es
from hazardlake.plans import select as Sel
from hazardlake.plans.store import ScoreStore
from hazardlake.plans.together import together


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 240
    a, b = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    text = rng.choice(["46,XX", "46,XY,del(5)", "complex", "47,XX,+8", None], n)
    pdf = pd.DataFrame({"ID": np.arange(n), "a": np.where(rng.random(n) < .1, np.nan, a), "b": b, "CENTER": rng.choice(["x", "y", "z"], n), "CYTOGENETICS": text,
                        "time": np.round(rng.exponential(np.exp(-a - (text == "complex"))), 2) + 0.01, "event": rng.random(n) < 0.7})
    df = spark.createDataFrame(pdf).withColumns({"a": F.nanvl("a", F.lit(None).cast("double")), "OS_STATUS": F.col("event").cast("int")})
    return df.withColumn("CYTOGENETICS", F.when(F.col("CYTOGENETICS") != "None", F.col("CYTOGENETICS"))).repartition(3).checkpoint()


ESTIMATORS = [Es.RidgeTime(), Es.CoxPH(alpha=0.1), Es.Coxnet(nAlphas=5), Es.BoostedCox(nEstimators=4), Es.BoostedTime(nEstimators=4), Es.ForestRisk(nEstimators=3),
              Es.KMeansRisk(k=3, nInit=2)]


@pytest.mark.parametrize("est", ESTIMATORS, ids=lambda e: type(e).__name__)
def test_every_model_saves_loads_and_scores_alike(spark, rows, tmp_path, est):
    pre = Es.Preprocessor(numCols=["a", "b"], catCols=["CENTER"], textCol="CYTOGENETICS", svdComponents=2)
    Pipeline(stages=[pre, est]).write().overwrite().save(str(tmp_path / "unfitted"))
    again = Pipeline.load(str(tmp_path / "unfitted"))
    assert again.getStages()[1].extractParamMap().values() is not None and again.getStages()[0].get("svdComponents") == 2
    model = again.fit(rows)
    model.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    a, b = (m.transform(rows).select("ID", "risk").orderBy("ID").toPandas()["risk"].to_numpy() for m in (model, loaded))
    assert len(a) == 240 and np.isfinite(a).all() and np.array_equal(a, b)


def test_param_maps_make_several_models(rows):
    pre = Es.Preprocessor(numCols=["a", "b"]).fit(rows)
    X = pre.transform(rows)
    est = Es.RidgeTime()
    models = est.fit(X, [{est.alpha: 0.1}, {est.alpha: 1000.0}])
    assert abs(models[1].state[0]).sum() < abs(models[0].state[0]).sum() and est.get("alpha") == 1.0


def test_rank_mean_is_a_saved_transformer(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 7.0), (3, 3.0, 6.0)], "ID long, p double, q double")
    Es.RankMean(inputCols=["p", "q"], weights=[3.0, 1.0]).write().overwrite().save(str(tmp_path / "r"))
    got = {r["ID"]: r["risk"] for r in Es.RankMean.load(str(tmp_path / "r")).transform(df).collect()}
    assert got == {1: 0.0, 2: (3 * .5 + 1) / 4, 3: (3 + .5) / 4}


def test_grid_search_by_folds_and_hold_out(rows):
    def prepare(a, b):
        pre = Es.Preprocessor(numCols=["a", "b"]).fit(a)
        return pre.transform(a), pre.transform(b)
    grid = {"nEstimators": [2, 4], "learningRate": [0.1, 0.5]}
    res, summ = Sel.grid_search(rows, Es.BoostedCox(), grid, 2, 2.0, prepare=prepare)
    assert res.count() == 8 and summ.count() == 4 and summ.where("is_best").count() == 1
    best = summ.orderBy(F.col("mean").desc(), "position").first()
    assert best["is_best"]
    tr, va = prepare(rows.where("ID % 3 > 0"), rows.where("ID % 3 = 0"))
    got = {r["config"]: r["cindex"] for r in Sel.grid_holdout(tr, va, Es.BoostedCox(), grid, 2.0).collect()}
    # a stage equals a fit of its own
    from hazardlake.operators.survival import ipcw_cindex
    alone = Es.BoostedCox(nEstimators=2, learningRate=0.5).fit(tr).transform(va)
    assert math.isclose(ipcw_cindex(tr, alone, "risk", 2.0).first()["cindex"], got['{"learningRate": 0.5, "nEstimators": 2}'])
    forest = Sel.grid_holdout(tr, va, Es.ForestRisk(), {"nEstimators": [2, 3], "maxFeatures": ["sqrt", 1.0]}, 2.0)
    assert forest.count() == 4


def test_permutation_importance_of_a_pipeline(rows):
    model = Pipeline(stages=[Es.Preprocessor(numCols=["a", "b"], catCols=["CENTER"], textCol="CYTOGENETICS", svdComponents=2), Es.CoxPH(alpha=0.1)]).fit(rows)
    got = {r["column"]: r for r in Sel.permutation_importance(model, rows, rows, ["a", "CENTER", "CYTOGENETICS"], 3, 2.0).collect()}
    assert got["a"]["importance"] > 0.1 > abs(got["CENTER"]["importance"]) and got["a"]["std"] is not None


def test_scores_are_stored_and_a_second_run_computes_what_is_missing(spark, rows, tmp_path):
    from hazardlake.operators.splits import kfold
    pre = Es.Preprocessor(numCols=["a", "b"]).fit(rows)
    X = pre.transform(rows).select("ID", "features", "time", "event")
    folds, calls = kfold(X, 2, out="fold").checkpoint(), []

    def fit(name, est, fail=False):
        def run(a, b):
            calls.append(name)
            if fail:
                raise RuntimeError("lost")
            return est.copy().fit(a).transform(b)
        return run

    first = ScoreStore(spark, str(tmp_path), "v1")
    with pytest.raises(RuntimeError):
        Sel.stacked(first, folds, (X, X), {"ridge": fit("ridge", Es.RidgeTime()), "cox": fit("cox", Es.CoxPH(), fail=True)}, 2)
    kept = len(first.computed)
    second, calls[:] = ScoreStore(spark, str(tmp_path), "v1"), []
    out, beta = Sel.stacked(second, folds, (X, X), {"ridge": fit("ridge", Es.RidgeTime()), "cox": fit("cox", Es.CoxPH())}, 2)
    assert out.count() == 240 and set(beta) == {"ridge", "cox"} and len(second.computed) == len(calls) == 6 - kept
    third = ScoreStore(spark, str(tmp_path), "v1")
    Sel.stacked(third, folds, (X, X), {"ridge": fit("ridge", None), "cox": fit("cox", None)}, 2)
    assert third.computed == [] and ScoreStore(spark, str(tmp_path), "v2").has(0, "cox") is False


def test_together_keeps_order_and_stops_at_the_first_error(spark):
    got = together(spark, {k: (lambda k=k: spark.range(k).count()) for k in (5, 3, 9, 1)}, most=2)
    assert list(got.items()) == [(5, 5), (3, 3), (9, 9), (1, 1)]
    started = []

    def wrong():
        raise ValueError("no")

    with pytest.raises(ValueError):
        together(spark, {"wrong": wrong, **{i: (lambda i=i: started.append(i) or spark.range(10).count()) for i in range(20)}}, most=1)
    assert len(started) < 20


def test_sweep_shares_counts_and_equal_designs(rows):
    calls = []

    def risks(tr, va):
        calls.append(1)
        return Es.RidgeTime().fit(tr).transform(va).select("ID", "time", "event", "risk").withColumn("model", F.lit("ridge"))
    got = Sel.preprocessing_sweep(rows.where("ID % 3 > 0"), rows.where("ID % 3 = 0"), ["a", "b"], [(5, 2), (9, 3), (20000, 100), (20000, 120)], tau=2.0, risks=risks).toPandas()
    assert len(calls) == 6 and len(got) == 4 * 2 * 2
    same = got[got["tfidf_max"] == 20000].groupby(["center_te", "model"])["cindex"].nunique() if (got["tfidf_max"] == 20000).any() else []
    assert all(v == 1 for v in same)


def test_fit_eval_all_scores_stages_and_their_rank_mean(rows):
    pre = Es.Preprocessor(numCols=["a", "b"]).fit(rows)
    tr, va = (pre.transform(rows.where(c)) for c in ("ID % 3 > 0", "ID % 3 = 0"))
    got = {r["model"]: r["cindex"] for r in Sel.fit_eval_all(tr, va, 2.0, n_trees=4, boost_rounds=(2, 5)).collect()}
    assert set(got) == {"forest", "boost_2", "boost_5", "rank_mean"} and min(got.values()) > 0.55


def test_design_of_few_texts_does_not_shuffle_the_rows(rows, monkeypatch):
    from hazardlake.operators import encode as E
    from hazardlake.operators import pipeline as P
    pre = Es.Preprocessor(numCols=["a", "b"], catCols=["CENTER"], textCol="CYTOGENETICS", svdComponents=2).fit(rows)
    some = rows.checkpoint()
    got = pre.transform(some).select("ID", "features")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "BROADCAST_CELLS", 0)
    shuffled = pre.transform(some).select("ID", "features")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, shuffled.collect()), key=str)
    cats = pre.state.categories["CENTER"] + ["none has it"]
    wide = E.onehot(some, "CENTER", cats, "C_", fill=cats[0]).select("ID", *[f"C_{c}" for c in cats])
    array = some.select("ID", E.onehot_array("CENTER", cats, cats[0]).alias("x"))
    assert {r[0]: [float(v) for v in r[1:]] for r in wide.collect()} == {r[0]: r[1] for r in array.collect()}
