"""Registered model queries (rows-only checks: no SQL oracle exists for a model fit).

All of them read the fixture tables through the training-table plan, fit on
the training part of the hold-out split and score the evaluation part.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import estimators as Es
from ..operators import linear as Lm
from ..operators import survival as S
from ..operators import tables as P
from ..operators.pipeline import fit_preprocessor
from ..session import cut_lineage
from . import select as Sel
from . import train_table as N
from .context import TAU, TOP_EFFECTS, TOP_GENES
from .queries import query
from .together import together

# Parameters of the reference's runs.  Trees, rounds, alphas and starts are the library's defaults
# (300, 300, 100 and 10), those of the final risk table as given here.
TFIDF_MAX, SVD_K = 5000, 120
RIDGE_ALPHA = 1.0
KMEANS_K, KMEANS_CANDIDATES = 4, (3, 4, 5, 6, 7, 8, 10)
COXNET_L1, L1_RATIOS = 0.9, (0.1, 0.3, 0.5, 0.7, 0.9)
CV_FOLDS = 3
FINAL_FOREST = {"nEstimators": 150, "maxSamples": 0.7}
BOOST_GRID = {"nEstimators": [100, 200, 300], "learningRate": [0.05, 0.1], "maxDepth": [2, 3, 4]}
FOREST_GRID = {"nEstimators": [200, 400], "minSamplesLeaf": [10, 20], "minSamplesSplit": [10], "maxFeatures": ["sqrt", 0.5]}
GRID_FOLDS = 2
SWEEP = ((5000, 80), (5000, 120), (10000, 100), (10000, 150), (20000, 150), (20000, 200))
IMPORTANCE_COLUMNS = ("BM_BLAST", "HB", "PLT", "CENTER", "CYTOGENETICS")
KEEP = ("ID", "features", "time", "event")


def _numeric(t):
    return [f.name for f in t.schema.fields if f.name not in ("ID", "OS_YEARS", "OS_STATUS", "time", "is_test", "fold")
            and f.dataType.typeName() in ("integer", "long", "double")]


def _table(c):
    """The whole training table with outcomes."""
    t, genes, effects = N.train_table(c.clinical_train, c.molecular_train, c.target, TOP_GENES, TOP_EFFECTS)
    return cut_lineage(P.to_survival(t)), genes, effects


def _split(c):
    """Training and evaluation rows of the hold-out."""
    t = _table(c)[0].withColumn("is_test", c.is_test())
    return t.where(~F.col("is_test")), t.where(F.col("is_test"))


def _preprocessor(t, **params):
    return Es.Preprocessor(numCols=_numeric(t), catCols=["CENTER"], textCol="CYTOGENETICS", tfidfMax=TFIDF_MAX, svdComponents=SVD_K).set_all(**params)


def _design(c, with_text=True):
    """Hold-out design matrices, fitted preprocessing on the training part."""
    tr, te = _split(c)
    fp = fit_preprocessor(tr, _numeric(tr), ["CENTER"], "CYTOGENETICS" if with_text else None, TFIDF_MAX, SVD_K if with_text else 0)
    return tr, te, fp, cut_lineage(fp.transform(tr).select(*KEEP)), cut_lineage(fp.transform(te).select(*KEEP))


def _prepare(a, b):
    """Preprocessing of a fold, fitted on its training rows."""
    fp = fit_preprocessor(a, _numeric(a), ["CENTER"], "CYTOGENETICS", TFIDF_MAX, SVD_K)
    return fp.transform(a).select(*KEEP), fp.transform(b).select(*KEEP)


@query("svd_text")
def q_svd(c):
    """M1 / M9: fitted preprocessing; output the text components of the evaluation rows."""
    _, _, fp, _, Xte = _design(c)
    from pyspark.ml.functions import vector_to_array
    k = fp.k
    return Xte.select("ID", vector_to_array("features").alias("__a")).select(
        "ID", *[F.col("__a")[len(fp.output_cols) - k + i].alias(f"svd_{i}") for i in range(k)])


@query("ridge_risk")
def q_ridge(c):
    """Ridge on time, risk = -prediction."""
    _, _, _, Xtr, Xte = _design(c)
    return Es.RidgeTime(alpha=RIDGE_ALPHA).fit(Xtr).transform(Xte).select("ID", "risk")


@query("gbt_time_risk")
def q_gbt(c):
    """Boosted regression trees on time (depth 3, lr 0.05, 100 rounds), risk = -prediction."""
    _, _, _, Xtr, Xte = _design(c)
    return Es.BoostedTime().fit(Xtr).transform(Xte).select("ID", "risk")


@query("kmeans_risk")
def q_kmeans(c):
    """Cluster risk = -median time of the cluster."""
    _, _, _, Xtr, Xte = _design(c)
    return Es.KMeansRisk(k=KMEANS_K).fit(Xtr).transform(Xte).select("ID", "cluster", "risk")


@query("kmeans_tune")
def q_kmeans_tune(c):
    """Silhouette per candidate k (squared Euclidean), best flagged."""
    from ..operators.cluster import tune_k
    _, _, _, Xtr, _ = _design(c)
    rows, best = tune_k(Xtr, KMEANS_CANDIDATES)
    return c.spark.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, best boolean")


@query("cox_ph")
def q_cox(c):
    """Cox proportional hazards (ridge 1e-4 for separable columns), risk = linear predictor."""
    _, _, _, Xtr, Xte = _design(c, with_text=False)
    return Es.CoxPH(alpha=1e-4).fit(Xtr).transform(Xte).select("ID", "risk")


@query("coxnet")
def q_coxnet(c):
    """Elastic-net Cox (l1_ratio 0.9, last alpha of a 100-alpha path at ratio 0.01)."""
    _, _, _, Xtr, Xte = _design(c)
    return Es.Coxnet(l1Ratio=COXNET_L1).fit(Xtr).transform(Xte).select("ID", "risk")


@query("coxnet_path")
def q_coxnet_path(c):
    """The whole path: alpha, active features, log-likelihood and how far the optimality conditions are from holding."""
    _, _, _, Xtr, _ = _design(c)
    return Lm.path_summary(c.spark, Lm.coxnet_path(Xtr, l1_ratio=COXNET_L1))


@query("boosted_survival")
def q_boost(c):
    """Cox-loss gradient boosting (300 rounds, depth 3, leaf >= 5, lr 0.1)."""
    _, _, _, Xtr, Xte = _design(c)
    return Es.BoostedCox().fit(Xtr).transform(Xte).select("ID", "risk")


@query("survival_forest")
def q_forest(c):
    """Random survival forest (300 trees, log-rank splits, sqrt features, Poisson bootstrap, grown to the leaf limit)."""
    _, _, _, Xtr, Xte = _design(c)
    return Es.ForestRisk().fit(Xtr).transform(Xte).select("ID", "risk")


@query("model_comparison")
def q_models(c):
    """Hold-out IPCW C of ridge, Cox, Coxnet and their rank mean, one grouped job."""
    tr, _, _, Xtr, Xte = _design(c)
    fits = {"ridge": Es.RidgeTime(alpha=RIDGE_ALPHA), "cox": Es.CoxPH(alpha=1e-4), "coxnet": Es.Coxnet(l1Ratio=COXNET_L1)}
    models = together(c.spark, {n: (lambda e=e: e.fit(Xtr)) for n, e in fits.items()})
    allp = None
    for name, m in models.items():
        p = m.transform(Xte).select("ID", "time", "event", "risk").withColumn("model", F.lit(name))
        allp = p if allp is None else allp.unionByName(p)
    return S.ipcw_cindex(tr, Sel.with_rank_mean(cut_lineage(allp)), "risk", TAU, "time", "event", group_cols=["model"]).select("model", "cindex")


@query("fit_eval_all")
def q_fit_eval_all(c):
    """Hold-out IPCW C of the forest, boosting after 200 and 300 rounds, and their rank mean."""
    _, _, _, Xtr, Xte = _design(c)
    return Sel.fit_eval_all(Xtr, Xte, TAU)


@query("preprocessing_sweep")
def q_sweep(c):
    """Vocabulary and rank x target encoding, 12 configurations, all models of fit_eval_all."""
    tr, te = _split(c)
    return Sel.preprocessing_sweep(tr, te, _numeric(tr), SWEEP, tau=TAU)


@query("cross_validate")
def q_cv(c):
    """Stratified 3-fold IPCW C of the ridge-on-time model (preprocessing refitted per fold)."""
    def fit_predict(a, b):
        return Es.RidgeTime(alpha=RIDGE_ALPHA).fit(a).transform(b)
    return Sel.cross_validate(_table(c)[0], fit_predict, CV_FOLDS, TAU, strata="OS_STATUS", prepare=_prepare, keep_designs=False)


@query("grid_search")
def q_grid(c):
    """The forest's grid over stratified folds; mean and std per configuration, winner flagged."""
    _, summ = Sel.grid_search(_table(c)[0], Es.ForestRisk(), FOREST_GRID, GRID_FOLDS, TAU, strata="OS_STATUS", prepare=_prepare)
    return summ.drop("position")


@query("boosting_grid")
def q_boosting_grid(c):
    """18 boosting configurations on the hold-out, from six fits with staged scores."""
    _, _, _, Xtr, Xte = _design(c)
    return Sel.grid_holdout(Xtr, Xte, Es.BoostedCox(), BOOST_GRID, TAU, most=6).drop("position")


@query("model_importance")
def q_importance(c):
    """Permutation importance of raw columns through a fitted PipelineModel (preprocessing and Coxnet), five repeats."""
    from pyspark.ml import Pipeline
    tr, te = _split(c)
    model = Pipeline(stages=[_preprocessor(tr), Es.Coxnet(l1Ratio=COXNET_L1)]).fit(tr)
    return Sel.permutation_importance(model, te, tr, IMPORTANCE_COLUMNS, 5, TAU)


def final_pipeline(t):
    """Preprocessing, Coxnet, boosting and forest side by side, and the mean of their ranks."""
    return [_preprocessor(t)], {
        "coxnet": Es.Coxnet(l1Ratio=COXNET_L1, riskCol="coxnet"), "boost": Es.BoostedCox(riskCol="boost"),
        "forest": Es.ForestRisk(riskCol="forest", **FINAL_FOREST)}, Es.RankMean(inputCols=["coxnet", "boost", "forest"], riskCol="risk_score")


def fit_final(t):
    """The PipelineModel of all labelled rows; its models are fitted side by side."""
    from pyspark.ml import PipelineModel
    (pre,), estimators, ranks = final_pipeline(t)
    prepared = pre.fit(t)
    X = cut_lineage(prepared.transform(t).select(*KEEP))
    models = together(t.sparkSession, {n: (lambda e=e: e.fit(X)) for n, e in estimators.items()})
    return PipelineModel([prepared, *models.values(), ranks])


@query("risk_table")
def q_risk_table(c):
    """Fit on all labeled rows, score the unlabeled entities, rank mean of forest, boosting, Coxnet."""
    t, genes, effects = _table(c)
    cols = P.feature_columns(t.drop("time", "event"))
    test = cut_lineage(N.scoring_table(c.clinical_unlabeled, c.molecular_unlabeled, cols, genes, effects))
    return fit_final(t).transform(test).select("ID", "risk_score")


# --------------------------------------------------------------------------- model parts with a closed form
TERMS_BETA = (0.05, -0.02, 0.03)
TERMS_X = ("HB / 10.0", "coalesce(BM_BLAST, 0.0) / 100.0", "coalesce(PLT, 0.0) / 400.0")


def _small_design(c):
    """Labeled rows with three scaled columns as features."""
    from pyspark.ml.functions import array_to_vector
    lab = P.to_survival(c.labeled.join(c.clinical, on="ID"))
    return lab.select("ID", "time", "event", array_to_vector(F.array(*[F.expr(x).cast("double") for x in TERMS_X])).alias("features"))


def _rows(c, named):
    return c.spark.createDataFrame([(k, float(v)) for k, v in named], "term string, value double")


@query("cox_terms")
def q_cox_terms(c):
    """Log-likelihood, gradient and information at a fixed beta, by row, divided by the number of rows."""
    prob = Lm.CoxProblem(_small_design(c))
    ll, g, h = prob.terms(TERMS_BETA)
    named = [("loglik", ll), *[(f"g{i + 1}", g[i]) for i in range(3)],
             *[(f"h{i + 1}{j + 1}", h[i, j]) for i in range(3) for j in range(i, 3)]]
    return _rows(c, [(k, v / prob.n) for k, v in named])


@query("boost_first_residuals")
def q_boost_residuals(c):
    """Martingale residuals of the first boosting round (event minus Nelson-Aalen hazard)."""
    rows, _ = Lm.cox_residuals(_small_design(c).withColumn("__F", F.lit(0.0)), "__F")
    return rows.select("ID", F.col("__r").alias("residual"))


@query("boost_first_tree")
def q_boost_first_tree(c):
    """The first tree of a fit by one split on three coarse columns: where it cuts, its leaves, and the log-likelihood before."""
    from pyspark.ml.functions import array_to_vector
    cols = [F.floor("HB"), F.floor(F.coalesce("BM_BLAST", F.lit(0.0)) / 10), F.floor(F.coalesce("PLT", F.lit(0.0)) / 10)]
    lab = P.to_survival(c.labeled.join(c.clinical, on="ID")).select(
        "ID", "time", "event", array_to_vector(F.array(*[x.cast("double") for x in cols])).alias("features"))
    model = Es.BoostedCox(nEstimators=1, maxDepth=1).fit(lab).state
    tree = model.trees[0]
    return _rows(c, [("feature", tree.feature[0]), ("cut", model.cut_value(tree.feature[0], tree.cut[0])), ("left", tree.value[1]),
                     ("right", tree.value[2]), ("loglik", model.loglik[0] / 1000.0)])


@query("svd_trace")
def q_svd_trace(c):
    """M9: the squared singular values of the training texts add up to the number of texts with a term (their rows have length one)."""
    _, _, fp, _, _ = _design(c)
    return _rows(c, [("trace", sum(s * s for s in fp.singular_values))])


@query("rf_weights")
def q_rf_weights(c):
    """Poisson bootstrap weights of four trees."""
    from ..operators.splits import poisson_weight
    trees = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tree")
    return c.labeled.select("ID", trees).select("ID", "tree", poisson_weight("ID", 42, F.col("tree")).cast("int").alias("weight"))


@query("ridge_small")
def q_ridge_small(c):
    """G1: ridge on time with two columns (closed form in the oracle): weights and intercept."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = _small_design(c).withColumn("__a", vector_to_array("features"))
    d = d.select("time", array_to_vector(F.slice("__a", 1, 2)).alias("features"))
    w, b = Lm.fit_ridge_time(d, alpha=RIDGE_ALPHA)
    return _rows(c, [("w1", w[0]), ("w2", w[1]), ("intercept", b)])


# --------------------------------------------------------------------------- selection and stacking
@query("l1_ratio_selection")
def q_l1_ratio(c):
    """Hold-out IPCW C of a Coxnet by l1_ratio, the first best flagged."""
    _, _, _, tr, te = _design(c)
    res, best, _ = Sel.select_l1_ratio(tr, te, L1_RATIOS, TAU)
    return res.withColumn("is_best", F.col("l1_ratio") == F.lit(best))


@query("cox_stacking")
def q_stacking(c):
    """Cox model on out-of-fold forest, boosting and Coxnet scores of the training part, applied to the hold-out."""
    import uuid

    from ..operators.splits import kfold
    from ..session import ensure_checkpoint_dir
    from .store import ScoreStore
    _, _, _, tr, te = _design(c)
    folds = cut_lineage(kfold(tr, CV_FOLDS, out="fold"))
    fits = {"forest": Es.ForestRisk(**FINAL_FOREST), "boost": Es.BoostedCox(), "coxnet": Es.Coxnet(l1Ratio=COXNET_L1)}
    store = ScoreStore(c.spark, f"{ensure_checkpoint_dir(c.spark)}/scores-{uuid.uuid4().hex}")
    out, _ = Sel.stacked(store, folds, (tr, te), {n: (lambda a, b, e=e: e.copy().fit(a).transform(b)) for n, e in fits.items()}, CV_FOLDS)
    return out.select("ID", "risk")
