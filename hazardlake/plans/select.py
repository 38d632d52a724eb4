"""Model selection and interpretation jobs.

Folds, permutations and weights are columns, not driver loops over copies
of the data: every candidate is scored by one grouped concordance job.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import prefix_sums
from ..operators.splits import hash_u32
from ..session import cut_lineage


def permuted_copies(df: DataFrame, id_col: str, cols, repeats: int, seed: int = 42) -> DataFrame:
    """One copy of ``df`` per (column, repeat) with that column permuted.

    The row at position k in ID order receives the value of the row at
    position k in hash(seed, column, repeat, ID) order — a permutation that
    a recomputed stage reproduces exactly.  Positions come from
    ``prefix_sums`` (no single-partition window).  Only (column, repeat, ID,
    value) is copied, ranked and shuffled; the position in ID order is the same
    for all copies, and the rows meet their values by an equi-join on it.
    """
    spark = df.sparkSession
    plan = spark.createDataFrame([(c, r) for c in cols for r in range(repeats)], "column string, repeat int")
    types = {c: df.schema[c].dataType for c in cols}
    numeric = all(isinstance(t, T.NumericType) for t in types.values())
    kind = "double" if numeric else "string"             # values of several types travel as text
    copies = df.select(id_col, *[c for c in cols if c != id_col]).join(F.broadcast(plan), how="cross")   # cols x repeats copies
    val = None
    for c in cols:
        val = F.when(F.col("column") == c, F.col(c).cast(kind)) if val is None else \
            val.when(F.col("column") == c, F.col(c).cast(kind))
    h = hash_u32(F.concat_ws("|", F.col("column"), F.col("repeat").cast("string"), F.col(id_col).cast("string")), seed)
    one = F.lit(1).alias("__one")
    by_h = prefix_sums(cut_lineage(copies.select("column", "repeat", h.alias("__h"), id_col, val.alias("__perm"), one)), ["__h", id_col],
                       ["__one"], ["column", "repeat"], prefix="__p")
    donor = cut_lineage(by_h.select("column", "repeat", F.col("__p__one").alias("__pos"), "__perm"))
    recv = prefix_sums(df.select("*", one), [id_col], ["__one"], prefix="__p").withColumnRenamed("__p__one", "__pos")
    j = recv.join(donor, on="__pos", how="inner")
    new = {c: F.when(F.col("column") == c, F.col("__perm").cast("double" if numeric else types[c]))
           .otherwise(F.col(c).cast("double") if numeric else F.col(c)) for c in cols}
    return j.select("column", "repeat", *[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def prepare_folds(df: DataFrame, prepare, n_splits=3, seed=42, strata=(), id_col="ID", keep=True):
    """Fold ids on one table and, per fold, ``prepare(train_df, test_df) -> (train_X, test_X)``.

    The per-fold preprocessing is fitted on that fold's training rows only
    and materialised once, so every model / configuration reuses it; with ``keep``
    off the designs stay plans, for a model that reads its design once.
    Returns (fold table, list of (train_X, test_X)).
    """
    from ..operators.splits import kfold
    from ..session import cut_lineage

    f = cut_lineage(kfold(df, n_splits, id_col=id_col, seed=seed, strata=strata, out="__fold"))
    prepared = []
    for k in range(n_splits):
        a, b = prepare(f.where(F.col("__fold") != k), f.where(F.col("__fold") == k))
        prepared.append((cut_lineage(a), cut_lineage(b)) if keep else (a, b))
    return f, prepared


def score_folds(f: DataFrame, prepared, fit_predict, tau=7.0, id_col="ID", time_col="time",
                event_col="event", keep=False) -> DataFrame:
    """Fit per fold, then score all out-of-fold risks in ONE grouped IPCW job -> (fold, cindex).

    The censoring curve of fold k is estimated on fold k's training rows.  ``keep`` materialises the risks.
    """
    from ..operators.survival import ipcw_cindex

    preds = None
    for k, (a, b) in enumerate(prepared):
        p = fit_predict(a, b).select(id_col, time_col, event_col, "risk").withColumn("fold", F.lit(k))
        p = cut_lineage(p) if keep else p
        preds = p if preds is None else preds.unionByName(p)
    spark = f.sparkSession
    folds = spark.createDataFrame([(k,) for k in range(len(prepared))], "fold int")
    train_rows = f.join(F.broadcast(folds), F.col("__fold") != F.col("fold"))  # each row trains k-1 folds
    return ipcw_cindex(train_rows.select("fold", time_col, event_col), preds, "risk", tau, time_col, event_col,
                       group_cols=["fold"]).select("fold", "cindex")


def cross_validate(df: DataFrame, fit_predict, n_splits=3, tau=7.0, seed=42, strata=(), id_col="ID",
                   time_col="time", event_col="event", prepare=None, keep_designs=True) -> DataFrame:
    """K-fold IPCW C.  ``prepare(train, test)`` (optional) builds per-fold designs,
    ``fit_predict(train_X, test_X)`` returns the test rows with 'risk'.  Returns (fold, cindex).

    A model that reads its design once needs no copy of it on disk for each fold: with ``keep_designs`` off only the risks are written.
    """
    prep = prepare or (lambda a, b: (a, b))
    f, prepared = prepare_folds(df, prep, n_splits, seed, strata, id_col, keep_designs)
    return score_folds(f, prepared, fit_predict, tau, id_col, time_col, event_col, keep=not keep_designs)


def param_grid(grid: dict) -> list[dict]:
    """Cartesian product of parameter lists, the last name varying fastest."""
    import itertools

    return [dict(zip(grid, vals)) for vals in itertools.product(*grid.values())]


def staged_fits(configs: list[dict], stage: str = "nEstimators") -> dict:
    """Configurations that differ in the number of trees only share the largest fit: {fit's params as JSON: [(position, config)]}."""
    import json

    found: dict = {}
    for i, cfg in enumerate(configs):
        rest = json.dumps({k: v for k, v in cfg.items() if k != stage}, sort_keys=True)
        found.setdefault(rest, []).append((i, cfg))
    return found


def grid_scores(estimator, configs: list[dict], train: DataFrame, valid: DataFrame, design=None, keep=("ID", "time", "event"),
                most=4) -> DataFrame:
    """Risks of the validation rows under every configuration: (keep..., risk, position).

    ``estimator`` is an Estimator of ``hazardlake.estimators``; each configuration sets its params.  Fits run side by
    side; those of one packed design share it, and a number of trees is a stage of the largest fit with the
    other params.
    """
    from ..session import cut_lineage
    from .together import together

    groups = staged_fits(configs) if hasattr(estimator, "fit_design") else {str(i): [(i, c)] for i, c in enumerate(configs)}
    if hasattr(estimator, "fit_design") and design is None:
        design = estimator.design(train)

    def scored(members):
        def run():
            est = estimator.copy()
            rest = {k: v for k, v in members[0][1].items() if k != "nEstimators"}
            est.set_all(**rest)
            if not hasattr(est, "fit_design"):
                found = est.fit(train).transform(valid)
                return cut_lineage(found.select(*keep, F.col(est.get("riskCol")).alias("risk"), F.lit(members[0][0]).alias("position")))
            stages = sorted({c.get("nEstimators", est.get("nEstimators")) for _, c in members})
            est.set_all(nEstimators=stages[-1])
            # another number of bins is another design
            model = est.fit_design(design if "maxBins" not in rest else est.design(train))
            found = model.staged(valid, stages)
            each = F.array(*[F.struct(F.col(f"{est.get('riskCol')}_{c.get('nEstimators', est.get('nEstimators'))}").alias("risk"),
                                      F.lit(i).alias("position")) for i, c in members])
            return cut_lineage(found.select(*keep, F.explode(each).alias("__s")).select(*keep, "__s.*"))
        return run

    parts = together(train.sparkSession, {k: scored(m) for k, m in groups.items()}, most)
    out = None
    for p in parts.values():
        out = p if out is None else out.unionByName(p)
    return out


def config_table(spark, configs: list[dict]) -> DataFrame:
    import json

    return spark.createDataFrame([(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(configs)], "position int, config string")


def best_first(scores: DataFrame, score="mean") -> DataFrame:
    """Adds ``is_best``: the largest score, of equal ones the first position (O3); NULL and NaN scores never win."""
    usable = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    top = usable.orderBy(F.col(score).desc(), F.col("position").asc()).limit(1).select(F.col("position").alias("__best"))
    return scores.join(F.broadcast(top), how="left", on=F.col("position") == F.col("__best")) \
        .withColumn("is_best", F.col("__best").isNotNull()).drop("__best")


def grid_search(df: DataFrame, estimator, grid: dict, n_splits=3, tau=7.0, seed=42, strata=(), prepare=None, most=4):
    """Cartesian product of the grid (J11) x folds; mean and std of the IPCW C by configuration, first best flagged (O3).

    Folds and their preprocessing are built once and shared by all configurations, fits run side by side, and the out-of-fold risks of all
    (configuration, fold) pairs are scored by one grouped job.  Returns (per fold: position, config, fold, cindex;
    summary: position, config, mean, std, is_best).
    """
    from ..operators.survival import ipcw_cindex

    configs, spark = param_grid(grid), df.sparkSession
    f, prepared = prepare_folds(df, prepare or (lambda a, b: (a, b)), n_splits, seed, strata)
    preds = None
    for k, (a, b) in enumerate(prepared):
        p = grid_scores(estimator, configs, a, b, most=most).withColumn("fold", F.lit(k))
        preds = p if preds is None else preds.unionByName(p)
    folds = spark.createDataFrame([(k,) for k in range(n_splits)], "fold int")
    train_rows = f.join(F.broadcast(folds), F.col("__fold") != F.col("fold"))  # each row trains k-1 folds
    scored = ipcw_cindex(train_rows.select("fold", "time", "event"), preds, "risk", tau, "time", "event", group_cols=["fold", "position"])
    res = scored.select("position", "fold", "cindex").join(F.broadcast(config_table(spark, configs)), on="position")
    summ = res.groupBy("position", "config").agg(F.avg("cindex").alias("mean"), F.stddev_samp("cindex").alias("std"))
    return res, best_first(summ)


def grid_holdout(train: DataFrame, valid: DataFrame, estimator, grid: dict, tau=7.0, design=None, most=4) -> DataFrame:
    """The grid on one split: (position, config, cindex, is_best), scored by one grouped job."""
    from ..operators.survival import ipcw_cindex

    configs = param_grid(grid)
    preds = grid_scores(estimator, configs, train, valid, design, most=most)
    scored = ipcw_cindex(train, preds, "risk", tau, "time", "event", group_cols=["position"]).select("position", "cindex")
    return best_first(scored.join(F.broadcast(config_table(train.sparkSession, configs)), on="position"), "cindex")


def permutation_importance(model, valid: DataFrame, train: DataFrame, cols, repeats=5, tau=7.0, seed=42, id_col="ID", risk_col="risk") -> DataFrame:
    """Drop of the IPCW C when a raw column is permuted, of any fitted Model or PipelineModel.

    ``cols`` are columns of ``valid`` of any type.  All (column, repeat) copies pass the model as one table and are scored by one grouped job.
    Returns (column, importance, std, base), the mean and sample deviation over ``repeats``.
    """
    from ..operators.survival import ipcw_cindex

    cols = list(cols)
    base = ipcw_cindex(train, model.transform(valid), risk_col, tau).select(F.col("cindex").alias("base"))
    copies = permuted_copies(valid, id_col, cols, repeats, seed)
    risks = cut_lineage(model.transform(copies).select("column", "repeat", "time", "event", risk_col))
    scored = ipcw_cindex(train, risks, risk_col, tau, group_cols=["column", "repeat"]).select("column", "repeat", "cindex")
    drop = scored.join(F.broadcast(base), how="cross")       # one row
    return drop.groupBy("column").agg(F.avg(F.col("base") - F.col("cindex")).alias("importance"),
                                      F.stddev_samp(F.col("base") - F.col("cindex")).alias("std"), F.first("base").alias("base"))


def select_l1_ratio(train_X: DataFrame, valid_X: DataFrame, ratios=(0.1, 0.3, 0.5, 0.7, 0.9), tau=7.0,
                    **coxnet_kw):
    """One Coxnet per l1_ratio, their paths side by side; all validation risks scored by one grouped IPCW job; first best wins.

    Returns (results DataFrame (l1_ratio, cindex), best ratio, its coefficients).
    """
    from ..operators.linear import fit_coxnets, linear_risk
    from ..operators.survival import ipcw_cindex

    ratios = list(ratios)
    preds, betas = None, {r: fit[0] for r, fit in zip(ratios, fit_coxnets(train_X, ratios, **coxnet_kw))}
    for r in ratios:
        p = linear_risk(valid_X, betas[r]).select("time", "event", "risk").withColumn("l1_ratio", F.lit(float(r)))
        preds = p if preds is None else preds.unionByName(p)
    res = ipcw_cindex(train_X, preds, "risk", tau, group_cols=["l1_ratio"]).select("l1_ratio", "cindex")
    got = {r["l1_ratio"]: r["cindex"] for r in res.collect()}
    best = None
    for r in ratios:                        # strict > : the first of equal scores wins
        if got.get(float(r)) is not None and (best is None or got[float(r)] > got[float(best)]):
            best = r
    return res, best, betas.get(best)


def cox_stacking(oof: DataFrame, other: DataFrame, score_cols, alpha=1e-4):
    """Cox model on out-of-fold model scores.

    ``oof`` holds (time, event, scores) predicted out of fold for the
    training rows; the scores are standardised with the training mean and
    population std, and the same transform is applied to ``other``.
    """
    from pyspark.ml.feature import VectorAssembler

    from ..operators.encode import fit_scaler, impute_scale
    from ..operators.linear import fit_cox, linear_risk

    cols = list(score_cols)
    stats = fit_scaler(oof, cols)
    va = VectorAssembler(inputCols=[f"{c}__z" for c in cols], outputCol="features")
    tr = va.transform(impute_scale(oof, cols, {}, stats, "__z"))
    beta = fit_cox(tr, alpha=alpha)
    te = va.transform(impute_scale(other, cols, {}, stats, "__z"))
    return linear_risk(te, beta).drop("features"), beta


def fit_eval_all(train_X: DataFrame, valid_X: DataFrame, tau=7.0, n_trees=300, boost_rounds=(200, 300), seed=42):
    """Forest, Cox boosting after fewer and more rounds and the mean of their ranks: (model, cindex).

    The two boosted models are stages of one fit, forest and boosting are fitted side by side, and all risks are scored in one grouped job.
    """
    from ..operators.survival import ipcw_cindex

    risks = model_risks(train_X, valid_X, n_trees, boost_rounds, seed)
    return ipcw_cindex(train_X, with_rank_mean(risks), "risk", tau, group_cols=["model"]).select("model", "cindex")


def model_risks(train_X: DataFrame, valid_X: DataFrame, n_trees=300, boost_rounds=(200, 300), seed=42) -> DataFrame:
    """(ID, time, event, risk, model) of ``forest`` and ``boost_<rounds>``."""
    from ..estimators import BoostedCox, ForestRisk
    from ..session import cut_lineage
    from .together import together

    def forest():
        found = ForestRisk(nEstimators=n_trees, seed=seed).fit(train_X).transform(valid_X)
        return cut_lineage(found.select("ID", "time", "event", "risk", F.lit("forest").alias("model")))

    def boost():
        found = BoostedCox(nEstimators=max(boost_rounds)).fit(train_X).staged(valid_X, boost_rounds)
        each = F.array(*[F.struct(F.col(f"risk_{r}").alias("risk"), F.lit(f"boost_{r}").alias("model")) for r in sorted(boost_rounds)])
        return cut_lineage(found.select("ID", "time", "event", F.explode(each).alias("__s")).select("ID", "time", "event", "__s.*"))

    parts = together(train_X.sparkSession, {"forest": forest, "boost": boost})
    return parts["forest"].unionByName(parts["boost"])


def with_rank_mean(risks: DataFrame, name="rank_mean", by=()) -> DataFrame:
    """Adds the model ``name``: the mean over the models of the scaled ranks of their risks, within ``by``."""
    from ..operators.ordered import rank01

    keep = ["ID", "time", "event", *by]
    ens = rank01(risks, "risk", "__r", partition_cols=["model", *by]).groupBy(*keep).agg(F.avg("__r").alias("risk"))
    return risks.unionByName(ens.withColumn("model", F.lit(name)).select(risks.columns))


def preprocessing_sweep(train: DataFrame, valid: DataFrame, num_cols, sweep, cat_cols=("CENTER",), text_col="CYTOGENETICS", tau=7.0,
                        target_encoding=(False, True), risks=model_risks):
    """(tfidf_max, svd_k) x target encoding: one row per configuration and model with its IPCW C.

    The n-grams are counted once; every vocabulary is a prefix of the ranked terms, and all ranks of a vocabulary
    come from one SVD.  Configurations that end with the same features (a vocabulary smaller than the cap, a rank
    below k) share their fits.  All risks are scored in one grouped job.
    """
    from ..estimators import Preprocessor
    from ..operators.encode import target_encode
    from ..operators.pipeline import fit_preprocessor, text_corpus
    from ..operators.survival import ipcw_cindex
    from ..session import cut_lineage

    corpus = text_corpus(train, text_col, max(t for t, _ in sweep))
    largest: dict = {}
    for terms, k in sweep:
        terms = min(terms, len(corpus.terms))
        largest[terms] = max(k, largest.get(terms, 0))
    svds = {terms: corpus.svd(terms, k) for terms, k in largest.items()}
    scored, rows = {}, []
    for te in target_encoding:
        tr, va, nums = train, valid, list(num_cols)
        if te:
            tr, va = (cut_lineage(d) for d in target_encode(train, valid, "CENTER", "OS_STATUS", "CENTER_TE"))
            nums.append("CENTER_TE")
        for terms, k in sweep:
            text = svds[min(terms, len(corpus.terms))].first(k)
            key = (len(text.terms), text.k, te)
            if key not in scored:
                fp = fit_preprocessor(tr, nums, list(cat_cols), text_col, text=text)
                keep = ["ID", "features", "time", "event"]
                found = risks(*(cut_lineage(fp.transform(d).select(*keep)) for d in (tr, va)))
                scored[key] = (len(scored), found, len(fp.output_cols))
            rows.append((terms, k, te, scored[key][2], scored[key][0]))
    allp = None
    for number, found, _ in scored.values():
        found = found.withColumn("design", F.lit(number))
        allp = found if allp is None else allp.unionByName(found)
    res = ipcw_cindex(train, with_rank_mean(allp, by=["design"]), "risk", tau, group_cols=["design", "model"]).select("design", "model", "cindex")
    table = train.sparkSession.createDataFrame(rows, "tfidf_max int, svd_k int, center_te boolean, x_dim int, design int")
    return table.join(res, on="design").drop("design")


def stacked(store, folds: DataFrame, holdout: tuple, fits: dict, n_splits: int, alpha=1e-4):
    """Cox model on out-of-fold scores of several models; restarts where a run stopped.

    ``folds`` holds (ID, features, time, event, fold), ``holdout`` a (fit on, score) pair for the final scores,
    ``fits`` name -> function (fit on, rows) -> rows with ``risk``.  Every (fold, model) score table goes through ``store``.
    Returns (hold-out rows with risk and the models' scores, coefficients by model).
    """
    from .together import together

    names = list(fits)
    work = {}
    for name in names:
        for k in range(n_splits):
            work[k, name] = (folds.where(F.col("fold") != k), folds.where(F.col("fold") == k))
        work["all", name] = holdout

    def run(k, name, fit_on, rows):
        return lambda: store.scores(k, name, None, lambda: fits[name](fit_on, rows).select("ID", "time", "event", "risk"))

    got = together(folds.sparkSession, {key: run(*key, *parts) for key, parts in work.items()})

    def wide(keys):
        out = None
        for name in names:
            part = None
            for k in keys:
                p = got[k, name].select("ID", "time", "event", F.col("risk").alias(name))
                part = p if part is None else part.unionByName(p)
            out = part if out is None else out.join(part.select("ID", name), on="ID")
        return out

    out, beta = cox_stacking(wide(range(n_splits)), wide(["all"]), names, alpha)
    return out, dict(zip(names, (float(b) for b in beta)))


def cross_validate_models(df: DataFrame, models: dict, n_splits=3, tau=7.0, seed=42, strata=(), prepare=None,
                          id_col="ID", time_col="time", event_col="event"):
    """Every model of ``models`` (name -> fit_predict) on the same folds.

    All (fold, model) out-of-fold risks are scored by ONE IPCW job grouped
    by (fold, model), with the censoring curve of each fold estimated on its
    training rows.  Returns (per-fold (fold, model, cindex), summary (model, mean, std)).
    """
    from ..operators.survival import ipcw_cindex

    f, prepared = prepare_folds(df, prepare or (lambda a, b: (a, b)), n_splits, seed, strata, id_col)
    preds = None
    for k, (a, b) in enumerate(prepared):
        for name, fit_predict in models.items():
            p = fit_predict(a, b).select(id_col, time_col, event_col, "risk") \
                .withColumn("fold", F.lit(k)).withColumn("model", F.lit(name))
            preds = p if preds is None else preds.unionByName(p)
    folds = df.sparkSession.createDataFrame([(k,) for k in range(n_splits)], "fold int")
    train_rows = f.join(F.broadcast(folds), F.col("__fold") != F.col("fold"))  # each row trains k-1 folds
    per_fold = ipcw_cindex(train_rows.select("fold", time_col, event_col), preds, "risk", tau, time_col, event_col,
                           group_cols=["fold", "model"]).select("fold", "model", "cindex")
    summary = per_fold.groupBy("model").agg(F.avg("cindex").alias("mean"), F.stddev_samp("cindex").alias("std"))
    return per_fold, summary
