"""Registered queries: one per operator of the inventory, on the fixture views.

Each function takes (spark, sf_dir) and returns a DataFrame whose columns
carry the same names as the DuckDB oracle in ``plans.oracle``.  Doubles are
rounded to 6 places for the value-hash comparison.
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import aml_rule_flags, cyto_features
from ..operators import aggregates as A
from ..operators import encode as E
from ..operators import ordered as O
from ..operators import splits as L
from ..operators import survival as S
from ..operators import tables as P
from ..operators import textvec as X
from . import train_table as N
from ..session import cut_lineage, ensure_checkpoint_dir, ship_package
from .context import ROUND, SEED, TAU, TOP_EFFECTS, TOP_GENES, make_ctx, round_doubles

REGISTRY: dict = {}


def query(name):
    def deco(fn):
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return round_doubles(fn(make_ctx(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# Fixed parameters of the registered queries.
COMUT_PAIRS = [("Brand#11", "Brand#12"), ("Brand#21", "Brand#33"), ("Brand#44", "Brand#55")]
HIST_BINS = 30
RANK_SCORES = ("HB", "BM_BLAST", "PLT")
SWEEP_WEIGHTS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
TFIDF_VOCAB = 50
PERM_REPEATS = 5
PERM_COLUMNS = ("HB", "PLT")


def _labeled_with_clinical(c):
    return c.labeled.join(c.clinical, on="ID", how="inner")


def _split(c, df):
    return df.withColumn("is_test", c.is_test())


# --------------------------------------------------------------------------- scans / validation
@query("validate")
def q_validate(c):
    """Data checks on the clinical and target tables."""
    return A.validate(c.clinical, c.target)


@query("semi_entities")
def q_semi(c):
    """Clinical entities that have a target row."""
    return c.clinical_train.select("ID", "CENTER")


@query("anti_missing_target")
def q_anti(c):
    """Entities without a target and their count per centre."""
    return c.clinical_unlabeled.groupBy("CENTER").agg(F.countDistinct("ID").alias("n_missing_target"))


# --------------------------------------------------------------------------- aggregates
@query("entity_features")
def q_entity_features(c):
    """The twelve per-entity aggregates."""
    return A.entity_features(c.molecular).select("ID", *A.ENTITY_NUMERIC)


@query("top_values")
def q_top_values(c):
    """O1: top genes of the training events, (count desc, value asc)."""
    return A.top_values(c.molecular_train, "GENE", TOP_GENES)


def _pivot(c, binary):
    mt = c.molecular_train
    genes = A.top_list(mt, "GENE", TOP_GENES)
    effects = A.top_list(mt, "EFFECT", TOP_EFFECTS)
    f = A.entity_features(mt, gene_list=genes, effect_list=effects, binary=binary, p90=False)
    return f.select("ID", *[x for x in f.columns if x.startswith(("GENE__", "EFFECT__"))])


def _long(df, kind="double"):
    """(ID, feature, value) of the numeric columns: a table whose columns depend on the data, in a fixed schema."""
    cols = [f.name for f in df.schema.fields if f.name != "ID" and f.dataType.simpleString() != "string"]
    return df.select("ID", *[F.col(f"`{c}`").cast(kind).alias(c) for c in cols]).unpivot(
        ["ID"], [F.col(f"`{c}`") for c in cols], "feature", "value")


@query("indicator_pivot_binary")
def q_pivot_binary(c):
    """A8/A9 (J3): binary top-k GENE__/EFFECT__ indicators, one groupBy; long form."""
    return _long(_pivot(c, True), "long")


@query("indicator_pivot_count")
def q_pivot_count(c):
    """Count indicators; long form."""
    return _long(_pivot(c, False), "long")


@query("gene_filter")
def q_gene_filter(c):
    """Events of the three most frequent genes, by a value list and, the same, by a table of values; counted by effect."""
    by_list = P.filter_values(c.molecular, "GENE", A.top_list(c.molecular, "GENE", 3)).groupBy("GENE", "EFFECT").agg(F.count("*").alias("n_list"))
    by_table = P.filter_values(c.molecular, "GENE", A.top_values(c.molecular, "GENE", 3)).groupBy("GENE", "EFFECT").agg(F.count("*").alias("n_table"))
    return by_list.join(by_table, on=["GENE", "EFFECT"], how="full")


@query("lenient_numbers")
def q_lenient_numbers(c):
    """P5: VAF and DEPTH that arrive as text, with signs, blanks, exponents, suffixes and words among them; sums by entity."""
    text = F.col("VAF").cast("string")
    kind = F.col("ID") % 9
    vaf = F.when(kind == 0, "abc").when(kind == 1, F.concat(text, F.lit("d"))).when(kind == 2, F.concat(F.lit(" +"), text, F.lit(" "))) \
        .when(kind == 3, "").when(kind == 4, "nan").when(kind == 5, "1e-2").when(kind == 6, ".5").otherwise(text)
    mol = c.molecular.withColumns({"VAF": vaf, "DEPTH": F.when(kind == 7, "n/a").otherwise(F.col("DEPTH").cast("string"))})
    return A.entity_features(mol).select("ID", "n_mut", "vaf_mean", "vaf_max", "vaf_p90", "vaf_sum", "n_vaf_gt_30", "depth_mean", "depth_max")


@query("entity_sketches")
def q_entity_sketches(c):
    """A3 / A5 opt-in: sketches by entity and depth class, merged by entity; exact here, where an entity has few events."""
    parts = A.entity_sketches(c.molecular.withColumn("deep", F.col("DEPTH") > 30000), ["ID", "deep"])
    return A.sketch_estimates(A.merge_sketches(parts, ["ID"]))


@query("group_sum")
def q_group_sum(c):
    """A10: VAF sum per entity; entities without events get 0."""
    return A.group_sum(c.molecular.where(F.col("VAF").isNotNull()), "ID", "VAF", keys=c.clinical, out="vaf_sum")


@query("group_count")
def q_group_count(c):
    """Events per entity; entities without events get 0."""
    return A.group_count(c.molecular, "ID", keys=c.clinical, out="n_events")


@query("group_stats")
def q_group_stats(c):
    """VAF mean / std / max per entity, 0 when empty."""
    return A.group_stats(c.molecular, "ID", "VAF", keys=c.clinical)


@query("describe")
def q_describe(c):
    """count/mean/std/min/quartiles/max of the numeric columns."""
    return A.describe(_labeled_with_clinical(c), ["BM_BLAST", "HB", "PLT", "OS_YEARS"])


@query("value_counts")
def q_value_counts(c):
    """Frequency of each centre."""
    return A.value_counts(c.clinical, "CENTER")


@query("histogram_by_outcome")
def q_hist(c):
    """30 equal-width bins of time, all rows and split by outcome."""
    lab = c.labeled
    h_all = O.histogram(lab, "OS_YEARS", HIST_BINS).withColumn("OS_STATUS", F.lit(-1))
    h_by = O.histogram(lab, "OS_YEARS", HIST_BINS, by="OS_STATUS")
    return h_all.unionByName(h_by).select("OS_STATUS", "bin", "lo", "hi", F.col("count").cast("long"))


@query("median_events_per_entity")
def q_median_events(c):
    """Median number of events per entity."""
    per = c.molecular.groupBy("ID").agg(F.count(F.lit(1)).alias("n"))
    return O.exact_quantiles(per, "n", [0.5]).select(F.col("value").alias("median_events"))


@query("cluster_summary")
def q_cluster_summary(c):
    """A16 (with the centre as a fixed label): size, event rate, median and mean time."""
    return A.cluster_summary(_labeled_with_clinical(c), "CENTER")


@query("group_median_risk")
def q_group_median_risk(c):
    """Risk of a group = -median time."""
    return A.group_median_risk(_labeled_with_clinical(c), "CENTER")


@query("fold_summary")
def q_fold_summary(c):
    """Event rate and mean time per stratified fold, then mean/std over folds."""
    f = L.kfold(c.labeled, 3, seed=SEED, strata="OS_STATUS")
    per = f.groupBy("fold").agg(F.avg(F.col("OS_STATUS").cast("double")).alias("event_rate"),
                                F.avg("OS_YEARS").alias("mean_time"))
    long = per.select("fold", F.explode(F.array(
        F.struct(F.lit("event_rate").alias("metric"), F.col("event_rate").alias("value")),
        F.struct(F.lit("mean_time").alias("metric"), F.col("mean_time").alias("value")))).alias("m")) \
        .select("fold", "m.*")
    return A.fold_summary(long).select("metric", "mean", "std", F.col("n_folds").cast("long"))


# --------------------------------------------------------------------------- text functions
@query("text_flags")
def q_text_flags(c):
    """Generic karyotype flags."""
    return c.clinical.select("ID", *[v.alias(k) for k, v in cyto_features("CYTOGENETICS").items()])


@query("rule_flags")
def q_rule_flags(c):
    """thirteen targeted flags and the token count."""
    return c.clinical.select("ID", *[v.alias(k) for k, v in aml_rule_flags("CYTOGENETICS").items()])


@query("comutation")
def q_comutation(c):
    """P10: co-mutation flags for fixed gene pairs."""
    genes = sorted({g for p in COMUT_PAIRS for g in p})
    f = A.entity_features(c.molecular, gene_list=genes, effect_list=[], p90=False)
    f = P.add_comutations(f, COMUT_PAIRS)
    return f.select("ID", *[x for x in f.columns if x.startswith("COMUT__")])


# --------------------------------------------------------------------------- tables
@query("train_table")
def q_train_table(c):
    """Clinical + flags + aggregates + pivots + outcome, filled and cleaned; numeric columns in long form."""
    t, _, _ = N.train_table(c.clinical_train, c.molecular_train, c.target, TOP_GENES, TOP_EFFECTS)
    return _long(t)


@query("train_table_text")
def q_train_table_text(c):
    """The text columns of the training table, filled with "0"."""
    t, _, _ = N.train_table(c.clinical_train, c.molecular_train, c.target, TOP_GENES, TOP_EFFECTS)
    return t.select("ID", "CENTER", "CYTOGENETICS")


@query("aligned_test_table")
def q_aligned_test(c):
    """The unlabeled entities with the train lists, aligned to the train columns; numeric columns in long form."""
    t, genes, effects = N.train_table(c.clinical_train, c.molecular_train, c.target, TOP_GENES, TOP_EFFECTS)
    cols = P.feature_columns(t)
    return _long(N.scoring_table(c.clinical_unlabeled, c.molecular_unlabeled, cols, genes, effects))


@query("csv_roundtrip")
def q_csv_roundtrip(c):
    """The five inputs, a risk table and a result table written as CSV and read back by column name."""
    from ..sources import sinks, tables
    root = f"{ensure_checkpoint_dir(c.spark)}/csv-{uuid.uuid4().hex}"
    unlabeled = c.clinical_unlabeled
    parts = {"clinical_train": c.clinical_train, "clinical_test": unlabeled, "molecular_train": c.molecular_train,
             "molecular_test": c.molecular_unlabeled, "target_train": c.target}
    for name, df in parts.items():
        df.select(*reversed(df.columns)).write.option("header", True).csv(f"{root}/{name}.csv")
    back = tables.load_all(c.spark, root)
    sinks.write_risk_table(unlabeled.select("ID", F.col("HB").alias("risk_score")), f"{root}/risk.csv")
    sinks.write_results(c.clinical.groupBy("CENTER").agg(F.count(F.lit(1)).alias("n")), f"{root}/results.csv")
    header = c.spark.read.option("header", True)

    def line(name, df, value):
        total = F.sum(value.cast("double"))
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(value.isNotNull()).alias("n_values"), total.alias("total")) \
            .select(F.lit(name).alias("part"), "n_rows", "n_values", "total")

    value = {"clinical_train": "BM_BLAST", "clinical_test": "PLT", "molecular_train": "VAF", "molecular_test": "DEPTH", "target_train": "OS_YEARS"}
    out = [line(n, back[n], F.col(v)) for n, v in value.items()]
    out.append(line("target_status", back["target_train"], F.col("OS_STATUS")))
    out.append(line("risk_table", header.csv(f"{root}/risk.csv"), F.col("risk_score")))
    out.append(line("results", header.csv(f"{root}/results.csv"), F.col("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


# --------------------------------------------------------------------------- ordered / splits
@query("rank01")
def q_rank01(c):
    """Average-tie rank of HB scaled to [0, 1]."""
    return O.rank01(_labeled_with_clinical(c).select("ID", "HB"), "HB")


@query("minmax")
def q_minmax(c):
    """Min-max scaling of BM_BLAST."""
    return O.minmax_scale(c.clinical.select("ID", "BM_BLAST"), "BM_BLAST", "bm_blast_mm")


@query("quantile_strata")
def q_strata(c):
    """Event x time-tercile strata."""
    return L.make_strata(c.labeled, n_bins=3).select("ID", "stratum")


@query("stratified_split")
def q_strat_split(c):
    """L2: stratified 80/20 hold-out on the event flag."""
    return L.stratified_holdout(c.labeled, "OS_STATUS", test_size=0.2, seed=SEED).select("ID", "is_test")


@query("holdout_split")
def q_holdout(c):
    """L1: random 70/30 hold-out."""
    return L.holdout(c.labeled, test_size=0.3, seed=SEED).select("ID", "is_test")


@query("kfold")
def q_kfold(c):
    """L3 + L4 + L5: shuffled 3-fold, stratified 3-fold and (event x time bin) 3-fold ids."""
    lab = cut_lineage(L.make_strata(cut_lineage(c.labeled), n_bins=3).select("ID", "OS_STATUS", "stratum"))
    a = cut_lineage(L.kfold(lab, 3, seed=SEED, out="fold"))
    b = cut_lineage(L.kfold(a, 3, seed=SEED, strata="OS_STATUS", out="fold_event"))
    d = L.kfold(b, 3, seed=SEED, strata="stratum", out="fold_strata")
    return d.select("ID", "fold", "fold_event", "fold_strata")


@query("dense_codes")
def q_dense_codes(c):
    """dense integer code per centre."""
    return O.dense_codes(c.clinical.select("ID", "CENTER"), "CENTER", "center_code")


@query("random_baseline")
def q_random(c):
    """Uniform risk from a hash of (seed, ID)."""
    return c.clinical_unlabeled.select("ID", L.hash_unit("ID", SEED).alias("risk_score"))


# --------------------------------------------------------------------------- survival metrics
def _holdout_frames(c, cols=("HB", "BM_BLAST", "PLT")):
    """Train / evaluation parts of the labeled rows.

    The metric jobs run several small actions over these rows, so the
    lineage (fixture scans and joins) is cut once with a reliable checkpoint.
    """
    lab = _labeled_with_clinical(c).withColumn("is_test", c.is_test())
    s = cut_lineage(P.to_survival(lab).select("ID", "time", "event", "is_test", *cols))
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


@query("km_censoring")
def q_km(c):
    """Kaplan-Meier curve of the censoring distribution on the training part."""
    tr, _ = _holdout_frames(c, ())
    return S.km_censoring(tr, "time", "event")


@query("ipcw_weights")
def q_ipcw_w(c):
    """1/G(t) for test events before tau (as-of lookup of the step curve)."""
    tr, te = _holdout_frames(c, ())
    return S.ipcw_weights(tr, te, TAU, "time", "event").select("ID", "time", "event", "ipcw")


@query("ipcw_cindex")
def q_ipcw(c):
    """IPCW concordance of risk = HB on the hold-out, tau = 5."""
    tr, te = _holdout_frames(c)
    return S.ipcw_cindex(tr, te, "HB", TAU, "time", "event").select("cindex")


@query("harrell_cindex")
def q_harrell(c):
    """Harrell's concordance counts of risk = HB on the hold-out."""
    _, te = _holdout_frames(c)
    h = S.harrell_pairs(te, "HB", "time", "event")
    return h.select(*[F.col(x).cast("long").alias(x) for x in ("concordant", "discordant", "tied")], "cindex")


def _ranked_scores(c, df):
    """``df`` with r_<score> for every rank score: all scores are ranked in one long pass."""
    scores = F.array(*[F.struct(F.lit(s).alias("score"), F.coalesce(F.col(s), F.lit(0.0)).alias("__x")) for s in RANK_SCORES])
    long = cut_lineage(df.select("ID", F.explode(scores).alias("__s")).select("ID", "__s.*"))
    ranked = O.rank01(long, "__x", "rank", partition_cols=["score"])
    wide = ranked.groupBy("ID").agg(*[F.max(F.when(F.col("score") == s, F.col("rank"))).alias(f"r_{s}") for s in RANK_SCORES])
    return df.join(wide, on="ID")


def _with_best(sweep):
    """O3: marks the winner of a sweep (highest index, then lowest weight); a sweep has a row for each weight."""
    order = Window.orderBy(F.round("cindex", ROUND).desc(), "weight")
    return sweep.withColumn("is_best", F.row_number().over(order) == 1)


@query("rank_ensemble")
def q_rank_ensemble(c):
    """Mean of rank01 over three scores and over two."""
    r = _ranked_scores(c, _labeled_with_clinical(c).select("ID", *RANK_SCORES))
    a, b, d = (F.col(f"r_{s}") for s in RANK_SCORES)
    return r.select("ID", ((a + b + d) / 3.0).alias("ens3"), (0.5 * a + 0.5 * b).alias("ens2"))


@query("weight_sweep")
def q_weight_sweep(c):
    """IPCW C of w*r1 + (1-w)*(r2+r3)/2 for each weight, scored in one grouped job."""
    tr, te = _holdout_frames(c)
    r = _ranked_scores(c, te)
    ws = c.spark.createDataFrame([(float(w),) for w in SWEEP_WEIGHTS], "w double")
    a, b, d = (F.col(f"r_{s}") for s in RANK_SCORES)
    sw = r.join(F.broadcast(ws), how="cross")  # one copy per weight (7 rows)
    sw = sw.withColumn("ens", F.col("w") * a + (1 - F.col("w")) * (b + d) / 2.0).withColumnRenamed("w", "weight")
    return _with_best(S.ipcw_cindex(tr, sw, "ens", TAU, "time", "event", group_cols=["weight"]).select("weight", "cindex"))


@query("permutation_importance")
def q_perm(c):
    """Mean drop of IPCW C when a column is permuted (linear score)."""
    tr, te = _holdout_frames(c)
    base = te.select("ID", "time", "event", F.coalesce("HB", F.lit(0.0)).alias("HB"),
                     F.coalesce("PLT", F.lit(0.0)).alias("PLT"))
    score = lambda df: df.withColumn("risk", F.col("HB") - F.col("PLT") / 100.0)
    from ..plans.select import permuted_copies
    perm = permuted_copies(base, "ID", list(PERM_COLUMNS), PERM_REPEATS, SEED)
    scored = score(perm)
    s = S.ipcw_cindex(tr, scored, "risk", TAU, "time", "event", group_cols=["column", "repeat"])
    base_c = S.ipcw_cindex(tr, score(base), "risk", TAU, "time", "event").select(F.col("cindex").alias("__b"))
    d = s.join(F.broadcast(base_c), how="cross")  # one-row baseline
    return d.groupBy("column").agg(F.avg(F.col("__b") - F.col("cindex")).alias("importance"))


# --------------------------------------------------------------------------- encoders
@query("target_encode")
def q_target_encode(c):
    """Centre target encoding fitted on the training part."""
    lab = _labeled_with_clinical(c).withColumn("is_test", c.is_test())
    tr, va = E.target_encode(lab.where(~F.col("is_test")), lab.where(F.col("is_test")), "CENTER", "OS_STATUS",
                             "CENTER_TE")
    return tr.select("ID", "CENTER_TE", F.lit(False).alias("is_test")) \
        .unionByName(va.select("ID", "CENTER_TE", F.lit(True).alias("is_test")))


@query("impute_scale")
def q_impute_scale(c):
    """M2 + M4: train medians and train mean / population std applied to the test part."""
    lab = _labeled_with_clinical(c).withColumn("is_test", c.is_test())
    tr = lab.where(~F.col("is_test"))
    cols = ["BM_BLAST", "HB", "PLT"]
    med = E.fit_medians(tr, cols)
    stats = E.fit_scaler(tr, cols, med)
    return E.impute_scale(lab.where(F.col("is_test")), cols, med, stats).select("ID", *cols)


@query("onehot")
def q_onehot(c):
    """M3 + M5: most-frequent imputation and one-hot of CENTER with train categories; long form."""
    lab = _labeled_with_clinical(c).withColumn("is_test", c.is_test())
    tr = lab.where(~F.col("is_test"))
    cats = E.fit_categories(tr, "CENTER")
    mode = E.fit_modes(tr, ["CENTER"])["CENTER"]
    wide = E.onehot(c.clinical_unlabeled.select("ID", "CENTER"), "CENTER", cats, "CENTER_", fill=mode).drop("CENTER")
    return _long(wide, "int")


@query("char_ngram_tfidf")
def q_tfidf(c):
    """M6-M8: char 3-6-gram TF-IDF of the karyotype text (NULL -> "0"), 50-term vocabulary."""
    docs = c.clinical_train.select("ID", F.coalesce("CYTOGENETICS", F.lit("0")).alias("txt"))
    return X.tfidf_by_text(docs, "ID", "txt", TFIDF_VOCAB)


def registry() -> dict:
    from . import models_queries  # noqa: F401  (registers the model queries)
    return dict(REGISTRY)


# --------------------------------------------------------------------------- small report operators
# Fixed value: the challenge winner's score, the reference point of the score-gap report.
REFERENCE_SCORE = 0.7744


@query("mae")
def q_mae(c):
    """Mean absolute error of the centre mean time (fitted on train) as a time prediction."""
    lab = _labeled_with_clinical(c).withColumn("is_test", c.is_test())
    means = lab.where(~F.col("is_test")).groupBy("CENTER").agg(F.avg("OS_YEARS").alias("__pred"))
    glob = lab.where(~F.col("is_test")).agg(F.avg("OS_YEARS").alias("__g"))
    te = lab.where(F.col("is_test")).join(F.broadcast(glob), how="cross")  # one-row global mean
    te = P.lookup_with_default(te, means, "CENTER", "__pred", F.col("__g"), "__p")
    return te.agg(F.avg(F.abs(F.col("OS_YEARS") - F.col("__p"))).alias("mae"))


@query("score_range")
def q_score_range(c):
    """Row counts of the tables and splits, and the range of a score."""
    lab = _labeled_with_clinical(c).withColumn("is_test", c.is_test())
    return lab.agg(F.count(F.lit(1)).alias("n_labeled"), F.count_if(F.col("is_test")).alias("n_test"),
                   F.count_if(~F.col("is_test")).alias("n_train"), F.min("HB").alias("min_score"),
                   F.max("HB").alias("max_score"))


@query("top_results")
def q_top_results(c):
    """Centres sorted by event rate (then name), first five."""
    s = A.cluster_summary(_labeled_with_clinical(c), "CENTER")
    return s.orderBy(F.col("event_rate").desc(), F.col("CENTER").asc()).limit(5).select("CENTER", "event_rate", "n")


@query("score_gap")
def q_score_gap(c):
    """Hold-out IPCW C and its gap to the reference score."""
    tr, te = _holdout_frames(c)
    s = S.ipcw_cindex(tr, te, "HB", TAU, "time", "event")
    return s.select("cindex", (F.col("cindex") - F.lit(REFERENCE_SCORE)).alias("gap"))


@query("preview")
def q_preview(c):
    """First rows with an explicit order."""
    return c.clinical.orderBy("ID").limit(5).select("ID", "CENTER", "HB")


@query("gene_column_sums")
def q_gene_sums(c):
    """Sums of the GENE__ indicator columns of the training pivot, one row each."""
    sums = P.prefix_column_sums(_pivot(c, True), "GENE__")
    cols = [F.col(f"`{x}`").cast("long").alias(x) for x in sums.columns]
    return sums.select(F.lit(0).alias("k"), *cols).unpivot(["k"], [F.col(f"`{x}`") for x in sums.columns], "feature", "total").drop("k")


@query("minmax_pair_sweep")
def q_minmax_sweep(c):
    """IPCW C of w*mm(HB) + (1-w)*mm(PLT) per weight, one grouped job."""
    tr, te = _holdout_frames(c)
    t = O.minmax_scale(O.minmax_scale(te.withColumn("__pl", F.coalesce("PLT", F.lit(0.0))), "HB", "mm_a"),
                       "__pl", "mm_b")
    ws = c.spark.createDataFrame([(float(w),) for w in SWEEP_WEIGHTS], "weight double")
    sw = t.join(F.broadcast(ws), how="cross")  # one copy per weight (7 rows)
    sw = sw.withColumn("ens", F.col("weight") * F.col("mm_a") + (1 - F.col("weight")) * F.col("mm_b"))
    return _with_best(S.ipcw_cindex(tr, sw, "ens", TAU, "time", "event", group_cols=["weight"]).select("weight", "cindex"))


@query("cv_fixed_scores")
def q_cv_fixed(c):
    """Stratified 3-fold IPCW C of two fixed scores, censoring curve per training fold."""
    from . import select as Sel
    lab = cut_lineage(P.to_survival(_labeled_with_clinical(c)))
    models = {"HB": lambda a, b: b.withColumn("risk", F.col("HB")),
              "neg_PLT": lambda a, b: b.withColumn("risk", -F.coalesce(F.col("PLT"), F.lit(0.0)))}
    per_fold, _ = Sel.cross_validate_models(lab, models, 3, TAU, SEED, strata="OS_STATUS")
    return per_fold
