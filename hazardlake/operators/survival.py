"""Survival estimation and concordance scoring.

Every function takes flat columns (time double, event boolean, risk double)
and optional ``group_cols`` so that many folds / models / permutations are
scored by one Spark job.

Concordance definitions
-----------------------
A pair (i, j) is comparable when i is an event and either t_j > t_i, or
t_j == t_i and j is censored (the IPCW index), or only t_j > t_i (Harrell).
With w_i the weight of i (IPCW: 1{t_i < tau} / G(t_i)^2; Harrell: 1):

  lt  = sum_i w_i #{j comparable: r_j <  r_i - tol}
  le  = sum_i w_i #{j comparable: r_j <= r_i + tol}
  all = sum_i w_i #{j comparable}

IPCW C = (lt + le) / (2 all); Harrell C = (conc + tied/2) / (conc + disc + tied)
with conc = lt, tied = le - lt, disc = all - le (tol = 0).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordered import assign_bucket, default_buckets, prefix_sums, quantile_edges

TIED_TOL = 1e-8


# ---------------------------------------------------------------------------
# Kaplan-Meier estimate of the censoring distribution
# ---------------------------------------------------------------------------
def km_censoring(train: DataFrame, time_col="time", event_col="event", partition_cols=(),
                 n_buckets=None, edges=None) -> DataFrame:
    """G(t) = prod_{s <= t} (1 - c_s / (r_s - d_s)); events precede censorings at ties.

    Returns (partition_cols..., time, n_at_risk, n_events, n_censored, G), one
    row per distinct time.
    """
    partition_cols = list(partition_cols)
    g = (train.where(F.col(time_col).isNotNull() & F.col(event_col).isNotNull())
         .groupBy(*partition_cols, F.col(time_col).cast("double").alias("time"))
         .agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(event_col).cast("int")).alias("n_events")))
    g = g.withColumn("n_censored", F.col("__n") - F.col("n_events"))
    if edges is None:
        edges = quantile_edges(g, "time", n_buckets or default_buckets(train.sparkSession))
    r = prefix_sums(g, ["time"], ["__n"], partition_cols, descending=True, edges=edges, prefix="__risk")
    r = r.withColumn("n_at_risk", F.col("__risk__n"))
    ratio = F.when(F.col("n_censored") == 0, F.lit(0.0)).otherwise(
        F.col("n_censored") / (F.col("n_at_risk") - F.col("n_events")))
    r = r.withColumn("__ratio", ratio) \
        .withColumn("__z", (F.col("__ratio") >= 1.0).cast("long")) \
        .withColumn("__lf", F.when(F.col("__ratio") < 1.0, F.log(1.0 - F.col("__ratio"))).otherwise(F.lit(0.0)))
    c = prefix_sums(r, ["time"], ["__lf", "__z"], partition_cols, edges=edges, prefix="__cum")
    return c.select(*partition_cols, "time", F.col("n_at_risk").cast("long").alias("n_at_risk"),
                    F.col("n_events").cast("long").alias("n_events"),
                    F.col("n_censored").cast("long").alias("n_censored"),
                    F.when(F.col("__cum__z") > 0, F.lit(0.0)).otherwise(F.exp(F.col("__cum__lf"))).alias("G"))


# ---------------------------------------------------------------------------
# As-of lookup of a step function
# ---------------------------------------------------------------------------
def asof_lookup(keys: DataFrame, curve: DataFrame, key: str, value: str, default: float,
                partition_cols=(), n_buckets=None, out: str | None = None, edges=None) -> DataFrame:
    """For each (partition, key) row of ``keys`` the curve value at the largest
    curve key <= key (``default`` before the first point).

    ``keys`` should be distinct.  Both sides are cut into the same value
    ranges; a running ``last(ignorenulls)`` works inside each range and the
    last curve value of earlier ranges (a table of n_buckets rows) fills the
    gaps.  No row-level data crosses a range border.
    """
    out = out or value
    partition_cols = list(partition_cols)
    if edges is None:
        edges = quantile_edges(curve, key, n_buckets or default_buckets(curve.sparkSession))
    kq = keys.select(*partition_cols, F.col(key).cast("double").alias("__k"),
                     F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__q"))
    kc = curve.select(*partition_cols, F.col(key).cast("double").alias("__k"),
                      F.col(value).cast("double").alias("__v"), F.lit(0).alias("__q"))
    u = assign_bucket(kq.unionByName(kc), "__k", edges, "__ab")
    w = Window.partitionBy(*partition_cols, "__ab").orderBy("__k", "__q") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("__run", F.last("__v", ignorenulls=True).over(w))
    lastc = assign_bucket(kc, "__k", edges, "__ab").groupBy(*partition_cols, "__ab") \
        .agg(F.max_by("__v", "__k").alias("__lastv"))
    wc = Window.partitionBy(*partition_cols).orderBy("__ab").rowsBetween(Window.unboundedPreceding, -1)
    carry = lastc.select(*partition_cols, "__ab", F.last("__lastv", ignorenulls=True).over(wc).alias("__carry"))
    carry = F.broadcast(carry) if not partition_cols else carry  # n_buckets rows per partition
    res = u.where(F.col("__q") == 1).join(carry, on=[*partition_cols, "__ab"], how="left")
    return res.select(*partition_cols, F.col("__k").alias(key),
                      F.coalesce("__run", "__carry", F.lit(float(default))).alias(out))


# ---------------------------------------------------------------------------
# IPCW weights
# ---------------------------------------------------------------------------
def ipcw_weights(train: DataFrame, test: DataFrame, tau: float | None, time_col="time", event_col="event",
                 group_cols=(), n_buckets=None) -> DataFrame:
    """Adds ``ipcw`` = 1/G(t) for events before tau (0 otherwise) and ``w`` = ipcw^2.

    When ``group_cols`` are columns of ``train`` too, G is estimated per group
    (cross-validation folds); otherwise one curve serves every group.
    """
    group_cols = list(group_cols)
    tg = [c for c in group_cols if c in train.columns]
    edges = quantile_edges(train.select(F.col(time_col).cast("double").alias("__t")), "__t",
                           n_buckets or default_buckets(train.sparkSession))
    curve = km_censoring(train, time_col, event_col, tg, n_buckets, edges=edges)
    weighted = F.col(event_col) & (F.lit(True) if tau is None else (F.col(time_col) < F.lit(float(tau))))
    ev_times = test.where(weighted).select(*tg, F.col(time_col).cast("double").alias("time")).distinct()
    g = asof_lookup(ev_times, curve, "time", "G", 1.0, tg, n_buckets, edges=edges)
    t = test.withColumn("__t", F.col(time_col).cast("double"))
    j = t.join(g.withColumnRenamed("time", "__t"), on=[*tg, "__t"], how="left").drop("__t")
    ipcw = F.when(weighted, F.lit(1.0) / F.col("G")).otherwise(F.lit(0.0))
    return j.withColumn("ipcw", ipcw).withColumn("w", F.col("ipcw") * F.col("ipcw")).drop("G")


# ---------------------------------------------------------------------------
# B2: weighted dominance counts on a time x risk grid
# ---------------------------------------------------------------------------
def dominated_weight(pa, pb, pw, qa, qb) -> np.ndarray:
    """For every query q: sum of pw[j] over points with pa[j] > qa[q] and pb[j] < qb[q].

    O(m log^2 m): points sorted by pa (descending) make "pa > qa" a prefix;
    the prefix is split into dyadic blocks and each block is searched in a
    single sorted key array (block id, rank of pb).
    """
    pa = np.asarray(pa, dtype=float); pb = np.asarray(pb, dtype=float); pw = np.asarray(pw, dtype=float)
    qa = np.asarray(qa, dtype=float); qb = np.asarray(qb, dtype=float)
    res = np.zeros(len(qa))
    m = len(pa)
    if m == 0 or len(qa) == 0:
        return res
    order = np.argsort(-pa, kind="stable")
    na = -pa[order]; pbs = pb[order]; pws = pw[order]
    s = np.searchsorted(na, -qa, side="left")          # #points with pa > qa
    ub = np.unique(pbs)
    base = len(ub) + 1
    rp = np.searchsorted(ub, pbs, side="left").astype(np.int64)
    rq = np.searchsorted(ub, qb, side="left").astype(np.int64)  # pb < qb  <=>  rp < rq
    pos = np.arange(m, dtype=np.int64)
    for k in range(int(m).bit_length() + 1):
        sel = ((s >> k) & 1).astype(bool)
        if not sel.any():
            continue
        keys = (pos >> k) * base + rp
        o = np.argsort(keys, kind="stable")
        ks = keys[o]
        cw = np.concatenate([[0.0], np.cumsum(pws[o])])
        blk = (s[sel] >> k) - 1
        lo = np.searchsorted(ks, blk * base, side="left")
        hi = np.searchsorted(ks, blk * base + rq[sel], side="left")
        res[sel] += cw[hi] - cw[lo]
    return res


def _strip_counts(group_cols, out_fields, whole: bool):
    """Sums over the queries of one strip or cell; integers stay integers (``whole``)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iloc[0])
        pts = pdf[~pdf["is_q"]]
        qs = pdf[pdf["is_q"]]
        if len(pts) == 0 or len(qs) == 0:
            return pd.DataFrame({f: pd.Series(dtype=object) for f in out_fields})
        qv = qs["v"].to_numpy(dtype=float)
        strict = qs["strict"].to_numpy(dtype=bool)
        qx = np.where(strict, qv, np.nextafter(qv, np.inf))
        if kind == 1:       # row strip: tb_j > tb_i, risk_j < x
            pa, qa = pts["tb"].to_numpy(float), qs["tb"].to_numpy(float)
            pb, qb = pts["v"].to_numpy(float), qx
        else:               # column strip / cell: (t_j, c_j) > (t_i, 0)
            ut = np.unique(pts["time"].to_numpy(float))
            pr = np.searchsorted(ut, pts["time"].to_numpy(float))
            pa = 2.0 * pr + pts["cflag"].to_numpy(float)
            qt = qs["time"].to_numpy(float)
            qr = np.searchsorted(ut, qt, side="left")
            present = ut[np.minimum(qr, len(ut) - 1)] == qt
            qa = np.where(present, 2.0 * qr, 2.0 * qr - 0.5)
            if kind == 2:   # risk bucket strictly lower
                pb, qb = pts["eb"].to_numpy(float), qs["eb"].to_numpy(float)
            else:           # same cell: exact risk comparison
                pb, qb = pts["v"].to_numpy(float), qx
        cnt = dominated_weight(pa, pb, pts["n"].to_numpy(float), qa, qb)
        w = qs["w"].to_numpy(float)
        contrib = np.rint(w).astype(np.int64) * np.rint(cnt).astype(np.int64) if whole else w * cnt
        first = pdf.iloc[0]
        return pd.DataFrame([[first[g] for g in group_cols] + [t, contrib[k].sum()] for t, k in (("lt", strict), ("le", ~strict)) if k.any()],
                            columns=out_fields)
    return fn


#: Points of a strip; with its queries, at most two a point, a worker holds one.
POINTS_PER_BUCKET = 200_000


def grid_edges(qs) -> list:
    """Interior edges from quantiles; a repeated quantile is a hot value and gets a bucket of its own."""
    qs = [float(q) for q in qs or [] if q is not None]
    hot = {a for a, b in zip(qs, qs[1:]) if a == b}
    return sorted(set(qs) | {math.nextafter(v, math.inf) for v in hot})


def usable(rows: DataFrame) -> DataFrame:
    """Rows that can be in a pair: time, event and risk known, and no NaN."""
    t, r = F.col("time").cast("double"), F.col("risk").cast("double")
    return rows.where(t.isNotNull() & ~F.isnan(t) & r.isNotNull() & ~F.isnan(r) & F.col("event").isNotNull())


def concordance_sums(rows: DataFrame, group_cols=(), tol: float = TIED_TOL, censored_ties: bool = True,
                     n_buckets: int | None = None, whole: bool = False) -> DataFrame:
    """(group..., lt, le, all) for rows (group..., time, event, risk, w).

    ``w`` > 0 marks the weighted events (the i of a pair); every row is a
    potential j.  Rows without a time, event or risk (NULL or NaN) take no
    part.  ``whole``: weights are whole numbers and the sums exact decimals.

    ``all`` needs no risk: it is a sum over the at-risk counts by time.  For
    ``lt`` and ``le`` the points are cut into a time x risk grid whose bucket
    numbers grow with the data; prefix sums over the grid are windows over its
    rows and columns, and only strips of one bucket reach ``applyInPandas``.
    A hot time or risk is a bucket of its own and counted from the grid.
    """
    g = list(group_cols)
    number = T.LongType() if whole else T.DoubleType()
    exact_sum = (lambda c: F.sum(c.cast("decimal(38,0)"))) if whole else F.sum
    base = cut_lineage(usable(rows).select(
        *g, F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"),
        F.col("risk").cast("double").alias("risk"), F.coalesce(F.col("w").cast(number), F.lit(0).cast(number)).alias("w")))
    censored = ~F.col("event") if censored_ties else F.lit(False)
    counts = base.groupBy(*g, "time", censored.cast("int").alias("cflag"), "risk").agg(F.count(F.lit(1)).alias("n"))

    n_points = base.count()
    if n_buckets is None:
        n_buckets = max(4, math.ceil(n_points / POINTS_PER_BUCKET))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    st = counts.agg(F.percentile_approx("time", probs, 4 * n_buckets).alias("qt"),
                    F.percentile_approx("risk", probs, 4 * n_buckets).alias("qr")).first()
    t_edges, e_edges = grid_edges(st["qt"]), grid_edges(st["qr"])
    last = len(e_edges)
    pts = cut_lineage(assign_bucket(assign_bucket(counts, "time", t_edges, "tb"), "risk", e_edges, "eb"))

    # ---- all comparable pairs: at-risk counts by time
    weighted = F.when(F.col("event") & (F.col("w") > 0), F.col("w"))
    by_time = base.groupBy(*g, "time").agg(F.sum(weighted).alias("__w"), F.count(F.lit(1)).alias("__n"),
                                           F.count_if(censored).alias("__c"))
    after = prefix_sums(by_time, ["time"], ["__n"], g, descending=True, edges=t_edges, inclusive=False, prefix="__after")
    comparable = after.where(F.col("__w").isNotNull()).groupBy(*g).agg(
        exact_sum(F.col("__w") * (F.col("__after__n") + F.col("__c"))).alias("value")).select(*g, F.lit("all").alias("target"), "value")

    q0 = base.where(weighted.isNotNull()).groupBy(*g, "time", "risk").agg(F.sum("w").alias("w"))
    targets = F.array(
        F.struct(F.lit("lt").alias("target"), (F.col("risk") - F.lit(tol)).alias("x"), F.lit(True).alias("strict")),
        F.struct(F.lit("le").alias("target"), (F.col("risk") + F.lit(tol)).alias("x"), F.lit(False).alias("strict")))
    q = q0.select(*g, "time", "w", F.explode(targets).alias("__t")).select(*g, "time", "w", "__t.*")
    q = assign_bucket(assign_bucket(q, "time", t_edges, "tb"), "x", e_edges, "eb")

    # ---- the grid, dense by row, with its prefix sums
    cells = pts.groupBy(*g, "tb", "eb").agg(F.sum("n").alias("__c0"), F.sum(F.col("n") * F.col("cflag")).alias("__c1"),
                                            F.min("time").alias("t0"), F.max("time").alias("t1"),
                                            F.min("risk").alias("e0"), F.max("risk").alias("e1"))
    row_of = cells.groupBy(*g, "tb").agg((F.min("t0") == F.max("t1")).alias("hot_t"))
    col_of = cells.groupBy(*g, "eb").agg((F.min("e0") == F.max("e1")).alias("hot_e"), F.min("e0").alias("ev"))
    dense = (row_of.select(*g, "tb", "hot_t", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("eb"))
             .join(cells.select(*g, "tb", "eb", "__c0", "__c1"), on=[*g, "tb", "eb"], how="left").fillna(0, subset=["__c0", "__c1"]))
    before = Window.partitionBy(*g, "tb").orderBy("eb").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*g, "eb").orderBy(F.col("tb").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    dense = dense.withColumns({"__left": F.coalesce(F.sum("__c0").over(before), zero), "__left1": F.coalesce(F.sum("__c1").over(before), zero)})
    dense = dense.withColumns({"__corner": F.coalesce(F.sum("__left").over(above), zero), "__column": F.coalesce(F.sum("__c0").over(above), zero)})
    look = dense.join(col_of, on=[*g, "eb"], how="left").select(
        *g, "tb", "eb", "__corner", "__column", "__left1", "hot_t", F.coalesce("hot_e", F.lit(True)).alias("hot_e"), "ev")
    j = cut_lineage(q.join(look, on=[*g, "tb", "eb"], how="inner"))
    beats = F.coalesce(F.when(F.col("strict"), F.col("ev") < F.col("x")).otherwise(F.col("ev") <= F.col("x")), F.lit(False))
    whole_cells = (F.col("__corner") + F.when(F.col("hot_e") & beats, F.col("__column")).otherwise(zero)
                   + F.when(F.col("hot_t"), F.col("__left1")).otherwise(zero))
    analytic = j.groupBy(*g, "target").agg(exact_sum(F.col("w") * whole_cells).alias("value"))

    # ---- exact strips and cells
    def strips(row_strip, column_strip, cell):
        def one(cond, kind, k1, k2):
            return F.when(cond, F.struct(F.lit(kind).alias("kind"), k1.alias("k1"), k2.alias("k2")))
        none = F.lit(-1)
        return F.explode(F.filter(F.array(one(row_strip, 1, F.col("eb"), none), one(column_strip, 2, F.col("tb"), none),
                                          one(cell, 3, F.col("tb"), F.col("eb"))), lambda m: m.isNotNull())).alias("m")

    pts_m = pts.join(row_of, on=[*g, "tb"]).join(col_of, on=[*g, "eb"])
    pm = pts_m.select(*g, F.lit(False).alias("is_q"), "time", "cflag", F.col("risk").alias("v"), F.lit(True).alias("strict"),
                      "tb", "eb", "n", F.lit(None).cast(number).alias("w"),
                      strips(~F.col("hot_e"), ~F.col("hot_t"), F.lit(True)))
    qm = j.select(*g, F.lit(True).alias("is_q"), "time", F.lit(0).alias("cflag"), F.col("x").alias("v"), "strict",
                  "tb", "eb", F.lit(None).cast("long").alias("n"), "w",
                  strips(~F.col("hot_e"), ~F.col("hot_t"), F.col("ev").isNotNull()))
    members = pm.unionByName(qm).select("*", "m.kind", "m.k1", "m.k2").drop("m")
    out_fields = [*g, "target", "value"]
    gschema = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in g]
    gschema.sort(key=lambda f: g.index(f.name))
    out_schema = T.StructType([*gschema, T.StructField("target", T.StringType()), T.StructField("value", number)])
    exact = members.groupBy(*g, "kind", "k1", "k2").applyInPandas(_strip_counts(g, out_fields, whole), out_schema)

    parts = comparable.unionByName(analytic).unionByName(exact.withColumn("value", F.col("value").cast("decimal(38,0)" if whole else "double")))
    none = F.lit(0).cast("decimal(38,0)" if whole else "double")
    return parts.groupBy(*g).agg(*[F.coalesce(F.sum(F.when(F.col("target") == t, F.col("value"))), none)
                                   .cast("decimal(38,0)" if whole else "double").alias(t) for t in ("lt", "le", "all")])


def concordance_sums_pairs(rows: DataFrame, group_cols=(), tol: float = TIED_TOL, censored_ties=True) -> DataFrame:
    """The same sums by an explicit pair join — for small inputs and tests only."""
    g = list(group_cols)
    i = rows.where(F.col("event") & (F.col("w") > 0)).alias("i")
    j = rows.alias("j")
    cond = [F.col(f"i.{c}") == F.col(f"j.{c}") for c in g]
    comp = F.col("j.time") > F.col("i.time")
    if censored_ties:
        comp = comp | ((F.col("j.time") == F.col("i.time")) & ~F.col("j.event"))
    p = i.join(j, on=[*cond, comp], how="inner")
    return p.groupBy(*[F.col(f"i.{c}").alias(c) for c in g]).agg(
        F.sum(F.col("i.w") * (F.col("j.risk") < F.col("i.risk") - tol).cast("double")).alias("lt"),
        F.sum(F.col("i.w") * (F.col("j.risk") <= F.col("i.risk") + tol).cast("double")).alias("le"),
        F.sum(F.col("i.w")).alias("all"))


def _sums(rows, group_cols, tol, censored_ties, n_buckets, whole=False):
    """Sums for every group of ``rows``; a group without comparable pairs gets zeros."""
    g = list(group_cols)
    s = concordance_sums(rows, g, tol, censored_ties, n_buckets, whole)
    keys = rows.select(*g).distinct() if g else rows.sparkSession.range(1).select()
    out = keys.join(s, on=g, how="left") if g else keys.join(s, how="left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(s.schema[c].dataType)) for c in ("lt", "le", "all")})


# ---------------------------------------------------------------------------
# IPCW concordance index (Uno et al. 2011), truncated at tau
# ---------------------------------------------------------------------------
def ipcw_cindex(train: DataFrame, test: DataFrame, risk_col: str, tau: float | None = 7.0, time_col="time",
                event_col="event", group_cols=(), tol=TIED_TOL, n_buckets=None) -> DataFrame:
    """(group..., cindex, concordant_w, comparable_w).  ``cindex`` is NULL without comparable pairs."""
    g = list(group_cols)
    w = ipcw_weights(train, test, tau, time_col, event_col, g, n_buckets)
    rows = w.select(*g, F.col(time_col).alias("time"), F.col(event_col).alias("event"),
                    F.col(risk_col).alias("risk"), "w")
    s = _sums(rows, g, tol, True, n_buckets)
    num = 0.5 * (F.col("lt") + F.col("le"))
    return s.select(*g, F.when(F.col("all") > 0, num / F.col("all")).alias("cindex"),
                    num.alias("concordant_w"), F.col("all").alias("comparable_w"))


# ---------------------------------------------------------------------------
# Harrell's concordance (strictly ordered times, exact risk ties)
# ---------------------------------------------------------------------------
def harrell_pairs(df: DataFrame, risk_col: str, time_col="time", event_col="event", group_cols=(),
                  n_buckets=None) -> DataFrame:
    """(group..., concordant, discordant, tied, cindex); cindex 0.5 without pairs."""
    g = list(group_cols)
    rows = df.select(*g, F.col(time_col).alias("time"), F.col(event_col).cast("boolean").alias("event"),
                     F.col(risk_col).alias("risk"),
                     F.when(F.col(event_col).cast("boolean"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("w"))
    s = _sums(rows, g, 0.0, False, n_buckets, whole=True)
    kind = "decimal(38,0)"
    conc = F.col("lt").cast(kind)
    tied = (F.col("le") - F.col("lt")).cast(kind)
    disc = (F.col("all") - F.col("le")).cast(kind)
    out = s.select(*g, conc.alias("concordant"), disc.alias("discordant"), tied.alias("tied"))
    tot = F.col("concordant") + F.col("discordant") + F.col("tied")
    return out.withColumn("cindex", F.when(tot == 0, F.lit(0.5)).otherwise(
        (F.col("concordant").cast("double") + 0.5 * F.col("tied").cast("double")) / tot.cast("double")))
