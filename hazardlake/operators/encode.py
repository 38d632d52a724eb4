"""Fit-on-train encoders (M2-M5, M10) as aggregates + projections.

Fitted state is a handful of numbers per column (medians, means, standard
deviations, category lists); it is collected once and applied as literal
column expressions, so ``transform`` is a narrow projection with no join.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import exact_quantiles, quantiles_of_counts


#: Equal-width bins of a column in which its median is looked for.
MEDIAN_BINS = 1024


def _long(df: DataFrame, values: list) -> DataFrame:
    """(column, value): the values of a row below each other, by their place in the list; NULL and NaN are left out.

    Aggregates of this form compile to a short loop, those of many columns beside each other to methods too long for the JIT compiler.
    """
    return df.select(F.posexplode(F.array(*[v.cast("double") for v in values])).alias("column", "value")) \
        .where(F.col("value").isNotNull() & ~F.isnan("value"))


def fit_medians(df: DataFrame, cols) -> dict:
    """M2: exact (interpolated) median of every column (MLlib's Imputer is approximate).

    Rows are counted by equal-width bins, and only the bins that hold the middle rows are ranked by value: what lies in bins before and
    after counts as two infinities, so few distinct values are shuffled.  Columns with infinite values are ranked whole.
    """
    cols = list(cols)
    if not cols:
        return {}
    ends = {r["column"]: (r["a"], r["b"]) for r in
            _long(df, [F.col(c) for c in cols]).groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()}
    finite = [i for i, (a, b) in ends.items() if math.isfinite(b - a)]
    got, rest = {}, [i for i in ends if i not in finite]
    if finite:
        def of(values):
            return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("column"))

        low, widths = of(ends[i][0] for i in finite), [ends[i][1] - ends[i][0] for i in finite]
        scale = of(MEDIAN_BINS / w if w > 0 and math.isfinite(MEDIAN_BINS / w) else 0.0 for w in widths)
        long = _long(df, [F.col(cols[i]) for i in finite]).select("column", "value", F.floor((F.col("value") - low) * scale).cast("double").alias("bin"))
        counts: list = [[] for _ in finite]
        for r in long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")).collect():      # at most MEDIAN_BINS + 1 a column
            counts[r["column"]].append((r["bin"], r["n"]))
        first, last = zip(*[_middle_bins(sorted(c)) for c in counts])
        inf = F.lit(float("inf"))
        inside = F.when(F.col("bin") < of(first), -inf).when(F.col("bin") > of(last), inf).otherwise(F.col("value"))
        vals = cut_lineage(long.select("column", inside.alias("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("__n")))
        got = {finite[r["column"]]: r["value"] for r in quantiles_of_counts(vals, "value", [0.5], partition_cols=["column"]).collect()}
    if rest:
        whole = exact_quantiles(_long(df, [F.col(cols[i]) for i in rest]), "value", [0.5], partition_cols=["column"])
        got |= {rest[r["column"]]: r["value"] for r in whole.collect()}
    return {c: got.get(i) for i, c in enumerate(cols)}


def _middle_bins(counts: list) -> tuple:
    """The bins of the two middle rows, of sorted (bin, rows)."""
    n, upto, found = sum(k for _, k in counts), 0, []
    for b, k in counts:
        found += [b for at in ((n - 1) // 2, n // 2) if upto <= at < upto + k]
        upto += k
    return tuple(found)


def fit_modes(df: DataFrame, cols) -> dict:
    """M3: most frequent value per column, ties to the smallest value."""
    out = {}
    for c in cols:
        r = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), F.col(c).asc()).limit(1).collect())
        out[c] = r[0][c] if r else None
    return out


def fit_scaler(df: DataFrame, cols, medians: dict | None = None) -> dict:
    """M4: mean and population std per column (after median imputation when given)."""
    medians, cols = medians or {}, list(cols)
    if not cols:
        return {}
    values = [F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double")) if c in medians else F.col(c).cast("double") for c in cols]
    long = df.select(F.posexplode(F.array(*values)).alias("column", "value")).where("value is not null")
    got = {r["column"]: (r["m"], r["s"]) for r in long.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    return {c: got.get(i, (None, None)) for i, c in enumerate(cols)}


def scaled(cols, medians: dict, stats: dict) -> dict:
    """M2 + M4 as expressions by column; a zero-variance column is centred but not scaled."""
    new = {}
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double"))
        mean, std = stats[c]
        scale = std if std not in (None, 0.0) else 1.0
        new[c] = (v - F.lit(mean or 0.0)) / F.lit(scale)
    return new


def impute_scale(df: DataFrame, cols, medians: dict, stats: dict, suffix: str = "") -> DataFrame:
    """Apply M2 + M4."""
    return df.withColumns({f"{c}{suffix}": v for c, v in scaled(cols, medians, stats).items()})


#: Categories that a column may have; a column with more is no category (target encoding has no such limit).
MOST_CATEGORIES = 10_000


def fit_categories(df: DataFrame, col: str, most: int = MOST_CATEGORIES) -> list:
    """Sorted distinct non-NULL categories; raises ValueError if there are more than ``most``."""
    found = df.where(F.col(col).isNotNull()).select(col).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"column {col} has more than {most} categories")
    return sorted(r[col] for r in found)


def onehot(df: DataFrame, col: str, categories, prefix: str | None = None, fill=None) -> DataFrame:
    """M5: one 0/1 column per train category; unseen categories are all zeros."""
    prefix = prefix if prefix is not None else f"{col}_"
    v = F.coalesce(F.col(col), F.lit(fill)) if fill is not None else F.col(col)
    return df.withColumns({f"{prefix}{c}": (v == F.lit(c)).cast("int") if c is not None else F.lit(0)
                           for c in categories}).fillna(0, subset=[f"{prefix}{c}" for c in categories])


def onehot_array(col: str, categories, fill=None) -> Column:
    """M5 as one array of 0.0 and 1.0 in the order of ``categories``: a comparison in a loop, not an expression for each category.

    A projection with many expressions compiles to one method, which beyond 8,000 bytes of code the JVM does not compile further; one
    with a loop like this is split into short methods.
    """
    v = F.coalesce(F.col(col), F.lit(fill)) if fill is not None else F.col(col)
    known = F.array(*[F.lit(c) for c in categories])
    return F.transform(known, lambda c: F.when(c == v, 1.0).otherwise(0.0)) if len(categories) else F.array().cast("array<double>")


def target_encode(train: DataFrame, other: DataFrame, col: str, target_col: str, out: str | None = None):
    """Mean of the target per category on train only; the train mean for unseen ones.

    Returns (train_encoded, other_encoded).  The category table has one row
    per category and is joined (broadcast when small enough for Spark).
    """
    out = out or f"{col}_TE"
    glob = train.agg(F.avg(F.col(target_col).cast("double")).alias("__g"))
    means = train.groupBy(col).agg(F.avg(F.col(target_col).cast("double")).alias("__m"))

    def enc(d):
        j = d.join(means, on=col, how="left").join(F.broadcast(glob), how="cross")  # glob: one row
        return j.withColumn(out, F.coalesce(F.col("__m"), F.col("__g")).cast("double")).drop("__m", "__g")
    return enc(train), enc(other)
