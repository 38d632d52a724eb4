"""Deterministic splits and folds.

numpy's shuffles cannot be replayed, so every split is a function of
(seed, ID): a 32-bit number from md5, which DuckDB and Spark compute alike.
Positions within a stratum come from ``prefix_sums`` (value ranges of the
hash), never from a window over a whole stratum.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import prefix_sums, quantile_bins


def hash_u32(id_col, seed: int = 42) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_unit(id_col, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from (seed, ID)."""
    return hash_u32(id_col, seed) / F.lit(4294967296.0)


def holdout(df: DataFrame, id_col="ID", test_size=0.3, seed=42, out="is_test") -> DataFrame:
    """L1: random hold-out; a row is test when its hash falls below ``test_size``."""
    return df.withColumn(out, hash_unit(id_col, seed) < F.lit(float(test_size)))


def stratum_positions(df: DataFrame, id_col="ID", strata=(), seed=42, out="pos") -> DataFrame:
    """1-based position of each row in hash order within its stratum, plus the stratum size."""
    strata = [strata] if isinstance(strata, str) else list(strata)
    h = df.withColumn("__h", hash_u32(id_col, seed)).withColumn("__one", F.lit(1))
    p = prefix_sums(h, ["__h", id_col], ["__one"], partition_cols=strata, prefix="__pos")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n_stratum"))
    p = p.join(F.broadcast(sizes), on=strata, how="inner") if strata else p.join(F.broadcast(sizes), how="cross")
    return p.withColumnRenamed("__pos__one", out).drop("__h", "__one")


def stratified_holdout(df: DataFrame, strata, id_col="ID", test_size=0.2, seed=42, out="is_test") -> DataFrame:
    """L2: the first ceil(test_size * n_s) rows of each stratum (hash order) are test."""
    p = stratum_positions(df, id_col, strata, seed, "__p")
    return p.withColumn(out, F.col("__p") <= F.ceil(F.col("__n_stratum") * F.lit(float(test_size)))) \
        .drop("__p", "__n_stratum")


def kfold(df: DataFrame, k: int, id_col="ID", seed=42, strata=(), out="fold") -> DataFrame:
    """L3 (no strata) / L4 (strata): fold = (position - 1) mod k, balanced within each stratum."""
    p = stratum_positions(df, id_col, strata, seed, "__p")
    return p.withColumn(out, ((F.col("__p") - 1) % k).cast("int")).drop("__p", "__n_stratum")


def make_strata(df: DataFrame, time_col="OS_YEARS", status_col="OS_STATUS", n_bins=3, out="stratum") -> DataFrame:
    """L5: '<event>_<time quantile bin>' labels (qcut on exact quantiles, duplicate edges dropped)."""
    b = quantile_bins(df, time_col, n_bins, "__tbin")
    return b.withColumn(out, F.concat_ws("_", F.col(status_col).cast("int").cast("string"),
                                         F.col("__tbin").cast("string"))).drop("__tbin")


def poisson_weight(id_col, seed: int, tree, lam: float = 1.0) -> Column:
    """Bootstrap multiplicity ~ Poisson(lam) from a hash of (seed, tree, ID).

    Inverse CDF on a hash uniform: the same row gets the same weight when a
    stage is recomputed after an executor loss.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    t = F.lit(tree) if not isinstance(tree, Column) else tree
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), t.cast("string"), c.cast("string"))), 1, 8),
               16, 10).cast("bigint") / F.lit(4294967296.0)
    cdf, p, k, expr = 0.0, math.exp(-lam), 0, None
    while True:                     # until no hash value lies beyond
        cdf += p
        cond = u < F.lit(cdf)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
        p, k = p * lam / (k + 1), k + 1
        if 1.0 - cdf < 2.0 ** -33 and k > lam:
            return expr.otherwise(F.lit(k)).cast("double")
