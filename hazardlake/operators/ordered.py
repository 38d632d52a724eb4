"""Globally ordered computations without a single-partition window (B1).

A ``Window.orderBy`` with no ``partitionBy`` moves every row into one task.
Instead the (already collapsed, one row per key) input is cut into value
ranges whose edges come from ``approxQuantile``; a running window works inside
each range and the per-range totals, a table of at most ``n_buckets`` rows per
group, supply the offsets.  Ranges are cut by value, so equal keys never
straddle two ranges, and a hot key is a single row after the collapse.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, small: DataFrame, keys=()) -> DataFrame:
    """Attach the columns of a small summary table.

    With ``keys`` it is an equi-join on them; without, ``small`` is a summary
    with a fixed, tiny row count (one row of global aggregates, or a list of
    parameters) that is broadcast to every row.
    """
    keys = list(keys)
    if keys:
        return df.join(small, on=keys, how="inner")
    return df.join(F.broadcast(small), how="cross")


def default_buckets(spark) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def _is_numeric(df: DataFrame, col: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[col].dataType, T.NumericType)


def quantile_edges(df: DataFrame, col: str, n_buckets: int, rel_err: float | None = None) -> list:
    """Distinct, sorted interior edges for ``n_buckets`` equi-depth ranges.

    Numeric keys use ``approxQuantile``; other orderable keys (strings) use
    the sorted values of a bounded sample (about 64 rows per range).
    """
    if n_buckets <= 1:
        return []
    if not _is_numeric(df, col):
        n = df.count()
        want = 64 * n_buckets
        frac = min(1.0, want / max(n, 1))
        vals = sorted(r[0] for r in df.select(col).sample(False, frac, 7).where(F.col(col).isNotNull()).collect())
        if not vals:
            return []
        picks = [vals[min(len(vals) - 1, (i * len(vals)) // n_buckets)] for i in range(1, n_buckets)]
        return sorted(set(picks))
    rel_err = rel_err if rel_err is not None else 1.0 / (4 * n_buckets)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.select(F.col(col).cast("double").alias(col)).approxQuantile(col, probs, rel_err)
    return sorted({float(q) for q in qs if q is not None and not math.isnan(q) and not math.isinf(q)})


def assign_bucket(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    """Bucket id in ``[0, len(edges)]`` by binary search over ``edges`` (JVM side).

    Ranges are ``[e_k, e_k+1)``; +inf lands in the last range.
    """
    if not edges:
        return df.withColumn(out, F.lit(0))
    if not isinstance(edges[0], (int, float)):
        expr = F.lit(0)
        for e in edges:
            expr = expr + (F.col(col) >= F.lit(e)).cast("int")
        return df.withColumn(out, expr.cast("int"))
    tmp = f"__bk_in_{out}"
    b = Bucketizer(splits=[-math.inf] + list(edges) + [math.inf], inputCol=tmp, outputCol=f"__bk_out_{out}",
                   handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    return res.withColumn(out, F.col(f"__bk_out_{out}").cast("int")).drop(tmp, f"__bk_out_{out}")


def prefix_sums(df: DataFrame, order_cols, sum_cols, partition_cols=(), descending=False,
                n_buckets: int | None = None, edges: list[float] | None = None,
                inclusive=True, prefix="cum_") -> DataFrame:
    """Running sums of ``sum_cols`` in the order of ``order_cols`` (per partition).

    ``df`` must hold one row per (partition_cols, order_cols) key.  Adds
    ``{prefix}{c}``: the sum over keys before (and, if ``inclusive``, at) the row.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    sum_cols = [sum_cols] if isinstance(sum_cols, str) else list(sum_cols)
    partition_cols = list(partition_cols)
    spark = df.sparkSession
    if edges is None:
        edges = quantile_edges(df, order_cols[0], n_buckets or default_buckets(spark))
    nb = len(edges)
    b = assign_bucket(df, order_cols[0], edges, "__rb")
    if descending:
        b = b.withColumn("__rb", F.lit(nb) - F.col("__rb"))
    okeys = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    frame = (Window.unboundedPreceding, Window.currentRow) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy(*partition_cols, "__rb").orderBy(*okeys).rowsBetween(*frame)
    inner = b.withColumns({f"__w_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sum_cols})
    totals = b.groupBy(*partition_cols, "__rb").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    wt = Window.partitionBy(*partition_cols).orderBy("__rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition_cols, "__rb",
                            *[F.coalesce(F.sum(f"__t_{c}").over(wt), F.lit(0)).alias(f"__o_{c}") for c in sum_cols])
    # offsets hold at most n_buckets rows per partition key
    if not partition_cols:
        offsets = F.broadcast(offsets)
    out = inner.join(offsets, on=[*partition_cols, "__rb"], how="left")
    return out.withColumns({f"{prefix}{c}": F.col(f"__w_{c}") + F.coalesce(F.col(f"__o_{c}"), F.lit(0))
                            for c in sum_cols}).drop("__rb", *[f"__w_{c}" for c in sum_cols],
                                                     *[f"__o_{c}" for c in sum_cols])


def rank01(df: DataFrame, score_col: str, out: str = "rank01", partition_cols=(), n_buckets=None) -> DataFrame:
    """Average-tie rank scaled to [0, 1]; a single row gets 0.

    Collapses to distinct scores (a hot score is one row), ranks them with
    ``prefix_sums`` and joins the rank back on the score.
    """
    partition_cols = list(partition_cols)
    counts = df.groupBy(*partition_cols, score_col).agg(F.count(F.lit(1)).alias("__n"))
    ranked = prefix_sums(counts, [score_col], ["__n"], partition_cols, inclusive=False, prefix="__before_",
                         n_buckets=n_buckets)
    totals = df.groupBy(*partition_cols).agg(F.count(F.lit(1)).alias("__total"))
    ranked = attach(ranked, totals, partition_cols)
    ranked = ranked.withColumn(
        out, F.when(F.col("__total") <= 1, F.lit(0.0)).otherwise(
            (F.col("__before___n") + (F.col("__n") + 1) / 2.0 - 1.0) / (F.col("__total") - 1.0)))
    return df.join(ranked.select(*partition_cols, score_col, out), on=[*partition_cols, score_col], how="left")


def minmax_scale(df: DataFrame, col: str, out: str | None = None, partition_cols=()) -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0."""
    out = out or f"{col}_mm"
    partition_cols = list(partition_cols)
    stats = df.groupBy(*partition_cols).agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    j = attach(df, stats, partition_cols)
    rng = F.col("__mx") - F.col("__mn")
    return j.withColumn(out, F.when(rng == 0, F.lit(0.0)).otherwise((F.col(col) - F.col("__mn")) / rng)) \
            .drop("__mn", "__mx")


def exact_quantiles(df: DataFrame, col: str, probs, partition_cols=(), n_buckets=None) -> DataFrame:
    """Exact linearly interpolated quantiles (numpy/pandas default) at scale.

    Returns (partition_cols..., p, value).  Distinct values with counts are
    ranked by ``prefix_sums`` and meet their partition's total by an equi-join;
    the two order statistics around p·(n-1) are conditional aggregates, so no
    partition's values are ever held together.
    """
    vals = df.where(F.col(col).isNotNull()).groupBy(*partition_cols, col).agg(F.count(F.lit(1)).alias("__n"))
    return quantiles_of_counts(vals, col, probs, partition_cols, n_buckets)


def quantiles_of_counts(vals: DataFrame, col: str, probs, partition_cols=(), n_buckets=None) -> DataFrame:
    """``exact_quantiles`` of distinct values with their numbers of rows (``__n``)."""
    partition_cols = list(partition_cols)
    ranked = prefix_sums(vals, [col], ["__n"], partition_cols, inclusive=False, prefix="__lo_",
                         n_buckets=n_buckets)
    n = vals.groupBy(*partition_cols).agg(F.sum("__n").alias("__total"))
    r = attach(ranked, n, partition_cols)
    first, after = F.col("__lo___n"), F.col("__lo___n") + F.col("__n")      # rows [first, after) hold this value

    def at(row):
        return F.max(F.when((row >= first) & (row < after), F.col(col).cast("double")))

    aggs = [F.first("__total").alias("__total")]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        aggs += [at(F.floor(pos)).alias(f"__a{i}"), at(F.ceil(pos)).alias(f"__b{i}")]
    found = r.groupBy(*partition_cols).agg(*aggs)
    rows = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        value = F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (pos - F.floor(pos))
        rows.append(F.struct(F.lit(float(p)).alias("p"), value.alias("value")))
    out = found.select(*partition_cols, F.explode(F.array(*rows)).alias("__q")).select(*partition_cols, "__q.*")
    return out.where(F.col("value").isNotNull())


def histogram(df: DataFrame, col: str, bins: int, by=None) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), long form.

    Returns (by?, bin, lo, hi, count).  ``width_bucket`` is not used: it puts
    the maximum in an extra bin.
    """
    stats = df.agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    j = attach(df.where(F.col(col).isNotNull()), stats)
    rng = F.col("__mx") - F.col("__mn")
    b = F.when(rng == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("__mn")) * (F.lit(float(bins)) / rng)), F.lit(bins - 1))).cast("int")
    keys = ([by] if isinstance(by, str) else list(by or []))
    g = j.withColumn("bin", b).groupBy(*keys, "bin", "__mn", "__mx").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("__mx") - F.col("__mn")) / F.lit(float(bins))
    return g.select(*keys, "bin", (F.col("__mn") + F.col("bin") * width).alias("lo"),
                    (F.col("__mn") + (F.col("bin") + 1) * width).alias("hi"), "count")


def quantile_bins(df: DataFrame, col: str, n_bins: int, out: str = "qbin") -> DataFrame:
    """``qcut(labels=False, duplicates='drop')`` — right-closed bins on exact quantile edges."""
    probs = [i / n_bins for i in range(1, n_bins)]
    edges_df = exact_quantiles(df, col, [0.0] + probs + [1.0])
    rows = sorted(edges_df.collect(), key=lambda r: r["p"])  # n_bins + 1 numbers
    uniq = sorted({float(r["value"]) for r in rows})
    inner = uniq[1:-1]
    expr = F.lit(0)
    for e in inner:
        expr = expr + (F.col(col) > F.lit(e)).cast("int")
    return df.withColumn(out, expr.cast("int"))


def dense_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """dense integer code per distinct value, in value order (0-based)."""
    d = df.where(F.col(col).isNotNull()).select(col).distinct().withColumn("__one", F.lit(1))
    ranked = prefix_sums(d, [col], ["__one"], inclusive=False, prefix="__c_")
    return df.join(ranked.select(col, F.col("__c___one").cast("long").alias(out)), on=col, how="left")
