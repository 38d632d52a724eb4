"""Per-entity and per-group aggregates.

The event table is reduced to one row per entity with a single ``groupBy``:
numeric aggregates and the top-k indicator pivots are conditional aggregates
of the same pass (one shuffle, map-side partial aggregation), instead of one
aggregate and two pivots joined together.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from .ordered import exact_quantiles

ENTITY_NUMERIC = ["n_mut", "n_unique_genes", "n_unique_effects", "vaf_mean", "vaf_std", "vaf_max", "vaf_p90",
                  "vaf_sum", "n_vaf_gt_30", "n_vaf_lt_10", "depth_mean", "depth_max"]


def _numeric(df: DataFrame, col: str):
    """Lenient coercion only for text columns; numeric columns just lose NaN."""
    from pyspark.sql import types as T
    dt = df.schema[col].dataType
    if isinstance(dt, T.NumericType):
        c = F.col(col).cast("double")
        return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
    return to_number(col)


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """O1: the k most frequent non-NULL values, ordered by (count desc, value asc)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()).limit(k))


def top_list(df: DataFrame, col: str, k: int) -> list:
    """The top-k values as a Python list (k strings reach the driver)."""
    return [r[col] for r in top_values(df, col, k).collect()]


#: Values that one mask of an entity tells.
MASK_BITS = 62


def masks(col: str, values, prefix: str):
    """The indicators of A8/A9 as few aggregates: ([one bit mask per MASK_BITS values], {column: its bit of the mask})."""
    aggs, bits = [], {}
    for start in range(0, len(values), MASK_BITS):
        mask, hit = f"__{prefix}{start}", F.lit(None).cast("long")
        for i, v in reversed(list(enumerate(values[start:start + MASK_BITS]))):
            hit = F.when(F.col(col) == F.lit(v), F.lit(1 << i).cast("long")).otherwise(hit)
            bits[f"{prefix}{v}"] = F.coalesce(F.shiftright(F.col(mask), i).bitwiseAND(F.lit(1)), F.lit(0)).cast("int")
        aggs.append(F.bit_or(hit).alias(mask))
    return aggs, {f"{prefix}{v}": bits[f"{prefix}{v}"] for v in values}


def indicator_aggs(col: str, values, prefix: str, binary: bool = True) -> list:
    """One conditional aggregate per listed value (a pivot with a fixed list)."""
    out = []
    for v in values:
        hit = F.col(col) == F.lit(v)
        agg = F.max(F.when(hit, 1).otherwise(0)) if binary else F.sum(F.when(hit, 1).otherwise(0))
        out.append(F.coalesce(agg, F.lit(0)).cast("int" if binary else "long").alias(f"{prefix}{v}"))
    return out


#: Rows of an entity beyond which its quantile comes from ranges of values instead of one aggregation buffer.
HOT_ROWS = 100_000


def small_percentile(values, p: float):
    """The exact percentile of an array of few values, interpolated as ``percentile`` does; NULL if it is empty.

    ``percentile`` itself generates code whenever it packs a group's buffer, which is most of the time of small groups.
    """
    at = F.lit(float(p)) * (F.size(values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(values, low), F.get(values, high)
    return F.when(F.size(values) > 0, F.when(a == b, a).otherwise((high - at) * a + (at - low) * b))


def _p90(m: DataFrame, id_col: str, hot_rows: int):
    """(rows with ``__cool``: the value unless its entity is hot, hot entities' exact 0.9 quantiles or None)."""
    hot = m.groupBy(id_col).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows).select(id_col)
    if not hot.take(1):
        return m.withColumn("__cool", F.col("__vaf")), None
    few = hot.limit(hot_rows + 1).count() <= hot_rows
    marked = m.join(F.broadcast(hot.withColumn("__hot", F.lit(1))) if few else hot.withColumn("__hot", F.lit(1)), on=id_col, how="left")
    found = exact_quantiles(marked.where("__hot = 1").select(id_col, "__vaf"), "__vaf", [0.9], partition_cols=[id_col])
    return marked.withColumn("__cool", F.when(F.col("__hot").isNull(), F.col("__vaf"))).drop("__hot"), \
        found.select(id_col, F.col("value").alias("__p90"))


def entity_features(mol: DataFrame, id_col="ID", gene_col="GENE", effect_col="EFFECT", vaf_col="VAF",
                    depth_col="DEPTH", gene_list=None, effect_list=None, binary=True, p90=True, hot_rows=HOT_ROWS) -> DataFrame:
    """A1: one row per entity: 12 aggregates + GENE__/EFFECT__ indicators, NULLs -> 0, in one groupBy.

    VAF/DEPTH are coerced leniently (text, NaN -> NULL) before aggregation.
    ``vaf_std`` is the sample deviation, 0 for one-row entities; ``vaf_p90``
    is exact with linear interpolation: an aggregate of the same groupBy, but for entities of more than ``hot_rows``
    rows, whose values are never held together.  Without ``p90`` the column is left out, and the pass that looks for such entities.
    Where there are none, the rows are dealt by entity before they are aggregated: they are narrower than the aggregates.
    """
    m = mol.withColumns({"__vaf": _numeric(mol, vaf_col), "__depth": _numeric(mol, depth_col)})
    m = m.select(id_col, *dict.fromkeys([gene_col, effect_col]), "__vaf", "__depth")
    hot = None
    if p90:
        m, hot = _p90(m, id_col, hot_rows)
        m = m.repartition(id_col) if hot is None else m
    aggs = [
        F.count(F.lit(1)).alias("n_mut"),
        # distinct values per entity are few (a gene / effect vocabulary): a set per group, no Expand
        F.size(F.collect_set(gene_col)).cast("long").alias("n_unique_genes"),
        F.size(F.collect_set(effect_col)).cast("long").alias("n_unique_effects"),
        F.avg("__vaf").alias("vaf_mean"),
        F.stddev_samp("__vaf").alias("vaf_std"),
        F.max("__vaf").alias("vaf_max"),
        *([F.sort_array(F.collect_list("__cool")).alias("__values")] if p90 else []),
        F.sum("__vaf").alias("vaf_sum"),
        F.count_if(F.col("__vaf") > 0.30).alias("n_vaf_gt_30"),
        F.count_if(F.col("__vaf") < 0.10).alias("n_vaf_lt_10"),
        F.avg("__depth").alias("depth_mean"),
        F.max("__depth").alias("depth_max"),
    ]
    listed = {"GENE__": (gene_col, list(dict.fromkeys(gene_list or []))), "EFFECT__": (effect_col, list(dict.fromkeys(effect_list or [])))}
    names, bits = [], {}
    for prefix, (col, values) in listed.items():
        found, of_mask = masks(col, values, prefix) if binary else (indicator_aggs(col, values, prefix, False), {})
        aggs, names, bits = aggs + found, names + [f"{prefix}{v}" for v in values], bits | of_mask
    out = m.groupBy(id_col).agg(*aggs)
    p90_of = {"vaf_p90": small_percentile(F.col("__values"), 0.9)} if p90 else {}
    out = out.select(id_col, *[(p90_of | bits)[c].alias(c) if c in p90_of or c in bits else F.col(f"`{c}`") for c in
                               [c for c in ENTITY_NUMERIC if p90 or c != "vaf_p90"] + names])
    if hot is not None:
        out = out.join(hot, on=id_col, how="left").withColumn("vaf_p90", F.coalesce("vaf_p90", "__p90")).drop("__p90")
    fills = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in
             ["vaf_mean", "vaf_std", "vaf_max", "vaf_p90", "vaf_sum", "depth_mean", "depth_max"] if p90 or c != "vaf_p90"}
    return out.withColumns(fills)


def entity_sketches(mol: DataFrame, by, gene_col="GENE", effect_col="EFFECT", vaf_col="VAF", lg_k=12, k=200) -> DataFrame:
    """A3 / A5 opt-in: mergeable sketches by ``by`` (an entity, and perhaps a day or source).

    HyperLogLog sketches of the distinct genes and effects (standard error about 1.04 / sqrt(2^lg_k), 1.6 %) and a KLL sketch
    of VAF (rank error about 1.3 % at k = 200, exact up to about k values).  Tables of sketches are kept, appended to
    and merged by ``merge_sketches``, without the events.
    """
    m = mol.withColumn("__vaf", _numeric(mol, vaf_col))
    return m.groupBy(*by).agg(F.hll_sketch_agg(gene_col, lg_k).alias("genes_hll"), F.hll_sketch_agg(effect_col, lg_k).alias("effects_hll"),
                              F.kll_sketch_agg_double("__vaf", k).alias("vaf_kll"), F.count(F.lit(1)).alias("n_mut"), F.count("__vaf").alias("n_vaf"))


def merge_sketches(sketches: DataFrame, by) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(
        F.hll_union_agg("genes_hll").alias("genes_hll"), F.hll_union_agg("effects_hll").alias("effects_hll"),
        F.kll_merge_agg_double("vaf_kll").alias("vaf_kll"), F.sum("n_mut").alias("n_mut"), F.sum("n_vaf").alias("n_vaf"))


def sketch_estimates(sketches: DataFrame) -> DataFrame:
    """(..., n_mut, n_unique_genes, n_unique_effects, vaf_p90): estimates; a group without a VAF has 0."""
    keep = [c for c in sketches.columns if c not in ("genes_hll", "effects_hll", "vaf_kll", "n_vaf")]
    p90 = F.when(F.col("n_vaf") > 0, F.kll_sketch_get_quantile_double("vaf_kll", F.lit(0.9)))
    return sketches.select(*keep, F.hll_sketch_estimate("genes_hll").alias("n_unique_genes"),
                           F.hll_sketch_estimate("effects_hll").alias("n_unique_effects"), F.coalesce(p90, F.lit(0.0)).alias("vaf_p90"))


def group_sum(df: DataFrame, key: str, value: str, keys: DataFrame | None = None, out="sum") -> DataFrame:
    """A10: sum per key; keys listed in ``keys`` without rows get 0."""
    s = df.groupBy(key).agg(F.sum(value).alias(out))
    if keys is None:
        return s
    return keys.select(key).distinct().join(s, on=key, how="left").fillna({out: 0})


def group_count(df: DataFrame, key: str, keys: DataFrame | None = None, out="count") -> DataFrame:
    """Rows per key; listed keys without rows get 0."""
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    if keys is None:
        return s
    return keys.select(key).distinct().join(s, on=key, how="left").fillna({out: 0})


def group_stats(df: DataFrame, key: str, value: str, keys: DataFrame | None = None) -> DataFrame:
    """Mean / sample std / max per key, NULL/NaN skipped, 0 when nothing is left."""
    v = _numeric(df, value)
    s = df.groupBy(key).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"))
    if keys is not None:
        s = keys.select(key).distinct().join(s, on=key, how="left")
    return s.fillna({"mean": 0.0, "std": 0.0, "max": 0.0})


def validate(clinical: DataFrame, target: DataFrame, id_col="ID", time_col="OS_YEARS",
             status_col="OS_STATUS") -> DataFrame:
    """Duplicates, entities without a target, missing outcome values, event and censoring rates."""
    c = clinical.agg(F.count(F.lit(1)).alias("n_clinical"), F.countDistinct(id_col).alias("n_clinical_ids"))
    t = target.agg(F.count(F.lit(1)).alias("n_target"), F.countDistinct(id_col).alias("n_target_ids"),
                   F.count_if(F.col(time_col).isNull()).alias("n_missing_time"),
                   F.count_if(F.col(status_col).isNull()).alias("n_missing_status"),
                   F.avg(F.col(status_col).cast("double")).alias("event_rate"))
    missing = clinical.select(id_col).distinct().join(target.select(id_col), on=id_col, how="left_anti") \
        .agg(F.count(F.lit(1)).alias("n_without_target"))
    out = c.join(t, how="cross").join(missing, how="cross")  # three one-row aggregates
    return out.select(
        F.col("n_clinical").cast("long"), F.col("n_clinical_ids").cast("long"),
        (F.col("n_clinical") - F.col("n_clinical_ids")).cast("long").alias("n_duplicate_clinical"),
        F.col("n_target").cast("long"), (F.col("n_target") - F.col("n_target_ids")).cast("long").alias("n_duplicate_target"),
        F.col("n_without_target").cast("long"), F.col("n_missing_time").cast("long"),
        F.col("n_missing_status").cast("long"), "event_rate", (1.0 - F.col("event_rate")).alias("censoring_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-NULL value, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()))


def describe(df: DataFrame, cols) -> DataFrame:
    """count/mean/std/min/25%/50%/75%/max per column (exact quartiles), long form.

    The columns are unpivoted once, so all columns share one aggregation and
    one ordered pass for the quartiles.
    """
    cols = list(cols)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                        for c in cols])).alias("kv")).select("kv.*")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    base = long.groupBy("column").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], partition_cols=["column"])
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                   for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(qw, on="column", how="left").select("column", F.col("count").cast("long"), "mean", "std",
                                                          "min", "p25", "p50", "p75", "max")


def _medians(df: DataFrame, label_col: str, value_col: str, out: str) -> DataFrame:
    return exact_quantiles(df, value_col, [0.5], partition_cols=[label_col]).select(label_col, F.col("value").alias(out))


def cluster_summary(df: DataFrame, label_col: str, time_col="OS_YEARS", event_col="OS_STATUS") -> DataFrame:
    """Size, event rate, median and mean time per cluster."""
    base = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(event_col).cast("double")).alias("event_rate"),
                                     F.avg(F.col(time_col)).alias("mean_time"))
    return base.join(_medians(df, label_col, time_col, "median_time"), on=label_col, how="left").select(
        label_col, "n", "event_rate", "median_time", "mean_time")


def group_median_risk(df: DataFrame, label_col: str, time_col="OS_YEARS", out="risk") -> DataFrame:
    """Risk of a group = minus its median time."""
    return _medians(df, label_col, time_col, "__m").select(label_col, (-F.col("__m")).alias(out))


def fold_summary(results: DataFrame, metric_col="metric", value_col="value") -> DataFrame:
    """Mean and sample std per metric over folds (std NULL for one fold)."""
    return results.groupBy(metric_col).agg(F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("std"),
                                           F.count(F.lit(1)).alias("n_folds"))
