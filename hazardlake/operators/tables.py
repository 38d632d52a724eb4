"""Projections, fills, target cleaning and joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_COL, TIME_COL, STATUS_COL = "ID", "OS_YEARS", "OS_STATUS"

# Gene pairs whose joint presence becomes a co-mutation flag.
COMUTATION_PAIRS = [
    ("TP53", "RUNX1"),
    ("ASXL1", "TET2"),
    ("DNMT3A", "TET2"),
    ("SRSF2", "TET2"),
    ("TP53", "ASXL1"),
    ("NPM1", "FLT3"),
    ("RUNX1", "ASXL1"),
]


def feature_columns(df: DataFrame, exclude=None, id_col=ID_COL, time_col=TIME_COL, status_col=STATUS_COL) -> list:
    """Every column but the ID, the outcome and ``exclude``."""
    ex = {id_col, time_col, status_col, *(exclude or [])}
    return [c for c in df.columns if c not in ex]


def align_columns(df: DataFrame, cols) -> DataFrame:
    """Exactly ``cols`` in that order; missing ones are 0, extra ones dropped."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(0).alias(c) for c in cols])


def clean_target(df: DataFrame, time_col=TIME_COL, status_col=STATUS_COL) -> DataFrame:
    """Drop rows with a missing outcome, cast time to double and status to int."""
    return (df.where(F.col(time_col).isNotNull() & F.col(status_col).isNotNull())
            .withColumn(time_col, F.col(time_col).cast("double"))
            .withColumn(status_col, F.col(status_col).cast("double").cast("int")))


def fill_all(df: DataFrame, value=0, string_value="0", cols=None) -> DataFrame:
    """Fill NULLs in every (or the listed) column: numbers with 0, strings with "0"."""
    fills = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, T.StringType):
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(string_value))
        elif isinstance(f.dataType, T.NumericType):
            nan_safe = F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name)) \
                if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            fills[f.name] = F.coalesce(nan_safe, F.lit(value).cast(f.dataType))
    return df.withColumns(fills) if fills else df


def to_survival(df: DataFrame, time_col=TIME_COL, status_col=STATUS_COL) -> DataFrame:
    """Flat (event boolean, time double) columns."""
    return df.withColumns({"event": F.col(status_col).cast("double").cast("int") == 1,
                           "time": F.col(time_col).cast("double")})


def add_comutations(df: DataFrame, pairs=COMUTATION_PAIRS, prefix="GENE__") -> DataFrame:
    """P10: COMUT__g1_g2 = both indicators positive (only for pairs whose columns exist)."""
    cols = set(df.columns)
    new = {f"COMUT__{a}_{b}": ((F.col(f"{prefix}{a}") > 0) & (F.col(f"{prefix}{b}") > 0)).cast("int")
           for a, b in pairs if f"{prefix}{a}" in cols and f"{prefix}{b}" in cols}
    return df.withColumns(new) if new else df


def prefix_column_sums(df: DataFrame, prefix: str) -> DataFrame:
    """One-row table with the sum of every column whose name starts with ``prefix``."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.agg(*[F.sum(F.col(c)).cast("long").alias(c) for c in cols])


def lookup_with_default(df: DataFrame, mapping: DataFrame, key: str, value: str, default, out=None) -> DataFrame:
    """Dictionary lookup with a default.

    ``mapping`` is one row per key (a category table); it is broadcast when
    Spark's size estimate allows, else the join shuffles.
    """
    out = out or value
    j = df.join(mapping.select(key, F.col(value).alias("__m")), on=key, how="left")
    d = default if hasattr(default, "_jc") else F.lit(default)
    return j.withColumn(out, F.coalesce(F.col("__m"), d).cast("double")).drop("__m")


#: Values of a list that become literals; longer lists and tables are joined.
MOST_LITERALS = 1000


def filter_values(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose ``col`` is one of ``values``, a list or a one-column table; NULL is never one of them.

    A short list becomes an ``isin`` that reaches the scan; a table is a left semi join, which the planner broadcasts if it is small.
    """
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("__value")).where("__value is not null").distinct()
        return df.join(keys, on=F.col(col) == F.col("__value"), how="left_semi")
    values = [v for v in values if v is not None]
    if not values:
        return df.limit(0)
    if len(values) > MOST_LITERALS:
        return filter_values(df, col, df.sparkSession.createDataFrame([(v,) for v in values], df.select(col).schema))
    return df.where(F.col(col).isin(values))
