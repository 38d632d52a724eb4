"""Scans of the three input tables.

Inputs are read with an explicit schema, never inferred, and their columns are
bound by name: a header may list them in any order.  CSV and parquet are both
accepted; the format follows the file suffix unless given.  Every double
column has NaN turned into NULL once, here, so that later aggregates skip it
(Spark keeps NaN distinct from NULL; ``NaN > 0.3`` would be true).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLINICAL_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("CENTER", T.StringType()),
    T.StructField("BM_BLAST", T.DoubleType()),
    T.StructField("WBC", T.DoubleType()),
    T.StructField("ANC", T.DoubleType()),
    T.StructField("MONOCYTES", T.DoubleType()),
    T.StructField("HB", T.DoubleType()),
    T.StructField("PLT", T.DoubleType()),
    T.StructField("CYTOGENETICS", T.StringType()),
])

# VAF / DEPTH arrive as text in some exports; they are read as strings and
# coerced leniently by ``functions.numeric.to_number``.
MOLECULAR_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("CHR", T.StringType()),
    T.StructField("START", T.LongType()),
    T.StructField("END", T.LongType()),
    T.StructField("REF", T.StringType()),
    T.StructField("ALT", T.StringType()),
    T.StructField("GENE", T.StringType()),
    T.StructField("PROTEIN_CHANGE", T.StringType()),
    T.StructField("EFFECT", T.StringType()),
    T.StructField("VAF", T.StringType()),
    T.StructField("DEPTH", T.StringType()),
])

TARGET_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("OS_YEARS", T.DoubleType()),
    T.StructField("OS_STATUS", T.DoubleType()),
])


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """Replace NaN by NULL in the floating point columns (all by default)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = [c for c in (cols or fl) if c in fl]
    if not cols:
        return df
    return df.withColumns({c: F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)) for c in cols})


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("csv" if str(path).lower().endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read
    if fmt == "csv":
        df = reader.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(str(path))
    else:
        df = reader.parquet(str(path))
    return nan_to_null(df if schema is None else by_name(df, schema))


def by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, found by name: extra columns go, missing ones and text that is no number are NULL."""
    present = {c.strip().lower(): c for c in reversed(df.columns)}
    return df.select(*[F.col(f"`{present[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) if f.name.lower() in present
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_clinical(spark, train_path, test_path=None, fmt=None):
    """(train, test) clinical tables; test is None when no path is given."""
    tr = read_table(spark, train_path, CLINICAL_SCHEMA, fmt)
    te = read_table(spark, test_path, CLINICAL_SCHEMA, fmt) if test_path else None
    return tr, te


def load_molecular(spark, train_path, test_path=None, fmt=None):
    """(train, test) one-to-many event tables."""
    tr = read_table(spark, train_path, MOLECULAR_SCHEMA, fmt)
    te = read_table(spark, test_path, MOLECULAR_SCHEMA, fmt) if test_path else None
    return tr, te


def load_target(spark, path, fmt=None):
    """S3: right-censored outcomes."""
    return read_table(spark, path, TARGET_SCHEMA, fmt)


def load_all(spark, data_dir, fmt="csv") -> dict[str, DataFrame]:
    """The five input tables, lazily, keyed by role."""
    ext = "csv" if fmt == "csv" else "parquet"
    d = str(data_dir).rstrip("/")
    clin_tr, clin_te = load_clinical(spark, f"{d}/clinical_train.{ext}", f"{d}/clinical_test.{ext}", fmt)
    mol_tr, mol_te = load_molecular(spark, f"{d}/molecular_train.{ext}", f"{d}/molecular_test.{ext}", fmt)
    return {
        "clinical_train": clin_tr, "clinical_test": clin_te,
        "molecular_train": mol_tr, "molecular_test": mol_te,
        "target_train": load_target(spark, f"{d}/target_train.{ext}", fmt),
    }
