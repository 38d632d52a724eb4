"""Stand-in clinical / molecular / target views over the driver's tables.

The entity is an order; its events are the order's line items joined to
their part.  Definitions follow FIXTURES.md §2 so that the DuckDB oracle in
``plans.oracle`` can rebuild the very same rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The CYTOGENETICS strings of the stand-in clinical view, keyed
# by o_orderkey % 12 (0 -> NULL).  They exercise every text rule.
CYTO_FIXTURE_VALUES = [
    None, "46,XX", " 46,XY ", "46,XX[20]", "45,XY,-7", "47,XX,+8",
    "46,XY,del(5)(q13q33)", "46,XX,t(8;21)(q22;q22)", "complex",
    "46,XX,inv(16)(p13q22)", "45,XY,-17,+8,del(20q)", "46,XX,del(13q)",
]

REFERENCE_DATE = "2001-08-01"


def _tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cyto_expr(key):
    k = (key % 12).cast("int")
    expr = F.lit(None).cast("string")
    for i, v in enumerate(CYTO_FIXTURE_VALUES):
        if v is not None:
            expr = F.when(k == i, F.lit(v)).otherwise(expr)
    return expr


def fx_clinical(spark, sf_dir) -> DataFrame:
    o = _tbl(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = _tbl(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("ID"),
        F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("CENTER"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice") / F.lit(5000.0)).alias("BM_BLAST"),
        (F.col("c_acctbal") / F.lit(1000.0)).alias("HB"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("o_custkey") % 400).cast("double")).alias("PLT"),
        _cyto_expr(F.col("o_orderkey")).alias("CYTOGENETICS"),
    )


def fx_molecular(spark, sf_dir) -> DataFrame:
    li = _tbl(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                "l_extendedprice")
    p = _tbl(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_orderkey").alias("ID"),
        F.col("p_brand").alias("GENE"),
        F.col("p_type").alias("EFFECT"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 13 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") / F.lit(50.0)).alias("VAF"),
        F.col("l_extendedprice").alias("DEPTH"),
    )


def fx_target(spark, sf_dir) -> DataFrame:
    o = _tbl(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    days = F.datediff(F.lit(REFERENCE_DATE).cast("date"), F.col("o_orderdate").cast("date"))
    return o.where(F.col("o_orderkey") % 17 != 0).select(
        F.col("o_orderkey").alias("ID"),
        ((days + 1).cast("double") / F.lit(365.25).cast("double")).alias("OS_YEARS"),
        F.when(F.col("o_orderkey") % 23 == 0, F.lit(None).cast("int"))
         .when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).alias("OS_STATUS"),
    )


def fixture_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {"fx_clinical": fx_clinical(spark, sf_dir), "fx_molecular": fx_molecular(spark, sf_dir),
            "fx_target": fx_target(spark, sf_dir)}


def register_fixture_views(spark, sf_dir) -> dict[str, DataFrame]:
    t = fixture_tables(spark, sf_dir)
    for k, v in t.items():
        v.createOrReplaceTempView(k)
    return t
