"""Fixture roles shared by the registered queries.

* labeled   — fx_target rows with a known outcome (time double, status int)
* hold-out  — hash(42, ID) % 10 >= 8 marks the evaluation rows
* unlabeled — clinical entities without any target row (the scoring set)
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import hash_u32
from ..operators.tables import clean_target
from ..sources.fixtures import fixture_tables

SEED = 42
TAU = 5.0
TOP_GENES = 10
TOP_EFFECTS = 25
ROUND = 6


@dataclass
class Ctx:
    spark: SparkSession
    sf_dir: str
    clinical: DataFrame
    molecular: DataFrame
    target: DataFrame

    @property
    def labeled(self) -> DataFrame:
        return clean_target(self.target)

    def is_test(self, id_col="ID"):
        return (hash_u32(id_col, SEED) % 10) >= 8

    @property
    def molecular_train(self) -> DataFrame:
        """Events of the entities that have a target row (J4: left semi)."""
        return self.molecular.join(self.target.select("ID"), on="ID", how="left_semi")

    @property
    def clinical_train(self) -> DataFrame:
        return self.clinical.join(self.target.select("ID"), on="ID", how="left_semi")

    @property
    def clinical_unlabeled(self) -> DataFrame:
        """Entities without a target."""
        return self.clinical.join(self.target.select("ID"), on="ID", how="left_anti")

    @property
    def molecular_unlabeled(self) -> DataFrame:
        return self.molecular.join(self.target.select("ID"), on="ID", how="left_anti")


def make_ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    fx = fixture_tables(spark, sf_dir)
    return Ctx(spark, sf_dir, fx["fx_clinical"], fx["fx_molecular"], fx["fx_target"])


def round_doubles(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round every double column (for value-hash comparison with the SQL oracle)."""
    return df.withColumns({f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
