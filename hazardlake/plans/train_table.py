"""Training / scoring table assembly.

One lazy plan: text flags (before any fill) -> per-entity aggregates with
the train top-k pivots -> entity LEFT JOIN features -> fill -> INNER JOIN
target -> drop missing outcomes.  All joins are on ID, so the shuffles by ID
of the three inputs line up and no extra exchange is planned between them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text_rules import aml_rule_flags, cyto_features
from ..operators.aggregates import entity_features, top_list
from ..operators.tables import align_columns, clean_target, feature_columns, fill_all


def entity_table(clinical: DataFrame, molecular: DataFrame, gene_list, effect_list, text_col="CYTOGENETICS",
                 rules: bool = True, binary: bool = True, id_col="ID") -> DataFrame:
    flags = cyto_features(text_col)
    if rules:
        flags.update(aml_rule_flags(text_col))
    c = clinical.withColumns(flags)
    feats = entity_features(molecular, id_col=id_col, gene_list=gene_list, effect_list=effect_list, binary=binary)
    return fill_all(c.join(feats, on=id_col, how="left"))


def train_table(clinical: DataFrame, molecular: DataFrame, target: DataFrame, top_genes=60, top_effects=25,
                gene_list=None, effect_list=None, rules=True, binary=True, id_col="ID"):
    """Returns (table, gene_list, effect_list); the lists are the train top-k (T4)."""
    gene_list = gene_list if gene_list is not None else top_list(molecular, "GENE", top_genes)
    effect_list = effect_list if effect_list is not None else top_list(molecular, "EFFECT", top_effects)
    t = entity_table(clinical, molecular, gene_list, effect_list, rules=rules, binary=binary, id_col=id_col)
    t = t.join(target, on=id_col, how="inner")
    return clean_target(t), gene_list, effect_list


def scoring_table(clinical: DataFrame, molecular: DataFrame, train_cols, gene_list, effect_list, rules=True,
                  binary=True, id_col="ID") -> DataFrame:
    """Features of entities to score, aligned to the training feature columns."""
    t = entity_table(clinical, molecular, gene_list, effect_list, rules=rules, binary=binary, id_col=id_col)
    return align_columns(t, [id_col] + list(train_cols))


def train_feature_columns(table: DataFrame) -> list:
    return feature_columns(table)
