"""Sinks: the ranked risk table (S5) and experiment result tables."""
from __future__ import annotations

from pyspark.sql import DataFrame


def write_risk_table(df: DataFrame, path: str, id_col="ID", score_col="risk_score", fmt="csv",
                     mode="overwrite") -> None:
    """Write (ID, risk_score); csv with a header by default, else parquet.

    No ``coalesce(1)``: each task writes its own part file, so the writer
    scales with the table.
    """
    out = df.select(id_col, score_col)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_results(df: DataFrame, path: str, fmt="csv", mode="overwrite") -> None:
    """Write an experiment's result table, part files by task."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
