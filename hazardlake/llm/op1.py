"""Query op1: all documents without the passages that stand elsewhere before."""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm.common import table
from hazardlake.llm.linededup import dedup_lines


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"),
                                    F.col("removed_words").cast("long").alias("removed_words"),
                                    F.size("removed_spans").cast("long").alias("removed_passages"))
