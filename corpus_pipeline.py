"""Corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates, benchmark passages, token ids.

Each stage reads all rows that the one before kept.  Empty tables, NULL texts
and NULL ids pass every stage; see the operators for what each does with them.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm import bpe, decontaminate, linededup, neardup, toxicity
from hazardlake.llm.common import materialise, table
from hazardlake.llm.op2 import vocab_path
from hazardlake.llm.op4 import fitted


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go; it is fitted on labelled rows that are not held out."""
    return toxicity.reject_toxic(docs, fitted(spark, docs, sf_dir))


def line_dedup_stage(spark, docs, sf_dir):
    """Repeated passages go; a document goes only if no word of its own is left."""
    cut = linededup.dedup_lines(docs)
    keep = (F.col("removed_words") == 0) | (linededup.n_words(F.col("text")) > 0)
    return cut.where(keep).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one with the smallest id."""
    return neardup.keep_one(docs).select(*docs.columns)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold benchmark passages beyond the limit go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark, docs, sf_dir):
    """Token ids of every document that remains."""
    return bpe.encode(docs.drop("ids"), vocab_path()).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", bpe_stage),
]

#: None: models, suffix automata and merges have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
