"""Query op5: log-probabilities of all documents, learnt from those that are not held out."""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm import lm
from hazardlake.llm.common import table


def op5_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    model, counts = lm.fit(docs.where(~held_out).select("text"))
    scored = lm.score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
