"""Query op4: toxicity of every document, learnt from labelled rows that are not held out."""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm import toxicity
from hazardlake.llm.common import table


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fitted(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.fit(docs, labels)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
