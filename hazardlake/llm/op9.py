"""Query op9: contamination of every document by the benchmark."""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm.common import table
from hazardlake.llm.decontaminate import find_contamination


def op9_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), want_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
