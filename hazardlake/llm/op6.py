"""Query op6: every document's shard out of 16, by the first version of the slot map."""
from __future__ import annotations

from pyspark.sql import functions as F

from hazardlake.llm import shards
from hazardlake.llm.common import materialise, table

N_SHARDS = 16


def op6_sharding(spark, sf_dir):
    docs = shards.records(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = materialise(docs.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "v_slot"), "records")
    slots = shards.first_map(shards.slot_bytes(rows), N_SHARDS)
    placed = shards.assign(rows, shards.MapStore(spark).save(slots, 1), tie="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "v_slot")
