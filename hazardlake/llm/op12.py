"""Query op12: how many words of every document the mix of all sources takes."""
from __future__ import annotations

from hazardlake.llm import mixing
from hazardlake.llm.common import table


def op12_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate")
