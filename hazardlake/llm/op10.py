"""Query op10: near-duplicate components of all documents on two-word shingles."""
from __future__ import annotations

from hazardlake.llm.common import table
from hazardlake.llm.neardup import near_duplicates


def op10_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, min_percent=80)
