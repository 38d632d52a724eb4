"""Query op13: spelling variants of all words of the documents."""
from __future__ import annotations

from hazardlake.llm import spelling
from hazardlake.llm.common import table


def op13_spelling(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))
