"""Query op8: the main text of every page."""
from __future__ import annotations

from hazardlake.llm.common import table
from hazardlake.llm.html import extract


def op8_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
