"""Registered queries of the training-data operators and their SQL oracles."""
from __future__ import annotations

from collections.abc import Callable

from hazardlake.llm import op7
from hazardlake.llm.op1 import op1_line_dedup
from hazardlake.llm.op2 import op2_bpe
from hazardlake.llm.op3 import op3_chat
from hazardlake.llm.op4 import op4_toxicity
from hazardlake.llm.op5 import op5_language_model
from hazardlake.llm.op6 import op6_sharding
from hazardlake.llm.op7 import op7_quality_rules
from hazardlake.llm.op8 import op8_html_extraction
from hazardlake.llm.op9 import op9_decontamination
from hazardlake.llm.op10 import op10_minhash
from hazardlake.llm.op11 import op11_prefix_trie
from hazardlake.llm.op12 import op12_mixing
from hazardlake.llm.op13 import op13_spelling


def registry() -> dict[str, Callable]:
    found = [op1_line_dedup, op2_bpe, op3_chat, op4_toxicity, op5_language_model, op6_sharding, op7_quality_rules,
             op8_html_extraction, op9_decontamination, op10_minhash, op11_prefix_trie,
             op12_mixing, op13_spelling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries whose rows SQL can express."""
    return {"op7_quality_rules": op7.ORACLE}
