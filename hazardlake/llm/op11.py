"""Query op11: the prefix trie of all conversations, rebuilt on the starts of their hosts."""
from __future__ import annotations

from hazardlake.llm import convtrie
from hazardlake.llm.common import materialise, table


def op11_prefix_trie(spark, sf_dir):
    rows = materialise(convtrie.turns(table(spark, sf_dir, "conversations")), "numbered")
    rebuilt, convs = convtrie.rebuilt(rows)
    return convtrie.trie(rebuilt, convs)
