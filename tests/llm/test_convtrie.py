"""Prefix tries against brute force over all prefixes."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from hazardlake.llm import convtrie
from hazardlake.llm.op11 import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((-2**63 if t is None else t, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, x) for _, r, _, x in sorted(ts)] for c, ts in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        host = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(host, [])[:h] + own[h:]
    return out


def brute(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            node = tuple(ts[:d])
            members[node].append(c)
            if d:
                kids[node[:-1]].add(node)
    out = set()

    def visit(node):
        leaves, saved = 0, 0
        for kid in kids[node]:
            a, b = done[kid]
            leaves, saved = leaves + a, saved + b
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        return leaves or 1, saved + (len(members[node]) - 1) * words

    done = {}
    for node in sorted(members, key=len, reverse=True):
        done[node] = visit(node)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.add((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]),
                 *done[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    rows = [tuple(r[c] for c in convtrie.NODE) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(op11_prefix_trie(spark, sf))
    assert got == brute(rebuild(ordered(rows))) and max(r[3] for r in got if r[1]) > 1


@pytest.mark.parametrize("range_turns", [3, 10_000])
def test_copies_nulls_ties_and_long_conversations(spark, monkeypatch, range_turns):
    monkeypatch.setattr(convtrie, "RANGE_TURNS", range_turns)
    rng = random.Random(2)
    rows = []
    for c in range(-5, 90):
        n = rng.choice([0, 1, 2, 3, 5, 9])
        start = rng.choice([["a b", "c", "d"], ["a b", "c", "e f g"], ["x"]])
        said = (start + [rng.choice(["y y", "z", ""]) for _ in range(9)])[:n]
        rows += [(c, t if rng.random() < .9 else None, rng.choice(["user", "user", "user", None]), x or None) for t, x in enumerate(said)]
    rows += [(c, t, "user", f"t{t}") for c in (200, 201, 202) for t in range(25)]                # three copies
    rows += [(203, t, "user", f"t{t}") for t in range(40)]                                       # goes on after them
    rows += [(400, t, "user", "same") for t in range(300)] + [(7, 1, "user", "twice")] * 3
    rows += [(None, 1, "user", "no conversation")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    convs = ordered(rows)
    assert rows_of(convtrie.conversation_trie(df)) == brute(convs)
    numbered = convtrie.materialise(convtrie.turns(df), "t")
    assert rows_of(convtrie.trie(*convtrie.rebuilt(numbered))) == brute(rebuild(convs))


def test_one_long_conversation_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "RANGE_TURNS", 500)
    rows = [(1, t, "user", f"w{t % 7}") for t in range(4000)] + [(2, 0, "user", "w0"), (2, 1, "user", "no")]
    got = rows_of(convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 4002 and got == brute(ordered(rows))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 5, "x")], SCHEMA + ", depth long, path string")
    assert rows_of(convtrie.conversation_trie(df)) == brute({1: [("user", "a")]})
    assert convtrie.conversation_trie(df.limit(0)).count() == 0
    assert convtrie.trie(*convtrie.rebuilt(convtrie.turns(df.limit(0)))).count() == 0
