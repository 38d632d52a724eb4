"""Entropy balancing: targets, multipliers and rounding against plain numpy."""
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from hazardlake.llm import mixing
from hazardlake.llm.op12 import op12_mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    """Sources in code-point order, NULL last; shares above three times a size go to the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        got = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if got[s] > 3 * sizes[s]]
        if not over:
            return full | got
        full |= {s: 3.0 * sizes[s] for s in over}
        if len(full) == len(names):
            return full


def plain_rates(z, target):
    """The rates that maximise the bounded entropy, by bisection on the multiplier."""
    if target >= 3 * z.sum():
        return np.full(len(z), 3.0)
    unit = (z * z).sum() / z.sum()
    rate = lambda lam: 3 / (1 + np.exp(np.clip(math.log(2) - lam * z / unit, -700, 700)))
    lo, hi = -1.0, 1.0
    while (rate(lo) * z).sum() > target:
        lo *= 2
    while (rate(hi) * z).sum() < target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (rate(mid) * z).sum() < target else (lo, mid)
    return rate(lo)


def check(rows, want_sizes):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    assert sorted(r["size"] for r in rows) == sorted(want_sizes)
    targets = plain_targets(sizes)
    for s, rs in by.items():
        z = np.array([r["size"] for r in rs], float)
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) <= 1e-6 * (1 + targets[s]) for r in rs)
        if sizes[s]:
            assert np.allclose([r["rate"] for r in rs], plain_rates(z, targets[s]), atol=1e-5)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rs)
        assert sum(abs(r["copies"] - r["rate"]) >= 1 + 1e-9 for r in rs) <= 3       # those that settle the rest
        least = min((r["size"] for r in rs if r["size"] and 0 < r["rate"] < 3), default=0)
        yield s, abs(sum(r["taken"] for r in rs) - targets[s]), least


def test_query_meets_its_targets(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs]
    got = op12_mixing(spark, sf).collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    rows = [r.asDict() | {"source": source[r["doc_id"]]} for r in got]
    for s, missed, least in check(rows, want):
        target = next(r["target"] for r in rows if r["source"] == s)
        assert missed <= max(0.02 * target, least), (s, missed, target)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in op12_mixing(spark, sf).collect())


def test_hot_source_in_small_cells_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(k), s) for i, (k, s) in enumerate(zip(
        rng.integers(1, 30, 3000), rng.choice(["a", "b", "B", "é", None], 3000, p=[.6, .1, .1, .1, .1])))]
    rows += [(0, "w " * 7, "a")] * 50                    # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = [r.asDict() for r in mixing.mix(df, cell_rows=20).collect()]
    for s, missed, least in check(got, [len(t.split()) for _, t, _ in rows]):
        assert missed <= least, (s, missed)
    again = [r.asDict() for r in mixing.mix(df.repartition(3), cell_rows=20).collect()]
    key = lambda r: (r["doc_id"], r["size"], str(r["source"]), r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_targets_stop_at_three_times_the_size(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 1000, "c"), (4, None, "d"), (5, "w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r for r in mixing.mix(df).collect()}
    assert got["a"]["target"] == 30 and got["a"]["copies"] == 3 and got["d"]["target"] == 0
    assert got[None]["target"] == 3 and abs(sum(r["target"] for r in got.values()) - 2011) < 1e-6


def test_odd_rows_kept_columns_and_empty_tables(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs, keep=("text", "lang", "score")).collect()
    assert len(got) == odd_docs.count()
    mixed = mixing.mix(odd_docs, keep=("text",))
    assert mixing.repeated(mixed).count() == sum(r["copies"] for r in got)
    with pytest.raises(ValueError):
        mixing.mix(odd_docs.withColumnRenamed("score", "copies"), keep=("copies",))
    assert mixing.mix(no_docs).count() == 0
