import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from hazardlake.llm import lm
from hazardlake.llm.op5 import op5_language_model
from llm_helpers import WORD, fold


def corpus(rng, n=300):
    tongues = [["the", "and", "walking", "seeing", "going", "of"], ["der", "und", "gehung", "sehung", "zu", "ist"]]
    docs = []
    for i in range(n):
        t = tongues[i % 2]
        docs.append((i, " ".join(rng.choice(t) + rng.choice(["", "", "", str(rng.randrange(400))]) for _ in range(rng.randint(0, 60)))))
    return docs


@pytest.fixture(scope="module")
def fitted(spark):
    docs = corpus(random.Random(1))
    df = spark.createDataFrame([*docs, (900, None), (901, "Zebra unseen"), (901, "Zebra unseen")], "doc_id long, text string").repartition(2)
    train = df.where("doc_id % 7 <> 2 and doc_id < 900").select("text")
    return df, train, {k: lm.fit(train, lexicon=k) for k in (30, 100_000)}


def test_base_scores_against_brute_force_for_any_lexicon(spark, fitted):
    df, train, models = fitted
    tokens = lambda t: [*WORD.findall(fold(t)), None]
    c = Counter(w for r in train.collect() for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    results = []
    for model, counts in models.values():
        rows = lm.score(df, model, counts).collect()
        results.append(sorted((r.doc_id, round(r.score, 6)) for r in rows))
        assert len(rows) == df.count()
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in rows:
            ts = tokens(texts[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(c[t] > 0 for t in ts), n)
            assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), abs_tol=1e-6)
    assert len(results[0]) == len(results[1])


def test_model_is_a_distribution_and_beats_the_base(spark, fitted):
    df, _, models = fitted
    model, counts = models[100_000]
    ctx = np.arange(0, lm.BUCKETS**2, 997)
    p = np.exp(lm.logits(model.weights, ctx) - model.norm[ctx][:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    inside = Counter()
    for w, (_, own) in model.lexicon.items():
        inside[model.layout.of(w)[1]] += 10**own
    for c, total in inside.items():
        assert abs(total + 1 / model.in_class[c] - 1) < 1e-6          # and one unseen word
    held = lm.score(df.where("doc_id % 7 = 2"), model, counts).collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.95


def test_contexts_follow_the_words(spark):
    layout = lm.Layout([b"a", b"b"], [])
    reader = lm.Reader(layout)
    (group, flat, inside, ctx, cls, starts, ends), = reader.batch([b"A b a", b"", b"b"])
    b = {w: layout.of(w)[0] for w in (b"a", b"b")}
    s = lm.BOS
    assert [(x // lm.BUCKETS, x % lm.BUCKETS) for x in ctx.tolist()] == [
        (s, s), (b[b"a"], s), (b[b"b"], b[b"a"]), (b[b"a"], b[b"b"]), (s, s), (s, s), (b[b"b"], s)]
    assert cls.tolist()[3] == cls.tolist()[4] == lm.END and ends.tolist() == [3, 4, 6]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    model, counts = lm.fit(odd_docs.select("text"), lexicon=5)
    out = lm.score(odd_docs, model, counts)
    assert out.count() == odd_docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].n_tokens == rows[1].n_tokens == rows[2].n_tokens == 1 and rows[5].n_tokens == 30_001
    assert lm.score(no_docs, model, counts).count() == 0
    empty, none = lm.fit(no_docs.select("text"))
    got = lm.score(odd_docs, empty, none).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_query(spark):
    rows = op5_language_model(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
