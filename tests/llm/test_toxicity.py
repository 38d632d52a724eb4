import random
from zlib import crc32

import numpy as np

from hazardlake.llm import toxicity as X
from hazardlake.llm.op4 import op4_toxicity


def labelled(rng, n=400):
    syllables = ["an", "the", "ing", "er", "ou", "st", "ble", "re", "to", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    vile = lambda: "zorg" + rng.choice(["ix", "ul", "en", "os", "am", "ip"])
    docs, labels = [], []
    for i in range(n):
        y = int(i % 5 == 0)
        w = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(4 * y):
            w.insert(rng.randrange(len(w)), vile())
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return docs, labels


def test_held_out_accuracy_and_unseen_forms(spark):
    docs, labels = labelled(random.Random(1))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, toxic int")
    model = X.fit(d, known)
    rows = {r.doc_id: r.score for r in X.score(d, model).collect()}
    held = [(rows[i], y) for i, y in labels if i % 4 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) >= 0.97
    assert model.kn.ratios(["zorgxq"])[0] > 2                  # a form that training never saw
    assert abs(model.kn.ratios(["anthe"])[0]) < 1


def test_odd_rows_and_missing_classes(spark, odd_docs, no_docs):
    docs, labels = labelled(random.Random(2), 120)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = X.fit(d, lab)
    out = X.score(odd_docs, model)                             # replaces the column "score"
    assert out.count() == odd_docs.count() and set(out.columns) == set(odd_docs.columns)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert X.score(no_docs, model).count() == 0
    assert X.reject_toxic(odd_docs, model).columns == odd_docs.columns
    for some in (lab.limit(0), lab.where("toxic = 0")):
        none = X.fit(d, some)
        assert {r.score for r in X.score(d, none).collect()} == {0.0}


def test_grams_of_words():
    codes, owner = X.gram_codes(["ab", "", "é"])
    assert owner.tolist() == [0, 0, 0, 1, 2, 2]
    first = (97 << 0)
    assert codes[0] == first and codes[1] == (97 << X.BITS | 98) and codes[3] == X.END and codes[4] == ord("é")


def test_probabilities_of_each_class_sum_to_one():
    words = ["abc", "abd", "bcd", "abcabc", "dd"]
    codes, _ = X.gram_codes(words)
    grams, n = np.unique(codes, return_counts=True)
    kn = X.KneserNey(grams, n, np.ones(len(n), np.int64))
    context = grams[0] >> X.BITS
    every = (context << X.BITS) | np.arange(1024)
    p = np.full(1024, 1 / 1024)
    for k, level in enumerate(kn.levels, 1):
        p = level.mix(every & ((1 << X.BITS * k) - 1), p)
    assert abs(p.sum() - 1) < 1e-3
    for level in kn.classes:
        assert abs(level.mix(every, p).sum() - 1) < 1e-3


def test_query_shape(spark):
    rows = op4_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)


def test_every_token_counts():
    rng = random.Random(3)
    plain, vile = ["anthe", "ingou", "stre", "blend", "toner"], ["zorgix", "zorgul", "zorgen"]
    grams, n = np.unique(X.gram_codes(plain + vile)[0], return_counts=True)
    toxic = np.isin(grams, X.gram_codes(vile)[0])
    kn = X.KneserNey(grams, np.where(toxic, 50 * n, 1), np.where(toxic, 1, 50 * n))
    words = vile + [rng.choice(plain) for _ in range(400)] + [vile[0]] * 50 + [rng.choice(plain) for _ in range(100)]
    v = kn.ratios(words)
    whole, stretch, top = kn.features(" ".join(words))
    assert abs(whole - v.mean()) < 1e-9
    assert abs(stretch - max(v[i:i + X.STRETCH].mean() for i in range(len(v) - X.STRETCH + 1))) < 1e-9
    assert abs(top - np.sort(v)[-3:].mean()) < 1e-9
    assert stretch > 0 and abs(stretch - kn.ratios([vile[0]])[0]) < 1e-9


def test_letters_of_an_alphabet_have_codes_of_their_own():
    for first, last in ((0x410, 0x44F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x904, 0x939), (0x3041, 0x30FF)):
        letters = [chr(c) for c in range(first, last + 1)]
        codes = [int(X.gram_codes([c])[0][0]) for c in letters]
        assert len(set(codes)) == len(letters) and 1 < min(codes) and max(codes) < 1 << X.BITS
