import random
from collections import defaultdict

import numpy as np

from hazardlake.llm import neardup as N
from llm_helpers import fold, WORD


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall(fold(t))
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    chain = [rng.choice(words) for _ in range(100)]                  # each like the next, the ends unlike
    for k in range(25):
        chain = chain[4:] + [rng.choice(words) for _ in range(4)]
        rows.append(" ".join(chain))
    rows += ["", "one", "ONE", "two words", "Two Words", None, " \t "]
    rows += [rows[0]] * 5
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_against_brute_force(spark):
    for seed, size in ((1, 2), (2, 5)):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, shingle=size).collect()}
        assert got == brute(rows, size)


def test_keep_one_and_odd_rows(spark, odd_docs, no_docs):
    out = N.near_duplicates(odd_docs)
    assert out.count() == odd_docs.count()
    kept = N.keep_one(odd_docs)
    assert set(kept.columns) == set(odd_docs.columns)
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2, 3, 4, 5, 7, None} <= ids and 8 not in ids and 6 not in ids
    assert N.near_duplicates(no_docs).count() == 0 and N.keep_one(no_docs).count() == 0


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200)]
    rng.shuffle(edges)
    pad = lambda i: i.to_bytes(4, "big")
    links = spark.createDataFrame([(bytearray(pad(a)), bytearray(pad(b))) for a, b in edges], "a binary, b binary")
    groups = defaultdict(set)
    for r in N.components(links).collect():
        groups[bytes(r.label)].add(int.from_bytes(r.node, "big"))
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(100, 160)), [200, 201]]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    assert abs((N.signature(np.unique(a)) == N.signature(np.unique(b))).mean() - 800 / 1200) < 0.15


def test_rows_without_an_id_are_linked_and_repeated_ids_judged_by_their_texts(spark):
    rng = random.Random(77)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(4)]
    near = [b + " tail" for b in base]
    rows = [(None, base[0], "x"), (6, near[0], "x"), (7, base[1], "first"), (7, base[2], "clean"), (3, near[1], "x"),
            (1, base[3], "y"), (1, base[3], "y"), (None, "two words", "z"), (None, "two words", "z"), (9, "", "e"), (9, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stays string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert {(d, c, k) for d, _, c, k in got} >= {(None, 6, False), (6, 6, True), (7, 3, False), (7, 7, True), (3, 3, True), (1, 1, True), (9, 9, True)}
    left = sorted((r.doc_id or 0, r.text, r.stays) for r in N.keep_one(df).collect())
    assert left == sorted([(6, near[0], "x"), (7, base[2], "clean"), (3, near[1], "x"), (1, base[3], "y"), (0, "two words", "z"), (9, "", "e"), (9, "", "e")])
    assert N.keep_one(df.limit(0)).count() == 0
