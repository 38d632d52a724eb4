"""Spelling variants against brute force over all pairs of words."""
import random
import re
import zlib
from collections import Counter

import pytest

from hazardlake.llm import spelling
from hazardlake.llm.op13 import op13_spelling


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    friends = {w: [] for w in counts}
    # every near pair shares the word with one letter cut out or replaced by a mark
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault(w[:i] + "*" + w[i + 1:], set()).add(w)
            if w[:i] + w[i + 1:] in counts:
                friends[w].append(w[:i] + w[i + 1:])
                friends[w[:i] + w[i + 1:]].append(w)
    for group in holes.values():
        for a in group:
            friends[a] += [b for b in group if b != a]
    form = {}
    for w, fs in friends.items():
        assert all(near(w, f) for f in fs)
        best = min(set(fs), key=lambda f: (-counts[f], f), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(set(friends[w])), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(op13_spelling(spark, sf))
    assert got == brute(brute_counts(docs)) and any(r[1] for r in got)


@pytest.mark.parametrize("cell_words", [40, 100_000])
def test_crowded_vocabulary_in_small_and_large_cells(spark, cell_words):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé×Ö") for _ in range(rng.randint(5, 7))) for _ in range(900)}
    words |= {"z" * 3000, "z" * 2999 + "y", "z" * 3001}
    counts = {w: rng.choice([3, 4, 6, 8, 16, 16, 40]) for w in words}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows_of(spelling.variants(vocab, cell_words=cell_words)) == brute(counts)


def test_deletions_follow_the_hash_of_id_and_run():
    text = "Alpha beta " * 40 + "ÀÉ Ünter"
    for doc_id in list(range(300)) + [None, -5]:
        got = {w: n for w, n in spelling.text_words(doc_id, text).items()}
        want = Counter()
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
        assert got == want


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    counts = spelling.word_counts(odd_docs)
    assert {(r["word"], r["n"]) for r in counts.collect()} == set(brute_counts(rows).items())
    assert rows_of(spelling.variants(counts)) == brute(brute_counts(rows))
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
