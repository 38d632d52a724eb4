import random
from hashlib import sha256

from hazardlake.llm import decontaminate as D
from hazardlake.llm.op9 import op9_decontamination


def brute(words, items, window):
    hit, found = set(), set()
    for item, ws in items:
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1):
            for p in range(len(words) - k + 1):
                if k and words[p:p + k] == ws[a:a + k]:
                    found.add(item)
                    hit.update(range(p, p + k))
    return hit, found


def test_matches_against_brute_force():
    rng = random.Random(1)
    for _ in range(250):
        window = rng.choice([1, 2, 3, 4])
        letters = [b"a", b"b", b"c", b"d"][:rng.choice([2, 3, 4])]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(1, 7))]) for i in range(rng.randint(1, 6))]
        sa = D.SuffixAutomaton(items, window)
        for _ in range(8):
            words = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
            spans, found = sa.matches(words)
            hit, expected = brute(words, items, window)
            assert {i for a, b in D.merged(spans) for i in range(a, b)} == hit and found == expected


def test_frames_blocks_and_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, None), (3, ""), (None, "two words"), (4, "--")],
                                  "item_id long, text string")
    one = D.find_contamination(odd_docs, bench).drop("hit_spans").collect()
    many = D.automata(bench, block_words=5)
    assert len(many) > 1
    assert len(one) == odd_docs.count()
    got = {r.doc_id: r for r in one}
    assert got[7].contaminated and got[7].item_ids == ["1"] and got[7].clean_text == ""
    assert got[4].contaminated and got[4].item_ids == [""]
    assert not got[0].contaminated and got[0].n_words == 0 and not got[5].contaminated
    kept = D.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (4, 7, 8)").count() == 0
    spans = D.decontaminate(odd_docs, bench, mode="spans")
    assert spans.count() == odd_docs.count()
    assert D.find_contamination(no_docs, bench).count() == 0
    assert D.find_contamination(odd_docs, bench.limit(0)).where("contaminated").count() == 0


def test_cut_keeps_the_rest():
    assert D.cut("One two, THREE four! Five.", [[1, 3]]) == "One  four! Five."


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(str(r.item_id), D.words_of((r.text or "").encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams: dict = {}
    for i, ws in items:
        k = min(13, len(ws))
        for a in range(len(ws) - k + 1 if k else 0):
            grams.setdefault(tuple(ws[a:a + k]), set()).add(i)
    sizes = {len(g) for g in grams}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_decontamination(spark, sf).collect():
        words = D.words_of((texts[r.doc_id] or "").encode())
        hit, found = set(), set()
        for k in sizes:
            for p in range(len(words) - k + 1):
                g = grams.get(tuple(words[p:p + k]))
                if g:
                    found |= g
                    hit.update(range(p, p + k))
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(found))
        assert r.items_sha256 == sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_columns_named_like_the_measures_stay(spark):
    from hazardlake.llm import decontaminate as D
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, passage, 99, True, "mine"), (2, "clean text", 98, None, None)],
                                 "doc_id long, text string, n_words long, contaminated boolean, clean_text string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    assert [tuple(r) for r in D.decontaminate(docs, bench).collect()] == [(2, "clean text", 98, None, None)]
    spans = {r.doc_id: tuple(r) for r in D.decontaminate(docs, bench, mode="spans").collect()}
    assert spans[1][1].strip() == "" and spans[1][2:] == (99, True, "mine") and spans[2] == (2, "clean text", 98, None, None)
