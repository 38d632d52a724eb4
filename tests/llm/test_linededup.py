import random

from hazardlake.llm import linededup as L


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(rng):
    shared = [prose(rng, 58) + "." for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 120)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 3), shared[i % 4])
        docs.append((i, rng.choice([". ", "\n", " "]).join(parts), "keep"))
    docs += [(100, docs[5][1], "copy"), (101, docs[5][1], "copy"), (102, "Short line.\nShort line.", "x"), (103, "", "x"), (104, None, None)]
    return docs, shared


def windows(text, n=52):
    w = (text or "").split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_passages_stay_once_and_clean_texts_as_they_are(spark):
    docs, shared = corpus(random.Random(8))
    df = spark.createDataFrame(docs, "doc_id long, text string, removed_words string").repartition(3)
    rows = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert len(rows) == len(docs)
    before = {i: t for i, t, _ in docs}
    planted = {i for i in before if i is not None and before[i] and any(s in before[i] for s in shared)} | {5, 100, 101}
    for i, t in before.items():
        if i not in planted:
            assert rows[i].text == t and rows[i].removed_spans == [] and rows[i].removed_words == 0
    for s in shared:
        assert sum(s in (r.text or "") for r in rows.values()) == 1
    kept = [w for r in rows.values() for w in windows(r.text)]
    assert len(kept) == len(set(kept))
    assert sum(rows[i].text == before[5] for i in (5, 100, 101)) >= 1
    assert rows[103].text == "" and rows[104].text is None


def test_cut_text_is_the_text_outside_the_spans(spark):
    docs, _ = corpus(random.Random(9))
    for r, (i, t, _) in zip(L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, x string")).orderBy(
            "doc_id").collect(), sorted(docs)):
        at, out = 0, ""
        for s in r.removed_spans:
            out += t.encode()[at:s.s].decode()
            at = s.e
        assert r.text == (t if t is None else out + t.encode()[at:].decode())


def test_odd_rows(spark, odd_docs, no_docs):
    out = L.dedup_lines(odd_docs)
    assert out.count() == odd_docs.count()
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id in (0, 1, 2, 3)} == {0: None, 1: "", 2: "  \n\t ", 3: "one"}
    assert L.dedup_lines(no_docs).count() == 0


def test_chunks_do_not_depend_on_what_stands_before(spark):
    rng = random.Random(2)
    body = prose(rng, 300)
    rows = spark.createDataFrame([(prose(rng, 40) + ". " + body,), (body,)], "text string").select(
        L.chunk_array(L.F.col("text"), L.WINDOW).alias("c")).collect()
    a, b = ([x["hash"] for x in r.c] for r in rows)
    assert len(set(a) & set(b)) >= len(b) - 3


def test_offsets_are_prefix_sums(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (1, 2, L.BLOCK - 1, L.BLOCK, L.BLOCK + 1, 3 * L.BLOCK + 5, 2000)]
    for r in spark.createDataFrame(rows, "z array<int>").select("z", L.offsets(L.F.col("z")).alias("p")).collect():
        assert r.p == [sum(r.z[:i]) for i in range(len(r.z))]


def between(rng, passages):
    """Each passage twice, between different words."""
    return [(2 * i + k, prose(rng, 45) + " " + p + " " + prose(rng, 45)) for i, p in enumerate(passages) for k in (0, 1)]


def left_standing(spark, docs, n=50):
    rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    kept = [w for r in rows for w in windows(r.text, n)]
    return len(kept) - len(set(kept))


def test_passages_of_any_script(spark):
    rng = random.Random(11)
    letters = ["АБВГДЕЖЗИКЛМН", "ابتثجحخدذرزس", "ABCDEFGHIJKLM", "0123456789", "%#@$&*+=", "漢字仮名交文"]
    passages = [" ".join("".join(rng.choice(some) for _ in range(6)) for _ in range(51)) for some in letters for _ in range(4)]
    assert left_standing(spark, between(rng, passages)) == 0


def test_runs_of_equal_words_and_lines(spark):
    rng = random.Random(12)
    junk = ["word%%% word###\n" * 40, "word " * 51, "\n".join(["one and the same line."] * 12), "x y z " * 20]
    docs = between(rng, junk)
    assert left_standing(spark, docs) == 0
    alone = [(1, "start " + "word " * 1000 + "end"), (2, "other words")]
    out = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(alone, "doc_id long, text string")).collect()}
    assert 50 <= len(out[1].split()) < 120 and out[1].startswith("start ") and out[1].endswith("end") and out[2] == "other words"


def test_short_passages_between_other_words(spark):
    rng = random.Random(13)
    passages = [prose(rng, rng.choice([50, 51, 53, 55, 60])) for _ in range(300)]
    assert left_standing(spark, between(rng, passages)) == 0


def test_pipeline_keeps_documents_with_words_of_their_own(spark):
    import corpus_pipeline
    rng = random.Random(14)
    shared, own = prose(rng, 300), prose(rng, 70)
    docs = [(1, shared, None), (2, own + "\n" + shared, None), (3, shared, None), (4, "", None), (5, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in corpus_pipeline.line_dedup_stage(spark, df, None).collect()}
    assert set(rows) == {1, 2, 4, 5}                           # 3 is a whole copy of 1
    assert rows[1].text == shared and rows[2].text.split() == own.split() and rows[2].n_chars == len(rows[2].text)


def test_passages_that_share_only_part_with_the_first_place(spark):
    """40 words stand in A; B and C share them and ten more, before or after."""
    rng = random.Random(15)
    docs = []
    for i in range(200):
        part, more = prose(rng, 40), prose(rng, 10)
        both = part + " " + more if i % 2 else more + " " + part
        docs += [(10 * i + k, prose(rng, 45) + " " + p + " " + prose(rng, 45)) for k, p in enumerate([part, both, both])]
    assert left_standing(spark, docs) == 0
    rows = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(rows[10 * i].removed_words == rows[10 * i + 1].removed_words == 0 for i in range(200))
    assert all(50 <= rows[10 * i + 2].removed_words <= 52 for i in range(200))


def brute(docs, n=50):
    """Passages of n words that an earlier place holds, by document: covered word numbers (whole texts: no self-overlap)."""
    seen, out = {}, {}
    for i, text in sorted(docs):
        w = text.split()
        hit = set()
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            if key in seen and (seen[key][0] != i or s - seen[key][1] >= n):
                hit |= set(range(s, s + n))
            seen.setdefault(key, (i, s))
        out[i] = hit
    return out


def test_query_cuts_what_brute_force_finds(spark, tmp_path):
    """Every word of a passage that stands before goes, and no other word."""
    from hazardlake.llm.op1 import op1_line_dedup
    rng = random.Random(16)
    pool = [prose(rng, rng.choice([30, 44, 49, 50, 51, 64, 90])) for _ in range(25)]
    docs = []
    for i in range(150):
        parts = [prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(pool).split()
            cut = rng.choice([0, 0, 0, 8])
            parts.insert(rng.randint(0, len(parts)), " ".join(p[cut:] if rng.random() < .5 else p[:len(p) - cut]))
        docs.append((i, " ".join(parts)))
    docs.append((500, docs[7][1]))                       # a whole copy
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    want = brute(docs)
    assert sum(map(bool, want.values())) > 20
    for i, text in docs:
        w = text.split()
        kept = " ".join(x for k, x in enumerate(w) if k not in want[i])
        assert " ".join(got[i].text.split()) == kept, i
        assert got[i].removed_words == len(want[i]) and got[i].n_chars == len(got[i].text)


def test_anchors_are_those_of_the_arrays_without_a_loop_over_them(spark):
    """The windows are compiled rows; texts without neighbouring equal hashes have the rows of ``chunk_array``, the others are marked."""
    from pyspark.sql import functions as F
    rng = random.Random(17)
    docs = [prose(rng, rng.choice([3, 49, 50, 51, 60, 200])) for _ in range(60)] + ["a b\n" * 60, prose(rng, 80) + " x" * 90, "of the of and " * 3 + prose(rng, 70), ""]
    docs += [" ".join(rng.choice("abc") for _ in range(300)) for _ in range(20)]       # many equal words in a window
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string").select("id", F.xxhash64("text").alias("h"), "text")
    for window in (2, 7, 16, 25):
        found = L.anchors(df, window)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lambdafunction") <= 2 and "aggregate(" not in plan
        got, marked = {}, set()
        for r in found.collect():
            got.setdefault(r.id, set()).add((r["hash"], r["at"], r["at"], 0))
            marked |= {r.id} if r.again else set()
        arrays, merged = {}, set()
        for r in df.select("id", F.explode(L.chunk_array(F.col("text"), window)).alias("c")).select("id", "c.*").collect():
            arrays.setdefault(r.id, set()).add((r["hash"], r["at"], r["last"], r["gap"]))
            merged |= {r.id} if r["gap"] else set()
        assert merged == marked and marked and set(got) == set(arrays)
        assert all(got[i] == arrays[i] for i in got if i not in marked)
