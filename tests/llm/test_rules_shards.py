import random
from collections import Counter, defaultdict

from hazardlake.llm import op6, rules, shards


def repeated(text):
    w = (text or "").split()
    n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)})


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a " * 3000), (904, "x y " * 9)]
    got = {r.doc_id: r.n_repeat_words for r in rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: repeated(t) for i, t in rows}


def test_ledger_of_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumnRenamed("n_tokens", "failures")
    out = rules.ledger(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd_docs.count() and set(out.columns) == {*df.columns, *rules.MEASURES}
    for i in (0, 1, 2):
        assert (rows[i].n_words, rows[i].failures) == (0, rules.BIT["few_words"])
    assert rules.ledger(no_docs).count() == 0


def test_policies_and_ablation(spark):
    texts = ["good words only here " * 8 + f"{i}" for i in range(3)] + ["short", "a$$$ b### c%%% " * 9, "LOUD!! WORDS!! " * 20]
    led = rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for policy in rules.POLICIES:
        masks = [r.failures & rules.mask(policy) for r in led.collect()]
        got = {r.rule: r for r in rules.ablation(led, policy).collect()}
        for name in rules.POLICIES[policy]:
            bit = rules.BIT[name]
            assert (got[name].n_fail, got[name].n_fail_alone, got[name].n_kept_without) == (
                sum(m & bit > 0 for m in masks), sum(m == bit for m in masks), sum(m in (0, bit) for m in masks))


def test_shards_are_near_equal_and_gapless(spark):
    rows = op6.op6_sharding(spark, "/root/testdata/sf0.001").collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_records(spark, odd_docs, no_docs):
    recs = shards.records(odd_docs)
    slots = shards.first_map(shards.slot_bytes(recs), 3)
    store = shards.MapStore(spark)
    out = shards.assign(recs, store.save(slots, 1), tie="text").collect()
    assert len(out) == odd_docs.count()
    assert {r.size for r in out if r.text is None} == {1}
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    empty = shards.records(no_docs)
    assert shards.assign(empty, store.load(1)).count() == 0
    assert shards.first_map({}, 4) and store.slots(1) == slots


def test_growth_moves_slots_to_the_new_shard_only():
    rng = random.Random(1)
    sizes = {v: rng.randint(1, 100) for v in range(shards.SLOTS)}
    old = shards.first_map(sizes, 16)
    new = shards.rebalance(old, sizes, 17)
    moved = [(a, b) for a, b in zip(old, new) if a != b]
    assert moved and all(b == 16 for _, b in moved)
    load = Counter()
    for v, s in enumerate(new):
        load[s] += sizes[v]
    assert max(load.values()) - min(load.values()) <= 2 * 100 + sum(sizes.values()) / 17 * 0.05
    shrunk = shards.rebalance(new, sizes, 16)
    assert max(shrunk) == 15 and all(a == b for a, b in zip(new, shrunk) if a < 16 and b == a)
