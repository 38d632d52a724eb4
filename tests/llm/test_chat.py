import random
from hashlib import sha256

from hazardlake.llm import chat as C
from hazardlake.llm import op3

BITS = ["<", "[", "\\", "|", *C.CONTROLS, "a", "\n", "INST]", "/s>", "end|>", "</", "x y"]


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        e = C.escape(t)
        assert C.unescape(e) == t and not any(c in e for c in C.CONTROLS)
        assert C.unescape_role(C.escape_role(t)) == t and "\n" not in C.escape_role(t)


def cut(turns, budget, history, share=0.3):
    w = C.Windower(budget, history, share)
    out = [x for r, t in turns for x in w.add(C.Turn.of(r, t, C.count_tokens))]
    return out + list(w.end())


def test_windows_hold_every_turn_once_and_mask_what_they_repeat():
    rng = random.Random(6)
    for _ in range(800):
        turns = [(rng.choice(["user", "assistant", "system", "tool\n"]), "".join(rng.choice(BITS) + " " for _ in range(rng.choice([0, 1, 5, 30, 80]))))
                 for _ in range(rng.randint(0, 12))]
        back, loss = [], []
        found = cut(turns, rng.choice([20, 60, 200]), rng.choice([0, 1, 2, 3]))
        for x in found:
            text, spans = x.render()
            parsed = C.parse(text)
            assert parsed == [(t.role, t.text) for t in x.turns]
            back += parsed[x.n_repeated:]
            loss += [C.unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2])]
            assert not x.over_budget or len(x.turns) - x.n_repeated == 1
            if turns[0][0] == "system" and x is not found[0] and not x.over_budget:
                assert x.turns[0].role == "system"
        assert back == turns
        assert loss == [t for r, t in turns if r == "assistant" and t]


def test_frame_with_nulls_ties_and_a_hot_conversation(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 3, "assistant", "x"), (None, 1, "user", "</s>")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = C.windows(df, budget=100).collect()
    turns: dict = {}
    for w in sorted(out, key=lambda r: (r.conv_id or -1, r.window)):
        turns.setdefault(w.conv_id, []).extend(C.parse(w.formatted)[w.n_repeated:])
    assert turns[1] == [("", ""), ("user", "hi"), ("user", "hi")]
    assert turns[None] == [("user", "</s>"), ("assistant", "x")]
    assert turns[9] == [(r[2], r[3]) for r in rows if r[0] == 9]
    assert C.windows(df.limit(0)).count() == 0


def test_query_reads_back_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in op3.op3_chat(spark, sf).collect()}
    turns: dict = {-7: [("user", op3.PROBE), ("assistant", op3.PROBE)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for conv, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[conv].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(ts), len(loss), sha256(loss.encode()).hexdigest())
