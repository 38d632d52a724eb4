"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns.  Its key is its depth and four sums, over its turns, of 32-bit hashes of
(position, role, text): sums of a conversation's prefixes are running sums, so a conversation of any length is cut
into ranges of turns, and stripping a node's last turn is a subtraction.

1. Conversations with equal sequences are merged: the smallest conv_id stands for them (``ended``).
2. Nodes that only one such sequence passes form its tail.  All their numbers are known from the sequence itself,
   so a tail leaves at once, however long, and enters the peeling as one child of the node above it.
3. Peeling descends from the deepest node that two sequences share.  Each round merges the sequences that end at this
   depth (or have their tail below it) with the nodes that survive from the round before, by their key; the merged rows are the
   nodes of this depth, complete.  Each then loses its last turn and is regrouped with the next round.  A round is
   one aggregation with map-side combine, written out; rows carry the turns that are left of the path.

The rounds are as many as the deepest shared node has turns.  SHA-256 of a node's ended conv_ids follows their order by
definition, so one task streams them, sorted, without holding them.

Turns are ordered by ``turn``, NULL first, then by role and by the SHA-256 of the text; repeated rows are repeated turns.
NULL role and text count as empty.  Rows without a conv_id belong to no conversation and are left out.  An empty
table has no nodes, not even a root.  Other columns are not read.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hazardlake.llm.common import materialise
from hazardlake.operators.ordered import prefix_sums, quantile_edges
from hazardlake.session import ship_package

#: Turns of a conversation that are summed in one range; longer conversations are cut by turn numbers.
RANGE_TURNS, MAX_RANGES = 10_000, 4_096
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ("p1", "p2", "p3", "p4")
TURN = ("q1", "q2", "q3", "q4")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, w): turns numbered from 1, 128 bits of role and text, and the words of the text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialise(rows.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("said"),
                                   F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("w")), "turns")
    numbered = _running(rows.withColumn("i", F.lit(1).cast("long")), ["turn", "role", "said"], ["i"])
    return numbered.select("conv_id", F.col("s_i").alias("i"), F.xxhash64("role", "said").alias("a"),
                           F.xxhash64("said", F.lit("|"), "role").alias("b"), "w")


def _running(rows: DataFrame, order: list, sums: list) -> DataFrame:
    """Running sums within each conversation; only conversations beyond RANGE_TURNS rows are cut into ranges."""
    long = rows.groupBy("conv_id").agg(F.count("*").alias("__rows")).where(F.col("__rows") > RANGE_TURNS)
    most = long.agg(F.max("__rows")).first()[0]
    edges = []
    if most:
        of_long = rows.join(long.select("conv_id"), on="conv_id", how="left_semi")
        edges = quantile_edges(of_long, order[0], min(MAX_RANGES, -(-most // RANGE_TURNS)))
    return prefix_sums(rows, order, sums, ["conv_id"], edges=edges, prefix="s_")


def rebuilt(rows: DataFrame, window: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their start with their host, the first conv_id of each ``window``.

    Returns (turns: conv_id, k, a, b, w; conversations: conv_id, depth).  The first h = crc32(conv_id) % ``most``
    turns come from the host, the others are the conversation's own after its first h.
    """
    sizes = materialise(rows.groupBy("conv_id").agg(F.count("*").alias("m")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", "m", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % window).alias("host"))
    hosts = sizes.select(F.col("conv_id").alias("host"), F.col("m").alias("host_m"))
    convs = materialise(convs.join(hosts, on="host", how="left").select(
        "conv_id", "host", "m", "h", F.least("h", F.coalesce("host_m", F.lit(0))).alias("g")), "convs")
    own = rows.join(convs.select("conv_id", "h", "g"), on="conv_id").where(F.col("i") > F.col("h")).select(
        "conv_id", (F.col("i") - F.col("h") + F.col("g")).alias("k"), "a", "b", "w")
    first = rows.where(F.col("i") < most).select(F.col("conv_id").alias("host"), F.col("i").alias("k"), "a", "b", "w")
    lent = convs.where("g > 0").select("conv_id", "host", F.explode(F.sequence(F.lit(1).cast("long"), F.col("g"))).alias("k"))
    lent = lent.join(first, on=["host", "k"]).select("conv_id", "k", "a", "b", "w")
    depth = F.col("g") + F.greatest(F.col("m") - F.col("h"), F.lit(0))
    return own.unionByName(lent), convs.select("conv_id", depth.alias("depth"))


def keyed(rows: DataFrame) -> DataFrame:
    """Turns with their own hashes (TURN), the key of the prefix that they end (KEY) and its words (``upto``)."""
    low = F.lit((1 << 32) - 1)
    x, y = F.xxhash64("k", "a", "b"), F.xxhash64("b", "k", "a")
    rows = rows.select("conv_id", "k", "w", x.bitwiseAND(low).alias("q1"), F.shiftrightunsigned(x, 32).alias("q2"),
                       y.bitwiseAND(low).alias("q3"), F.shiftrightunsigned(y, 32).alias("q4"))
    summed = _running(rows, ["k"], [*TURN, "w"])
    return summed.select("conv_id", "k", "w", *TURN, *[F.col(f"s_{q}").alias(p) for p, q in zip(KEY, TURN)], F.col("s_w").alias("upto"))


ENDED = "depth long, p1 long, p2 long, p3 long, p4 long, conv_id long, n long, all_words long, ends_sha256 string"


def ended(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each distinct whole sequence: its key, smallest conv_id, conversations, words and digest of their ids."""
    ship_package(convs.sparkSession)
    last = rows.select("conv_id", F.col("k").alias("depth"), *KEY, "upto")
    zero = F.lit(0).cast("long")
    ends = convs.join(last, on=["conv_id", "depth"], how="left").select(
        "depth", *[F.coalesce(p, zero).alias(p) for p in KEY], "conv_id", F.coalesce("upto", zero).alias("all_words"))

    def run(batches):
        key, state, done = None, None, []

        def flush():
            cols = [pa.array(c, pa.string() if i == 8 else pa.int64()) for i, c in enumerate(zip(*done))]
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in ENDED.split(", ")])

        for batch in batches:
            for depth, p1, p2, p3, p4, conv, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, p1, p2, p3, p4) != key:
                    if key is not None:
                        done.append((*key, *state[:3], state[3].hexdigest()))
                    key, state = (depth, p1, p2, p3, p4), [conv, 0, words, hashlib.sha256()]
                state[3].update(f"{',' if state[1] else ''}{conv}".encode())
                state[1] += 1
            if len(done) > 10_000:
                yield flush()
                done.clear()
        if key is not None:
            done.append((*key, *state[:3], state[3].hexdigest()))
            yield flush()

    return ends.repartition("depth", *KEY).sortWithinPartitions("depth", *KEY, "conv_id").mapInArrow(run, ENDED)


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes (NODE) of conversations given as turns (conv_id, k from 1, a, b, w) and (conv_id, depth)."""
    spark = rows.sparkSession
    rows = materialise(keyed(rows), "prefixes")
    whole = materialise(ended(convs, rows), "ended")
    of = whole.select("conv_id", F.col("depth").alias("end"), "n", "all_words", F.col("ends_sha256").alias("__ends"))
    path = materialise(rows.join(of, on="conv_id").withColumn("ends", F.when(F.col("k") == F.col("end"), F.col("__ends"))).drop("__ends"), "paths")

    # tails: nodes of one sequence
    passing = path.groupBy("k", *KEY).agg(F.count("*").alias("__m"), F.min(F.struct(
        "conv_id", "end", "n", "all_words", "upto", "w", *TURN, "ends")).alias("s"))
    tail = materialise(passing.where("__m = 1").select("k", *KEY, "s.*"), "tails")
    heads = tail.groupBy("conv_id").agg(F.min("k").alias("head"))
    entries = whole.join(heads, on="conv_id", how="left").select(
        "conv_id", "n", "all_words", (F.coalesce(F.col("head") - 1, F.col("depth"))).alias("depth"),
        F.col("head").isNotNull().alias("has_tail"), F.when(F.col("head").isNull(), F.col("ends_sha256")).alias("ends"))
    entries = materialise(entries, "entries")
    turn = F.struct("k", *TURN, "w")
    kept = path.select("conv_id", "k", *TURN, "w", *KEY, "upto").join(entries.select("conv_id", "depth"), on="conv_id").where("k <= depth")
    kept = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("path"), F.max(F.struct("k", *KEY, "upto")).alias("__at"))
    zero = F.lit(0).cast("long")
    entries = materialise(entries.join(kept, on="conv_id", how="left").select(
        "depth", *[F.coalesce(f"__at.{p}", zero).alias(p) for p in KEY], "path", "conv_id", F.col("n").alias("n_convs"),
        F.col("has_tail").cast("long").alias("n_children"), F.col("has_tail").cast("long").alias("n_leaves"),
        F.when(F.col("has_tail"), (F.col("n") - 1) * (F.col("all_words") - F.coalesce("__at.upto", zero))).otherwise(0).alias("saved_tokens"),
        "ends"), "entries")

    # peeling
    deepest = entries.agg(F.max("depth")).first()[0]
    levels = []
    alive = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = entries.where(F.col("depth") == d).drop("depth")
        merged = (here if alive is None else here.unionByName(alive)).groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("__leaves"), F.sum("saved_tokens").alias("__saved"), F.max("ends").alias("ends"), F.first("path").alias("path"))
        last = F.get("path", F.lit(d - 1))
        words = last["w"] if d else zero
        level = materialise(merged.select(
            F.lit(d).cast("long").alias("depth"), *KEY, "conv_id", "n_convs", "n_children",
            F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("__leaves")).cast("long").alias("n_leaves"),
            (F.col("__saved") + (F.col("n_convs") - 1) * words).alias("saved_tokens"), "ends",
            *[(F.col(p) - (last[q] if d else zero)).alias(f"up_{p}") for p, q in zip(KEY, TURN)], "path"), f"depth{d}")
        levels.append(level.drop("path"))
        if d:
            alive = level.select(*[F.col(f"up_{p}").alias(p) for p in KEY], F.slice("path", 1, d - 1).alias("path"), "conv_id",
                                 "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                                 F.lit(None).cast("string").alias("ends"))
    if not levels:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    shared = levels[0]
    for level in levels[1:]:
        shared = shared.unionByName(level)
    root = levels[-1].first()["conv_id"]

    # parents: of a tail's node the same conversation stands above, of the others the shared node that lacks their last turn
    below = tail.join(heads, on="conv_id").select(
        F.col("k").alias("depth"), *KEY, "conv_id", F.col("n").alias("n_convs"), (F.col("k") < F.col("end")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("all_words") - F.col("upto") + F.col("w"))).alias("saved_tokens"), "ends",
        *[(F.col(p) - F.col(q)).alias(f"up_{p}") for p, q in zip(KEY, TURN)], (F.col("k") > F.col("head")).alias("__own"))
    nodes = shared.withColumn("__own", F.lit(False)).unionByName(below)
    parents = shared.where("depth > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(p).alias(f"up_{p}") for p in KEY],
                                               F.col("conv_id").alias("__parent"))
    own = nodes.where("__own").withColumn("parent_conv_id", F.col("conv_id"))
    top = nodes.where("not __own and depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root)))
    rest = nodes.where("not __own and depth > 1").join(parents, on=["depth", *[f"up_{p}" for p in KEY]], how="left") \
        .withColumn("parent_conv_id", F.col("__parent")).drop("__parent")
    found = own.unionByName(top).unionByName(rest)
    return found.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).select(*NODE)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they stand."""
    rows = materialise(turns(conversations), "numbered")
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("depth"))
    return trie(rows.withColumnRenamed("i", "k"), convs)
