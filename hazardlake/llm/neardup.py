"""Near-duplicate documents: MinHash, banding, verification on full sets, connected components.

1. One pass turns every text into its set of word shingles, the set's digest
   (the node) and ``bands x rows`` minima of universal hashes.  Equal sets are
   one node, so copies cost one row each and are never compared.
2. Nodes that share a band are compared with the bucket's most central node
   (the one whose bands are shared most): a star, not all pairs.  Pairs whose
   signatures could not come from similar sets are left out, the others are
   confirmed on their full sets.
3. Components come from alternating large-star and small-star rounds.
4. A link may join two members of a bucket neither of which is like its
   centre.  So in every star that holds several components, the nodes outside
   its largest one meet all others, in blocks of bounded size and on full sets;
   tasks hand on one link for each node and component, not pairs.  Then the
   components are formed again.  After that every pair that shares a band is
   confirmed, rejected, or in one component.

With 28 bands of 5 minima a pair of similarity 0.8 shares no band with
probability 1.5e-5; pairs within a component reach each other over many links.

Nodes are digests; a group may hold any share of the rows.  Texts are read
again only for nodes in candidate pairs.

NULL, empty and blank texts have no shingles and are linked with nothing.
Rows of one doc_id are separate rows of their own texts; a component's id is
its smallest doc_id (NULL ids count only where there is no other).
"""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from hazardlake.llm.common import forget, materialise, slices
from hazardlake.session import ship_package

BANDS, ROWS = 28, 5
SHINGLE, MIN_PERCENT = 5, 80
MAYBE = 0.62             # signatures that agree less cannot come from sets of similarity 0.8 (over 5 deviations)
MINOR_BLOCK, STAR_BLOCK = 512, 16_384    # nodes of a block
BROADCAST_IDS = 1_000_000    # ids, 8 MB: beyond it the texts are joined by shuffling
ASCII_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_rng = np.random.default_rng(20240229)
MULT = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(33))) * M2
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``size`` make one shingle."""
    words = text.translate(ASCII_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        acc = mix(acc * M1 + h[i:len(h) - width + 1 + i])
    return np.unique(acc)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS universal hash functions over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at:at + 2048, None] * MULT + PLUS).min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for col in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        acc = mix(acc * M1 + col)
    return acc.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, node, sig, bands) of every row; node is NULL for texts without words."""
    ship_package(df.sparkSession)

    def run(batches):
        forget()
        for batch in chain.from_iterable(map(slices, batches)):
            n, node, sigs, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                if len(s):
                    sig = signature(s)
                    node.append(xxh3_128_digest(s.tobytes()))
                    sigs.append(sig.tobytes())
                    keys.append(band_keys(sig))
                else:
                    node.append(None)
                    sigs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sigs, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "node", "sig", "bands"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(
        run, f"doc_id {kind}, text_key long, n_shingles long, node binary, sig binary, bands array<long>")


def full_sets(wanted: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, full): the shingle sets of the wanted nodes, read again from one text each, found by its hash."""
    keys = materialise(wanted.join(nodes.select("node", "text_key"), "node").select("text_key").distinct(), "wanted")
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    text = F.col(text_col).cast("string")
    texts = df.select(text.alias("text"), F.xxhash64(text).alias("text_key")).join(keys, "text_key", "left_semi").select("text")

    def sets(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            found = [shingles(t, size) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            found = {xxh3_128_digest(raw): raw for raw in (s.tobytes() for s in found if len(s))}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                                             names=["node", "full"])

    return materialise(texts.mapInArrow(sets, "node binary, full binary").join(wanted, "node", "left_semi"), "sets")


class Minors:
    """Nodes of a block, with an index from shingles to nodes."""

    def __init__(self, rows: list):
        self.nodes, self.labels = [r[0] for r in rows], np.array([r[1] for r in rows], object)
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.done: set = set()

    def links(self, node, label, raw, min_percent):
        """(minor, node) for similar minors of other components: the first of each minor and component."""
        x = np.frombuffer(raw, np.uint64)
        low, high = np.searchsorted(self.values, x, "left"), np.searchsorted(self.values, x, "right")
        n = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        hit = np.flatnonzero((100 * both >= min_percent * (self.sizes + len(x) - both)) & (self.labels != label))
        for i in hit.tolist():
            if (i, label) not in self.done:
                self.done.add((i, label))
                yield self.nodes[i], node


def across(shared: DataFrame, labels: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str,
           size: int, min_percent: int) -> DataFrame:
    """Links between different components of a star: its nodes outside the largest one against all of it."""
    star = shared.where("members > 2").select("center", "node").distinct().join(labels, "node", "left").select(
        "center", "node", F.coalesce("label", "node").alias("label"))
    star = materialise(star, "stars")
    sizes = star.groupBy("center", "label").agg(F.count("*").alias("n"))
    head = sizes.groupBy("center").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = head.select("center", F.col("top.label").alias("main"),
                         F.ceil((F.col("n") - F.col("top.n")) / MINOR_BLOCK).cast("int").alias("ni"),
                         F.ceil(F.col("n") / STAR_BLOCK).cast("int").alias("nj"))
    mixed = materialise(star.join(blocks, "center"), "mixed")
    if mixed.isEmpty():
        return shared.select(F.col("center").alias("a"), F.col("node").alias("b")).limit(0)

    def part(n, seed):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    minors = mixed.where("label <> main").select("center", part("ni", 1).alias("i"), every("nj").alias("j"), F.lit(0).alias("role"), "node", "label")
    others = mixed.select("center", every("ni").alias("i"), part("nj", 2).alias("j"), F.lit(1).alias("role"), "node", "label")
    full = full_sets(mixed.select("node").distinct(), nodes, df, id_col, text_col, size)
    rows = minors.union(others).join(full, "node").select("center", "i", "j", "role", "label", "node", "full")

    def compare(batches):
        key, held, block = None, [], None
        for batch in batches:
            out = []
            cols = [c.to_pylist() for c in batch.columns]
            for center, i, j, role, label, node, raw in zip(*cols):
                if (center, i, j) != key:
                    key, held, block = (center, i, j), [], None
                if role == 0:
                    held.append((node, label, raw))
                    continue
                if block is None:
                    block = Minors(held)
                    held = []
                out += block.links(node, label, raw, min_percent)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    links = (rows.repartition("center", "i", "j").sortWithinPartitions("center", "i", "j", "role")
             .mapInArrow(compare, "a binary, b binary"))
    return materialise(links.distinct(), "across")


def confirm(pairs: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str,
            size: int, min_percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow it and whose full sets confirm it."""
    def likely(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for i in (2, 3))
            ok = (a == b).mean(axis=1) >= MAYBE
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    sig = nodes.select("node", "sig")
    kept = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(likely, "a binary, b binary"))
    kept = materialise(kept, "likely")
    full = full_sets(kept.select(F.col("a").alias("node")).union(kept.select("b")).distinct(), nodes, df, id_col, text_col, size)

    def similar(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= min_percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    links = (kept.join(full.select(F.col("node").alias("b"), F.col("full").alias("fb")), "b")
             .join(full.select(F.col("node").alias("a"), F.col("full").alias("fa")), "a")
             .select("a", "b", "fa", "fb").mapInArrow(similar, "a binary, b binary"))
    return materialise(links.distinct(), "links")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without links are left out.

    Alternating large-star and small-star rounds until the edges stay as they are.
    """
    def stamp(e):
        r = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], r[1]

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = stamp(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        edges = materialise(small, "edges")
        after = stamp(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = after
    raise RuntimeError("connected components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    min_percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df``.

    Rows without an id are linked as others are; a component of none but such rows has no component_id.
    """
    sig, classes, labels = clusters(df, id_col, text_col, shingle, min_percent)
    grouped = classes.select("node", "lo", "copies").join(labels, "node", "left")
    lowest = (grouped.where("label is not null").groupBy("label").agg(F.min("lo").alias("component_id")))
    named = (grouped.where("label is not null").join(lowest, "label").select("node", "component_id")
             .union(grouped.where("label is null and copies > 1").select("node", F.col("lo").alias("component_id"))))
    out = sig.select("doc_id", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def clusters(df: DataFrame, id_col: str, text_col: str, shingle: int, min_percent: int):
    """Signatures of the rows, classes of equal shingle sets (node), and the labels of those that are linked."""
    sig = materialise(signatures(df, id_col, text_col, shingle), "signatures")
    classes = materialise(sig.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("lo"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"),
        F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    often = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    inside = materialise(rows.join(often, "band").select("band", "members", "node"), "buckets")
    central = inside.groupBy("node").agg(F.sum("members").alias("score"))
    centers = (inside.join(central, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("top"))
               .select("band", F.col("top.node").alias("center")))
    shared = materialise(inside.join(centers, "band").select("members", "center", "node").distinct(), "stars")
    pairs = shared.where("center <> node").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(pairs, classes, df, id_col, text_col, shingle, min_percent)
    labels = materialise(components(links), "labels")
    more = across(shared, labels, classes, df, id_col, text_col, shingle, min_percent)
    if not more.isEmpty():
        labels = materialise(components(links.union(more)), "labels")
    return sig, classes, labels


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row of each component of ``df``, with all its columns.

    The row with the smallest id stays (no id comes last, then the text's hash decides); rows are judged by their own text, also
    where an id is repeated, and of rows that repeat id and text one stays.  Rows without shingles all stay.
    """
    sig, classes, labels = clusters(df, id_col, text_col, shingle, min_percent)
    rows = sig.where("node is not null").join(labels, "node", "left").select(
        "doc_id", "text_key", F.coalesce("label", "node").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    first = rows.groupBy("component").agg(F.min(place).alias("f"), F.count("*").alias("members")).where("members > 1")
    judged = rows.join(first, "component").select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(F.col("f.id")) & (
        F.col("text_key") == F.col("f.key"))).alias("__stays"))
    judged = materialise(judged.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__stays").agg(F.count("*").alias("__times"))
                         .where("not __stays or __times > 1"), "judged")
    if judged.count() <= BROADCAST_IDS:
        judged = F.broadcast(judged)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__key"))
    marked = df.join(judged, same, "left")
    once = marked.where("__stays").select(*df.columns).dropDuplicates([id_col, text_col])
    return marked.where("__stays is null").select(*df.columns).unionByName(once)
