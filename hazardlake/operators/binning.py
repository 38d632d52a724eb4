"""Designs for tree growers: features cut into bins once, rows packed into blocks.

A bin number is the count of a feature's cuts below the value, so "bin <= b goes left" is "x <= cut b".  Cuts are the
middles between neighbouring values where a feature has at most ``max_bins`` of them, else weighted quantiles of
summaries that every partition makes of all its rows and that are merged by feature in a shuffle (rank error about
1 / SUMMARY).  A NaN lies in the last bin.

Tree growers that sum over all rows take the ranges by feature (``columns``): of each feature the rows of its commonest bin are
not listed, so mostly empty columns cost little, and sums are gathers over rows in the order of their codes.

``pack`` deals the rows to ranges of about ``CELLS`` cells, by falling time, and stores each range as blocks of
bytes; the number of ranges follows the data and not the cluster, since each pass over them is a Spark job.
"""
from __future__ import annotations

import math
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: Points kept of a feature in a partition's summary; cells (rows x features) of a range; most bins of a feature.
SUMMARY = 1024
CELLS = 4_000_000
MOST_BINS = 255
#: Results of so many tasks are added on the driver; more are first added in groups by tasks.
ADDENDS = 32


def features_array(col: str):
    """The features as an array; NULL stays NULL."""
    return F.when(F.col(col).isNotNull(), vector_to_array(F.col(col)))


def rows_of(batch, column: int, p: int) -> np.ndarray:
    """The rows of a list column as a matrix."""
    if not batch.num_rows:
        return np.zeros((0, p))
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def thin(values: np.ndarray, weights: np.ndarray, most: int):
    """At most about ``most`` of the sorted values, each with the weight up to it since the one before."""
    if len(values) <= most:
        return values, weights
    upto = np.cumsum(weights)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, most + 1) / most, side="left").clip(0, len(values) - 1))
    return values[at], np.diff(np.r_[0.0, upto[at]])


def merge(values: np.ndarray, weights: np.ndarray):
    v, at = np.unique(values, return_inverse=True)
    return v, np.bincount(at, weights=weights, minlength=len(v))


def cuts_of(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """Cut points of a weighted sample of a feature."""
    if len(values) > max_bins:
        upto = np.cumsum(weights)
        at = np.searchsorted(upto, upto[-1] * np.arange(1, max_bins) / max_bins, side="left")
        at = np.unique(at[at < len(values) - 1])
    else:
        at = np.arange(len(values) - 1)
    return (values[at] + values[at + 1]) / 2


def fit_cuts(df: DataFrame, features_col: str = "features", max_bins: int = 64) -> list[np.ndarray]:
    """Cuts of every feature from all rows; one list of at most ``max_bins`` numbers a feature reaches the driver."""
    if not 2 <= max_bins <= MOST_BINS:
        raise ValueError(f"max_bins must be 2 to {MOST_BINS}")
    ship_package(df.sparkSession)

    def summarise(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch, 0, 0)
            held = held or [(np.zeros(0), np.zeros(0))] * x.shape[1]
            for j in range(x.shape[1]):
                v, n = np.unique(x[~np.isnan(x[:, j]), j], return_counts=True)
                v, n = merge(np.r_[held[j][0], v], np.r_[held[j][1], n])
                held[j] = thin(v, n, SUMMARY) if len(v) > 4 * SUMMARY else (v, n)
        parts = [thin(v, n, SUMMARY) for v, n in held or []]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([v.tobytes() for v, _ in parts], pa.binary()),
                                          pa.array([n.astype(float).tobytes() for _, n in parts], pa.binary())], names=["j", "v", "n"])

    def join(batches):
        at, held = None, []

        def done():
            cuts = cuts_of(*merge(*(np.concatenate(c) for c in zip(*held))), max_bins)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([cuts.tobytes()], pa.binary())], names=["j", "cuts"])

        for batch in batches:
            for j, v, n in zip(*(c.to_pylist() for c in batch.columns)):
                if j != at:
                    if held:
                        yield done()
                    at, held = j, []
                held.append((np.frombuffer(v), np.frombuffer(n)))
        if held:
            yield done()

    parts = df.select(features_array(features_col).alias("x")).where("x is not null").mapInArrow(summarise, "j int, v binary, n binary")
    found = parts.repartition(df.sparkSession.sparkContext.defaultParallelism, "j").sortWithinPartitions("j").mapInArrow(join, "j int, cuts binary").collect()
    return [np.frombuffer(r["cuts"]) for r in sorted(found, key=lambda r: r["j"])]


def to_bins(x: np.ndarray, cuts: list) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def add_up(parts: DataFrame, n: int) -> DataFrame:
    """Adds arrays of doubles (``sums``) and numbers (``ll``) of many tasks in groups, so few reach the driver."""
    while n > ADDENDS:
        n = math.ceil(math.sqrt(n)) if n > ADDENDS * ADDENDS else ADDENDS

        def add(batches):
            total, ll = None, 0.0
            for batch in batches:
                for s, x in zip(batch.column(2), batch.column(1)):
                    s = np.frombuffer(s.as_py())
                    total, ll = s.copy() if total is None else total + s, ll + x.as_py()
            if total is not None:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "ll": [ll], "sums": [total.tobytes()]})

        parts = parts.repartition(n, F.col("part")).mapInArrow(add, parts.schema)
    return parts


class Block:
    """Rows of a range: bins, time, event, key and the score that trees so far give them."""

    def __init__(self, row, p: int):
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, p)
        self.time, self.event = np.frombuffer(row["time"]), np.frombuffer(row["event"])
        self.key = np.frombuffer(row["key"], np.uint64)
        self.score = np.frombuffer(row["score"])

    def __len__(self):
        return len(self.time)

    def pieces(self, most: int):
        """The rows in pieces of at most ``most``."""
        for i in range(0, len(self), most):
            piece = object.__new__(Block)
            for c in _NAMES:
                setattr(piece, c, getattr(self, c)[i:i + most])
            yield piece


BLOCKS = "bins binary, time binary, event binary, key binary, score binary"
_NAMES = [f.split()[0] for f in BLOCKS.split(", ")]


#: Rows of a block by feature: their numbers fit two bytes.
BLOCK_ROWS = 1 << 16
COLUMNS = "cols binary, common binary, time binary, event binary, score binary, code binary, size binary, rows binary"
#: Columns that tell the rows' scores and residuals.
ROW_COLUMNS = ("cols", "common", "time", "event", "score")
_COLUMN_TYPES = (("cols", np.uint8), ("common", np.int32), ("time", float), ("event", float), ("score", float), ("code", np.int32),
                 ("size", np.int32), ("rows", np.uint16))


class ColumnBlock:
    """Rows of a range by feature: bins as (feature, row), ``common`` the commonest code of each feature, and the rows of all other
    cells in the order of their codes (``code``, ``size`` rows each).  A code is a feature's first code plus the bin."""

    def __init__(self, **arrays):
        self.__dict__.update(arrays)
        self.cols = self.cols.reshape(-1, len(self.time))

    def __len__(self):
        return len(self.time)

    def _pieces(self, most: int = 1 << 16):
        """(codes, first place of each, rows) of whole codes, about ``most`` rows at a time."""
        ends = np.cumsum(self.size)
        starts, k = ends - self.size, 0
        while k < len(ends):
            e = max(int(np.searchsorted(ends, starts[k] + most, side="right")), k + 1)
            yield self.code[k:e], starts[k:e] - starts[k], self.rows[starts[k]:ends[e - 1]].astype(np.intp)
            k = e

    def histograms(self, values, own, nodes: int, features: np.ndarray):
        """Sums of ``values`` and numbers of rows by (node, code); ``own`` is a row's node, -1 for none.

        ``features`` names the feature of each code.  The commonest code of a feature has what its others leave of the node.
        """
        cells = len(features)
        inside = own >= 0
        if nodes <= 2:                                   # sums and numbers as one complex number, while its copies stay in the cache
            g, n = np.zeros((nodes, cells)), np.zeros((nodes, cells))
            held = [np.where(own == k, values, 0.0) + 1j * (own == k) for k in range(nodes)]
            for codes, starts, rows in self._pieces():
                for k, v in enumerate(held):
                    found = np.add.reduceat(v[rows], starts)
                    g[k, codes], n[k, codes] = found.real, found.imag
        else:
            hit = np.flatnonzero(inside[self.rows])
            rows = self.rows[hit]
            at = np.repeat(self.code, self.size)[hit] + own[rows] * cells
            g, n = (np.bincount(at, w, nodes * cells).astype(float).reshape(nodes, cells) for w in (values[rows], None))
        for k in range(nodes):
            mine = own == k
            for x, total in ((g, values[mine].sum()), (n, mine.sum())):
                x[k, self.common] = total - np.bincount(features, x[k], len(self.common))
        return g, n


def by_feature(block, first: np.ndarray) -> list:
    """The arrays of a ColumnBlock in the order of COLUMNS; ``first`` is the first code of each feature."""
    cols = np.ascontiguousarray(block.bins.T)
    common, codes, sizes, rows = [], [], [], []
    for j, c in enumerate(cols):
        counts = np.bincount(c)
        most = int(counts.argmax())
        common.append(first[j] + most)
        counts[most] = 0
        order = np.argsort(c, kind="stable")
        there = np.flatnonzero(counts)
        codes.append(first[j] + there), sizes.append(counts[there]), rows.append(order[c[order] != most])
    return [cols, np.array(common), block.time, block.event, block.score, *(np.concatenate(x) if x else np.zeros(0, int) for x in (codes, sizes, rows))]


def column_blocks(batches):
    """Blocks with the columns that the batches have."""
    for batch in batches:
        for i in range(batch.num_rows):
            got = {c: batch.column(c)[i].as_buffer() for c in batch.schema.names}
            sizes = {"cols": len(got["common"]) // 4 * (len(got["time"]) // 8), "rows": 2 * int(np.frombuffer(got["size"], np.int32).sum()) if "size" in got else 0}
            got |= {c: pa.decompress(got[c], sizes[c], "zstd") if sizes[c] else b"" for c in sizes if c in got}
            got = {c: np.frombuffer(got[c], t) for c, t in _COLUMN_TYPES if c in got}
            if "rows" in got:                            # both bytes of the gaps between rows, which wrap around
                got["rows"] = np.cumsum(np.ascontiguousarray(got["rows"].view(np.uint8).reshape(2, -1).T).view(np.uint16).ravel(), dtype=np.uint16)
            yield ColumnBlock(**got)


def column_batch(arrays: list) -> pa.RecordBatch:
    """Arrow row of a ColumnBlock; what reaches Python workers in every pass is compressed: columns, and gaps between rows."""
    data = {c: np.ascontiguousarray(a, t) for a, (c, t) in zip(arrays, _COLUMN_TYPES)}
    data["rows"] = np.ascontiguousarray(np.diff(data["rows"], prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T)
    data = {c: pa.compress(a.tobytes(), "zstd", asbytes=True) if c in ("cols", "rows") else a.tobytes() for c, a in data.items()}
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in data.values()], names=list(data))


def block_batch(blocks: list) -> pa.RecordBatch:
    """Arrow rows of (bins, time, event, key, score) arrays."""
    cols = list(zip(*blocks)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes() for a in c], pa.binary()) for c in cols], names=_NAMES)


def blocks_in(batches, p: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({c: batch.column(k)[i].as_py() for k, c in enumerate(_NAMES)}, p)


class PackedDesign:
    """Rows with features, time and event as a checkpointed table of blocks; rows that lack one of them are left out.

    ``ranges`` holds the rows by falling time, so a range's rows are no earlier than those of the next; rows of
    one time may lie in several ranges.  A design of at most ``held_cells`` cells (``held``) may be read by one task.
    """

    def __init__(self, df: DataFrame, features_col="features", time_col="time", event_col="event", id_col=None, max_bins=64,
                 cuts=None, cells: int = CELLS, held_cells: int = 0):
        spark = df.sparkSession
        ship_package(spark)
        key = F.xxhash64(F.col(id_col).cast("string")) if id_col else F.lit(0).cast("long")
        event = F.col(event_col).cast("boolean").cast("double") if event_col else F.lit(1.0)
        rows = df.select(F.col(features_col).alias("features"), F.col(time_col).cast("double").alias("time"), event.alias("event"),
                         key.alias("key")).where("features is not null and time is not null and event is not null and key is not null").where(~F.isnan("time"))
        rows = rows.select(features_array("features").alias("x"), "time", "event", "key")
        first = rows.select(F.size("x").alias("p"), F.lit(1)).agg(F.max("p").alias("p"), F.count("*").alias("n"), F.min("p").alias("q")).first()
        self.n, self.p = int(first["n"]), int(first["p"] or 0)
        if not self.n:
            raise ValueError("no rows with features, time and event to fit on")
        if first["q"] != self.p:
            raise ValueError("rows have different numbers of features")
        self.cuts = cuts if cuts is not None else fit_cuts(df, features_col, max_bins)
        self.bins = max((len(c) for c in self.cuts), default=0) + 1
        fits = self.n * self.p <= held_cells
        n_ranges = max(1, math.ceil(self.n * self.p / (min(cells, CELLS) if fits else cells)))
        cuts_, p, per_block = self.cuts, self.p, max(1, min(cells, CELLS) // max(self.p, 1))

        def pack(batches):
            held, size = [], 0

            def block():
                x, t, e, k = (np.concatenate(c) for c in zip(*held))
                return block_batch([(to_bins(x, cuts_), t, e, k, np.zeros(len(t)))])

            for batch in batches:
                if batch.num_rows:
                    held.append((rows_of(batch, 0, p), *(batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)),
                                 batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
                    size += batch.num_rows
                if size >= per_block:
                    yield block()
                    held, size = [], 0
            if held:
                yield block()

        order = [F.col("time").desc(), F.xxhash64("x", "event", "key")]
        dealt = rows.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
        self.data = cut_lineage(dealt.mapInArrow(pack, BLOCKS))
        self.n_ranges = self.data.rdd.getNumPartitions()
        self.held = fits or self.n_ranges == 1
        self.spark = spark
        self._columns, self._lock = None, Lock()

    def first_codes(self) -> np.ndarray:
        """Of each feature the number of bins of all features before it."""
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])[:-1]]).astype(np.int64) if self.cuts else np.zeros(0, np.int64)

    def columns(self) -> DataFrame:
        """The same ranges as a checkpointed table of ColumnBlocks, made once."""
        p, first = self.p, self.first_codes()

        def turn(batches):
            for b in blocks_in(batches, p):
                for piece in b.pieces(BLOCK_ROWS):
                    yield column_batch(by_feature(piece, first))

        with self._lock:
            if self._columns is None:
                self._columns = cut_lineage(self.data.mapInArrow(turn, COLUMNS))
            return self._columns
