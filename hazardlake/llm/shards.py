"""Sharding over fixed virtual slots.

Native DataFrame expressions throughout.  A record's slot is a hash of its id:
``SLOTS`` slots, for ever.  Bytes are summed by slot (combined before the
shuffle), and a versioned map says which shard holds which slot.  The map is a
table of ``SLOTS`` rows by version; rebalancing or adding a shard writes a new
version and moves as few slots as the balance needs.

A record is as large as its text in UTF-8 plus ``OVERHEAD``; a NULL text has
no bytes.  Rows that repeat an id share its slot.  A NULL id is an id.
Sorting and numbering happen inside small cells of a slot, so no shard, slot
or repeated text is ever sorted in one task; an id that fills a slot by itself
is numbered by the rest of its row.
"""
from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hazardlake.session import ensure_checkpoint_dir

SLOTS = 4096                 # fixed for the life of the data set
CELLS = 64                   # parts of a slot in which records are numbered
OVERHEAD = 1


def slot_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SLOTS)).cast("int")


def record_size(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long")


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes by slot: ``SLOTS`` rows at most reach the driver."""
    return {r.v_slot: r.n for r in records.groupBy("v_slot").agg(F.sum("size").alias("n")).collect()}


# ------------------------------------------------------------ slot maps (SLOTS entries, on the driver)

def first_map(sizes: dict[int, int], shards: int) -> list[int]:
    """Slots by falling size, each to the shard with the fewest bytes (then slots) so far."""
    load = [(0, 0, s) for s in range(shards)]
    out = [0] * SLOTS
    for v in sorted(range(SLOTS), key=lambda v: (-sizes.get(v, 0), v)):
        n, k, s = heapq.heappop(load)
        out[v] = s
        heapq.heappush(load, (n + sizes.get(v, 0), k + 1, s))
    return out


def rebalance(old: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """An edit of ``old`` for ``shards`` shards: slots move from shards above the mean to those below it only."""
    out = list(old)
    total = sum(sizes.values())
    load = [0] * max(shards, max(old) + 1)
    for v, s in enumerate(old):
        load[s] += sizes.get(v, 0)
    mean = total / shards
    free = [v for v in range(SLOTS) if old[v] >= shards]                    # slots of shards that end
    for s in range(shards):
        over = load[s] - mean
        for v in sorted((v for v in range(SLOTS) if old[v] == s), key=lambda v: (-sizes.get(v, 0), v)):
            n = sizes.get(v, 0)
            if 0 < n <= over:
                free.append(v)
                load[s] -= n
                over -= n
    room = [(load[s], s) for s in range(shards)]
    heapq.heapify(room)
    for v in sorted(free, key=lambda v: (-sizes.get(v, 0), v)):
        n, s = heapq.heappop(room)
        out[v] = s
        heapq.heappush(room, (n + sizes.get(v, 0), s))
    return out


def map_rows(spark: SparkSession, slots: list[int], version: int) -> DataFrame:
    """(version, v_slot, shard): the map as a table of SLOTS rows."""
    shard = F.element_at(F.split(F.lit(",".join(map(str, slots))), ","), (F.col("id") + 1).cast("int")).cast("int")
    return spark.range(SLOTS).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("v_slot"), shard.alias("shard"))


class MapStore:
    """Versioned slot maps under one folder of the shared store, one sub-folder for each version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"

    def save(self, slots: list[int], version: int) -> DataFrame:
        map_rows(self.spark, slots, version).coalesce(1).write.parquet(f"{self.path}/v={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("version int, v_slot int, shard int").parquet(f"{self.path}/v={version}")

    def slots(self, version: int) -> list[int]:
        return [r.shard for r in self.load(version).orderBy("v_slot").collect()]


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append ``size`` and ``v_slot``."""
    return df.withColumn("size", record_size(text_col)).withColumn("v_slot", slot_of(id_col))


def assign(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", tie: str | None = None) -> DataFrame:
    """Append ``shard`` and ``slot``, the record's gapless number inside its shard.

    Records are numbered in a cell (slot and a second hash of the row); the
    cells' offsets come from ``SLOTS * CELLS`` counts.
    """
    tie = tie or id_col
    placed = (rows.join(F.broadcast(slot_map.select("v_slot", "shard")), "v_slot")          # SLOTS rows
              .withColumn("__cell", F.pmod(F.xxhash64(id_col, tie, F.lit(7)), F.lit(CELLS)).cast("int")))
    counts = placed.groupBy("shard", "v_slot", "__cell").agg(F.count("*").alias("n"))       # SLOTS * CELLS rows at most
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("v_slot", "__cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "v_slot", "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("shard", "v_slot", "__cell").orderBy(id_col, tie))
    return (placed.withColumn("__in", inside).join(offsets, ["shard", "v_slot", "__cell"])
            .withColumn("slot", (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__in", "__before", "__cell"))
