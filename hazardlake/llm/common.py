"""Helpers shared by the training-data operators."""
from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hazardlake.session import ensure_checkpoint_dir, ship_package

ASCII_SPACE = "\x20\x09-\x0d"            # the white space of the word definition
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SLICE_BYTES = 2 << 20                     # of an Arrow batch that are Python objects at a time


_held: list = [None, None]


def worker_memory(owner, make):
    """What a Python worker remembers between tasks: the ``make()`` of one owner; another owner's takes its place.

    Workers are reused by stage after stage, so that what several operators
    remember would add up otherwise.
    """
    if _held[0] is None or _held[0] != owner:
        _held[:] = [None, None]            # the memory goes before the new one grows
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):         # glibc only: freed pages go back to the system
            ctypes.CDLL(None).malloc_trim(0)
        _held[:] = [owner, make()]
    return _held[1]


def forget():
    """Lets go of what an operator before remembered in this worker."""
    if _held[0] is not None:
        worker_memory(("nothing",), lambda: None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with a columnar table that every executor can read, so a
    lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """The rows of a batch in order, in slices of about ``most`` bytes: Spark cuts batches by rows, however long these are."""
    rows = batch.num_rows
    step = max(1, rows * most // max(batch.nbytes, 1))
    for i in range(0, max(rows, 1), step):
        yield batch.slice(i, step)


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make) -> DataFrame:
    """Append columns computed per slice of an Arrow batch; every other column passes through untouched.

    ``make()`` runs once per task and returns ``fn(*lists) -> list of lists``
    (one per field).  A column of ``df`` that has the name of a new field is
    replaced.
    """
    ship_package(df.sparkSession)
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType(keep + list(fields))
    kept = [f.name for f in keep]
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        fn = make()
        for batch in chain.from_iterable(map(slices, batches)):
            at = {n: i for i, n in enumerate(batch.schema.names)}
            out = fn(*(batch.column(at[c]).to_pylist() for c in inputs))
            arrays = [batch.column(at[c]) for c in kept]
            arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(c):
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; NULL and blank texts give an empty array."""
    flat = F.trim(F.translate(F.coalesce(c, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """Rows with the largest ``n``: all above a threshold chosen so that at most ``limit`` remain.

    Only a histogram of ``n`` (eight steps to a doubling) reaches the driver
    before; a sort with a limit would send ``limit`` rows of every partition.
    """
    step = F.floor(F.log2(F.col(n)) * 8)
    total, least = 0, None
    for s, rows in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if total + rows > limit:
            break
        total, least = total + rows, s
    return counts.where(step >= least) if least is not None else counts.limit(0)
