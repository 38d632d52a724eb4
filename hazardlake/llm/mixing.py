"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the mean number of times that the mix holds it.  Among all rates between 0 and
``most`` (3) whose words sum up to each source's target, the mix takes those closest to one copy each: least
relative entropy against rate 1, with the entropy of the room up to ``most`` beside it so that no rate passes it.
The solution is an exponential tilt by the document's words z,

    odds(z) = odds(1 copy) * exp(lambda_s * z / scale_s),    rate = most * odds / (1 + odds),

with one multiplier a source, the maximiser of the concave dual.  Newton steps find all multipliers together:
each is one aggregate over the table (source, size, documents), guarded by a bracket around each root.  A source
whose target is ``most`` times its size has rate ``most`` throughout.

Rates become copies: the whole part is taken, and of the documents of one source and size (in cells of at most
about ``CELL_ROWS``) so many get one more that the words still owed are met; what a cell misses is carried to the
next smaller size, and what a source misses at its end moves the copies of a few documents that fit into it.
Which documents these are follows a hash of their content, so reruns agree.

Targets: sources in code-point order, NULL last, weigh ``weights`` in turn; no target exceeds ``most`` times the
source's words, the excess is shared by weight among the others until none is above.

NULL and empty texts have size 0, one copy and nothing taken; a source of none but them has target 0.  Repeated rows are
documents of their own.  Empty tables give no rows.  Columns not named in ``keep`` are left out; those that
are take the place of none of the operator's columns (a clash raises ValueError).
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hazardlake.llm.common import materialise
from hazardlake.session import ship_package

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
CELL_ROWS = 50_000
#: Source and size tables up to so many rows are broadcast; larger ones meet the documents in a shuffled join.
SMALL_ROWS = 100_000
TOLERANCE, MAX_STEPS = 1e-9, 200
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ADDED = ("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def numbered(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``col``, NULL last, without a window over all of them."""
    order = F.col(col).asc_nulls_last()
    rows = materialise(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    offset, total = [], 0
    for p, n in sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):   # one row a partition
        offset.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(offset, "__p long, __start long")
    return rows.withColumn("__p", part).join(F.broadcast(starts), on="__p").withColumn(
        out, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__at", "__start")


def with_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds ``target`` to sources numbered by ``i`` with their words ``source_size``."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    level, full = 0.0, -1
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        above = weight * F.lit(level) > limit
        r = sources.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("held"),
                        F.sum(F.when(~above, weight)).alias("open"), F.count_if(above).alias("full")).first()
        if r["full"] == full or not r["open"]:
            break
        full, level = r["full"], (total - r["held"]) / r["open"]
    return sources.withColumn("target", F.least(weight * F.lit(level), limit))


def rate_of(lam, size, scale, most: float = MOST):
    """Rate of a document by its size; ``lam`` NULL stands for a source that is taken ``most`` times as a whole."""
    tilt = F.lit(-math.log(most - 1)) + lam * size / scale
    return F.when(lam.isNull(), F.lit(float(most))).otherwise(F.lit(float(most)) / (F.lit(1.0) + F.exp(-tilt)))


def solve(profile: DataFrame, sources: DataFrame, most: float = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds the multiplier ``lam`` to ``sources``, by Newton steps on the dual over ``profile`` (i, size, n)."""
    inf = float("inf")
    whole = F.col("target") >= float(most) * F.col("source_size") * (1 - 1e-12)
    state = materialise(sources.withColumns({
        "lam": F.when(~whole, F.lit(0.0)), "__lo": F.lit(-inf), "__hi": F.lit(inf), "__open": ~whole}), "dual")
    profile = profile.where("size > 0")
    for _ in range(MAX_STEPS):
        asked = state.where("__open").select("i", "target", "scale", "lam")
        z = F.col("size").cast("double")
        rate = rate_of(F.col("lam"), z, F.col("scale"), most)
        slope = z * z / F.col("scale") * rate * (1 - rate / float(most))
        sums = profile.join(small(asked), on="i").groupBy("i").agg(
            F.sum(F.col("n") * z * rate).alias("__words"), F.sum(F.col("n") * slope).alias("__slope"))
        gap = F.col("__words") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("__lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("__hi"))
        widest = F.greatest(F.lit(2.0), F.abs("lam"))      # a step at most doubles the tilt
        newton = F.when(F.col("__slope") > 0, -gap / F.col("__slope")).otherwise(-F.signum(gap) * widest)
        at = F.col("lam") + F.greatest(-widest, F.least(widest, newton))
        inside = (at > F.col("__lo2")) & (at < F.col("__hi2"))
        step = F.when(inside, at).otherwise((F.col("__lo2") + F.col("__hi2")) / 2)
        done = F.abs(gap) <= F.lit(tolerance) * F.col("target") + F.lit(1e-9)
        moved = state.join(sums, on="i", how="left").withColumns({"__lo2": lo, "__hi2": hi})
        live = F.col("__open") & F.col("__words").isNotNull()
        state = materialise(moved.withColumns({
            "__now": live & ~done & (F.col("__lo2") < F.col("__hi2")), "__step": step}).select(
            *sources.columns, F.when(F.col("__now"), F.col("__step")).otherwise(F.col("lam")).alias("lam"),
            F.when(F.col("__now"), F.col("__lo2")).otherwise(F.col("__lo")).alias("__lo"),
            F.when(F.col("__now"), F.col("__hi2")).otherwise(F.col("__hi")).alias("__hi"), F.col("__now").alias("__open")), "dual")
        if not state.where("__open").limit(1).count():
            return state.drop("__lo", "__hi", "__open")
    raise RuntimeError(f"the dual did not converge in {MAX_STEPS} steps")


def _owed(most: float):
    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of each cell beyond the whole part of its rate, from the largest size down; what is missed is carried on.

        First no document leaves the two whole numbers beside its rate; what a source then still misses goes
        to the largest documents that fit into it, within 0 and ``most`` copies.
        """
        pdf = pdf.sort_values(["size", "salt"], ascending=[False, True])
        z, c, whole = pdf["size"].to_numpy(float), pdf["n"].to_numpy(), pdf["whole"].to_numpy()
        want = pdf["part"].to_numpy(float) * c
        more, err = np.zeros(len(pdf), np.int64), 0.0
        for k in np.flatnonzero(z > 0):
            owed = want[k] * z[k] + err
            more[k] = min(max(round(owed / z[k]), 0), c[k] if whole[k] < most else 0)
            err = owed - more[k] * z[k]
        for k in np.flatnonzero((z > 0) & (z < 2 * abs(err))):
            moved = min(max(round(err / z[k]), -whole[k] * c[k] - more[k]), (most - whole[k]) * c[k] - more[k])
            more[k], err = more[k] + moved, err - moved * z[k]
        return pdf[["i", "size", "salt", "n"]].assign(more=more)
    return spread


def mix(docs: DataFrame, id_col="doc_id", text_col="text", group_col="source", keep=(), weights=WEIGHTS, most: int = MOST,
        cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: ADDED and the columns of ``keep``; ``copies`` (0 to ``most``) says how often the mix holds it."""
    if clash := set(keep) & set(ADDED):
        raise ValueError(f"columns {sorted(clash)} clash with the operator's")
    ship_package(docs.sparkSession)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(group_col).alias("source"), *keep, words.alias("size"),
        F.xxhash64(F.col(id_col), F.col(group_col), F.col(text_col)).alias("__u")), "sizes")
    counted = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "profile")
    z = F.col("size").cast("double")
    sources = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                            F.sum(F.col("n") * z * z).alias("__zz"))
    sources = numbered(sources.select("source", "source_size", F.when(F.col("source_size") > 0, F.col("__zz") / F.col("source_size"))
                                      .otherwise(F.lit(1.0)).alias("scale")), "source", "i")
    sources = materialise(sources, "sources")
    sources = materialise(with_targets(sources, weights, most), "targets")
    same = F.col("source").eqNullSafe(F.col("__source"))
    number = small(sources.select(F.col("source").alias("__source"), "i"))
    profile = materialise(counted.join(number, on=same).select("i", "size", "n"), "profile")
    solved = solve(profile, sources, most)

    # cells of documents that share source and size, hence the rate
    salts = F.ceil(F.col("n") / F.lit(cell_rows))
    dealt = profile.join(small(solved.select("i", "lam", "scale")), on="i")
    rate = rate_of(F.col("lam"), F.col("size").cast("double"), F.col("scale"), most)
    dealt = dealt.withColumn("rate", rate).select("i", "size", "n", "rate", F.floor("rate").alias("whole"),
                                                  (F.col("rate") - F.floor("rate")).alias("part"), salts.alias("salts"))
    crowded = small(dealt.where("salts > 1").select("i", "size", "salts"))
    by_source = small(solved.select(F.col("source").alias("__source"), "i", "source_size", "target", "lam", "scale"))
    placed = rows.join(by_source, on=same).join(crowded, on=["i", "size"], how="left").withColumn(
        "salt", F.when(F.col("salts").isNotNull(), F.pmod("__u", "salts")).otherwise(F.lit(0)).cast("long")).drop("__source", "salts")
    cells = placed.groupBy("i", "size", "salt").agg(F.count("*").alias("n"))
    shares = dealt.select("i", "size", "whole", "part")
    more = cells.join(shares, on=["i", "size"]).groupBy("i").applyInPandas(_owed(most), "i long, size long, salt long, n long, more long")
    more = materialise(more, "owed")
    chosen = placed.join(more, on=["i", "size", "salt"], how="left")
    rank = F.expr("row_number() over (partition by i, size, salt order by __u, doc_id)")
    rate = rate_of(F.col("lam"), F.col("size").cast("double"), F.col("scale"), most)
    even = F.floor(F.col("more") / F.col("n"))                      # of every document of the cell; the first ones get one more
    copies = F.floor("rate") + even + (F.col("__rank") <= F.col("more") - even * F.col("n")).cast("long")
    return chosen.withColumns({"__rank": rank, "rate": rate}).withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its ``copies`` say, numbered by ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
