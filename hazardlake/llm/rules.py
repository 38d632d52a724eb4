"""Quality rules as a ledger of failure bits.

Native DataFrame expressions throughout.  Every rule is evaluated once for
every text: the ledger keeps the measurements and one bit for each rule that
fails.  A policy is a versioned set of rules, that is, a mask; verdicts,
policy comparisons and ablations are bit operations on the ledger and never
read the texts again.

Shares are compared in whole numbers.  NULL, empty and blank texts have no
words, so they fail ``few_words`` and nothing else.  Columns of the input pass
through, those with the name of an added column are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardlake.llm.common import let, spaced_words

SPAN = 8                      # words of a window
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim"]

#: (name, fails if): the place in the list is the bit.  Append only, so that stored ledgers stay readable.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_upper > 30 * word_chars"),
    ("exclamations", "100 * n_exclaim > 30 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "2024.1": ["few_words", "repeated_words", "symbols", "dup_lines", "shouting", "exclamations", "long_words"],
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows of ``SPAN`` words that the text holds twice or more.

    Windows are sorted by hash and compared word for word with their
    neighbours, so the cost is that of a sort, however often a text repeats.
    """
    def covered(w, h):
        def places(s):
            def same(k, j):
                return F.coalesce((F.get(s, k)["h"] == F.get(s, j)["h"]) & (
                    F.slice(w, F.get(s, k)["i"] + 1, F.lit(SPAN)) == F.slice(w, F.get(s, j)["i"] + 1, F.lit(SPAN))), F.lit(False))

            def beside(k):
                return F.when(k > 0, same(k, k - 1)).otherwise(F.lit(False)) | F.when(
                    k < F.size(s) - 1, same(k, k + 1)).otherwise(F.lit(False))

            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), beside), lambda k: F.get(s, k)["i"]))

        def total(p):
            steps = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(SPAN)), F.lit(SPAN)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, lambda s: let(places(s), total))).otherwise(F.lit(0))

    def hashed(w):
        starts = F.sequence(F.lit(1), F.size(w) - (SPAN - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(SPAN)))), lambda h: covered(w, h))

    return let(words, lambda w: F.when(F.size(w) > SPAN, hashed(w)).otherwise(F.lit(0))).cast("long")


def measures(column: str) -> list[Column]:
    raw = F.coalesce(F.col(column), F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    words = spaced_words(F.col(column))
    lines = F.filter(F.split(raw, "\n"), lambda x: F.translate(x, spaces, "") != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return [by_words.alias("__w"), by_lines.alias("__l"),
            (F.length(raw).cast("long") - _count(raw, spaces)).alias("word_chars"), _count(raw, SYMBOLS).alias("n_symbols"),
            _count(raw, UPPER).alias("n_upper"), _count(raw, "!").alias("n_exclaim")]


def ledger(df: DataFrame, column: str = "text") -> DataFrame:
    """Append the measurements and ``failures`` (bit i: rule i fails), both long."""
    new = {*MEASURES, "failures", "__w", "__l"}
    keep = [c for c in df.columns if c not in new]
    text = column if column in keep else None
    source = df if text else df.withColumn("__text", F.col(column))
    column = text or "__text"
    measured = source.select(*keep, *measures(column)).select(
        *keep, F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", F.col("__l.dup").alias("n_dup_lines"),
        F.col("__w.again").alias("n_repeat_words"), F.col("__l.n").alias("n_lines"), "n_upper", "n_exclaim")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures)


def rejected(policy: str) -> Column:
    """Whether a policy rejects a row of the ledger."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """By rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    The ledger is first counted by failure bits: at most 2^rules rows remain.
    """
    kinds = rows.groupBy("failures").agg(F.count("*").alias("n"))
    bits = F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    out = kinds.select("n", bits.alias("bits"), rule.alias("r")).select("n", "bits", "r.*")
    own = F.col("bits").bitwiseAND(F.col("bit")) != 0

    def total(c):
        return F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))

    return out.groupBy("rule").agg(total(own).alias("n_fail"), total(F.col("bits") == F.col("bit")).alias("n_fail_alone"),
                                   total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"))
