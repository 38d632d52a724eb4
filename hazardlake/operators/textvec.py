"""Character n-gram TF-IDF (M6-M8) relational (M9 lives in ``pipeline``).

Documents stay in long form (doc, term, tf) from the n-gram explode on; the
vocabulary cap keeps the ``max_features`` most frequent terms (ties by
term), idf = ln((1 + N) / (1 + df)) + 1 and rows are L2-normalised.  Whole
texts are processed; nothing is truncated.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def char_ngrams(df: DataFrame, id_col: str, text_col: str, n_min=3, n_max=6, lowercase=True) -> DataFrame:
    """M6: (id, term, tf) for all character n-grams, n in [n_min, n_max].

    Runs of two or more whitespace characters collapse to one space first.
    """
    s = F.regexp_replace(F.col(text_col).cast("string"), r"\s\s+", " ")
    if lowercase:
        s = F.lower(s)
    d = df.select(F.col(id_col).alias("__id"), s.alias("__s")).where(F.col("__s").isNotNull())
    def gram_of(n):
        return lambda i: F.substring(F.col("__s"), i + 1, F.lit(n))

    grams = []
    for n in range(n_min, n_max + 1):
        # sequence(0, -1) is not empty, so lengths below n are filtered first
        grams.append(F.when(F.length("__s") >= n, F.transform(F.sequence(F.lit(0), F.length("__s") - n), gram_of(n)))
                     .otherwise(F.array().cast("array<string>")))
    ex = d.select("__id", F.explode(F.flatten(F.array(*grams))).alias("term"))
    return ex.groupBy("__id", "term").agg(F.count(F.lit(1)).alias("tf")).withColumnRenamed("__id", id_col)


def tfidf(tf: DataFrame, docs: DataFrame, id_col: str, max_features: int | None = None) -> DataFrame:
    """M7 + M8: (id, term, weight) with smooth idf and L2 rows; ``docs`` lists every document."""
    n_docs = docs.select(id_col).distinct().agg(F.count(F.lit(1)).alias("__N"))
    if max_features:
        vocab = (tf.groupBy("term").agg(F.sum("tf").alias("__ctf"))
                 .orderBy(F.col("__ctf").desc(), F.col("term").asc()).limit(max_features).select("term"))
        # at most max_features rows
        tf = tf.join(F.broadcast(vocab), on="term", how="left_semi")
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("__df"))
    idf = df_.join(F.broadcast(n_docs), how="cross") \
        .select("term", (F.log((1.0 + F.col("__N")) / (1.0 + F.col("__df"))) + 1.0).alias("__idf"))
    w = tf.join(idf, on="term").withColumn("__w", F.col("tf") * F.col("__idf"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    return w.join(norm, on=id_col).select(id_col, "term", (F.col("__w") / F.col("__norm")).alias("weight"))


def tfidf_by_text(docs: DataFrame, id_col: str, text_col: str, max_features: int | None = None,
                  n_min=3, n_max=6) -> DataFrame:
    """M6-M8 for text columns with many repeated values: (id, term, weight).

    N-grams, corpus term frequencies, document frequencies and the L2 rows
    are computed once per distinct text, weighted by how many documents
    carry it; the rows are joined back to the document ids on the text
    (a hot text is split by AQE's skew join).  Same result as ``tfidf``.
    """
    texts = docs.groupBy(text_col).agg(F.count(F.lit(1)).alias("__cnt"))
    tf = char_ngrams(texts, text_col, text_col, n_min, n_max).join(texts, on=text_col)
    n_docs = texts.agg(F.sum("__cnt").alias("__N"))
    if max_features:
        vocab = (tf.groupBy("term").agg(F.sum(F.col("tf") * F.col("__cnt")).alias("__ctf"))
                 .orderBy(F.col("__ctf").desc(), F.col("term").asc()).limit(max_features).select("term"))
        tf = tf.join(F.broadcast(vocab), on="term", how="left_semi")  # at most max_features rows
    dfreq = tf.groupBy("term").agg(F.sum("__cnt").alias("__df"))
    idf = dfreq.join(F.broadcast(n_docs), how="cross") \
        .select("term", (F.log((1.0 + F.col("__N")) / (1.0 + F.col("__df"))) + 1.0).alias("__idf"))
    w = tf.join(idf, on="term").withColumn("__w", F.col("tf") * F.col("__idf"))
    norm = w.groupBy(text_col).agg(F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"))
    per_text = w.join(norm, on=text_col).select(text_col, "term", (F.col("__w") / F.col("__norm")).alias("weight"))
    return docs.select(id_col, text_col).join(per_text, on=text_col).select(id_col, "term", "weight")
