"""Feature preprocessing fitted on train, applied anywhere (M1).

numeric: exact median imputation + standardisation (population std)
categorical: most-frequent imputation + one-hot on train categories
text: char n-gram TF-IDF with the train vocabulary and idf, projected on the
      top-k right singular vectors of the train TF-IDF matrix (no centring, ``svd``)

``transform`` is a projection and, for the text, a join on the distinct texts'
components, which are computed first and broadcast while they are few.  Fitted state (medians, means, categories, vocabulary, idf, V)
is bounded by the parameters, not by the row count.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import encode as E
from .svd import TextCorpus, TextSVD

#: Components of distinct texts (texts x k numbers, 32 MB) that are broadcast; more are joined by shuffling.
BROADCAST_CELLS = 4_000_000


@dataclass
class FittedPreprocessor:
    num_cols: list
    cat_cols: list
    text_col: str | None
    medians: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    text: TextSVD | None = None

    @property
    def k(self) -> int:
        return self.text.k if self.text else 0

    @property
    def singular_values(self) -> list:
        return self.text.singular_values if self.text else []

    @property
    def output_cols(self) -> list:
        """Names of the features, in the order of the vector."""
        out = [f"{c}__z" for c in self.num_cols]
        for c in self.cat_cols:
            out += [f"{c}__{v}" for v in self.categories[c]]
        return out + [f"svd_{i}" for i in range(self.k)]

    def text_key(self, df: DataFrame):
        return F.coalesce(F.col(self.text_col).cast("string"), F.lit(self.modes.get(self.text_col) or "0"))

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        nan = F.lit(float("nan"))                       # a column without any value in training
        scaled = E.scaled(self.num_cols, self.medians, self.stats)
        parts = F.array(*[F.coalesce(scaled[c], nan) for c in self.num_cols]).cast("array<double>")
        if self.cat_cols:
            parts = F.concat(parts, *[E.onehot_array(c, self.categories[c], self.modes.get(c)) for c in self.cat_cols])
        out = df
        if self.k:
            # projections are computed once per distinct text and joined back on the text
            proj = cut_lineage(self.text.project(df.select(self.text_key(df).alias("__txt")).distinct()))
            proj = F.broadcast(proj) if proj.count() * self.k <= BROADCAST_CELLS else proj
            out = out.withColumn("__txt", self.text_key(out)).join(proj, on="__txt", how="left").drop("__txt")
            parts = F.concat(parts, F.col("__svd"))
        return out.withColumn(features_col, array_to_vector(parts)).drop("__svd")

    def state(self) -> dict:
        return {"num_cols": self.num_cols, "cat_cols": self.cat_cols, "text_col": self.text_col, "medians": self.medians,
                "stats": {k: list(v) for k, v in self.stats.items()}, "categories": self.categories, "modes": self.modes,
                "text": self.text.state() if self.text else None}

    @classmethod
    def from_state(cls, s: dict) -> "FittedPreprocessor":
        return cls(s["num_cols"], s["cat_cols"], s["text_col"], s["medians"], {k: tuple(v) for k, v in s["stats"].items()},
                   s["categories"], s["modes"], TextSVD.from_state(s["text"]) if s["text"] else None)


def text_corpus(df: DataFrame, text_col: str, max_features: int) -> TextCorpus:
    """N-gram counts of a text column, for one or several vocabulary sizes (NULL: the most frequent text)."""
    mode = E.fit_modes(df, [text_col])[text_col]
    return TextCorpus(df.select(F.coalesce(F.col(text_col).cast("string"), F.lit(mode or "0")).alias("__txt")), max_features)


def fit_preprocessor(df: DataFrame, num_cols, cat_cols=(), text_col=None, tfidf_max_features=5000, svd_components=120, seed=42,
                     corpus: TextCorpus | None = None, text: TextSVD | None = None) -> FittedPreprocessor:
    """``corpus`` (counts) or ``text`` (components) of the same rows, if known, save the work on the text."""
    num_cols, cat_cols = list(num_cols), list(cat_cols)
    if not svd_components and text is None:
        text_col = None
    med = E.fit_medians(df, num_cols)
    fp = FittedPreprocessor(num_cols, cat_cols, text_col, med, E.fit_scaler(df, num_cols, med), {c: E.fit_categories(df, c) for c in cat_cols},
                            E.fit_modes(df, cat_cols + ([text_col] if text_col else [])))
    if text_col:
        if text is None:
            corpus = corpus or text_corpus(df, text_col, tfidf_max_features)
            text = corpus.svd(tfidf_max_features, svd_components, seed)
        fp.text = text
    return fp
