"""One family of Estimators and Models for survival data, usable in ``pyspark.ml`` Pipelines.

Every estimator has Params (columns, hyper-parameters, seed), takes param maps in ``fit(df, {est.alpha: 0.1})`` and returns a
Model whose ``transform`` adds one risk column, larger for an earlier event.  Estimators, Models and Pipelines of
them save to and load from a shared folder: metadata as ``pyspark.ml`` writes them, and a state beside them
(small states as one JSON row, a forest's trees as a parquet table).  A row without features gets a NULL risk.

============================  =======================================================
``Preprocessor``              M1: imputation, scaling, one-hot, text components -> features
``RidgeTime``                 G1: ridge on time
``BoostedTime``               G2: boosted trees on time
``KMeansRisk``                G3: clusters and their median time
``CoxPH``, ``Coxnet``         G5, G6
``BoostedCox``                G8
``ForestRisk``                G10
``RankMean``                  N1: mean of the scaled ranks of risk columns (a Transformer: ranks are those of the table it is given)
============================  =======================================================
"""
from __future__ import annotations

import json

import numpy as np
from pyspark.ml.base import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters as C
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import boosting as B
from .operators import cluster as K
from .operators import forest as Fo
from .operators import linear as L
from .operators.binning import PackedDesign
from .operators.ordered import rank01
from .operators.pipeline import FittedPreprocessor, fit_preprocessor


def _param(name: str, doc: str, convert=C.identity) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class Columns(Params):
    """Columns that the estimators share; defaults as everywhere in this library."""

    featuresCol = _param("featuresCol", "vector of features", C.toString)
    timeCol = _param("timeCol", "observed time", C.toString)
    eventCol = _param("eventCol", "whether the time is an event", C.toString)
    riskCol = _param("riskCol", "risk that transform adds", C.toString)
    idCol = _param("idCol", "entity, for reproducible draws", C.toString)
    seed = _param("seed", "seed of all draws", C.toInt)
    DEFAULTS = {"featuresCol": "features", "timeCol": "time", "eventCol": "event", "riskCol": "risk", "idCol": "ID", "seed": 42}

    def __init__(self, **values):
        super().__init__()
        defaults: dict = {}
        for c in reversed(type(self).__mro__):
            defaults |= getattr(c, "DEFAULTS", {})
        self._setDefault(**defaults)
        self._set(**values)

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def set_all(self, **values):
        """Sets several params by name."""
        return self._set(**values)


class FitsRisk(Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator whose Model takes over its params."""

    MODEL: type

    def _fitted(self, state):
        model = self.MODEL()
        self._copyValues(model)
        model.state = state
        return model


class _StateWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_state(self.sparkSession, f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._load_state(self.sparkSession, f"{path}/state")
        return model


class RiskModel(Columns, Model, MLReadable, MLWritable):
    """A Model with a state that ``to_json`` and ``from_json`` know."""

    state = None

    def write(self):
        return _StateWriter(self)

    @classmethod
    def read(cls):
        return _StateReader(cls)

    def copy(self, extra=None):
        new = super().copy(extra)
        new.state = self.state
        return new

    def _save_state(self, spark, path: str):
        spark.createDataFrame([(json.dumps(self.to_json()),)], "state string").coalesce(1).write.mode("overwrite").parquet(path)

    def _load_state(self, spark, path: str):
        self.state = self.from_json(json.loads(spark.read.parquet(path).first()["state"]))

    def to_json(self):
        return self.state.state()

    @staticmethod
    def from_json(state):
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.state.predict(df, out=self.get("riskCol"), features_col=self.get("featuresCol"))


# ----------------------------------------------------------------------------------------------------- preprocessing
class _PreprocessorParams(Columns):
    numCols = _param("numCols", "numeric columns", C.toListString)
    catCols = _param("catCols", "categorical columns", C.toListString)
    textCol = _param("textCol", "text column, empty for none", C.toString)
    tfidfMax = _param("tfidfMax", "terms of the vocabulary", C.toInt)
    svdComponents = _param("svdComponents", "components of the text", C.toInt)
    DEFAULTS = {"numCols": [], "catCols": [], "textCol": "", "tfidfMax": 5000, "svdComponents": 120}


class PreprocessorModel(_PreprocessorParams, RiskModel):
    from_json = staticmethod(FittedPreprocessor.from_state)

    def _transform(self, df):
        return self.state.transform(df, self.get("featuresCol"))


class Preprocessor(_PreprocessorParams, FitsRisk):
    MODEL = PreprocessorModel

    def _fit(self, df):
        return self._fitted(fit_preprocessor(df, self.get("numCols"), self.get("catCols"), self.get("textCol") or None,
                                             self.get("tfidfMax"), self.get("svdComponents"), self.get("seed")))


# ----------------------------------------------------------------------------------------------------- linear models
class LinearRiskModel(RiskModel):
    """risk = features . beta + intercept"""

    def to_json(self):
        beta, intercept = self.state
        return {"beta": np.asarray(beta, float).tolist(), "intercept": float(intercept)}

    @staticmethod
    def from_json(s):
        return np.array(s["beta"], float), s["intercept"]

    def _transform(self, df):
        beta, intercept = self.state
        out = self.get("riskCol")
        return L.linear_risk(df, beta, self.get("featuresCol"), out).withColumn(out, F.col(out) + F.lit(float(intercept)))


class RidgeTime(FitsRisk):
    MODEL = LinearRiskModel
    alpha = _param("alpha", "ridge penalty", C.toFloat)
    DEFAULTS = {"alpha": 1.0}

    def _fit(self, df):
        w, b = L.fit_ridge_time(df, self.get("featuresCol"), self.get("timeCol"), self.get("alpha"))
        model = LinearRiskModel(**{c: self.get(c) for c in Columns.DEFAULTS})
        model.state = (-np.asarray(w), -b)
        return model


class CoxPH(RidgeTime):
    alpha = _param("alpha", "ridge penalty", C.toFloat)
    DEFAULTS = {"alpha": 1e-4}

    def _fit(self, df):
        beta = L.fit_cox(df, self.get("featuresCol"), self.get("timeCol"), self.get("eventCol"), self.get("alpha"))
        model = LinearRiskModel(**{c: self.get(c) for c in Columns.DEFAULTS})
        model.state = (beta, 0.0)
        return model


class Coxnet(FitsRisk):
    MODEL = LinearRiskModel
    l1Ratio = _param("l1Ratio", "share of the absolute penalty", C.toFloat)
    alphaMinRatio = _param("alphaMinRatio", "last alpha by the first", C.toFloat)
    nAlphas = _param("nAlphas", "alphas of the path", C.toInt)
    DEFAULTS = {"l1Ratio": 0.9, "alphaMinRatio": 0.01, "nAlphas": 100}

    def _fit(self, df):
        beta, _, _ = L.fit_coxnet(df, self.get("featuresCol"), self.get("timeCol"), self.get("eventCol"), self.get("l1Ratio"),
                                  self.get("alphaMinRatio"), self.get("nAlphas"))
        model = LinearRiskModel(**{c: self.get(c) for c in Columns.DEFAULTS})
        model.state = (beta, 0.0)
        return model


# ----------------------------------------------------------------------------------------------------- trees
class _TreeParams(Columns):
    nEstimators = _param("nEstimators", "trees", C.toInt)
    minSamplesLeaf = _param("minSamplesLeaf", "least rows of a leaf", C.toInt)
    minSamplesSplit = _param("minSamplesSplit", "least rows of a split", C.toInt)
    maxBins = _param("maxBins", "bins of a feature", C.toInt)


class BoostedModel(_TreeParams, RiskModel):
    learningRate = _param("learningRate", "weight of a tree", C.toFloat)
    maxDepth = _param("maxDepth", "depth of a tree", C.toInt)
    DEFAULTS = {"nEstimators": 300, "learningRate": 0.1, "maxDepth": 3, "minSamplesLeaf": 5, "minSamplesSplit": 10, "maxBins": 64}
    from_json = staticmethod(B.BoostedTrees.from_state)

    def staged(self, df: DataFrame, stages) -> DataFrame:
        """Risks after each number of trees, as columns ``<riskCol>_<trees>``."""
        return self.state.predict(df, self.get("riskCol"), self.get("featuresCol"), stages)


class BoostedCox(FitsRisk, _TreeParams):
    MODEL = BoostedModel
    learningRate, maxDepth = BoostedModel.learningRate, BoostedModel.maxDepth
    DEFAULTS = BoostedModel.DEFAULTS
    LOSS = "cox"

    def design(self, df: DataFrame) -> PackedDesign:
        """The packed rows; several fits on the same rows may share them."""
        return PackedDesign(df, self.get("featuresCol"), self.get("timeCol"), self.get("eventCol") if self.LOSS == "cox" else None,
                            max_bins=self.get("maxBins"), cells=B.RANGE_CELLS, held_cells=B.HELD_CELLS)

    def fit_design(self, design: PackedDesign) -> BoostedModel:
        fit = B.Boosting(design, self.LOSS, self.get("learningRate"), self.get("maxDepth"), self.get("minSamplesLeaf"), self.get("minSamplesSplit"))
        return self._fitted(fit.fit(self.get("nEstimators")))

    def _fit(self, df):
        return self.fit_design(self.design(df))


class BoostedTime(BoostedCox):
    DEFAULTS = {"nEstimators": 100, "learningRate": 0.05, "maxDepth": 3, "minSamplesLeaf": 20, "minSamplesSplit": 2, "maxBins": 255}
    LOSS = "squared"


class ForestModel(_TreeParams, RiskModel):
    maxFeatures = _param("maxFeatures", "'sqrt', a share or a number of features a split looks at")
    maxSamples = _param("maxSamples", "rate of the bootstrap", C.toFloat)
    DEFAULTS = {"nEstimators": 300, "minSamplesLeaf": 10, "minSamplesSplit": 10, "maxBins": 64, "maxFeatures": "sqrt", "maxSamples": 1.0}

    def staged(self, df: DataFrame, stages) -> DataFrame:
        """Risks of the first trees, as columns ``<riskCol>_<trees>``."""
        return self.state.predict(df, self.get("riskCol"), self.get("featuresCol"), stages)

    def _save_state(self, spark, path):
        self.state.save(path)

    def _load_state(self, spark, path):
        self.state = Fo.SurvivalForest.load(spark, path)


class ForestRisk(FitsRisk, _TreeParams):
    MODEL = ForestModel
    maxFeatures, maxSamples = ForestModel.maxFeatures, ForestModel.maxSamples
    DEFAULTS = ForestModel.DEFAULTS

    def design(self, df: DataFrame) -> PackedDesign:
        return PackedDesign(df, self.get("featuresCol"), self.get("timeCol"), self.get("eventCol"), self.get("idCol"), self.get("maxBins"))

    def fit_design(self, design: PackedDesign) -> ForestModel:
        return self._fitted(Fo.fit_survival_forest(
            None, n_trees=self.get("nEstimators"), min_samples_leaf=self.get("minSamplesLeaf"), min_samples_split=self.get("minSamplesSplit"),
            max_features=self.get("maxFeatures"), max_samples=self.get("maxSamples"), seed=self.get("seed"), design=design))

    def _fit(self, df):
        return self.fit_design(self.design(df))


# ----------------------------------------------------------------------------------------------------- clusters
class _KMeansParams(Columns):
    k = _param("k", "clusters", C.toInt)
    nInit = _param("nInit", "starts", C.toInt)
    DEFAULTS = {"k": 4, "nInit": 10}


class KMeansRiskModel(_KMeansParams, RiskModel):
    from_json = staticmethod(K.ClusterRisk.from_state)


class KMeansRisk(_KMeansParams, FitsRisk):
    MODEL = KMeansRiskModel

    def _fit(self, df):
        return self._fitted(K.fit_kmeans_risk(df, self.get("k"), self.get("featuresCol"), self.get("timeCol"), self.get("seed"), self.get("nInit")))


# ----------------------------------------------------------------------------------------------------- ensembles
class RankMean(Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = _param("inputCols", "risk columns", C.toListString)
    weights = _param("weights", "their weights, empty for equal ones", C.toListFloat)
    DEFAULTS = {"inputCols": [], "weights": []}

    def _transform(self, df):
        cols = self.get("inputCols")
        weights = self.get("weights") or [1.0] * len(cols)
        if not cols or len(weights) != len(cols):
            raise ValueError("RankMean needs input columns and, if any, a weight for each")
        out = df
        for i, c in enumerate(cols):
            out = rank01(out, c, f"__rank{i}")
        total = sum((F.col(f"__rank{i}") * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))
        return out.withColumn(self.get("riskCol"), total / F.lit(float(sum(weights)))).drop(*[f"__rank{i}" for i in range(len(cols))])
