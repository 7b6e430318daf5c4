"""The learning operators as stages of a pyspark.ml Pipeline: parameters, fit, transform, saving and loading."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCols, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import forest
from lodestone.operators.learning import Forest

__all__ = ["ForestClassifier", "ForestModel", "MinMaxScaler", "ScaledModel", "ZScoreScaler"]


# Scaling of columns


class _Scaling(HasInputCols, HasOutputCols):
    """inputCols are scaled into outputCols (by default in place)."""

    def _outputs(self) -> list[str]:
        return list(self.getOutputCols()) if self.isSet("outputCols") else list(self.getInputCols())


class ScaledModel(Model, _Scaling, MLWritable, MLReadable):
    """(x - offset) / scale of each input column; 0 where the scale is 0. Null stays null."""

    def __init__(self, offsets: list[float] | None = None, scales: list[float] | None = None) -> None:
        super().__init__()
        self.offsets, self.scales = offsets or [], scales or []

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self._outputs(), self.offsets, self.scales, strict=True)
        return df.withColumns({o: (F.col(c) - F.lit(a)) / F.lit(s) if s else F.col(c) * 0.0 for c, o, a, s in pairs})

    def write(self) -> MLWriter:
        return _Writer(self, lambda: self._rows())

    def _rows(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([(k, float(a), float(s)) for k, (a, s) in enumerate(zip(self.offsets, self.scales, strict=True))], "place int, offset double, scale double")

    @classmethod
    def read(cls) -> MLReader:
        def build(rows: DataFrame, _: dict) -> ScaledModel:
            found = sorted(rows.collect(), key=lambda r: r.place)
            return cls([r.offset for r in found], [r.scale for r in found])

        return _Reader(cls, build)


class ZScoreScaler(Estimator, _Scaling, DefaultParamsReadable, DefaultParamsWritable):
    """Each column less its mean, over its population standard deviation."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None) -> None:  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ScaledModel:
        cols = list(self.getInputCols())
        r = df.agg(*(f(c) for c in cols for f in (F.avg, F.stddev_pop))).first()
        return self._copyValues(ScaledModel([r[2 * k] or 0.0 for k in range(len(cols))], [r[2 * k + 1] or 0.0 for k in range(len(cols))]))


class MinMaxScaler(Estimator, _Scaling, DefaultParamsReadable, DefaultParamsWritable):
    """Each column from 0 at its least to 1 at its greatest value."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None) -> None:  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ScaledModel:
        cols = list(self.getInputCols())
        r = df.agg(*(f(F.col(c).cast("double")) for c in cols for f in (F.min, F.max))).first()
        ends = [(r[2 * k], r[2 * k + 1]) for k in range(len(cols))]
        return self._copyValues(ScaledModel([a or 0.0 for a, _ in ends], [b - a if a is not None else 0.0 for a, b in ends]))


# Forests


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    keyCol = Param(Params._dummy(), "keyCol", "distinct numbers from 0 on, by which rows are drawn; empty: rows are numbered", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "labels are 0 to numClasses - 1", TypeConverters.toInt)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "nodes of so many rows or fewer stay whole", TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "how often a row is drawn for a tree on average; 0: every tree has all rows", TypeConverters.toFloat)
    tried = Param(Params._dummy(), "tried", "features tried in a node; 0: the root of their number", TypeConverters.toInt)

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self._setDefault(labelCol="label", predictionCol="prediction", probabilityCol="probability", seed=42, keyCol="", numClasses=2, numTrees=100, maxDepth=10, minLeaf=5, bootstrap=0.8, tried=0)


class ForestModel(Model, _ForestParams, MLWritable, MLReadable):
    """Adds the prediction (the class with most votes) and the classes' shares of the votes."""

    def __init__(self, fitted: Forest | None = None) -> None:
        super().__init__()
        self.forest = fitted or Forest()

    @property
    def featureImportances(self) -> dict[str, float]:  # noqa: N802
        return self.forest.importances()

    def _transform(self, df: DataFrame) -> DataFrame:
        judged = self.forest.predict(df, df.columns)
        return judged.withColumnsRenamed({"y_pred": self.getOrDefault("predictionCol"), "probabilities": self.getOrDefault("probabilityCol")})

    def write(self) -> MLWriter:
        return _Writer(self, self._rows, {"classes": self.forest.k, "columns": self.forest.columns})

    def _rows(self) -> DataFrame:
        """The nodes of all trees, and as trees from -1 down the features' bins: `gain` their ends, `at` 1 where each is a value."""
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
        bins = [(-1 - f, k, f, int(b.values is not None), 0, float(e), 0, 0) for f, b in enumerate(self.forest.cuts) for k, e in enumerate(b.edges)]
        ends = spark.createDataFrame(bins, "tree int, heap long, feature int, at int, upto int, gain double, n long, label int")
        return forest.saved(spark, self.forest.nodes).unionByName(ends)

    @classmethod
    def read(cls) -> MLReader:
        def build(rows: DataFrame, extra: dict) -> ForestModel:
            f = Forest()
            f.columns, f.k = list(extra["columns"]), int(extra["classes"])
            f.nodes = forest.loaded(rows.filter("tree >= 0"))
            ends: dict[int, list] = {}
            for r in rows.filter("tree < 0").collect():
                ends.setdefault(r.feature, []).append(r)
            f.cuts = []
            for k in range(len(f.columns)):
                own = sorted(ends.get(k, []), key=lambda r: r.heap)
                edges = np.array([r.gain for r in own])
                f.cuts.append(forest.Bins(edges, edges if own and own[0].at else None))
            return cls(f)

        return _Reader(cls, build)


class ForestClassifier(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """A forest over all rows, see `Forest`."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = "label", predictionCol: str = "prediction", probabilityCol: str = "probability", keyCol: str = "", numClasses: int = 2, numTrees: int = 100, maxDepth: int = 10, minLeaf: int = 5, bootstrap: float = 0.8, tried: int = 0, seed: int = 42) -> None:  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ForestModel:
        g = self.getOrDefault
        f = Forest(g("numTrees"), g("maxDepth"), g("minLeaf"), g("bootstrap") or None, g("tried") or None, g("seed"))
        f.fit(df, g("inputCols"), g("labelCol"), g("numClasses"), g("keyCol") or None)
        return self._copyValues(ForestModel(f))


# Saving and loading


class _Writer(MLWriter):
    """Parameters as pyspark.ml keeps them, and what was learnt as Parquet beside them."""

    def __init__(self, instance: Any, rows: Any, extra: dict | None = None) -> None:
        super().__init__()
        self.instance, self.rows, self.extra = instance, rows, extra or {}

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"learnt": self.extra})
        self.rows().write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls: type, build: Any) -> None:
        super().__init__()
        self.cls, self.build = cls, build

    def load(self, path: str) -> Any:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.build(self.sparkSession.read.parquet(f"{path}/data"), metadata.get("learnt", {}))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
