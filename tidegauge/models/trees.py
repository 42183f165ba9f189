"""Tree ensembles from MLlib on feature tables with a ``split`` column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.evaluation.metrics import CLASSES, NAMES
from tidegauge.models.base import Model
from tidegauge.operators.scaling import impute, recode_label, train_medians
from tidegauge.session import materialise


@dataclass
class TreeModel(Model):
    """Common fit and predict; subclasses supply the estimators.

    Gaps become the train median of the series, because MLlib trees take no missing values.
    """

    name = "tree"

    def __post_init__(self) -> None:
        super().__post_init__()
        self.medians: DataFrame | None = None
        self.fitted: list[Any] = []

    def _inputs(self) -> list[str]:
        return list(self.features)

    def _prepare(self, df: DataFrame) -> DataFrame:
        ready = impute(df, self.medians, self.features, self.keys)
        # a feature without any train value has no median
        ready = ready.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in self.features})
        return VectorAssembler(inputCols=self._inputs(), outputCol="_x").transform(ready)

    def fit(self, df: DataFrame) -> TreeModel:
        """Fit on ``split = 'train'``; boosted models watch ``split = 'val'`` to stop early."""
        known = df.where(F.col(self.target).isNotNull() & F.col("split").isin("train", "val"))
        self.medians = materialise(train_medians(known.where("split = 'train'"), self.features, self.keys))
        rows = self._prepare(known).select("_x", self.target, "split")
        self.fitted = self._fit(materialise(rows))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_pred`` and, for classes, ``p_neg, p_neu, p_pos``."""
        self._require(self.fitted)
        return self._score(self._prepare(df)).select(*df.columns, *self.outputs())

    def unfilled(self, df: DataFrame) -> DataFrame:
        """``(keys, feature, n)``: gaps of ``df`` that no train median fills, where the trees are given 0.0.

        A feature without a train value in its series has such gaps, and every gap of a series
        that the train rows do not have. Only features with a gap left are listed.
        """
        if self.medians is None:
            raise RuntimeError("fit the model first")
        left = impute(df, self.medians, self.features, self.keys).groupBy(*self.keys)
        counts = left.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.features])
        return counts.unpivot(list(self.keys), list(self.features), "feature", "n").where("n > 0")

    def importances(self) -> DataFrame:
        """``(feature, importance)`` of the inputs, averaged over the fitted ensembles."""
        spark = self.medians.sparkSession
        total = sum(m.featureImportances.toArray() for m in self.fitted) / len(self.fitted)
        pairs = [(c, float(v)) for c, v in zip(self._inputs(), total, strict=True)]
        return spark.createDataFrame(pairs, "feature string, importance double")

    def _write(self, path: str) -> None:
        for i, model in enumerate(self.fitted):
            model.write().overwrite().save(f"{path}/ensemble_{i}")
        self.medians.write.mode("overwrite").parquet(f"{path}/medians")

    def _read(self, spark: SparkSession, path: str) -> None:
        self.medians = spark.read.parquet(f"{path}/medians")
        self.fitted = [loader.load(f"{path}/ensemble_{i}") for i, loader in enumerate(self._loaders())]


def _winner(probabilities: Sequence[Column]) -> Column:
    """Label of the largest probability, the smaller label on ties."""
    best = F.greatest(*probabilities)
    pick = F.lit(float(CLASSES[-1]))
    for c, p in reversed(list(zip(CLASSES, probabilities, strict=True))):
        pick = F.when(p == best, float(c)).otherwise(pick)
    return pick


@dataclass
class RandomForest(TreeModel):
    """Bagged trees; classes weighted inversely to their frequency."""

    name = "random_forest"

    def _common(self) -> dict[str, Any]:
        # fixed values: defaults of the forest
        base = dict(numTrees=500, maxDepth=30, minInstancesPerNode=2, featureSubsetStrategy="sqrt")
        return {**base, **self.params, "featuresCol": "_x", "seed": self.seed}

    def _fit(self, rows: DataFrame) -> list[Any]:
        train = rows.where("split = 'train'")
        if self.task == "regression":
            return [RandomForestRegressor(labelCol=self.target, predictionCol="y_pred", **self._common()).fit(train)]
        labelled = train.withColumn("_y", recode_label(self.target).cast("double"))
        counts = {r["_y"]: r["count"] for r in labelled.groupBy("_y").count().collect()}  # at most three rows
        total = sum(counts.values())
        weight = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, total / (len(counts) * n))])
        weighted = labelled.withColumn("_w", F.element_at(weight, F.col("_y")))
        return [RandomForestClassifier(labelCol="_y", weightCol="_w", **self._common()).fit(weighted)]

    def _score(self, ready: DataFrame) -> DataFrame:
        scored = self.fitted[0].transform(ready)
        if self.task == "regression":
            return scored
        p = vector_to_array("probability")
        # a class above every train label has no slot in the vector
        share = [F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(3)]
        scored = scored.withColumns({f"p_{n}": s for n, s in zip(NAMES, share, strict=True)})
        return scored.withColumn("y_pred", _winner([F.col(f"p_{n}") for n in NAMES]))

    def _loaders(self) -> list[Any]:
        from pyspark.ml.classification import RandomForestClassificationModel
        from pyspark.ml.regression import RandomForestRegressionModel

        return [RandomForestRegressionModel if self.task == "regression" else RandomForestClassificationModel]


@dataclass
class BoostedTrees(TreeModel):
    """Gradient boosting with early stopping on the validation split.

    Besides imputation every feature gets a flag for its gaps. Classes are one ensemble per
    class against the rest; their margins become probabilities through a softmax.
    """

    name = "boosted_trees"

    def _inputs(self) -> list[str]:
        return [*self.features, *[f"_na_{c}" for c in self.features]]

    def _prepare(self, df: DataFrame) -> DataFrame:
        flags = {f"_na_{c}": F.col(c).isNull().cast("double") for c in self.features}
        return super()._prepare(df.withColumns(flags))

    def _common(self) -> dict[str, Any]:
        # fixed values: defaults of the boosted model
        base = dict(maxIter=500, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8")
        return {**base, **self.params, "featuresCol": "_x", "seed": self.seed, "validationIndicatorCol": "_val"}

    def _fit(self, rows: DataFrame) -> list[Any]:
        marked = rows.withColumn("_val", F.col("split") == "val")
        if self.task == "regression":
            return [GBTRegressor(labelCol=self.target, predictionCol="y_pred", **self._common()).fit(marked)]
        models = []
        for c in CLASSES:
            binary = marked.withColumn("_y", (F.col(self.target) == c).cast("double"))
            models.append(GBTClassifier(labelCol="_y", **self._common()).fit(binary))
        return models

    def _score(self, ready: DataFrame) -> DataFrame:
        if self.task == "regression":
            return self.fitted[0].transform(ready)
        for model, n in zip(self.fitted, NAMES, strict=True):
            scored = model.transform(ready)
            ready = scored.withColumn(f"_s_{n}", vector_to_array("rawPrediction")[1]).drop(
                "rawPrediction", "probability", "prediction"
            )
        exps = {n: F.exp(F.col(f"_s_{n}")) for n in NAMES}
        total = exps["neg"] + exps["neu"] + exps["pos"]
        scored = ready.withColumns({f"p_{n}": e / total for n, e in exps.items()})
        return scored.withColumn("y_pred", _winner([F.col(f"p_{n}") for n in NAMES]))

    def _loaders(self) -> list[Any]:
        from pyspark.ml.classification import GBTClassificationModel
        from pyspark.ml.regression import GBTRegressionModel

        return [GBTRegressionModel] if self.task == "regression" else [GBTClassificationModel] * 3
