"""The baselines as models: zero return, majority class, autoregression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.models import baselines as bl
from tidegauge.models.base import Model
from tidegauge.operators.blocks import Blocked, SeriesSpec
from tidegauge.session import materialise


@dataclass
class ZeroForecast(Model):
    """No drift: a return of zero for every row."""

    features: Sequence[str] = ()
    target: str = "y_reg_h24"
    name = "naive_zero"
    tasks = ("regression",)

    def fit(self, df: DataFrame) -> ZeroForecast:
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("y_pred", bl.zero_forecast())


@dataclass
class MajorityClass(Model):
    """The most frequent train label of each series; a series without any gets NULL."""

    features: Sequence[str] = ()
    target: str = "y_clf_h24"
    task: str = "classification"
    name = "majority"
    tasks = ("classification",)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.majority: DataFrame | None = None

    def fit(self, df: DataFrame) -> MajorityClass:
        self.majority = materialise(bl.majority_class(df.where("split = 'train'"), self.target, self.keys))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._require(self.majority is not None)
        scored = df.join(self.majority, list(self.keys), "left").withColumns(bl.majority_columns())
        return scored.select(*df.columns, *self.outputs())

    def _write(self, path: str) -> None:
        self.majority.write.mode("overwrite").parquet(f"{path}/majority")

    def _read(self, spark: SparkSession, path: str) -> None:
        self.majority = spark.read.parquet(f"{path}/majority")


@dataclass
class AutoRegression(Model):
    """AR of log-returns, order by AIC, summed over ``horizon`` steps; as a label beyond the neutral zone for classes.

    Needs ``close``, ``rn``, ``n_rows``, ``split`` and ``split_row``; forecasts restart at each
    split, so all rows of a split must be handed in. Parameters: ``horizon`` (24), ``orders``,
    ``vol_window`` (24) and ``factor`` (0.5) of the neutral zone, ``block_rows``.
    """

    features: Sequence[str] = ("close",)
    target: str = "y_reg_h24"
    name = "autoregression"

    def __post_init__(self) -> None:
        super().__post_init__()
        self.coefs: DataFrame | None = None

    def outputs(self) -> list[str]:
        return ["y_pred"]

    def _setting(self, name: str, default: object) -> object:
        return self.params.get(name, default)

    def _spec(self) -> SeriesSpec:
        return SeriesSpec(keys=tuple(self.keys), block_rows=self._setting("block_rows", SeriesSpec.block_rows))

    def fit(self, df: DataFrame) -> AutoRegression:
        orders = tuple(self._setting("orders", bl.ORDERS))
        lags, spec = max(orders), self._spec()
        b = Blocked.of(df.where("split = 'train'"), spec, back=lags + 2)
        sums = bl.ar_moments(b.run(bl.lagged_returns(b, lags)).home(), spec.keys, lags)
        self.coefs = materialise(bl.fit_ar(sums, spec.keys, self._setting("horizon", 24), orders))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._require(self.coefs is not None)
        horizon, window = self._setting("horizon", 24), self._setting("vol_window", 24)
        lags = max(self._setting("orders", bl.ORDERS))
        out = bl.attach_forecast(df, self.coefs, self._spec(), horizon, lags, window, self._setting("factor", 0.5))
        if self.task == "classification":
            out = out.withColumn("y_pred", F.col("y_label"))
        return out.select(*df.columns, *self.outputs())

    def _write(self, path: str) -> None:
        self.coefs.write.mode("overwrite").parquet(f"{path}/coefficients")

    def _read(self, spark: SparkSession, path: str) -> None:
        self.coefs = spark.read.parquet(f"{path}/coefficients")
