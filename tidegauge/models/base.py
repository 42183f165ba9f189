"""What every model has: fit, predict, save and load.

A stored model is a folder with the tables it needs and a ``description``: its kind, features,
target, task, keys, parameters and seed. The description is written last, so a folder
without one is an unfinished save. ``load_model`` needs nothing but the folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession

from tidegauge.evaluation.metrics import NAMES

TASKS = ("regression", "classification")

#: model classes by their ``name``
KINDS: dict[str, type[Model]] = {}


@dataclass
class Model:
    """Common state; subclasses fit on ``split = 'train'`` and may watch ``split = 'val'``."""

    features: Sequence[str]
    target: str
    task: str = "regression"
    keys: Sequence[str] = ("symbol",)
    params: dict[str, Any] = field(default_factory=dict)
    seed: int = 42
    name: ClassVar[str] = "abstract"
    tasks: ClassVar[Sequence[str]] = TASKS

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        KINDS[cls.name] = cls

    def __post_init__(self) -> None:
        if self.task not in self.tasks:
            raise ValueError(f"task of {self.name} must be one of {tuple(self.tasks)}, not {self.task!r}")

    def fit(self, df: DataFrame) -> Model:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``y_pred`` and, where the model has them, ``p_neg, p_neu, p_pos``."""
        raise NotImplementedError

    def _require(self, fitted: Any) -> None:
        if not fitted:
            raise RuntimeError("fit before predict")

    def outputs(self) -> list[str]:
        """The columns that ``predict`` adds."""
        return ["y_pred", *([f"p_{n}" for n in NAMES] if self.task == "classification" else [])]

    def describe(self) -> dict[str, Any]:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {"kind": self.name, **{k: list(v) if isinstance(v, tuple) else v for k, v in values.items()}}

    def save(self, path: str) -> None:
        """All of the model under one folder, replacing what is there."""
        self._write(path)
        text = json.dumps(self.describe(), sort_keys=True, default=lambda v: v.item())  # numpy scalars
        one = SparkSession.active().createDataFrame([(text,)], "value string")
        one.coalesce(1).write.mode("overwrite").text(f"{path}/description")

    def load(self, spark: SparkSession, path: str) -> Model:
        """Take the fitted state of a stored model of the same kind."""
        kind = read_description(spark, path)["kind"]
        if kind != self.name:
            raise ValueError(f"{path} holds a {kind}, not a {self.name}")
        self._read(spark, path)
        return self

    def _write(self, path: str) -> None:
        """Store the fitted state."""

    def _read(self, spark: SparkSession, path: str) -> None:
        """Restore the fitted state."""


def read_description(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/description").first()[0])


def load_model(spark: SparkSession, path: str) -> Model:
    """The model stored under ``path``, with all its settings, ready to predict."""
    from tidegauge.models import naive, trees  # noqa: F401  their classes enter KINDS

    settings = read_description(spark, path)
    kind = settings.pop("kind")
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model {kind!r}; known: {sorted(KINDS)}")
    return KINDS[kind](**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()}).load(spark, path)

