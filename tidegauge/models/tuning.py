"""Seeded random search judged on the validation split."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.evaluation.metrics import classification_metrics, regression_metrics

#: a draw per parameter: ``("int", low, high, step)``, ``("float", low, high)`` or ``("log", low, high)``
Space = Mapping[str, tuple]

# fixed values: search ranges, in the names of the estimators here
FOREST_SPACE: Space = {
    "numTrees": ("int", 200, 800, 100),
    "maxDepth": ("int", 5, 30, 1),
    "minInstancesPerNode": ("int", 1, 10, 1),
}
BOOSTED_SPACE: Space = {
    "maxDepth": ("int", 3, 10, 1),
    "stepSize": ("log", 0.01, 0.3),
    "subsamplingRate": ("float", 0.5, 1.0),
    "maxIter": ("int", 200, 800, 1),
}


def draw(space: Space, rng: random.Random) -> dict[str, Any]:
    params: dict[str, Any] = {}
    for name, (kind, low, high, *step) in space.items():
        if kind == "int":
            params[name] = rng.randrange(low, high + 1, step[0] if step else 1)
        elif kind == "log":
            params[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            params[name] = rng.uniform(low, high)
    return params


def validation_loss(preds: DataFrame, target: str, task: str) -> float:
    """RMSE, or one minus macro F1, over the validation rows."""
    rows = preds.where("split = 'val'").withColumn("y_true", F.col(target))
    if task == "regression":
        return float(regression_metrics(rows, ["split"]).first()["rmse"])
    return 1.0 - float(classification_metrics(rows, ["split"]).first()["f1_macro"])


def tune(build: Callable[[dict[str, Any]], Any], space: Space, df: DataFrame, trials: int = 30, seed: int = 42) -> tuple[dict[str, Any], DataFrame]:
    """Best parameters and a ``(trial, loss, params)`` table; ``build`` makes an unfitted model."""
    rng, log = random.Random(seed), []
    for trial in range(trials):
        params = draw(space, rng)
        model = build(params).fit(df)
        loss = validation_loss(model.predict(df.where("split = 'val'")), model.target, model.task)
        log.append((trial, loss, {k: str(v) for k, v in params.items()}, params))
    best = min(log, key=lambda row: (row[1], row[0]))
    table = df.sparkSession.createDataFrame(
        [row[:3] for row in log], "trial int, loss double, params map<string,string>"
    )
    return best[3], table
