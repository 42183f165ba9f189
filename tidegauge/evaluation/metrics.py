"""Forecast metrics per group of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.stats import pearson
from tidegauge.operators.ordered import average_ranks, running_totals
from tidegauge.session import materialise

CLASSES = (-1, 0, 1)
NAMES = ("neg", "neu", "pos")
REGRESSION = ("mse", "rmse", "mae", "mape", "r2", "directional_accuracy", "pearson", "spearman", "bias")
CLASSIFICATION = ("accuracy", "f1_macro", "mcc", "precision_macro", "recall_macro")


def complete(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def spearman(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of average ranks, from the distinct (y_true, y_pred) pairs and their counts.

    The pairs are stored, so the predictions are read once for the two ranks and their join.
    """
    pairs = materialise(complete(preds).groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("w")))
    true_ranks = average_ranks(pairs, keys, "y_true", "w").withColumnRenamed("rank", "rt")
    pred_ranks = average_ranks(pairs, keys, "y_pred", "w").withColumnRenamed("rank", "rp")
    ranked = pairs.join(true_ranks, [*keys, "y_true"]).join(pred_ranks, [*keys, "y_pred"])
    w, rt, rp = F.col("w"), F.col("rt"), F.col("rp")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * rt * rp).alias("tp"),
        F.sum(w * rt * rt).alias("tt"),
        F.sum(w * rp * rp).alias("pp"),
    )
    # both rank columns have mean (n + 1) / 2
    n, centre = F.col("n"), F.col("n") * (F.col("n") + 1.0) * (F.col("n") + 1.0) / 4.0
    spread = F.sqrt(F.greatest(F.col("tt") - centre, F.lit(0.0))) * F.sqrt(F.greatest(F.col("pp") - centre, F.lit(0.0)))
    return sums.select(*keys, F.when(n > 1, F.try_divide(F.col("tp") - centre, spread)).alias("spearman"))


def regression_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nine regression metrics per group of ``(y_true, y_pred)`` rows (read twice)."""
    yt, yp = F.col("y_true"), F.col("y_pred")
    err = yt - yp
    sse, sst = F.sum(err * err), F.var_pop(yt) * F.count(yt)
    base = (
        complete(preds)
        .groupBy(*keys)
        .agg(
            F.avg(err * err).alias("mse"),
            F.avg(F.abs(err)).alias("mae"),
            F.avg(F.when(F.abs(yt) > 1e-12, F.abs(err / yt))).alias("mape"),
            F.when(sst > 0, 1.0 - F.try_divide(sse, sst)).when(sse == 0, 1.0).otherwise(0.0).alias("r2"),
            F.avg((F.signum(yt) == F.signum(yp)).cast("double")).alias("directional_accuracy"),
            pearson("y_true", "y_pred").alias("pearson"),
            F.avg(yp - yt).alias("bias"),
        )
        .withColumn("rmse", F.sqrt("mse"))
    )
    return base.join(spearman(preds, keys), list(keys), "left").select(*keys, *REGRESSION)


def confusion_wide(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with the nine counts ``c_<true>_<pred>``."""
    cells = [
        F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).alias(f"c_{tn}_{pn}")
        for t, tn in zip(CLASSES, NAMES, strict=True)
        for p, pn in zip(CLASSES, NAMES, strict=True)
    ]
    return complete(preds).groupBy(*keys).agg(*cells)


def confusion(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, y_true, neg, neu, pos, neg_pct, neu_pct, pos_pct)``, every true class present."""
    wide = confusion_wide(preds, keys)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("y_true"), *[F.col(f"c_{t}_{p}").alias(p) for p in NAMES])
            for c, t in zip(CLASSES, NAMES, strict=True)
        ]
    )
    table = wide.select(*keys, F.inline(rows))
    total = F.greatest(F.col("neg") + F.col("neu") + F.col("pos"), F.lit(1))
    return table.withColumns({f"{p}_pct": F.col(p) / total * 100.0 for p in NAMES})


def _marginals() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    hit = {c: F.col(f"c_{c}_{c}") for c in NAMES}
    true = {c: F.col(f"c_{c}_neg") + F.col(f"c_{c}_neu") + F.col(f"c_{c}_pos") for c in NAMES}
    pred = {c: F.col(f"c_neg_{c}") + F.col(f"c_neu_{c}") + F.col(f"c_pos_{c}") for c in NAMES}
    return hit, true, pred


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _class_scores() -> tuple[list[Column], list[Column], list[Column]]:
    hit, true, pred = _marginals()
    precision = [_ratio(hit[c], pred[c]) for c in NAMES]
    recall = [_ratio(hit[c], true[c]) for c in NAMES]
    f1 = [_ratio(2 * hit[c], true[c] + pred[c]) for c in NAMES]
    return precision, recall, f1


def _mean(columns: Sequence[Column]) -> Column:
    return sum(columns[1:], columns[0]) / len(columns)


def classification_metrics(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, macro scores over the three classes and the multiclass correlation."""
    hit, true, pred = _marginals()
    precision, recall, f1 = _class_scores()
    n = sum((true[c] for c in NAMES[1:]), true[NAMES[0]]).cast("double")
    right = sum((hit[c] for c in NAMES[1:]), hit[NAMES[0]]).cast("double")

    def cross(a: dict[str, Column], b: dict[str, Column]) -> Column:
        parts = [a[c].cast("double") * b[c].cast("double") for c in NAMES]
        return sum(parts[1:], parts[0])

    spread = F.sqrt((n * n - cross(pred, pred)) * (n * n - cross(true, true)))
    return confusion_wide(preds, keys).select(
        *keys,
        _ratio(right, n).alias("accuracy"),
        _mean(f1).alias("f1_macro"),
        F.coalesce(F.try_divide(right * n - cross(pred, true), spread), F.lit(0.0)).alias("mcc"),
        _mean(precision).alias("precision_macro"),
        _mean(recall).alias("recall_macro"),
    )


def class_report(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, label, precision, recall, f1, support)`` per class, macro and weighted."""
    _, true, _ = _marginals()
    precision, recall, f1 = _class_scores()
    support = [true[c].cast("double") for c in NAMES]
    total = sum(support[1:], support[0])

    def weighted(values: Sequence[Column]) -> Column:
        parts = [v * s for v, s in zip(values, support, strict=True)]
        return _ratio(sum(parts[1:], parts[0]), total)

    def line(label: str, values: Sequence[Column]) -> Column:
        return F.struct(F.lit(label).alias("label"), *[v.alias(n) for v, n in zip(values, ("precision", "recall", "f1", "support"), strict=True)])

    lines = [line(str(c), (precision[i], recall[i], f1[i], support[i])) for i, c in enumerate(CLASSES)]
    lines.append(line("macro avg", (_mean(precision), _mean(recall), _mean(f1), total)))
    lines.append(line("weighted avg", (weighted(precision), weighted(recall), weighted(f1), total)))
    return confusion_wide(preds, keys).select(*keys, F.inline(F.array(*lines)))


def threshold_points(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-vs-rest counts at every distinct score.

    ``preds`` holds ``y_true`` and ``p_neg, p_neu, p_pos``. The result has, per group, class and
    score, the positives and negatives at the score (``pos``, ``neg``), above it
    (``pos_above``, ``neg_above``) and in all (``pos_total``, ``neg_total``).
    """
    scored = F.array(
        *[
            F.struct(F.lit(c).alias("label"), F.col(f"p_{n}").alias("score"), (F.col("y_true") == c).alias("hit"))
            for c, n in zip(CLASSES, NAMES, strict=True)
        ]
    )
    by_score = (
        preds.where(F.col("y_true").isNotNull())
        .select(*keys, F.inline(scored))
        .groupBy(*keys, "label", "score")
        .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    totals = running_totals(by_score, [*keys, "label"], -F.col("score"), ["pos", "neg"])
    return totals.withColumnsRenamed({"pos_before": "pos_above", "neg_before": "neg_above"})


def roc_points(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False and true positive rates at every threshold; classes absent or universal skipped."""
    pts = threshold_points(preds, keys).where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    return pts.select(
        *keys,
        "label",
        "score",
        ((F.col("neg_above") + F.col("neg")) / F.col("neg_total")).alias("fpr"),
        ((F.col("pos_above") + F.col("pos")) / F.col("pos_total")).alias("tpr"),
    )


def roc_auc(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the one-vs-rest curves: pairs won, ties counting half."""
    pts = threshold_points(preds, keys).where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))
    won = F.sum(F.col("neg").cast("double") * (F.col("pos_above") + F.col("pos") / 2.0))
    return pts.groupBy(*keys, "label").agg(
        (won / (F.max("pos_total").cast("double") * F.max("neg_total"))).alias("auc"),
        F.max("pos_total").alias("positives"),
        (F.max("pos_total") + F.max("neg_total")).alias("n"),
    )


def pr_points(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision and recall at every threshold."""
    pts = threshold_points(preds, keys).where(F.col("pos_total") > 0)
    taken = F.col("pos_above") + F.col("pos")
    return pts.select(
        *keys,
        "label",
        "score",
        (taken / (taken + F.col("neg_above") + F.col("neg"))).alias("precision"),
        (taken / F.col("pos_total")).alias("recall"),
        (F.col("pos") / F.col("pos_total")).alias("recall_step"),
        (F.col("pos_total") / (F.col("pos_total") + F.col("neg_total"))).alias("prevalence"),
    )


def average_precision(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        pr_points(preds, keys)
        .groupBy(*keys, "label")
        .agg(
            F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"),
            F.max("prevalence").alias("prevalence"),
        )
    )
