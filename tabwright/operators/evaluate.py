"""Evaluation of predictions; input tables have columns ``label`` and ``prediction``."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion_counts(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, classes: Sequence[Any]) -> DataFrame:
    """Actual × predicted counts over a known class list, absent pairs as 0."""
    wide = confusion_counts(preds).groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n"))
    rows = preds.sparkSession.createDataFrame([(c,) for c in classes], f"label {dict(preds.dtypes)['label']}")
    return rows.join(wide, "label", "left").na.fill(0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def per_class(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    return _per_class(confusion_counts(preds))


def _per_class(counts: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("hit"),
                    F.col("n").alias("actual"),
                    zero.alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("class"), zero.alias("hit"), zero.alias("actual"),
                    F.col("n").alias("predicted"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")
    )
    return sums.select(
        "class",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("actual")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("actual") + F.col("predicted")).alias("f1_score"),
        F.col("actual").alias("support"),
        "hit",
    )


def macro_prf(preds: DataFrame) -> DataFrame:
    """Unweighted class means; an undefined ratio counts as 0."""
    return per_class(preds).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score")
    )


def classification_metrics(preds: DataFrame) -> DataFrame:
    """Accuracy with the macro means, from one pass over the predictions."""
    return per_class(preds).agg(
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1_score").alias("f1_score"),
    )


def weighted_f1(preds: DataFrame) -> DataFrame:
    """F1 averaged over the classes by their support."""
    return per_class(preds).agg(F.try_divide(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("f1"))


def classification_report(preds: DataFrame) -> DataFrame:
    """Class rows, then accuracy, macro and weighted averages."""
    classes = per_class(preds)
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    names = ["precision", "recall", "f1_score"]
    rows = classes.select(F.col("class").cast("string").alias("class"), *names, "support")
    blank = F.lit(None).cast("double")
    accuracy_row = classes.agg(
        F.try_divide(F.sum("hit"), F.sum("support")).alias("f1_score"), F.sum("support").alias("support")
    ).select(F.lit("accuracy").alias("class"), blank.alias("precision"), blank.alias("recall"), "f1_score", "support")
    macro = classes.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), *names, "support"
    )
    weights = classes.agg(*[weighted(c) for c in names], F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("class"), *names, "support"
    )
    return rows.unionByName(accuracy_row).unionByName(macro).unionByName(weights)


def regression_metrics(preds: DataFrame) -> DataFrame:
    error = F.col("prediction") - F.col("label")
    sums = preds.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop("label").alias("_spread"),
    )
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("_spread") == 0, constant).otherwise(1 - F.try_divide("mse", "_spread")).alias("r_squared"),
    )


def prediction_range(preds: DataFrame) -> DataFrame:
    """Common lower and upper end of labels and predictions."""
    return preds.agg(
        F.count_if(F.col("label").isNotNull() & F.col("prediction").isNotNull()).alias("pairs"),
        F.least(F.min("label"), F.min("prediction")).alias("low"),
        F.greatest(F.max("label"), F.max("prediction")).alias("high"),
    )


def _metric(metrics: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)) if name in metrics.columns else F.lit(0.0)


def overall_score(metrics: DataFrame, kind: str) -> DataFrame:
    """Append ``score`` from 0 to 10 and ``grade`` to a table of metrics.

    Weights, the error scale and the grade limits are fixed values.
    """
    if kind == "classification":
        weights = {"accuracy": 0.4, "f1_score": 0.3, "precision": 0.15, "recall": 0.15}
        raw = sum((_metric(metrics, name) * weight for name, weight in weights.items()), F.lit(0.0))
    else:
        closeness = F.lit(0.0)
        if "rmse" in metrics.columns:
            share = 1 - F.col("rmse") / 100.0
            closeness = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0))
        raw = _metric(metrics, "r_squared") * 0.7 + closeness * 0.3
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), raw * 10))
    grade = (
        F.when(F.col("score") >= 8.5, "Excellent")
        .when(F.col("score") >= 7.0, "Good")
        .when(F.col("score") >= 5.0, "Fair")
        .otherwise("Poor")
    )
    return metrics.withColumn("score", score).withColumn("grade", grade)
