"""Evaluation queries over rule-made predictions."""

from pyspark.sql import functions as F

from tabwright.operators import evaluate as ev
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query

_CLASSES_SQL = f"""
{fx.LABELLED_SQL},
classes AS (SELECT DISTINCT label AS class FROM preds UNION SELECT DISTINCT prediction FROM preds),
counts AS (
  SELECT class, (SELECT count(*) FROM preds WHERE label = class AND prediction = class) AS hit,
         (SELECT count(*) FROM preds WHERE label = class) AS actual,
         (SELECT count(*) FROM preds WHERE prediction = class) AS predicted FROM classes),
per AS (
  SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision,
         CASE WHEN actual = 0 THEN 0 ELSE hit / actual END AS recall,
         CASE WHEN actual + predicted = 0 THEN 0 ELSE 2 * hit / (actual + predicted) END AS f1_score,
         actual AS support, hit FROM counts)"""
_NAMES = ["precision", "recall", "f1_score"]


@query("eval_accuracy", f"""
WITH {fx.LABELLED_SQL} SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM preds""")
def accuracy(t):
    return fx.rounded(ev.accuracy(fx.labelled(t)), ["accuracy"], 6)


@query("eval_macro_prf", f"""
WITH {_CLASSES_SQL}
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1_score), 6) AS f1_score FROM per""")
def macro(t):
    return fx.rounded(ev.macro_prf(fx.labelled(t)), _NAMES, 6)


@query("eval_report", f"""
WITH {_CLASSES_SQL}
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM per""")
def report(t):
    return fx.rounded(ev.classification_report(fx.labelled(t)), _NAMES, 6)


@query("eval_confusion", f"""
WITH {fx.LABELLED_SQL}
SELECT label, count(*) FILTER (WHERE prediction = 'A') AS "A", count(*) FILTER (WHERE prediction = 'N') AS "N",
       count(*) FILTER (WHERE prediction = 'R') AS "R" FROM preds GROUP BY label""")
def confusion(t):
    return ev.confusion_matrix(fx.labelled(t), ["A", "N", "R"])


@query("eval_confusion_long", f"""
WITH {fx.LABELLED_SQL} SELECT label, prediction, count(*) AS n FROM preds GROUP BY ALL""")
def confusion_long(t):
    return ev.confusion_counts(fx.labelled(t))


@query("eval_regression", f"""
WITH {fx.NUMERIC_PREDS_SQL}
SELECT round(avg(abs(prediction - label)), 2) AS mae, round(avg((prediction - label) ^ 2), 0) AS mse,
       round(sqrt(avg((prediction - label) ^ 2)), 2) AS rmse,
       round(1 - avg((prediction - label) ^ 2) / var_pop(label), 6) AS r_squared
FROM preds""")
def regression(t):
    metrics = ev.regression_metrics(fx.numeric_preds(t))
    return fx.rounded(fx.rounded(fx.rounded(metrics, ["mae", "rmse"], 2), ["mse"], 0), ["r_squared"], 6)


_GRADE_SQL = "CASE WHEN score >= 8.5 THEN 'Excellent' WHEN score >= 7 THEN 'Good' WHEN score >= 5 THEN 'Fair' ELSE 'Poor' END AS grade"


@query("eval_score_grade", f"""
WITH {_CLASSES_SQL},
num AS (SELECT l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem),
scores AS (
  SELECT 'classification' AS kind,
         greatest(0, least(10, 10 * (0.4 * sum(hit) / sum(support) + 0.3 * avg(f1_score)
                                     + 0.15 * avg(precision) + 0.15 * avg(recall)))) AS score FROM per
  UNION ALL
  SELECT 'regression',
         greatest(0, least(10, 10 * (0.7 * (1 - avg((prediction - label) ^ 2) / var_pop(label))
           + 0.3 * greatest(0, least(1, 1 - sqrt(avg((prediction - label) ^ 2)) / 100))))) FROM num)
SELECT kind, round(score, 4) AS score, {_GRADE_SQL} FROM scores""")
def score(t):
    classes = ev.overall_score(ev.classification_metrics(fx.labelled(t)), "classification")
    numbers = ev.overall_score(ev.regression_metrics(fx.numeric_preds(t)), "regression")
    both = classes.select(F.lit("classification").alias("kind"), "score", "grade").unionByName(
        numbers.select(F.lit("regression").alias("kind"), "score", "grade")
    )
    return fx.rounded(both, ["score"])


@query("eval_pred_range", f"""
WITH {fx.NUMERIC_PREDS_SQL}
SELECT count(*) AS pairs, least(min(label), min(prediction)) AS low,
       greatest(max(label), max(prediction)) AS high FROM preds""")
def pred_range(t):
    return ev.prediction_range(fx.numeric_preds(t))
