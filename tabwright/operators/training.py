"""Targets, algorithms and their parameters, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.clean import codebook
from tabwright.operators.edit import quoted
from tabwright.plans.quantiles import number

# fixed values: algorithm names and default parameters.  Where Spark has only the
# linear support vector machine, the kernel default is "linear".
ALGORITHMS: dict[str, dict[str, Any]] = {
    "RandomForestClassifier": {
        "n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1,
        "max_features": "sqrt",
    },
    "LogisticRegression": {"max_iter": 1000, "C": 1.0, "solver": "lbfgs"},
    "SVC": {"C": 1.0, "kernel": "linear"},
    "GradientBoostingClassifier": {
        "n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_samples_split": 2,
    },
    "KNeighborsClassifier": {"n_neighbors": 5, "weights": "uniform", "algorithm": "auto"},
    "DecisionTreeClassifier": {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "RandomForestRegressor": {
        "n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1,
        "max_features": "sqrt",
    },
    "LinearRegression": {},
    "Ridge": {"alpha": 1.0},
    "Lasso": {"alpha": 1.0},
    "GradientBoostingRegressor": {
        "n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_samples_split": 2,
    },
    "XGBoostClassifier": {
        "n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0,
    },
    "XGBoostRegressor": {
        "n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0,
    },
    "NeuralNetwork": {
        "nn_hidden_layers": [64, 32], "learning_rate": 0.001, "batch_size": 16, "num_epochs": 10,
    },
}

# fixed values: lowest and highest value a parameter is clamped to
LIMITS = {
    "n_estimators": (1, None), "max_depth": (1, None), "learning_rate": (0.001, 1.0), "C": (0.001, None),
    "min_samples_split": (2, None), "max_iter": (1, None),
}

REGRESSORS = {
    "RandomForestRegressor", "LinearRegression", "Ridge", "Lasso", "GradientBoostingRegressor", "XGBoostRegressor",
}
SCALED = {"SVC", "LogisticRegression", "KNeighborsClassifier", "NeuralNetwork"}
DEEPEST_TREE = 30
SPLIT_BINS = 256  # at least; more if a text feature has more values
TREES = {
    "RandomForestClassifier", "RandomForestRegressor", "DecisionTreeClassifier", "GradientBoostingClassifier",
    "GradientBoostingRegressor", "XGBoostClassifier", "XGBoostRegressor",
}


def problem_kind(algorithm: str) -> str:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return "regression" if algorithm in REGRESSORS else "classification"


def checked_params(algorithm: str, params: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Known parameters in their proper type and range; the rest are defaults."""
    problem_kind(algorithm)
    defaults = ALGORITHMS[algorithm]
    result = dict(defaults)
    for name, value in (params or {}).items():
        if name not in defaults:
            continue
        default = defaults[name]
        if isinstance(value, (list, tuple)) and not isinstance(default, list):
            value = value[0] if value else None
        if isinstance(value, str) and value.strip() in ("None", "null"):
            value = None
        try:
            if isinstance(default, int):
                value = int(float(value))
            elif isinstance(default, float):
                value = float(value)
            low, high = LIMITS.get(name, (None, None))
            if isinstance(value, (int, float)):
                value = value if low is None else max(low, value)
                value = value if high is None else min(high, value)
                if name == "max_depth":
                    value = int(value)
        except (TypeError, ValueError):
            value = default
        result[name] = value
    return result


def _tree(params: Mapping[str, Any], bins: int) -> dict[str, Any]:
    depth = params.get("max_depth")
    if depth is not None and depth > DEEPEST_TREE:
        raise ValueError(f"max_depth {depth} is above {DEEPEST_TREE}, the deepest tree that can be built")
    smallest = max(params.get("min_samples_leaf", 1), params.get("min_samples_split", 2) // 2)
    deepest = DEEPEST_TREE if depth is None else depth
    return {"maxDepth": deepest, "minInstancesPerNode": smallest, "maxBins": bins}


def _feature_share(value: Any) -> str:
    if value is None:
        return "all"
    return str(value) if isinstance(value, str) else ("all" if float(value) >= 1.0 else str(float(value)))


def estimator(
    algorithm: str,
    params: Mapping[str, Any],
    rows: int,
    features: int,
    classes: int = 2,
    label_std: float = 1.0,
    seed: int = 42,
    bins: int = SPLIT_BINS,
) -> Estimator:
    """The Spark ML estimator for an algorithm name and checked parameters.

    Penalties are per row in Spark and per table in the names used here, hence
    the row count; Spark also scales the squared penalty by the label's spread.
    """
    p = dict(params)
    columns = {"featuresCol": "_features", "labelCol": "_label"}

    def several(binary: Estimator) -> Estimator:
        return binary if classes <= 2 else mlc.OneVsRest(classifier=binary, **columns)

    match algorithm:
        case "RandomForestClassifier" | "RandomForestRegressor":
            kind = mlc.RandomForestClassifier if algorithm.endswith("Classifier") else mlr.RandomForestRegressor
            return kind(
                numTrees=p["n_estimators"], featureSubsetStrategy=_feature_share(p["max_features"]), seed=seed,
                **_tree(p, bins), **columns,
            )
        case "DecisionTreeClassifier":
            return mlc.DecisionTreeClassifier(seed=seed, **_tree(p, bins), **columns)
        case "LogisticRegression":
            return mlc.LogisticRegression(
                maxIter=p["max_iter"], regParam=1.0 / (p["C"] * rows), elasticNetParam=0.0, standardization=False,
                **columns,
            )
        case "SVC":
            if p["kernel"] != "linear":
                raise ValueError("only the linear kernel is available")
            return several(mlc.LinearSVC(regParam=1.0 / (p["C"] * rows), tol=1e-3, standardization=False, **columns))
        case "GradientBoostingClassifier":
            return several(
                mlc.GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], seed=seed, **_tree(p, bins), **columns)
            )
        case "GradientBoostingRegressor":
            return mlr.GBTRegressor(
                maxIter=p["n_estimators"], stepSize=p["learning_rate"], seed=seed, **_tree(p, bins), **columns
            )
        case "XGBoostClassifier" | "XGBoostRegressor":
            boosted = {
                "maxIter": p["n_estimators"], "stepSize": p["learning_rate"], "maxDepth": p["max_depth"],
                "maxBins": bins, "subsamplingRate": p["subsample"], "featureSubsetStrategy": _feature_share(p["colsample_bytree"]),
                "seed": seed, **columns,
            }
            if algorithm == "XGBoostRegressor":
                return mlr.GBTRegressor(**boosted)
            return several(mlc.GBTClassifier(**boosted))
        case "LinearRegression":
            return mlr.LinearRegression(regParam=0.0, **columns)
        case "Ridge":
            return mlr.LinearRegression(
                elasticNetParam=0.0, regParam=p["alpha"] / rows * label_std, standardization=False, **columns
            )
        case "Lasso":
            return mlr.LinearRegression(
                elasticNetParam=1.0, regParam=p["alpha"], standardization=False, tol=1e-9, maxIter=1000, **columns
            )
        case "NeuralNetwork":
            layers = [features, *p["nn_hidden_layers"], max(2, classes)]
            # ten quasi-Newton steps stand for one pass of mini-batches
            return mlc.MultilayerPerceptronClassifier(
                layers=layers, maxIter=10 * p["num_epochs"], seed=seed, **columns
            )
    raise ValueError(f"{algorithm} is not a Spark ML estimator")


def encode_target(df: DataFrame, target: str, kind: str, name: str = "label") -> tuple[DataFrame, DataFrame | None]:
    """Append the numeric label, and return the code table where one was needed.

    Classification keeps numbers and ranks texts by sorted order; regression
    reads texts as numbers and drops rows where that fails.
    """
    is_number = isinstance(df.schema[target].dataType, T.NumericType)
    if kind == "regression":
        value = number(target) if is_number else quoted(target).cast("string").try_cast("double")
        return df.withColumn(name, value).filter(F.col(name).isNotNull()), None
    if is_number:
        return df.withColumn(name, number(target)), None
    codes = codebook(df, target)
    joined = df.join(codes, quoted(target) == F.col("_value"))
    coded = joined.withColumn(name, F.col("_code").cast("double")).drop("_value", "_code")
    return coded, codes.select(F.col("_value").alias("value"), F.col("_code").alias("code"))


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit sample deviation; a constant column becomes 0."""
    row = df.agg(
        *[f(number(c)).alias(f"{tag}{i}") for i, c in enumerate(columns)
          for tag, f in (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        centred = number(c) - F.lit(row[f"m{i}"])
        scaled[c] = centred / F.lit(row[f"s{i}"]) if row[f"s{i}"] else centred
    return df.withColumns(scaled)


def impute_mean(train: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill numeric gaps of ``table`` with means learnt from the training rows."""
    from pyspark.ml.feature import Imputer

    typed = {c: number(c) for c in columns}
    model = Imputer(inputCols=list(columns), outputCols=list(columns), strategy="mean").fit(train.withColumns(typed))
    return model.transform(table.withColumns(typed))
