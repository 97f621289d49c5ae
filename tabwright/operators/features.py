"""Nonlinear feature expansion and selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.edit import quoted, require_columns
from tabwright.plans.quantiles import number

UNARY: dict[str, Callable[[Column], Column]] = {
    "inv": lambda x: F.try_divide(F.lit(1.0), x),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "log": lambda x: F.when(x > 0, F.ln(x)),
    "exp": F.exp,
    "abs": F.abs,
    "sq": lambda x: x * x,
    "cube": lambda x: x * x * x,
}


def expansions(columns: Sequence[str]) -> dict[str, Column]:
    """Unary terms of every column and products of every pair; undefined values are NULL."""
    terms = {f"{name}_{c}": make(number(c)) for c in columns for name, make in UNARY.items()}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            terms[f"{a}_x_{b}"] = number(a) * number(b)
    return terms


def expand_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.withColumns(expansions(columns))


def feature_correlations(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Correlation of every named column with the target, in one aggregate."""
    parts = [
        F.struct(F.lit(c).alias("feature"), F.corr(number(c), number(target)).alias("correlation")) for c in names
    ]
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def keep_useful(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.1) -> DataFrame:
    """The table with those expansions whose correlation with the target reaches the threshold."""
    wide = expand_features(df, columns)
    names = list(expansions(columns))
    scores = feature_correlations(wide, names, target).filter(F.abs("correlation") >= threshold).collect()
    useful = {r["feature"] for r in scores}
    return wide.select(*[quoted(c) for c in df.columns], *[quoted(c) for c in names if c in useful])


def lasso_useful(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 0.01) -> list[str]:
    """Names of the terms a Lasso over the standardised expansion keeps."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = [*columns, *expansions(columns)]
    wide = expand_features(df, columns).select(
        *[number(c).alias(c) for c in names], number(target).alias("_label")
    ).filter(F.col("_label").isNotNull())
    filled = [f"_i_{c}" for c in names]
    model = Pipeline(
        stages=[
            Imputer(inputCols=names, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
            LinearRegression(
                featuresCol="_scaled", labelCol="_label", elasticNetParam=1.0, regParam=alpha, standardization=False
            ),
        ]
    ).fit(wide)
    return [c for c, w in zip(names, model.stages[-1].coefficients) if abs(w) > 1e-9]
