"""Cleaning steps: missing values, outliers, categorical encodings.

Statistics a step needs (means, bounds, category lists) are computed first and
enter the plan as literals, so range filters still reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.edit import quoted
from tabwright.operators.profile import iqr_bounds, is_missing
from tabwright.plans.ordering import with_position
from tabwright.plans.quantiles import exact_quantiles, number


def _existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in _existing(df, columns) if isinstance(df.schema[c].dataType, T.NumericType)]


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """Drop rows with any missing value or, below 1, with more than that share missing."""
    subset = list(columns) if columns else df.columns
    if threshold >= 1.0:
        return df.na.drop("any", subset=subset)
    return df.na.drop(thresh=len(subset) - math.floor(len(subset) * threshold), subset=subset)


def _filled(df: DataFrame, name: str, value: Any, cast: str | T.DataType) -> DataFrame:
    fill = F.when(is_missing(df, name), F.lit(value).cast(cast)).otherwise(quoted(name).cast(cast))
    return df.withColumn(name, fill)


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Most frequent value per column, the smallest one on a tie."""
    modes = {}
    for c in columns:
        top = (
            df.filter(~is_missing(df, c))
            .groupBy(quoted(c).alias("v"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("v"))
            .first()
        )
        modes[c] = top["v"] if top else None
    return modes


def fill_missing(df: DataFrame, columns: Sequence[str], method: str = "mean", value: Any = None) -> DataFrame:
    columns = _existing(df, columns)
    if method in ("mean", "median"):
        columns = _numeric(df, columns)
        if not columns:
            return df
        if method == "mean":
            row = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
            fills = {c: row[f"m{i}"] for i, c in enumerate(columns)}
        else:
            fills = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
        for c in columns:
            df = _filled(df, c, fills[c], "double")
        return df
    if method == "mode":
        for c, mode in column_modes(df, columns).items():
            if mode is not None:
                df = _filled(df, c, mode, df.schema[c].dataType)
        return df
    if method == "constant":
        if value is None:
            return df
        for c in columns:
            df = _filled(df, c, value, df.schema[c].dataType)
        return df
    if method == "drop":
        return df.na.drop("any", subset=columns) if columns else df
    raise ValueError(f"unknown fill method {method!r}")


def remove_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", single_pass: bool = False
) -> DataFrame:
    """Drop rows outside the bounds of each numeric column.

    Columns are taken in turn and each one's bounds come from the rows still
    there; ``single_pass`` takes all bounds from the input instead, one round
    of statistics for any number of columns.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError(f"unknown outlier method {method!r}")
    columns = _numeric(df, columns)
    groups = [columns] if single_pass else [[c] for c in columns]
    for group in groups:
        if not group:
            continue
        if method == "iqr":
            quart = exact_quantiles(df, group, [0.25, 0.75])
            for c in group:
                low, high = iqr_bounds(*quart[c])
                df = df.filter(quoted(c).between(low, high)) if low is not None else df.filter(~is_missing(df, c))
        else:
            row = df.agg(
                *[f(number(c)).alias(f"{tag}{i}") for i, c in enumerate(group)
                  for tag, f in (("mean", F.avg), ("std", F.stddev_samp))]
            ).first()
            for i, c in enumerate(group):
                mean, std = row[f"mean{i}"], row[f"std{i}"]
                if std:
                    df = df.filter(F.abs((number(c) - F.lit(mean)) / F.lit(std)) < 3)
                else:  # no spread, hence no outliers
                    df = df.filter(~is_missing(df, c))
    return df


def categories(df: DataFrame, column: str) -> list[Any]:
    """Sorted distinct values, as many as the columns that are made of them."""
    values = df.filter(~is_missing(df, column)).select(quoted(column).alias("v")).distinct()
    return sorted(r["v"] for r in values.collect())


def onehot(df: DataFrame, column: str) -> DataFrame:
    """Replace a column by one boolean column per value, in value order.

    For a column of very many values ``onehot_vector`` makes one sparse vector instead.
    """
    flags = [F.coalesce(quoted(column) == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in categories(df, column)]
    kept = [quoted(c) for c in df.columns if c != column]
    return df.select(*kept, *flags)


def onehot_vector(df: DataFrame, column: str) -> DataFrame:
    """Replace a column by a sparse vector with a 1 at the rank of its value; missing values are all zero."""
    width = df.select(quoted(column)).distinct().filter(quoted(column).isNotNull()).count()
    coded = label_encode(df, column)
    place = F.when(quoted(column) >= 0, quoted(column)).otherwise(F.lit(width)).cast("double")
    encoder = OneHotEncoder(inputCol="_place", outputCol="_vector", dropLast=True)
    encoder = encoder.fit(df.sparkSession.createDataFrame([(float(width),)], "_place double"))  # the last place is the missing one
    vectors = encoder.transform(coded.withColumn("_place", place))
    return vectors.select(*[F.col("_vector").alias(c) if c == column else quoted(c) for c in df.columns])


def codebook(df: DataFrame, column: str) -> DataFrame:
    """Values (``_value``) and their rank among the sorted distinct values (``_code``)."""
    values = df.filter(~is_missing(df, column)).select(quoted(column).alias("_value")).distinct()
    return with_position(values, ["_value"], "_code")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Replace values by their rank; missing becomes -1.

    The codes are joined on the value: adaptive execution broadcasts them if
    they turn out small, and else splits a value that holds many rows.
    """
    order = df.columns
    joined = df.join(codebook(df, column), quoted(column) == F.col("_value"), "left")
    coded = joined.withColumn("_code", F.coalesce("_code", F.lit(-1)).cast("long"))
    return coded.select(*[F.col("_code").alias(c) if c == column else quoted(c) for c in order])


def encode_categorical(df: DataFrame, columns: Sequence[str], method: str = "label") -> DataFrame:
    """``onehot`` makes a column per value, ``onehot_vector`` one sparse vector for any number of values."""
    ways = {"label": label_encode, "onehot": onehot, "onehot_vector": onehot_vector}
    if method not in ways:
        raise ValueError(f"unknown encoding {method!r}")
    for c in _existing(df, columns):
        df = ways[method](df, c)
    return df
