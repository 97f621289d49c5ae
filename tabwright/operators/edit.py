"""Column and row edits of a user table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import formula as fx
from tabwright.plans.ordering import with_position


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def require_absent(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")


def drop_columns(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, columns)
    return df.drop(*columns)


def drop_columns_lenient(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))


def add_formula(df: DataFrame, name: str, text: str) -> DataFrame:
    require_absent(df, name)
    return df.withColumn(name, fx.formula(text, df.columns))


def add_values(
    df: DataFrame, name: str, values: DataFrame | Sequence[Any], order_by: Sequence[str], values_order: Sequence[str] = ()
) -> DataFrame:
    """Append one value per row: the first of ``values`` to the first row in ``order_by`` order, and so on.

    A table of values, ordered by its own ``values_order`` with the value in its column ``name`` or else its last column, is
    joined by position and never leaves Spark; a list is what the caller holds on the driver anyway.
    """
    require_absent(df, name)
    if not isinstance(values, DataFrame):
        values = df.sparkSession.createDataFrame(list(enumerate(values)), ["_at", name])
        values_order = ["_at"]
    if not values_order:
        raise ValueError("a table of values needs the order to follow")
    held = name if name in values.columns else values.columns[-1]
    places = {f"_by{i}": quoted(c) for i, c in enumerate(values_order)}
    listed = values.select(*[column.alias(at) for at, column in places.items()], quoted(held).alias(name))
    placed, numbered = with_position(df, order_by, "_row"), with_position(listed, list(places), "_row").select("_row", name)
    rows, given = placed.count(), numbered.count()
    if rows != given:
        raise ValueError(f"{given} values for {rows} rows")
    return placed.join(numbered, "_row").drop("_row")


def add_column(
    df: DataFrame, name: str, values: Any, order_by: Sequence[str] = (), values_order: Sequence[str] = ()
) -> DataFrame:
    if isinstance(values, str):
        return add_formula(df, name, values)
    if isinstance(values, (list, tuple, DataFrame)):
        if not order_by:
            raise ValueError("a list of values needs the row order to follow")
        return add_values(df, name, values, order_by, values_order)
    raise TypeError(f"values must be a formula, a list or a table, not {type(values).__name__}")


def _present(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns with NaN read as missing."""
    floating = (T.DoubleType, T.FloatType)
    return [
        F.when(~F.isnan(quoted(c)), quoted(c)) if isinstance(df.schema[c].dataType, floating) else quoted(c) for c in columns
    ]


def _sum(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in values])


def _product(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(v, F.lit(1)) for v in values])


def _mean(values: Sequence[Column]) -> Column:
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return F.try_divide(_sum(values), present)


def _concat(values: Sequence[Column]) -> Column:
    # a missing value prints as the text below (fixed value)
    return F.concat_ws("_", *[F.coalesce(v.cast("string"), F.lit("nan")) for v in values])


def _pair(values: Sequence[Column], name: str) -> tuple[Column, Column]:
    if len(values) != 2:
        raise ValueError(f"{name} needs exactly two columns")
    return values[0], values[1]


MERGES = {
    "add": _sum,
    "subtract": lambda cs: (lambda a, b: a - b)(*_pair(cs, "subtract")),
    "multiply": _product,
    "divide": lambda cs: F.try_divide(*_pair(cs, "divide")),
    "concat": _concat,
    "mean": _mean,
}


def merge_columns(df: DataFrame, columns: Sequence[str], name: str, operation: str = "add") -> DataFrame:
    """Combine columns row by row; sums, products and means skip missing values."""
    require_columns(df, columns)
    require_absent(df, name)
    if operation not in MERGES:
        raise ValueError(f"unknown merge {operation!r}")
    return df.withColumn(name, MERGES[operation](_present(df, columns)))


def filter_rows(df: DataFrame, text: str) -> DataFrame:
    return df.filter(fx.condition(text, df.columns))


def select_features(
    df: DataFrame, selected: Sequence[str] | None = None, excluded: Sequence[str] | None = None
) -> DataFrame:
    """Keep table order, intersect with ``selected``, subtract ``excluded``."""
    keep = [c for c in df.columns if (not selected or c in selected) and c not in (excluded or ())]
    return df.select(*[quoted(c) for c in keep])


def generated_features(df: DataFrame, features: Sequence[Any]) -> tuple[DataFrame, list[dict[str, str]]]:
    """Add each ``{name, formula}``; a failing one is reported and skipped.

    Plain-string entries name columns that are already there.
    """
    report = []
    for feature in features:
        if isinstance(feature, str):
            report.append({"name": feature, "status": "present"})
            continue
        name, text = feature.get("name", ""), feature.get("formula", "")
        if not name or not text:
            report.append({"name": name, "status": "skipped: name or formula missing"})
            continue
        try:
            wider = df.withColumn(name, fx.expression(text, df.columns))
            wider.schema  # analysis errors surface here, before any job
        except Exception as error:  # noqa: BLE001 - every failure is reported, none stops the rest
            report.append({"name": name, "status": f"skipped: {str(error).splitlines()[0]}"})
            continue
        df = wider
        report.append({"name": name, "status": "added"})
    return df, report


# fixed values: words that announce a target column in a free-text hint
TARGET_WORDS = r"(?i)(?:target|Ziel(?:variable)?|predict|Vorhersage)[^\w]*[:=]*[\"']?([\w\-]+)[\"']?"


def find_target(columns: Sequence[str], target: str | None = None, hint: str = "") -> str:
    if not columns:
        raise ValueError("the table has no columns")
    if target in columns:
        return target
    named = re.search(TARGET_WORDS, hint or "")
    if named and named.group(1) in columns:
        return named.group(1)
    return columns[-1]


def split_features_target(
    df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, hint: str = ""
) -> tuple[DataFrame, list[str], str]:
    """The table cut down to features and target, with their names."""
    target = find_target(df.columns, target, hint)
    names = [c for c in (features or df.columns) if c != target and c in df.columns]
    if not names:
        raise ValueError("no valid features found")
    return df.select(*[quoted(c) for c in names], quoted(target)), names, target


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` this is a distributed top-n."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
