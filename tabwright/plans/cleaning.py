"""Cleaning as an ordered operation list, its report, and rules that propose a list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators import clean as steps
from tabwright.operators.edit import drop_columns_lenient

# fixed values: operation names of a cleaning list, in lower case
OPERATIONS = {
    "dropmissingrows": lambda df, op: steps.drop_missing_rows(
        df, op.get("columns") or None, op.get("threshold", 1.0)
    ),
    "fillmissing": lambda df, op: steps.fill_missing(
        df, op.get("columns", []), op.get("method", "mean"), op.get("value")
    ),
    "dropcolumn": lambda df, op: drop_columns_lenient(df, op.get("columns", [])),
    "removeoutliers": lambda df, op: steps.remove_outliers(
        df, op.get("columns", []), op.get("method", "iqr"), op.get("single_pass", False)
    ),
    "encodecategorial": lambda df, op: steps.encode_categorical(
        df, op.get("columns", []), op.get("method", "label")
    ),
}
OPERATIONS["encodecategorical"] = OPERATIONS["encodecategorial"]


def clean(df: DataFrame, operations: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Apply the operations in order, each on the result of the one before."""
    for op in operations:
        kind = op.get("type", "").lower()
        if kind not in OPERATIONS:
            raise ValueError(f"unknown cleaning operation {op.get('type')!r}")
        df = df.transform(OPERATIONS[kind], op)
    return df


def cleaning_report(before: DataFrame, after: DataFrame, operations: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Number of operations, both shapes, and what was removed."""
    sides = before.agg(F.count(F.lit(1)).alias("b"), F.lit(None).cast("long").alias("a")).unionAll(
        after.agg(F.lit(None).cast("long").alias("b"), F.count(F.lit(1)).alias("a"))
    )
    wide_before, wide_after = len(before.columns), len(after.columns)
    return sides.agg(F.max("b").alias("rows_before"), F.max("a").alias("rows_after")).select(
        F.lit(len(operations)).cast("long").alias("operations"),
        "rows_before",
        F.lit(wide_before).cast("long").alias("columns_before"),
        "rows_after",
        F.lit(wide_after).cast("long").alias("columns_after"),
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.lit(wide_before - wide_after).cast("long").alias("columns_removed"),
    )


def needs_cleaning(profile: DataFrame, issues: int = 0) -> DataFrame:
    """True when the profile shows missing values or the caller knows of other issues."""
    return profile.agg(
        (F.coalesce(F.max("missing"), F.lit(0)) > 0).alias("_gaps"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
    ).select((F.col("_gaps") | F.lit(issues > 0)).alias("needs_cleaning"), "columns_with_missing")


def plan_cleaning(profile: DataFrame, drop_above: float = 50.0) -> DataFrame:
    """One proposed operation per column that has missing values.

    A column is dropped only when more than ``drop_above`` percent is missing;
    otherwise it is filled: numbers by their mean, texts by their mode.
    """
    mostly_gone = F.col("missing_percentage") > drop_above
    return profile.filter(F.col("missing") > 0).select(
        "column",
        F.when(mostly_gone, "dropColumn").otherwise("fillMissing").alias("type"),
        F.when(~mostly_gone, F.when(F.col("logical_type") == "numeric", "mean").otherwise("mode")).alias("method"),
    )


def as_operations(plan: DataFrame) -> list[dict[str, Any]]:
    """The plan as an operation list; it has at most one row per column of the table."""
    return [
        {"type": r["type"], "columns": [r["column"]], **({"method": r["method"]} if r["method"] else {})}
        for r in plan.orderBy("column").collect()
    ]


def fallback_operations(profile: DataFrame) -> list[dict[str, Any]]:
    """Drop rows of which more than half of the incomplete columns is missing."""
    gaps = [r["column"] for r in profile.filter(F.col("missing") > 0).select("column").orderBy("column").collect()]
    return [{"type": "dropMissingRows", "columns": gaps, "threshold": 0.5}] if gaps else []
