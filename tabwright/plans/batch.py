"""Ordered operation lists folded into one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tabwright.operators import edit

OPERATIONS = {
    "drop_columns": lambda df, op: edit.drop_columns(df, op["columns"]),
    "merge_columns": lambda df, op: edit.merge_columns(
        df, op["columns"], op["new_column_name"], op.get("operation", "add")
    ),
    "add_column": lambda df, op: edit.add_column(df, op["column_name"], op["values"], op.get("order_by", ())),
    "filter_rows": lambda df, op: edit.filter_rows(df, op["condition"]),
    "rename_columns": lambda df, op: edit.rename_columns(df, op["rename_map"]),
}


def apply_operations(df: DataFrame, operations: Sequence[Mapping[str, Any]]) -> DataFrame:
    for op in operations:
        kind = op.get("type")
        if kind not in OPERATIONS:
            raise ValueError(f"unknown operation {kind!r}")
        df = df.transform(OPERATIONS[kind], op)
    return df
