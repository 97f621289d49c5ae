"""Project tables: fingerprints, change histories, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint(projects: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """SHA-256 over the named fields as JSON in name order."""
    text = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return projects.select(key, F.sha2(text, 256).alias("fingerprint"))


def changed(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose stored fingerprint is missing or differs."""
    old = stored.select(key, F.col("fingerprint").alias("_stored"))
    return current.join(old, key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_stored"))).select(key)


def current_projects(changes: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table that results from a log of inserts, partial updates and deletes.

    A row of the log has ``id``, ``op`` (insert, update or delete), the order
    columns and the fields, where NULL means "unchanged".  An update before any
    insert, or after a delete, changes nothing.  Everything is a mergeable
    aggregate, so an id with very many versions is combined before the shuffle.
    """
    at = F.struct(*order)
    deletes = changes.filter(F.col("op") == "delete").groupBy("id").agg(F.max(at).alias("_gone"))
    alive = changes.join(deletes, "id", "left").filter(
        (F.col("op") != "delete") & (F.col("_gone").isNull() | (at > F.col("_gone")))
    )
    births = alive.filter(F.col("op") == "insert").groupBy("id").agg(F.min(at).alias("_born"))
    return (
        alive.join(births, "id")
        .filter(at >= F.col("_born"))
        .groupBy("id")
        .agg(
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields],
            F.count(F.lit(1)).alias("versions"),
        )
    )


def get_project(projects: DataFrame, project_id) -> DataFrame:
    return projects.filter(F.col("id") == project_id)


def list_projects(projects: DataFrame, json_fields: dict[str, str | T.DataType] | None = None) -> DataFrame:
    """All projects, newest first, with their JSON text columns parsed."""
    parsed = {c: F.from_json(c, s) for c, s in (json_fields or {}).items()}
    return projects.withColumns(parsed).orderBy(F.desc("created_at"), "id")
