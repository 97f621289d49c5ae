"""Queries over the metadata of cached prediction scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.clock import hours_before, moment, seconds_between

# fixed values: allowed age limits in hours
MIN_HOURS, MAX_HOURS, DEFAULT_HOURS = 1, 8760, 168


def last_touched() -> Column:
    return F.coalesce("last_used", "created_at")


def cache_status(meta: DataFrame, files: DataFrame, now) -> DataFrame:
    """One row per cached project, newest first.

    ``files`` has ``project_id``, ``kind`` (script or encoder) and ``size``.
    """
    sizes = files.groupBy("project_id").agg(
        F.max(F.when(F.col("kind") == "script", F.col("size"))).alias("_script"),
        F.max(F.when(F.col("kind") == "encoder", F.col("size"))).alias("_encoder"),
    )
    age = F.round(seconds_between(last_touched(), moment(now)) / 3600).cast("long")
    return (
        meta.join(sizes, "project_id", "left")
        .select(
            "project_id",
            "created_at",
            "last_used",
            F.col("_script").isNotNull().alias("script_exists"),
            F.col("_encoder").isNotNull().alias("encoder_exists"),
            (F.coalesce("_script", F.lit(0)) + F.coalesce("_encoder", F.lit(0))).cast("long").alias("total_size"),
            F.concat(F.substring("project_hash", 1, 8), F.lit("...")).alias("hash"),
            age.alias("age_hours"),
        )
        .orderBy(F.desc(last_touched()), "project_id")
    )


def cache_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total_metadata"),
        F.count_if("script_exists").alias("total_scripts"),
        F.count_if("encoder_exists").alias("total_encoders"),
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size_bytes"),
    ).withColumn("total_size_mb", F.round(F.col("total_size_bytes") / (1024 * 1024), 2))


def expire_cache(meta: DataFrame, now, hours: float = DEFAULT_HOURS) -> DataFrame:
    """Projects whose cached files are due for removal; nothing is deleted."""
    if not MIN_HOURS <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be between {MIN_HOURS} and {MAX_HOURS}")
    return meta.filter(last_touched() < hours_before(moment(now), hours)).select("project_id")
