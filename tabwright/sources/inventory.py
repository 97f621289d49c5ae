"""What lies in a folder, without opening any file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and time of every file below a folder, newest first."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        "path",
    ).orderBy(F.desc("last_modified"), "path")


def storage_stats(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """Files and bytes per kind, with a ``total`` row."""
    parts = [list_files(spark, path).select(F.lit(kind).alias("kind"), "size") for kind, path in folders.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return (
        whole.rollup("kind")
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
        .withColumn("kind", F.coalesce("kind", F.lit("total")))
    )
