"""Versioned writes: a table is never overwritten, the version before is the backup."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.sources.inventory import list_files
from tabwright.sources.readers import Schema, read_csv, read_parquet

FORMATS = ("csv", "parquet")


def save_version(df: DataFrame, folder: str, version: str | None = None, fmt: str = "csv") -> str:
    """Write to ``folder/version=…`` and return that path; an existing version is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    version = version or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{folder}/version={version}"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)
    return path


def finished_versions(spark: SparkSession, folder: str) -> list[str]:
    """Versions whose writing has ended, oldest first, by the time of their end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    marks = hadoop.Path(f"{folder}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    ended = [(s.getModificationTime(), s.getPath().getParent().getName().removeprefix("version=")) for s in found or []]
    return [name for _, name in sorted(ended)]


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The finished versions in a folder with their files and bytes."""
    name = F.regexp_extract("path", r"/version=([^/]+)/", 1)
    return (
        list_files(spark, folder, "part-*")
        .groupBy(name.alias("version"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("total_size"))
        .filter(F.col("version").isin(finished_versions(spark, folder)))
    )


def read_version(
    spark: SparkSession, folder: str, version: str | None = None, fmt: str = "csv", schema: Schema = None
) -> DataFrame:
    """A given version, or the newest one."""
    if version is None:
        finished = finished_versions(spark, folder)
        if not finished:
            raise ValueError(f"no finished version in {folder}")
        version = finished[-1]
    path = f"{folder}/version={version}"
    return read_csv(spark, path, schema) if fmt == "csv" else read_parquet(spark, path)
