"""Cut a long or non-repeatable plan with a reliable checkpoint.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a
local master, where driver and executors share one disk, falls back to a
fresh temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEWEST_PARTS, ROWS_PER_PART = 8, 250_000
ENOUGH_PARTS, VALUES_PER_PART = 36, 12_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tabwright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so later stages read one fixed copy."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends, and later passes read only what they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_of_parts(df: DataFrame, rows: int, rows_per_part: int) -> int:
    """Parts for passes of a learner, each of which sends the driver something per part: beyond enough parts, narrow rows
    fill them by the number of values."""
    parts = -(-rows // rows_per_part)
    if not any(kind == "vector" or kind.startswith(("array", "struct", "map", "variant")) for _, kind in df.dtypes):
        parts = min(parts, max(ENOUGH_PARTS, -(-rows * len(df.columns) // VALUES_PER_PART)))
    return max(FEWEST_PARTS, parts)


def spread(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Lay rows out by a hash of their columns, for learners that pass over them many times.

    The number of parts follows from the number of rows, and rows are sorted inside a part, so what a
    learner draws from a part does not depend on the cores or on how the table arrived.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant")) and kind != "vector"]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    return df.repartition(number_of_parts(df, df.count(), rows_per_part), key).sortWithinPartitions(key, *[F.col(f"`{c}`") for c in plain])
