"""An exact, repeatable train/test split without a global sort.

Rows are ordered by a hash of their key.  The first ``ceil(share · n)`` of that
order are the test rows, and the hash at which to cut is found by counting rows
per hash prefix: a few aggregates that return at most 4,096 counts each.  The
split itself is then a plain filter, so neither side is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.edit import quoted

PREFIX_STEP = 3


def split_hash(keys: Sequence[str], seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *[quoted(k).cast("string") for k in keys], F.lit(str(seed))))


def _cut(df: DataFrame, hashed: Column, test_share: float) -> str:
    """The bound below which exactly ``ceil(test_share · n)`` hashes lie."""
    rows = df.select(hashed.alias("_h"))
    prefix, wanted = "", None
    while True:
        inside = rows.filter(F.col("_h").startswith(prefix)) if prefix else rows
        width = len(prefix) + PREFIX_STEP
        counts = inside.groupBy(F.substring("_h", 1, width).alias("p")).count().orderBy("p").collect()
        if wanted is None:
            wanted = math.ceil(test_share * sum(r["count"] for r in counts))
            if wanted == 0:
                return ""
        for row in counts:
            if row["count"] >= wanted:
                break
            wanted -= row["count"]
        prefix = row["p"]
        if row["count"] == wanted:
            return prefix + "g"  # sorts after every hash with this prefix
        if len(prefix) >= 32:
            raise ValueError("the key columns do not identify rows uniquely")


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the test side has exactly ``ceil(share · n)`` rows."""
    marked = mark_split(df, keys, test_share, seed)
    return marked.filter(~F.col("_test")).drop("_test"), marked.filter("_test").drop("_test")


def mark_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """The table with a boolean ``_test`` column."""
    hashed = split_hash(keys, seed)
    return df.withColumn("_test", hashed < F.lit(_cut(df, hashed, test_share)))


def hash_split(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The cheap form: a hash bucket decides, sizes are only close to the share."""
    bucket = F.pmod(F.xxhash64(*[quoted(k) for k in keys], F.lit(seed)), F.lit(1_000_000))
    inside = bucket < F.lit(round(test_share * 1_000_000))
    return df.filter(~inside), df.filter(inside)
