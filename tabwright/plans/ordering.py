"""Row positions and bounded chunks without a single-task window.

A window with no (or with a hot) partition key puts an unbounded group into
one task.  Here the table is range-sorted, which splits hot keys as long as
the sort key ends in something unique, and positions come from the rows' place
inside each sorted partition plus the partition's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.plans.lineage import cut_lineage

ROWS_PER_CHUNK = 250_000


def with_position(df: DataFrame, order_by: Sequence[Column | str], name: str = "_pos") -> DataFrame:
    """Append the 0-based position of every row in the global order.

    The sorted rows are checkpointed first: partition offsets and rows must
    come from the same range boundaries, and those are sampled per exchange.
    The offsets table has one row per shuffle partition, so its size is bounded
    by the session's partition count.
    """
    fixed = cut_lineage(df.orderBy(*order_by))
    tagged = fixed.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    sizes = tagged.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    offsets, seen = [], 0
    for row in sizes:
        offsets.append((int(row["_part"]), seen))
        seen += row["count"]
    spark = df.sparkSession
    offset_table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _offset long")
    in_partition = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offset_table), "_part")
        .withColumn(name, F.col("_offset") + in_partition)
        .drop("_part", "_offset", "_mid")
    )


def with_chunks(
    df: DataFrame,
    order_by: Sequence[Column | str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Append ``_pos`` and ``_chunk``; no chunk holds more than ``rows_per_chunk`` rows."""
    placed = with_position(df, order_by)
    return placed.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(rows_per_chunk)).cast("long"))


def carry_over(chunked: DataFrame, rows_before: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Copy the last ``rows_before`` rows of each chunk into the next one.

    Copies are marked ``_carried`` so that a trailing frame of
    ``rows_before + 1`` rows is whole inside every chunk; drop them after the
    window has run.
    """
    if rows_before > rows_per_chunk:
        raise ValueError("a chunk must be at least as long as the frame")
    tail = F.col("_pos") % F.lit(rows_per_chunk) >= F.lit(rows_per_chunk - rows_before)
    homes = F.when(tail, F.array(F.col("_chunk"), F.col("_chunk") + 1)).otherwise(F.array("_chunk"))
    return (
        chunked.withColumn("_home", F.explode(homes))
        .withColumn("_carried", F.col("_home") != F.col("_chunk"))
        .drop("_chunk")
        .withColumnRenamed("_home", "_chunk")
    )
