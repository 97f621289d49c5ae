"""Running and trailing statistics per key that survive a hot key.

The rows are cut into chunks of bounded size along (keys, order); a window then
runs per key and chunk, and what earlier chunks contribute is added from their
totals or carried rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.plans.ordering import ROWS_PER_CHUNK, carry_over, with_chunks


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Append ``<name>_n`` and ``<name>_sum``: count and sum up to and including each row.

    ``order`` must end in something unique per row.
    """
    named = df.withColumns({f"_v_{n}": c.cast("double") for n, c in values.items()})
    chunked = with_chunks(named, [*keys, *order], rows_per_chunk)
    added = [f"{n}_{tag}" for n in values for tag in ("n", "sum")]
    return totals_in_chunks(chunked, keys, list(values)).select(*df.columns, *added)


def totals_in_chunks(chunked: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Running totals of the columns ``_v_<name>`` of rows that have a position and a chunk."""
    totals = chunked.groupBy(*keys, "_chunk").agg(
        *[f(f"_v_{n}").alias(f"{tag}_{n}") for n in values for tag, f in (("_tn", F.count), ("_ts", F.sum))]
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"{tag}_{n}").over(before), F.lit(0)).alias(f"_p{tag}_{n}")
          for n in values for tag in ("_tn", "_ts")],
    )
    here = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumns(
        {f"{n}_n": F.count(f"_v_{n}").over(here) for n in values}
        | {f"{n}_sum": F.coalesce(F.sum(f"_v_{n}").over(here), F.lit(0.0)) for n in values}
    )
    joined = local.join(earlier, [*keys, "_chunk"])
    return joined.withColumns(
        {f"{n}_n": F.col(f"{n}_n") + F.col(f"_p_tn_{n}") for n in values}
        | {f"{n}_sum": F.col(f"{n}_sum") + F.col(f"_p_ts_{n}") for n in values}
    ).drop(*[f"_p{tag}_{n}" for n in values for tag in ("_tn", "_ts")])


def trailing_means(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    rows: int,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Append the mean of each value over the last ``rows`` rows, nulls skipped.

    Sums are built from blocks of ``rows`` rows: a trailing frame is the rest
    of one block plus the beginning of the next, so each row costs a constant
    number of additions and no large sums are subtracted from each other.
    """
    named = df.withColumns({f"_v_{n}": c.cast("double") for n, c in values.items()})
    chunked = with_chunks(named, [*keys, *order], rows_per_chunk)
    return means_in_chunks(chunked, keys, list(values), rows, rows_per_chunk).select(*df.columns, *values)


def means_in_chunks(
    chunked: DataFrame, keys: Sequence[str], values: Sequence[str], rows: int, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Trailing means of the columns ``_v_<name>`` of rows that have a position and a chunk."""
    kept = chunked.columns
    chunked = carry_over(chunked, rows - 1, rows_per_chunk)
    group = [*keys, "_chunk"]
    along = Window.partitionBy(*group).orderBy("_pos")
    placed = chunked.withColumn("_at", F.row_number().over(along) - 1)
    placed = placed.withColumn("_block", F.floor(F.col("_at") / F.lit(rows)))
    to_here = Window.partitionBy(*group, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy(*group, "_block").orderBy(F.desc("_pos")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    sums = placed.withColumns(
        {f"_{side}n_{n}": F.count(f"_v_{n}").over(w) for n in values
         for side, w in (("head", to_here), ("rest", from_here))}
        | {f"_{side}s_{n}": F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0.0)) for n in values
           for side, w in (("head", to_here), ("rest", from_here))}
    )

    def whole(part: str, name: str) -> Column:
        head, rest = F.col(f"_head{part}_{name}"), F.lag(f"_rest{part}_{name}", rows - 1).over(along)
        full_block = F.col("_at") % rows == rows - 1
        return head + F.when(full_block, 0).otherwise(F.coalesce(rest, F.lit(0)))

    means = sums.withColumns({n: F.try_divide(whole("s", n), whole("n", n)) for n in values})
    return means.filter(~F.col("_carried")).select(*kept, *values)
