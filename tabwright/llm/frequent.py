"""The head of a table of counts, small enough for every task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 4096


def least_count(counted: DataFrame, most: int, count: str = "c") -> int | None:
    """The smallest count so that at most ``most`` rows have it or more; None if even the largest has too many rows."""
    sizes = counted.groupBy(count).agg(F.count(F.lit(1)).alias("n"))
    least, total = None, 0
    while True:  # a page is one job, however many partitions there are; one page nearly always holds the head
        rest = sizes if least is None else sizes.filter(F.col(count) < least)
        page = rest.orderBy(F.desc(count)).limit(PAGE).collect()
        for row in page:
            total += row["n"]
            if total > most:
                return least
            least = row[count]
        if len(page) < PAGE:
            return least


def head_of(counted: DataFrame, least: int | None, count: str = "c") -> pd.DataFrame:
    """The rows with at least that count, on the driver."""
    return counted.filter(F.col(count) >= least if least is not None else F.lit(False)).toPandas()
