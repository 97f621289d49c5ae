"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.plans.lineage import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends and columns can be pruned."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least node of the neighbourhood: those above it (large) or those up to it (small).

    A large step gives a row for each link at most, so only a small one, which follows it, makes rows distinct.
    """
    seen = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node that has a link.

    A step is two aggregations and joins on nodes; a hub is combined before the
    shuffle and its rows can be split by adaptive execution.  Steps repeat until
    every node links to its least node; their number grows with the logarithm of the size.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        edges = stored(_starred(_starred(edges, large=True), large=False), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
