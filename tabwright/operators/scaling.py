"""Queries over worker scaling events: ``pool``, ``event_id``, ``ts``, ``direction``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.functions.clock import hours_before, moment, seconds_between
from tabwright.operators.monitor import newest

# fixed values of the scaling rules
EVENTS_KEPT = 50
EVENTS_JUDGED = 10
OSCILLATION_SECONDS = 5 * 60

def _newest_first():
    return [F.desc("ts"), F.desc("event_id")]


def scaling_history(events: DataFrame, now, hours: float = 24, pool=None) -> DataFrame:
    chosen = events if pool is None else events.filter(F.col("pool") == pool)
    return chosen.filter(F.col("ts") > hours_before(moment(now), hours))


def recent_events(events: DataFrame, keep: int = EVENTS_KEPT) -> DataFrame:
    return newest(events, ["pool"], _newest_first(), keep)


def scaling_totals(events: DataFrame) -> DataFrame:
    up = F.col("direction") == "up"
    return events.groupBy("pool").agg(
        F.count_if(up).alias("scale_ups"),
        F.count_if(~up).alias("scale_downs"),
        F.max(F.when(up, F.col("ts"))).alias("last_scale_up"),
        F.max(F.when(~up, F.col("ts"))).alias("last_scale_down"),
    )


def scaling_efficiency(events: DataFrame, judged: int = EVENTS_JUDGED) -> DataFrame:
    """Share of the last events that is not part of a quick back-and-forth."""
    along = Window.partitionBy("pool").orderBy("ts", "event_id")
    recent = recent_events(events, judged).select(
        "pool",
        "direction",
        F.lead("direction", 1).over(along).alias("_next"),
        F.lead("direction", 2).over(along).alias("_after"),
        seconds_between(F.col("ts"), F.lead("ts", 2).over(along)).alias("_gap"),
    )
    swing = (
        (F.col("direction") != F.col("_next"))
        & (F.col("direction") == F.col("_after"))
        & (F.col("_gap") < OSCILLATION_SECONDS)
    )
    judged_pools = recent.groupBy("pool").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(swing).alias("oscillations")
    )
    share = F.greatest(F.lit(0.0), 1 - F.try_divide("oscillations", "events"))
    verdict = (
        F.when(F.col("events") < 2, "not enough data")
        .when(F.col("efficiency") < 0.7, "frequent oscillations, check the limits")
        .when(F.col("efficiency") < 0.9, "occasional oscillations, watch performance")
        .otherwise("stable scaling")
    )
    return judged_pools.withColumn(
        "efficiency", F.when(F.col("events") < 2, 1.0).otherwise(share)
    ).withColumn("analysis", verdict)


def stability(efficiency: DataFrame) -> DataFrame:
    mean = efficiency.agg(F.avg("efficiency").alias("average_efficiency"))
    value = F.col("average_efficiency")
    return mean.withColumn(
        "stability",
        F.when(value > 0.9, "Excellent").when(value > 0.8, "Good").when(value > 0.7, "Fair")
        .otherwise("Needs Attention"),
    )


def utilization(metrics: DataFrame) -> DataFrame:
    """Busy share of each pool's workers with a verdict; the first matching rule wins."""
    load = F.coalesce(F.try_divide("busy_workers", "active_workers"), F.lit(0.0))
    verdict = (
        F.when(F.col("active_workers") == 0, "no active workers")
        .when((F.col("utilization") > 0.8) & (F.col("queue_length") > 0), "scale up")
        .when((F.col("utilization") < 0.3) & (F.col("queue_length") == 0), "scale down possible")
        .when(F.col("utilization") > 0.9, "high load, more workers needed")
        .otherwise("optimal")
    )
    return metrics.withColumn("utilization", load).withColumn("recommendation", verdict)
