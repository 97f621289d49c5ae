"""Prediction monitoring over event tables.

An event has ``project``, ``event_id``, ``ts``, ``features`` (map of numbers),
``prediction`` and ``truth``.  Events count in (ts, event_id) order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.plans.lineage import cut_lineage
from tabwright.plans.ordering import ROWS_PER_CHUNK, with_chunks
from tabwright.plans.quantiles import number
from tabwright.plans.running import means_in_chunks, running_totals, totals_in_chunks, trailing_means

# fixed values of the monitoring rules
LAST_EVENTS = 500
ALERT_LIMIT = 3
ALERTS_KEPT = 1000
ALERTS_SHOWN = 50
DEVIATION_CAP = 10
SEVERITY = "warning"
CODE = "DRIFT_DETECTED"

EVENT_ORDER = ["ts", "event_id"]


def baseline(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample std and count per feature of the training data."""
    parts = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(number(c)).alias("mean"),
            F.coalesce(F.stddev_samp(number(c)), F.lit(0.0)).alias("std"),
            F.count(number(c)).alias("n"),
        )
        for c in features
    ]
    return df.agg(F.array(*parts).alias("_r")).select(F.inline("_r"))


def finite(value: Column) -> Column:
    """The value as double; NaN and infinities read as missing."""
    plain = value.cast("double")
    return F.when(~F.isnan(plain) & (F.abs(plain) != F.lit(float("inf"))), plain)


def feature_stats(events: DataFrame) -> DataFrame:
    """Count, mean and sample std per project and feature.

    Only mergeable aggregates, so a hot project is combined before the shuffle
    and the same plan runs as a stream.
    """
    values = events.select("project", F.explode("features").alias("feature", "_value")).select(
        "project", "feature", finite(F.col("_value")).alias("_value")
    )
    return values.filter(F.col("_value").isNotNull()).groupBy("project", "feature").agg(
        F.count("_value").alias("n"),
        F.avg("_value").alias("mean"),
        F.coalesce(F.stddev_samp("_value"), F.lit(0.0)).alias("std"),
    )


def _deviation(live: Column, mean: Column, std: Column) -> Column:
    distance = F.abs(F.try_divide(live - mean, std))
    # least() skips nulls, and an unknown distance must stay unknown
    return F.when(distance.isNotNull(), F.least(distance, F.lit(float(DEVIATION_CAP))))


def drift_score(base: DataFrame, live: DataFrame) -> DataFrame:
    """Mean capped deviation of the live means from the baseline, per project.

    Features unknown to the baseline or without spread there are skipped; a
    project with none left scores 0.
    """
    known = base.select("feature", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    usable = F.when(F.col("_std") != 0, _deviation(F.col("mean"), F.col("_mean"), F.col("_std")))
    return (
        live.join(known, "feature", "left")
        .groupBy("project")
        .agg(F.coalesce(F.avg(usable), F.lit(0.0)).alias("raw_score"))
        .withColumn("drift_score", F.round("raw_score", 3))
    )


def drift_alerts(scores: DataFrame, limit: float = ALERT_LIMIT) -> DataFrame:
    """An alert row for every score at or above the limit."""
    return scores.filter(F.col("raw_score") >= limit).withColumns(
        {
            "severity": F.lit(SEVERITY),
            "code": F.lit(CODE),
            "message": F.format_string("possible data drift (score=%.3f)", F.col("raw_score")),
        }
    )


def newest(df: DataFrame, per: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows per group; tasks prune to ``keep`` before the shuffle."""
    window = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= keep).drop("_rank")


def latest_alerts(alerts: DataFrame, keep: int = ALERTS_KEPT) -> DataFrame:
    return newest(alerts, ["project"], [F.desc(c) for c in EVENT_ORDER], keep)


def _numeric_pair() -> Column:
    return finite(F.col("prediction")).isNotNull() & finite(F.col("truth")).isNotNull()


def rolling_rmse(
    events: DataFrame, last: int = LAST_EVENTS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """RMSE of the numeric pairs among the last events, after each event that has one."""
    error = F.when(_numeric_pair(), F.pow(F.col("prediction") - F.col("truth"), 2))
    means = trailing_means(events, ["project"], EVENT_ORDER, {"_mse": error}, last, rows_per_chunk)
    return means.withColumn("rolling_rmse", F.when(_numeric_pair(), F.round(F.sqrt("_mse"), 4))).drop("_mse")


def rolling_accuracy(
    events: DataFrame, last: int = LAST_EVENTS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Share of equal pairs among the last events, after each event that has a pair."""
    equal = (F.col("prediction").cast("string") == F.col("truth").cast("string")).cast("double")
    means = trailing_means(events, ["project"], EVENT_ORDER, {"_share": equal}, last, rows_per_chunk)
    paired = F.col("prediction").isNotNull() & F.col("truth").isNotNull()
    return means.withColumn("rolling_accuracy", F.when(paired, F.round("_share", 4))).drop("_share")


def running_drift(events: DataFrame, base: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The drift score after every event.

    The baseline has one row per feature column of a table, so it becomes
    literals; an event without a feature keeps that feature's earlier state.
    """
    known = _known(base)
    values = _feature_values(known)
    if not values:
        return events.withColumn("raw_score", F.lit(0.0)).withColumn("drift_score", F.lit(0.0))
    totals = running_totals(events, ["project"], EVENT_ORDER, values, rows_per_chunk)
    return _scores(totals, known).select(*events.columns, "raw_score", "drift_score")


def _known(base: DataFrame) -> list[tuple[str, float, float]]:
    return [(r["feature"], r["mean"], r["std"]) for r in base.collect() if r["std"]]


def _feature_values(known: Sequence[tuple[str, float, float]]) -> dict[str, Column]:
    return {f"f{i}": finite(F.try_element_at("features", F.lit(name))) for i, (name, _, _) in enumerate(known)}


def _scores(totals: DataFrame, known: Sequence[tuple[str, float, float]]) -> DataFrame:
    parts = [
        _deviation(F.try_divide(f"f{i}_sum", f"f{i}_n"), F.lit(mean), F.lit(std))
        for i, (_, mean, std) in enumerate(known)
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    seen = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return totals.withColumn("raw_score", F.coalesce(F.try_divide(total, seen), F.lit(0.0))).withColumn(
        "drift_score", F.round("raw_score", 3)
    )


def scored_events(
    events: DataFrame, base: DataFrame, last: int = LAST_EVENTS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Project, time and id of every event with its rolling RMSE and drift score.

    Both come from one sort, of the keys and the few numbers that they need; the result is
    written once, for the status and the alerts to read.
    """
    known = _known(base)
    values = {"mse": F.when(_numeric_pair(), F.pow(F.col("prediction") - F.col("truth"), 2)), **_feature_values(known)}
    narrow = events.select("project", *EVENT_ORDER, *[v.cast("double").alias(f"_v_{n}") for n, v in values.items()])
    chunked = with_chunks(narrow, ["project", *EVENT_ORDER], rows_per_chunk)
    rolled = means_in_chunks(chunked, ["project"], ["mse"], last, rows_per_chunk)
    totals = totals_in_chunks(rolled, ["project"], [f"f{i}" for i in range(len(known))]) if known else rolled
    rmse = F.when(F.col("_v_mse").isNotNull(), F.round(F.sqrt("mse"), 4)).alias("rolling_rmse")
    return cut_lineage(_scores(totals, known).select("project", *EVENT_ORDER, rmse, "raw_score", "drift_score"))


def monitor_status(scored: DataFrame, alerts: DataFrame, shown: int = ALERTS_SHOWN) -> DataFrame:
    """Event count, current metrics and newest alerts per project.

    ``scored`` holds one row per event with any of the columns
    ``rolling_rmse``, ``rolling_accuracy`` and ``drift_score``; the current value
    is the last one set.
    """
    order = F.struct(*EVENT_ORDER)
    metrics = [c for c in ("rolling_rmse", "rolling_accuracy", "drift_score") if c in scored.columns]
    current = scored.groupBy("project").agg(
        F.count(F.lit(1)).alias("recent_count"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in metrics],
    )
    recent = newest(alerts, ["project"], [F.desc(c) for c in EVENT_ORDER], shown)
    listed = recent.groupBy("project").agg(
        F.sort_array(F.collect_list(F.struct("ts", "event_id", "severity", "code", "message"))).alias("alerts")
    )
    return current.join(listed, "project", "left")
