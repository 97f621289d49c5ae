"""Queries over job tables and job event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.clock import hours_before, moment
from tabwright.operators.monitor import newest
from tabwright.plans.ordering import ROWS_PER_CHUNK
from tabwright.plans.running import running_totals

# fixed values: job states
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"
FINISHED = [COMPLETED, FAILED, CANCELLED]


def pending_order(jobs: DataFrame) -> DataFrame:
    """Pending jobs as they will run: priority first, then arrival."""
    return jobs.filter(F.col("status") == PENDING).orderBy(F.desc("priority"), "created_at", "job_id")


def _newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("job_id")]


def latest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(*_newest_first()).limit(limit)


def latest_by_type(jobs: DataFrame, job_type: str | None = None, limit: int = 20) -> DataFrame:
    """Newest jobs of one type, or of every type at once."""
    if job_type is not None:
        return latest_jobs(jobs.filter(F.col("type") == job_type), limit)
    return newest(jobs, ["type"], _newest_first(), limit)


def job_state(events: DataFrame) -> DataFrame:
    """Fold status events into the current record of every job."""
    order = F.struct("ts", "event_id")

    def first_time(*states: str) -> Column:
        return F.min(F.when(F.col("status").isin(*states), F.col("ts")))

    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        first_time(PENDING).alias("created_at"),
        first_time(RUNNING).alias("started_at"),
        F.max(F.when(F.col("status").isin(*FINISHED), F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("changes"),
    )


def queue_status(jobs: DataFrame) -> DataFrame:
    counts = {
        "queue_length": PENDING, "running_jobs": RUNNING, "completed_jobs": COMPLETED, "failed_jobs": FAILED,
    }
    return jobs.agg(
        *[F.count_if(F.col("status") == state).alias(name) for name, state in counts.items()],
        F.count(F.lit(1)).alias("total_jobs"),
    )


def success_rate(jobs: DataFrame) -> DataFrame:
    """Whole percentages of completed and failed jobs, 0 for an empty table."""
    def percent(state: str) -> Column:
        share = F.try_divide(F.count_if(F.col("status") == state) * 100, F.count(F.lit(1)))
        return F.coalesce(F.round(share), F.lit(0.0)).cast("long")

    return jobs.agg(percent(COMPLETED).alias("success_rate"), percent(FAILED).alias("failure_rate"))


def average_execution(jobs: DataFrame) -> DataFrame:
    """Jobs processed and mean duration per pool."""
    return jobs.groupBy("pool").agg(
        F.count("duration").alias("processed"), F.avg("duration").alias("average_execution")
    )


def running_average_execution(jobs: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The mean duration per pool after every job."""
    totals = running_totals(
        jobs, ["pool"], ["created_at", "job_id"], {"d": F.col("duration")}, rows_per_chunk
    )
    return totals.withColumn("average_execution", F.try_divide("d_sum", "d_n")).drop("d_sum", "d_n")


def expire_jobs(jobs: DataFrame, now, hours: float = 24) -> DataFrame:
    """Jobs that stay: finished ones older than ``hours`` are left out."""
    old = F.col("created_at") < hours_before(moment(now), hours)
    return jobs.filter(~(F.col("status").isin(COMPLETED, FAILED) & old))
