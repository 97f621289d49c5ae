"""Live monitoring.

Feature statistics are plain streaming aggregates.  The last events of a
project need a buffer, which is kept per (project, shard): the newest events of
a project are among the newest of its shards, so a busy project is spread over many tasks.
A shard keeps the events that the frame of its newest pair reaches back to and the events since then.  Once
these are more than two frames, their middle moves from the state to the written snapshots, from where the
merged figure reads it again: a pair may still arrive in another shard or late.  A reset starts a new epoch,
which leaves the moved events of earlier ones out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabwright.functions.clock import micros
from tabwright.operators import monitor as mo

SHARDS = 16

_STATE = (
    "n long, names array<string>, counts array<long>, means array<double>, squares array<double>, "
    "ts array<long>, ids array<long>, errors array<double>, hits array<double>, epoch long"
)
_MOVED = "moved_ts array<long>, moved_ids array<long>"


def stream_feature_stats(events: DataFrame) -> DataFrame:
    """Running count, mean and deviation per project and feature; use output mode ``update``."""
    return mo.feature_stats(events)


def latest_stats(batches: DataFrame) -> DataFrame:
    """The newest row per project and feature from the batches of changed rows."""
    return (
        batches.groupBy("project", "feature")
        .agg(F.max_by(F.struct("n", "mean", "std"), "batch").alias("s"))
        .select("project", "feature", "s.*")
    )


def merged_batches(batches: DataFrame) -> DataFrame:
    """Of many batches of statistics the newest row per project and feature."""
    fields = [c for c in batches.columns if c not in ("project", "feature")]
    newest = batches.groupBy("project", "feature").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return newest.select("project", "feature", "s.*").select(*batches.columns)


def monitor_stream(events: DataFrame, last: int = mo.LAST_EVENTS, shards: int = SHARDS) -> DataFrame:
    """Snapshots of every (project, shard) that changed in a batch; output mode ``update``.

    Events may carry a boolean ``reset``: such a row clears everything its
    project has collected before it.
    """
    resets = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in events.columns else F.lit(False)
    project_type = dict(events.dtypes)["project"]
    numeric = all(isinstance(events.schema[c].dataType, T.NumericType) for c in ("prediction", "truth"))
    nothing = F.lit(None).cast("double")
    error = F.pow(mo.finite(F.col("prediction")) - mo.finite(F.col("truth")), 2) if numeric else nothing
    hit = nothing if numeric else (
        F.col("prediction").cast("string") == F.col("truth").cast("string")
    ).cast("double")
    homes = F.when(resets, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int"))
    )
    rows = events.select(
        "project",
        F.explode(homes).alias("shard"),
        micros(F.col("ts")).alias("ts"),
        F.col("event_id").cast("long").alias("event_id"),
        error.alias("error"),
        hit.alias("hit"),
        F.map_keys("features").alias("names"),
        F.transform(F.map_values("features"), lambda v: v.cast("double")).alias("numbers"),
        resets.alias("reset"),
    )

    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        # one batch of one shard: its size is bounded by the source's files per batch
        fresh = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        stored = _Collected.from_state(state.get) if state.exists else _Collected()
        marks = np.flatnonzero(fresh["reset"].to_numpy(dtype=bool))
        if len(marks):
            stored = _Collected(stored.epoch + 1)
            fresh = fresh.iloc[marks[-1] + 1:]
        moved = stored.add(fresh, last)
        state.update(stored.as_state())
        places = [[int(v) for v in moved[c]] for c in ("ts", "event_id")]
        yield pd.DataFrame([(key[0], int(key[1]), *stored.as_state(), *places)], columns=_columns())

    return rows.groupBy("project", "shard").applyInPandasWithState(
        update, f"project {project_type}, shard int, {_STATE}, {_MOVED}", _STATE, "update", GroupStateTimeout.NoTimeout
    )


def _columns() -> list[str]:
    return ["project", "shard", *[part.strip().split(" ")[0] for part in f"{_STATE}, {_MOVED}".split(", ")]]


class _Collected:
    """Mergeable statistics and the newest events of one shard."""

    def __init__(self, epoch: int = 0) -> None:
        self.n = 0
        self.epoch = epoch
        self.stats: dict[str, tuple[int, float, float]] = {}
        self.recent = pd.DataFrame({"ts": [], "event_id": [], "error": [], "hit": []})

    @classmethod
    def from_state(cls, values: tuple[Any, ...]) -> _Collected:
        n, names, counts, means, squares, ts, ids, errors, hits, epoch = values
        self = cls(epoch)
        self.n = n
        self.stats = {name: (c, m, s) for name, c, m, s in zip(names, counts, means, squares)}
        self.recent = pd.DataFrame(
            {
                "ts": list(ts), "event_id": list(ids),
                "error": pd.array(list(errors), dtype="Float64"),
                "hit": pd.array(list(hits), dtype="Float64"),
            }
        )
        return self

    def add(self, rows: pd.DataFrame, last: int) -> pd.DataFrame:
        """Take in a batch; the events without a pair that the state no longer holds."""
        self.n += len(rows)
        long = pd.DataFrame(
            {
                "name": [n for names in rows["names"] if names is not None for n in names],
                "value": [v for values in rows["numbers"] if values is not None for v in values],
            }
        )
        long["value"] = pd.to_numeric(long["value"], errors="coerce").astype("float64")
        long = long[np.isfinite(long["value"])]
        for name, values in long.groupby("name")["value"]:
            count, mean = len(values), float(values.mean())
            square = float(((values - mean) ** 2).sum())
            old = self.stats.get(name)
            if old:
                total, gap = old[0] + count, mean - old[1]
                square += old[2] + gap * gap * old[0] * count / total
                mean = old[1] + gap * count / total
                count = total
            self.stats[name] = (count, mean, square)
        fields = ["ts", "event_id", "error", "hit"]
        both = pd.concat([f for f in (self.recent, rows[fields]) if len(f)] or [self.recent], ignore_index=True)
        both = both.sort_values(["ts", "event_id"], kind="stable", ignore_index=True)
        # a figure is taken at an event with a pair: what its frame reaches back to, and what has come since
        paired = np.flatnonzero((both["error"].notna() | both["hit"].notna()).to_numpy(dtype=bool))
        cut = paired[-1] + 1 if len(paired) else 0
        since = both.iloc[cut:]
        moved = since.iloc[last:-last] if len(since) > 2 * last else since.iloc[:0]
        since = since.drop(moved.index)
        self.recent = pd.concat([both.iloc[max(0, cut - last):cut], since]) if cut else since
        return moved

    def as_state(self) -> tuple:
        names = sorted(self.stats)

        def numbers(column: str) -> list[float | None]:
            return [None if pd.isna(v) else float(v) for v in self.recent[column]]

        return (
            self.n, names, [self.stats[x][0] for x in names], [self.stats[x][1] for x in names],
            [self.stats[x][2] for x in names], [int(v) for v in self.recent["ts"]],
            [int(v) for v in self.recent["event_id"]], numbers("error"), numbers("hit"),
            self.epoch,
        )


def latest_snapshots(batches: DataFrame) -> DataFrame:
    """The newest snapshot per project and shard from the batches written so far.

    Events that batches moved out of the state since the last reset follow as rows that count nothing.
    """
    away = ("moved_ts", "moved_ids")
    fields = [c for c in batches.columns if c not in ("project", "shard", "batch", *away)]
    newest = (
        batches.groupBy("project", "shard")
        .agg(F.max_by(F.struct(*fields), "batch").alias("s"))
        .select("project", "shard", "s.*")
    )
    kinds = dict(batches.dtypes)
    values = {"n": F.lit(0), "ts": F.col("moved_ts"), "ids": F.col("moved_ids")}
    moved = batches.filter(F.size("moved_ts") > 0).join(
        newest.select("project", "shard", "epoch"), ["project", "shard", "epoch"]
    ).select("project", "shard", *[
        (F.col(c) if c == "epoch" else values.get(c, F.array())).cast(kinds[c]).alias(c) for c in fields
    ])
    return newest.unionByName(moved)


def merged_snapshots(batches: DataFrame) -> DataFrame:
    """Of many batches of snapshots those rows that ``latest_snapshots`` reads: per project and shard the newest, and of
    the older ones since the last reset the events they moved out of the state, nothing else.
    """
    home = ["project", "shard"]
    newest = batches.groupBy(*home).agg(F.max("batch").alias("_last"), F.max_by("epoch", "batch").alias("_epoch"))
    marked = batches.join(newest, home).withColumn("_now", F.col("batch") == F.col("_last"))
    still = marked.filter(F.col("_now") | ((F.col("epoch") == F.col("_epoch")) & (F.size("moved_ts") > 0)))
    kept = (*home, "batch", "epoch", "moved_ts", "moved_ids")
    return still.select(*[F.col(c) if c in kept else F.when(F.col("_now"), F.col(c)).alias(c) for c in batches.columns])


def merged_stats(snapshots: DataFrame) -> DataFrame:
    """Feature statistics per project over all shards."""
    parts = snapshots.select(
        "project", F.explode(F.arrays_zip("names", "counts", "means", "squares")).alias("f")
    ).select("project", F.col("f.names").alias("feature"), "f.counts", "f.means", "f.squares")
    totals = parts.groupBy("project", "feature").agg(
        F.sum("counts").alias("n"), (F.sum(F.col("counts") * F.col("means")) / F.sum("counts")).alias("mean")
    )
    gap = F.col("means") - F.col("mean")
    return (
        parts.join(totals, ["project", "feature"])
        .groupBy("project", "feature")
        .agg(
            F.first("n").alias("n"),
            F.first("mean").alias("mean"),
            F.sum(F.col("squares") + F.col("counts") * gap * gap).alias("_square"),
        )
        .select(
            "project", "feature", "n", "mean",
            F.when(F.col("n") > 1, F.sqrt(F.col("_square") / (F.col("n") - 1))).otherwise(0.0).alias("std"),
        )
    )


def monitor_view(snapshots: DataFrame, base: DataFrame, last: int = mo.LAST_EVENTS) -> DataFrame:
    """Event count, rolling RMSE or accuracy and drift score per project, as of the snapshots.

    The rolling figure is that of the newest event with a pair, as in the batch form: its frame
    is the ``last`` events up to that one.
    """
    events = snapshots.select(
        "project", F.explode(F.arrays_zip("ts", "ids", "errors", "hits")).alias("e")
    ).select("project", F.col("e.ts").alias("ts"), F.col("e.ids").alias("event_id"), "e.errors", "e.hits")
    place = F.struct("ts", "event_id")
    paired = F.col("errors").isNotNull() | F.col("hits").isNotNull()
    ends = events.filter(paired).groupBy("project").agg(F.max(place).alias("end"))  # one row per project
    framed = events.join(ends, "project").filter(place <= F.col("end")).drop("end")
    recent = mo.newest(framed, ["project"], [F.desc("ts"), F.desc("event_id")], last)
    rolling = recent.groupBy("project").agg(
        F.round(F.sqrt(F.avg("errors")), 4).alias("rolling_rmse"),
        F.round(F.avg("hits"), 4).alias("rolling_accuracy"),
    )
    counts = snapshots.groupBy("project").agg(F.sum("n").alias("recent_count"))
    drift = mo.drift_score(base, merged_stats(snapshots)).select("project", "drift_score")
    return counts.join(rolling, "project", "left").join(drift, "project", "left")
