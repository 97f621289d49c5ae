"""Positions, chunks, running statistics and quantiles against brute force, with tiny limits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import jobs as jb
from tabwright.operators import monitor as mo
from tabwright.operators import profile as pr
from tabwright.operators.split import hash_split, mark_split
from tabwright.plans.ordering import with_chunks, with_position
from tabwright.plans import lineage, quantiles
from tabwright.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """One project holds most of the rows; some values are missing."""
    rng = np.random.default_rng(7)
    n = 3000
    frame = pd.DataFrame(
        {
            "project": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 6, n)),
            "event_id": np.arange(n),
            "ts": rng.integers(0, 500, n),
            "prediction": rng.normal(size=n) * 10,
            "truth": rng.normal(size=n) * 10,
        }
    )
    frame.loc[rng.random(n) < 0.2, "truth"] = np.nan
    df = spark.createDataFrame(frame).repartition(5)
    return frame, df.withColumn("truth", F.nanvl("truth", F.lit(None).cast("double")))


def test_positions_are_the_sorted_order(hot):
    frame, df = hot
    placed = with_position(df, ["project", "ts", "event_id"]).select("event_id", "_pos").toPandas()
    expected = frame.sort_values(["project", "ts", "event_id"])["event_id"].tolist()
    assert placed.sort_values("_pos")["event_id"].tolist() == expected
    assert sorted(placed["_pos"]) == list(range(len(frame)))


def test_chunks_are_bounded(hot):
    _, df = hot
    sizes = with_chunks(df, ["project", "ts", "event_id"], 100).groupBy("_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 100


@pytest.mark.parametrize("last, chunk", [(7, 50), (50, 50), (500, 600), (1, 10)])
def test_rolling_rmse_across_chunks(hot, last, chunk):
    frame, df = hot
    got = mo.rolling_rmse(df, last, chunk).select("event_id", "rolling_rmse").toPandas().set_index("event_id")
    for _, group in frame.sort_values(["ts", "event_id"]).groupby("project"):
        square = (group["prediction"] - group["truth"]) ** 2
        expected = np.sqrt(square.rolling(last, min_periods=1).mean()).where(group["truth"].notna())
        actual = got.loc[group["event_id"], "rolling_rmse"].to_numpy(dtype=float)
        np.testing.assert_allclose(actual, expected.to_numpy(), atol=1e-4)


def test_running_mean_across_chunks(hot):
    frame, df = hot
    table = df.select(
        F.col("project").alias("pool"), F.col("ts").alias("created_at"), F.col("event_id").alias("job_id"),
        F.col("truth").alias("duration"),
    )
    got = jb.running_average_execution(table, 64).toPandas().set_index("job_id")
    for _, group in frame.sort_values(["ts", "event_id"]).groupby("project"):
        expected = group["truth"].expanding(min_periods=1).mean()
        np.testing.assert_allclose(
            got.loc[group["event_id"], "average_execution"].to_numpy(dtype=float), expected.to_numpy(), rtol=1e-9
        )


def test_running_drift_across_chunks(hot, spark):
    frame, df = hot
    base = spark.createDataFrame([("x", 0.0, 4.0), ("y", 1.0, 5.0), ("flat", 3.0, 0.0)], "feature string, mean double, std double")
    events = df.withColumn(
        "features",
        F.when(F.col("truth").isNull(), F.create_map(F.lit("x"), F.col("prediction"))).otherwise(
            F.create_map(F.lit("x"), F.col("prediction"), F.lit("y"), F.col("truth"))
        ),
    )
    got = mo.running_drift(events, base, 77).toPandas().set_index("event_id")["raw_score"]
    for _, group in frame.sort_values(["ts", "event_id"]).groupby("project"):
        x = (group["prediction"].expanding().mean() / 4.0).abs().clip(upper=10)
        y = ((group["truth"].expanding(min_periods=1).mean().ffill() - 1.0) / 5.0).abs().clip(upper=10)
        expected = pd.concat([x, y], axis=1).mean(axis=1)
        np.testing.assert_allclose(got.loc[group["event_id"]].to_numpy(dtype=float), expected.to_numpy(), rtol=1e-9)


@pytest.fixture(scope="module")
def spread_values(spark):
    rng = np.random.default_rng(3)
    n = 2000
    frame = pd.DataFrame(
        {
            "normal": rng.normal(size=n),
            "hot": np.where(rng.random(n) < 0.6, 5.0, rng.random(n) * 10),
            "wide": np.concatenate([rng.random(n - 3), [1e12, -1e12, 1e300]]),
            "constant": np.full(n, 2.5),
            "whole": rng.integers(0, 4, n),
            "scales": np.concatenate([10.0 ** rng.uniform(-300, 300, n - 4), [1e-300, 1e300, 5e-324, -1e-310]]),
        }
    )
    return frame, spark.createDataFrame(frame)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def scans_of(monkeypatch):
    scans, count = [], quantiles._count
    monkeypatch.setattr(quantiles, "_count", lambda df, open_: scans.append(len(open_)) or count(df, open_))
    return scans


def test_quantiles_of_widely_spread_values(spread_values, monkeypatch):
    frame, df = spread_values
    scans = scans_of(monkeypatch)
    got = exact_quantiles(df, list(frame.columns), PROBS)
    assert len(scans) == 1, "one scan to count after the sketch"
    for name in frame.columns:
        np.testing.assert_allclose(got[name], frame[name].quantile(PROBS).to_numpy(), rtol=1e-9, err_msg=name)


def test_quantiles_narrow_crowded_brackets(spread_values, monkeypatch):
    frame, df = spread_values
    for name, value in (("GROUP_ROWS", 10), ("CUTS", 32), ("REACH", (0.2,))):
        monkeypatch.setattr(quantiles, name, value)
    scans = scans_of(monkeypatch)
    got = exact_quantiles(df, list(frame.columns), PROBS)
    assert 2 <= len(scans) <= 16 and scans[-1] < scans[0]
    for name in frame.columns:
        np.testing.assert_allclose(got[name], frame[name].quantile(PROBS).to_numpy(), rtol=1e-9, err_msg=name)


@pytest.mark.parametrize("side", [0, 1])
def test_quantiles_recover_from_a_wrong_sketch(spread_values, monkeypatch, side):
    frame, df = spread_values
    first = quantiles._searches

    def beside(*args):
        ends = sorted(frame[args[0]].astype(float))
        searches = first(*args)
        for s in searches:
            s.probe = (ends[0], ends[3]) if side else (ends[-3], ends[-1])
        return searches

    monkeypatch.setattr(quantiles, "_searches", beside)
    monkeypatch.setattr(quantiles, "GROUP_ROWS", 50)
    got = exact_quantiles(df, ["normal", "whole"], [0.5, 0.75])
    for name in ("normal", "whole"):
        np.testing.assert_allclose(got[name], frame[name].quantile([0.5, 0.75]).to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_quantiles_of_few_rows(spark, n):
    values = [float((7 * i) % n) for i in range(n)]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "a double"), ["a"], [0.05, 0.5, 0.95])
    np.testing.assert_allclose(got["a"], np.quantile(values, [0.05, 0.5, 0.95]))


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
    stats = {r["column"]: r for r in pr.numeric_stats(df).collect()}
    assert (stats["a"]["missing"], stats["a"]["mean"], stats["b"]["missing"]) == (2, 2.0, 4)


@pytest.mark.parametrize("n, share", [(1, 0.2), (10, 0.2), (1001, 0.2), (1000, 0.5), (7, 1.0), (5, 0.0)])
def test_split_sizes_are_exact(spark, n, share):
    marked = mark_split(spark.range(n), ["id"], share)
    assert marked.filter("_test").count() == int(np.ceil(share * n))
    again = mark_split(spark.range(n).repartition(3), ["id"], share)
    assert marked.filter("_test").exceptAll(again.filter("_test")).count() == 0


def test_split_needs_unique_keys(spark):
    with pytest.raises(ValueError, match="uniquely"):
        mark_split(spark.range(10).selectExpr("1 AS k"), ["k"]).count()


def test_hash_split_is_a_partition_of_the_rows(spark):
    df = spark.range(5000)
    train, test = hash_split(df, ["id"], 0.2)
    assert train.count() + test.count() == 5000
    assert train.join(test, "id").count() == 0
    assert 850 < test.count() < 1150


def test_parts_of_narrow_rows_grow_by_values(spark):
    narrow = spark.range(1).selectExpr("0D AS a", "0D AS b", "0D AS c", "'x' AS y")
    wide = spark.range(1).select(*[F.lit(0.0).alias(f"c{i}") for i in range(60)])
    vectors = spark.range(1).selectExpr("array(0D) AS v")
    parts = [lineage.number_of_parts(narrow, n, lineage.ROWS_PER_PART) for n in (0, 480_000, 2_880_000, 28_800_000, 172_800_000)]
    assert parts == [8, 8, 12, 36, 58]
    assert [lineage.number_of_parts(df, 28_800_000, lineage.ROWS_PER_PART) for df in (wide, vectors)] == [116, 116]
    assert lineage.spread(spark.range(4000), 100).rdd.getNumPartitions() == 36
