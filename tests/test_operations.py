"""Edge cases of the job, scaling, cache, project and evaluation queries."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabwright.functions.clock import micros, seconds_between
from tabwright.operators import cache as ca
from tabwright.operators import evaluate as ev
from tabwright.operators import jobs as jb
from tabwright.operators import projects as pj
from tabwright.operators import scaling as sc

AT = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return AT + dt.timedelta(seconds=seconds)


def test_clock(spark):
    df = spark.createDataFrame([(AT, at(90061.25))], "a timestamp_ntz, b timestamp_ntz")
    row = df.select(seconds_between(F.col("a"), F.col("b")).alias("s"), micros(F.col("b")).alias("m")).first()
    assert row["s"] == 90061.25
    assert row["m"] == (at(90061.25) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(
        [
            (1, "t", "pending", 0, at(1)), (2, "t", "pending", 5, at(3)), (3, "p", "pending", 5, at(2)),
            (4, "p", "completed", 0, at(-100000)), (5, "p", "running", 0, at(-100000)), (6, "t", "failed", 1, at(4)),
        ],
        "job_id int, type string, status string, priority int, created_at timestamp_ntz",
    )


def test_jobs(jobs):
    assert [r["job_id"] for r in jb.pending_order(jobs).collect()] == [3, 2, 1]
    assert [r["job_id"] for r in jb.latest_by_type(jobs, "t", 2).collect()] == [6, 2]
    assert [r["job_id"] for r in jb.latest_jobs(jobs, 3).collect()] == [6, 2, 3]
    assert sorted(r["job_id"] for r in jb.expire_jobs(jobs, AT).collect()) == [1, 2, 3, 5, 6]
    assert rows(jb.success_rate(jobs)) == [(17, 17)]
    assert rows(jb.success_rate(jobs.limit(0))) == [(0, 0)]


def test_scaling(spark):
    swings = [("a", i, at(60 * i), "up" if i % 2 else "down") for i in range(10)]
    slow = [("b", i, at(600 * i), "up" if i % 2 else "down") for i in range(10)]
    lone = [("c", 0, at(0), "up")]
    events = spark.createDataFrame(
        swings + slow + lone, "pool string, event_id int, ts timestamp_ntz, direction string"
    )
    got = {r["pool"]: (r["oscillations"], r["efficiency"], r["analysis"]) for r in sc.scaling_efficiency(events).collect()}
    assert got["a"][0] == 8 and got["a"][1] == pytest.approx(0.2) and got["a"][2].startswith("frequent")
    assert got["b"] == (0, 1.0, "stable scaling")
    assert got["c"] == (0, 1.0, "not enough data")
    stable = sc.stability(sc.scaling_efficiency(events)).first()
    assert stable["stability"] == "Fair"
    assert sc.scaling_history(events, at(600), 1 / 12, "a").count() == 4


def test_cache_limits(spark):
    meta = spark.createDataFrame(
        [(1, AT, at(3600)), (2, AT, None)], "project_id int, created_at timestamp_ntz, last_used timestamp_ntz"
    )
    assert [r["project_id"] for r in ca.expire_cache(meta, at(3600 * 168 + 10)).collect()] == [2]
    for hours in (0, 8761):
        with pytest.raises(ValueError):
            ca.expire_cache(meta, AT, hours)


def test_project_history(spark):
    changes = spark.createDataFrame(
        [
            (1, 1, "update", "x"), (1, 2, "insert", "a"), (1, 3, "update", None), (1, 4, "update", "b"),
            (2, 1, "insert", "a"), (2, 2, "delete", None), (2, 3, "update", "z"),
            (3, 1, "insert", "a"), (3, 2, "delete", None), (3, 3, "insert", None), (3, 4, "update", "c"),
        ],
        "id int, v int, op string, name string",
    )
    assert rows(pj.current_projects(changes, ["name"], ["v"]), "id") == [(1, "b", 3), (3, "c", 2)]


def test_fingerprint_depends_on_values_not_on_order(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "y")], "id int, a string, b string")
    first = pj.fingerprint(df, "id", ["a", "b"])
    assert rows(first, "id") == rows(pj.fingerprint(df, "id", ["b", "a"]), "id")
    assert [r["id"] for r in pj.changed(first, first.filter("id = 1"), "id").collect()] == [2]


def test_confusion_sums_to_the_rows(spark):
    preds = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string"
    )
    assert preds.count() == ev.confusion_counts(preds).agg(F.sum("n")).first()[0]
    wide = ev.confusion_matrix(preds, ["a", "b", "c"])
    assert rows(wide, "label") == [("a", 1, 1, 0), ("b", 0, 1, 0), ("c", 1, 0, 0)]
    macro = ev.macro_prf(preds).first()
    assert macro["precision"] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert macro["recall"] == pytest.approx((0.5 + 1 + 0) / 3)


@pytest.mark.parametrize(
    "kind, metrics, score, grade",
    [
        ("classification", {"accuracy": 0.9, "f1_score": 0.8, "precision": 0.7, "recall": 0.6}, 7.95, "Good"),
        ("classification", {"accuracy": 1.0}, 4.0, "Poor"),
        ("regression", {"r_squared": 0.9, "rmse": 50.0}, 7.8, "Good"),
        ("regression", {"r_squared": 0.9}, 6.3, "Fair"),
        ("regression", {"r_squared": -3.0, "rmse": 500.0}, 0.0, "Poor"),
        ("regression", {"r_squared": 1.0, "rmse": 0.0}, 10.0, "Excellent"),
    ],
)
def test_scores(spark, kind, metrics, score, grade):
    row = ev.overall_score(spark.createDataFrame([metrics]), kind).first()
    assert row["score"] == pytest.approx(score) and row["grade"] == grade


def test_regression_of_a_constant(spark):
    exact = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    off = spark.createDataFrame([(2.0, 3.0), (2.0, 2.0)], "label double, prediction double")
    assert ev.regression_metrics(exact).first()["r_squared"] == 1.0
    assert ev.regression_metrics(off).first()["r_squared"] == 0.0
