import pytest
from conftest import plan as explained
from conftest import rows
from pyspark.sql import functions as F

from tabwright.operators import clean as cl
from tabwright.operators import profile as pr
from tabwright.plans import cleaning as plan


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 1.0, "b"), (2, None, "a"), (3, 3.0, None), (4, float("nan"), "b"), (5, 100.0, "a")],
        "id int, x double, s string",
    )


def test_fill_is_idempotent(table):
    ops = [
        {"type": "fillMissing", "columns": ["x"], "method": "median"},
        {"type": "fillMissing", "columns": ["s"], "method": "mode"},
    ]
    once = plan.clean(table, ops)
    assert rows(once, "id") == rows(plan.clean(once, ops), "id")
    assert [r["x"] for r in once.orderBy("id").collect()] == [1.0, 3.0, 3.0, 3.0, 100.0]
    assert [r["s"] for r in once.orderBy("id").collect()] == ["b", "a", "a", "b", "a"]


def test_fill_ignores_unknown_and_text_columns(table):
    assert cl.fill_missing(table, ["zzz", "s"], "mean").columns == table.columns
    with pytest.raises(ValueError):
        cl.fill_missing(table, ["x"], "zzz")


def test_threshold_counts_against_the_subset(table):
    assert cl.drop_missing_rows(table, ["x", "s"], 0.5).count() == 5
    assert cl.drop_missing_rows(table, ["x", "s"], 0.4).count() == 2
    assert cl.drop_missing_rows(table).count() == 2


def test_outliers_without_spread_keep_rows(spark):
    flat = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert cl.remove_outliers(flat, ["x"], "zscore").count() == 2
    assert cl.remove_outliers(flat, ["x"], "iqr").count() == 2


def test_outlier_bounds_reach_the_scan(spark, small):
    lineitem = spark.read.parquet(f"{small}/lineitem.parquet")
    text = explained(cl.remove_outliers(lineitem, ["l_extendedprice"]))
    assert "GreaterThanOrEqual(l_extendedprice" in text and "LessThanOrEqual(l_extendedprice" in text


def test_onehot_has_no_limit(spark, table):
    assert cl.onehot(table, "s").columns == ["id", "x", "s_a", "s_b"]
    many = spark.range(1500).select(F.concat(F.lit("v" * 1100), F.col("id").cast("string")).alias("s"))
    assert len(cl.onehot(many, "s").columns) == 1500


def test_onehot_vector(table):
    vectors = [r["s"] for r in cl.onehot_vector(table, "s").orderBy("id").collect()]
    assert [v.toArray().tolist() for v in vectors] == [[0, 1], [1, 0], [0, 0], [0, 1], [1, 0]]


def test_label_codes(table):
    assert [r[2] for r in rows(cl.label_encode(table, "s"), "id")] == [1, 0, -1, 1, 0]


def test_plan_from_profile(table):
    wide = table.withColumn("gone", F.when(F.col("id") == 1, 1.0))
    operations = plan.as_operations(plan.plan_cleaning(pr.profile(wide)))
    assert operations == [
        {"type": "dropColumn", "columns": ["gone"]},
        {"type": "fillMissing", "columns": ["s"], "method": "mode"},
        {"type": "fillMissing", "columns": ["x"], "method": "mean"},
    ]
    cleaned = plan.clean(wide, operations)
    assert not plan.needs_cleaning(pr.profile(cleaned)).first()["needs_cleaning"]
    assert plan.fallback_operations(pr.profile(wide))[0]["columns"] == ["gone", "s", "x"]


def test_unknown_operation(table):
    with pytest.raises(ValueError, match="unknown cleaning"):
        plan.clean(table, [{"type": "zzz"}])
