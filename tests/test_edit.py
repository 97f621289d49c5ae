import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tabwright.functions.formula import FormulaError, condition, formula
from tabwright.operators import edit
from tabwright.plans.batch import apply_operations


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 2.0, "x"), (2, None, "y"), (3, 0.0, None)], "a int, b double, c string"
    )


@pytest.mark.parametrize(
    "text",
    [
        "__import__('os').system('ls')", "a.__class__", "open('f')", "a if b else 1", "[a for a in b]",
        "lambda: 1", "nope + 1", "a > 1", "a; b", "", "f'{a}'", "a == b",
    ],
)
def test_formula_refuses(text):
    with pytest.raises(FormulaError):
        formula(text, ["a", "b"])


def test_formula_values(table):
    out = table.select(
        formula("a / b", table.columns).alias("div"),
        formula("-a ** 2 + abs(a)", table.columns).alias("pow"),
        formula("data['a'] + np.sqrt(4)", table.columns).alias("sub"),
        formula("`a` % 2", table.columns).alias("mod"),
    )
    assert rows(out) == [(0.5, 0.0, 3.0, 1.0), (None, -2.0, 4.0, 0.0), (None, -6.0, 5.0, 1.0)]


@pytest.mark.parametrize(
    "text, kept",
    [
        ("b > 0", [1]),
        ("b != 2", [2, 3]),
        ("not b > 0", [2, 3]),
        ("~(b > 0)", [2, 3]),
        ("c in ['x', 'y']", [1, 2]),
        ("c not in ['x']", [2, 3]),
        ("0 < a < 3 and (c == 'x' or b == 0)", [1]),
        ("(a > 1) & (a < 3)", [2]),
        ("(a == 1) | (c == 'y')", [1, 2]),
        ("not (b > 0 and c == 'x')", [2, 3]),
    ],
)
def test_filter(table, text, kept):
    assert [r["a"] for r in edit.filter_rows(table, text).orderBy("a").collect()] == kept


def test_plain_filter_reaches_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    text = plan(edit.filter_rows(orders, "o_totalprice > 1000 and o_orderstatus == 'O'").select("o_orderkey"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,O)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_values_are_set_beside_rows_by_position(spark, table):
    values = spark.createDataFrame([(30, "last"), (10, "first"), (20, None)], "at int, word string")
    got = edit.add_column(table, "d", values, order_by=["a"], values_order=["at"])
    assert rows(got.select("a", "d"), "a") == [(1, "first"), (2, None), (3, "last")]
    assert rows(edit.add_column(table, "at", values.select("at"), ["a"], ["at"]).select("a", "at"), "a") == [(1, 10), (2, 20), (3, 30)]
    with pytest.raises(ValueError, match="2 values for 3 rows"):
        edit.add_column(table, "d", values.limit(2), order_by=["a"], values_order=["at"])
    with pytest.raises(ValueError, match="order"):
        edit.add_column(table, "d", values, order_by=["a"])


def test_errors(table):
    with pytest.raises(ValueError, match="not found"):
        edit.drop_columns(table, ["zzz"])
    with pytest.raises(ValueError, match="not found"):
        edit.rename_columns(table, {"zzz": "a"})
    with pytest.raises(ValueError, match="already exists"):
        edit.add_column(table, "a", "b + 1")
    with pytest.raises(ValueError, match="2 values for 3 rows"):
        edit.add_column(table, "d", [1, 2], order_by=["a"])
    with pytest.raises(ValueError, match="exactly two"):
        edit.merge_columns(table, ["a", "b", "c"], "d", "subtract")
    with pytest.raises(ValueError, match="unknown merge"):
        edit.merge_columns(table, ["a"], "d", "zzz")
    with pytest.raises(ValueError, match="unknown operation"):
        apply_operations(table, [{"type": "zzz"}])
    with pytest.raises(ValueError, match="no valid features"):
        edit.split_features_target(table, "a", features=["a"])
    with pytest.raises(TypeError):
        edit.add_column(table, "d", 3)


def test_merge_with_all_missing(spark):
    gaps = spark.createDataFrame([(None, None)], "a double, b double")
    merged = {op: edit.merge_columns(gaps, ["a", "b"], "m", op).first()["m"] for op in edit.MERGES}
    assert merged == {"add": 0, "subtract": None, "multiply": 1, "divide": None, "concat": "nan_nan", "mean": None}


def test_generated_features_report(table):
    out, report = edit.generated_features(
        table,
        [{"name": "d", "formula": "a + b"}, {"name": "bad", "formula": "nope"}, "a", {"name": "", "formula": "a"}],
    )
    assert out.columns == ["a", "b", "c", "d"]
    assert [r["status"].split(":")[0] for r in report] == ["added", "skipped", "present", "skipped"]


def test_target_from_hint():
    assert edit.find_target(["a", "b", "c"], hint="Ziel: b") == "b"
    assert edit.find_target(["a", "b", "c"], hint="target = zzz") == "c"
    assert edit.find_target(["a", "b", "c"], "a", "target b") == "a"


def test_condition_in_a_column_is_never_null(table):
    out = table.select(F.coalesce(condition("b > 0", table.columns), F.lit(False)).alias("m"))
    assert rows(out) == [(True,), (False,), (False,)]
