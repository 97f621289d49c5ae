"""Projections, filters and table edits."""

from pyspark.sql import functions as F

from tabwright.operators import edit
from tabwright.plans.batch import apply_operations
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query


@query("edit_drop_columns", """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_shipdate
FROM lineitem""")
def drop_columns(t):
    return edit.drop_columns(t.lineitem, ["l_suppkey", "l_linestatus"])


@query("clean_drop_column", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def drop_lenient(t):
    return edit.drop_columns_lenient(t.part, ["p_type", "not_there"])


@query("edit_rename", """
SELECT s_suppkey AS supplier_id, s_name AS supplier, s_nationkey, s_acctbal AS balance FROM supplier""")
def rename(t):
    return edit.rename_columns(
        t.supplier, {"s_suppkey": "supplier_id", "s_name": "supplier", "s_acctbal": "balance"}
    )


@query("edit_add_formula", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice * (1 - l_discount) AS revenue,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice / (l_linenumber - 1) END AS per_line,
       floor(l_quantity / 7) AS packs,
       sqrt(l_quantity) + abs(-l_tax) AS root
FROM lineitem""")
def add_formula(t):
    df = t.lineitem.select(*fx.LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    df = edit.add_column(df, "revenue", "l_extendedprice * (1 - l_discount)")
    df = edit.add_column(df, "per_line", "l_extendedprice / (l_linenumber - 1)")
    df = edit.add_column(df, "packs", "l_quantity // 7")
    df = edit.add_column(df, "root", "sqrt(l_quantity) + abs(-l_tax)")
    df = edit.drop_columns(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.withColumn("packs", F.col("packs").cast("double"))


@query("edit_add_values", """
WITH s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier),
v AS (SELECT s_acctbal AS score, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, score FROM s JOIN v USING (r)""")
def add_values(t):
    """The balances in falling order, set beside the suppliers in the order of their keys."""
    down = t.supplier.select((-F.col("s_acctbal")).alias("down"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("score"))
    return edit.add_column(t.supplier, "score", down, order_by=["s_suppkey"], values_order=["down", "key"])


def _merge(name, sql_expression, columns, operation):
    sql = f"WITH {fx.GAPS_SQL} SELECT {fx.KEY_SQL}, {sql_expression} AS merged FROM gaps"

    @query(f"merge_{name}", sql)
    def merge(t):
        return edit.merge_columns(fx.gaps(t), columns, "merged", operation).select(*fx.LINEITEM_KEY, "merged")


_merge("add", "coalesce(qty, 0) + coalesce(disc, 0) + coalesce(tax, 0)", ["qty", "disc", "tax"], "add")
_merge("subtract", "qty - disc", ["qty", "disc"], "subtract")
_merge("multiply", "coalesce(qty, 1) * coalesce(disc, 1) * coalesce(tax, 1)", ["qty", "disc", "tax"], "multiply")
_merge("divide", "CASE WHEN div = 0 THEN NULL ELSE qty / div END", ["qty", "div"], "divide")
_merge(
    "mean",
    """CASE WHEN qty IS NULL AND disc IS NULL AND tax IS NULL THEN NULL
            ELSE (coalesce(qty, 0) + coalesce(disc, 0) + coalesce(tax, 0))
                 / ((qty IS NOT NULL)::INT + (disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT) END""",
    ["qty", "disc", "tax"],
    "mean",
)


@query("merge_concat", """
SELECT c_custkey,
       CASE WHEN c_custkey % 9 = 0 THEN 'nan' ELSE c_mktsegment END || '_' || CAST(c_nationkey AS VARCHAR)
         || '_' || c_name AS merged
FROM customer""")
def merge_concat(t):
    df = t.customer.withColumn("segment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return edit.merge_columns(df, ["segment", "c_nationkey", "c_name"], "merged", "concat").select(
        "c_custkey", "merged"
    )


@query("merge_nan", f"""
WITH x AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q FROM lineitem)
SELECT {fx.KEY_SQL}, coalesce(q, 0) + l_discount AS added, coalesce(q, 1) * l_discount AS multiplied,
       (coalesce(q, 0) + l_discount) / (1 + (q IS NOT NULL)::INT) AS mean,
       CASE WHEN q IS NULL THEN 'nan' ELSE l_returnflag END || '_' || l_linestatus AS joined
FROM x""")
def merge_nan(t):
    """NaN counts as missing."""
    gap = F.col("l_linenumber") % 3 != 0
    df = t.lineitem.withColumn("q", F.when(gap, F.col("l_quantity")).otherwise(float("nan")))
    for name, operation in (("added", "add"), ("multiplied", "multiply"), ("mean", "mean")):
        df = edit.merge_columns(df, ["q", "l_discount"], name, operation)
    df = edit.merge_columns(df, ["q", "l_linestatus"], "joined", "concat")
    flag = F.when(F.col("joined").startswith("nan_"), F.col("joined")).otherwise(F.concat_ws("_", "l_returnflag", "l_linestatus"))
    return df.select(*fx.LINEITEM_KEY, "added", "multiplied", "mean", flag.alias("joined"))


@query("edit_filter", """
SELECT * FROM orders
WHERE (o_totalprice > 100000 AND o_orderstatus = 'O') OR o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_rows(t):
    return edit.filter_rows(
        t.orders,
        "(o_totalprice > 100000 and o_orderstatus == 'O') or o_orderpriority in ['1-URGENT', '2-HIGH']",
    )


@query("edit_filter_ne_null", f"""
WITH {fx.PRIO_SQL}
SELECT * FROM prio WHERE prio IS DISTINCT FROM '5-LOW' AND NOT coalesce(prio = '2-HIGH', false)""")
def filter_ne(t):
    return edit.filter_rows(fx.prio(t), "prio != '5-LOW' and not prio == '2-HIGH'")


@query("edit_select_exclude", "SELECT o_orderkey, o_totalprice FROM orders")
def select_exclude(t):
    return edit.select_features(
        t.orders, selected=["o_totalprice", "o_orderkey", "o_custkey", "nope"], excluded=["o_custkey"]
    )


@query("edit_batch", """
SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderstatus || '_' || o_orderpriority AS state,
       o_totalprice / 1000 AS thousands
FROM orders WHERE o_totalprice > 200000""")
def batch(t):
    return apply_operations(
        t.orders,
        [
            {"type": "merge_columns", "columns": ["o_orderstatus", "o_orderpriority"],
             "new_column_name": "state", "operation": "concat"},
            {"type": "add_column", "column_name": "thousands", "values": "o_totalprice / 1000"},
            {"type": "filter_rows", "condition": "o_totalprice > 200000"},
            {"type": "drop_columns", "columns": ["o_orderstatus", "o_orderpriority", "o_orderdate"]},
            {"type": "rename_columns", "rename_map": {"o_totalprice": "price"}},
        ],
    )


@query("feat_generated", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice * (1 - l_discount) AS net,
       CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price,
       round(ln(l_quantity + 1), 4) AS log_qty, l_quantity > 25 AS is_bulk
FROM lineitem""")
def generated(t):
    base = t.lineitem.select(*fx.LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount")
    df, _ = edit.generated_features(
        base,
        [
            {"name": "net", "formula": "data['l_extendedprice'] * (1 - data['l_discount'])"},
            {"name": "unit_price", "formula": "data['l_extendedprice'] / data['l_quantity']"},
            {"name": "log_qty", "formula": "np.log(data['l_quantity'] + 1)"},
            {"name": "is_bulk", "formula": "data['l_quantity'] > 25"},
            {"name": "broken", "formula": "data['no_such_column'] * 2"},
            "l_discount",
        ],
    )
    return fx.rounded(df, ["log_qty"]).drop("l_quantity", "l_extendedprice", "l_discount")


@query("feat_target_split", "SELECT p_name, p_size, p_retailprice, p_brand AS target FROM part")
def target_split(t):
    df, features, target = edit.split_features_target(
        t.part, features=["p_name", "p_size", "p_retailprice", "p_brand", "gone"], hint="please predict: p_brand"
    )
    return df.withColumnRenamed(target, "target").select(*features, "target")


@query("edit_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(t):
    return edit.preview(t.orders, order_by=["o_orderkey"])
