"""Profiling queries."""

from pyspark.sql import functions as F

from tabwright.operators import profile as pr
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@query("prof_shape", """
SELECT 'lineitem' AS tab, count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem
UNION ALL SELECT 'orders', count(*), 6 FROM orders""")
def shape(t):
    return pr.shape(t.lineitem).withColumn("tab", F.lit("lineitem")).unionByName(
        pr.shape(t.orders).withColumn("tab", F.lit("orders"))
    )


def _types_sql(table):
    return f"""SELECT '{table}' AS tab, column_name AS "column",
      CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric'
           WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'unknown' END AS logical_type
      FROM (DESCRIBE SELECT * FROM {table})"""


@query("prof_types", " UNION ALL ".join(_types_sql(x) for x in ALL_TABLES))
def types(t):
    parts = [pr.logical_types(getattr(t, x)).withColumn("tab", F.lit(x)) for x in ALL_TABLES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("prof_type_counts", """
SELECT CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric'
            WHEN column_type = 'VARCHAR' THEN 'categorical' ELSE 'unknown' END AS logical_type,
       count(*) AS columns
FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY 1""")
def type_counts(t):
    return pr.type_counts(t.lineitem)


@query("prof_sniff", """
WITH first5 AS (SELECT * FROM events ORDER BY event_id LIMIT 5),
long AS (
  SELECT 'event_id' AS "column", CAST(event_id AS VARCHAR) AS v FROM first5
  UNION ALL SELECT 'ts', CAST(ts AS VARCHAR) FROM first5
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM first5
  UNION ALL SELECT 'event_type', event_type FROM first5
  UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM first5
  UNION ALL SELECT 'props', props FROM first5
  UNION ALL SELECT 'blank', '' FROM first5)
SELECT "column", CASE WHEN count(nullif(v, '')) = 0 THEN 'unknown'
                      WHEN bool_and(TRY_CAST(nullif(v, '') AS DOUBLE) IS NOT NULL)
                           FILTER (WHERE v <> '') THEN 'numeric'
                      ELSE 'categorical' END AS sniffed_type
FROM long GROUP BY 1""")
def sniff(t):
    return pr.sniff_types(t.events.withColumn("blank", F.lit("")), order_by=["event_id"])


_NUMERIC = ["qty", "disc", "tax", "div"]


def _stats_sql(table, column):
    return f"""SELECT '{column}' AS "column", min({column})::DOUBLE AS min, max({column})::DOUBLE AS max,
      round(avg({column}), 4) AS mean, round(median({column}), 4) AS median,
      round(stddev_samp({column}), 4) AS std, count(*) - count({column}) AS missing,
      round(100.0 * (count(*) - count({column})) / count(*), 4) AS missing_percentage FROM {table}"""


@query("prof_numeric_stats", f"WITH {fx.GAPS_SQL} " + " UNION ALL ".join(_stats_sql("gaps", c) for c in _NUMERIC))
def numeric_stats(t):
    stats = pr.numeric_stats(fx.gaps(t), _NUMERIC)
    return fx.rounded(stats, ["mean", "median", "std", "missing_percentage"])


def _top_sql(table, column):
    return f"""SELECT '{column}' AS "column", {column} AS value, count(*) AS n,
      CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INT) AS rank
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"""


@query("prof_categorical_top10", "SELECT * FROM (" + " UNION ALL ".join(
    _top_sql("part", c) for c in ("p_name", "p_brand", "p_type")) + ") WHERE rank <= 10")
def top10(t):
    return pr.top_values(t.part)


@query("prof_categorical_stats", f"""
WITH {fx.PRIO_SQL}, long AS (
  SELECT 'prio' AS "column", prio AS v FROM prio UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM prio),
counts AS (SELECT "column", v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM counts)
SELECT l."column", count(DISTINCT l.v) AS unique_count, count(*) - count(l.v) AS missing,
       round(100.0 * (count(*) - count(l.v)) / count(*), 4) AS missing_percentage,
       (SELECT string_agg(v || '=' || n, ';' ORDER BY r) FROM ranked k
        WHERE k."column" = l."column" AND r <= 10) AS top
FROM long l GROUP BY l."column" """)
def categorical_stats(t):
    stats = pr.categorical_stats(fx.prio(t))
    return fx.rounded(stats, ["missing_percentage"]).select(
        "column", "unique_count", "missing", "missing_percentage", _top_text().alias("top")
    )


def _top_text():
    return F.array_join(
        F.transform("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), ";"
    )


@query("prof_missing", f"WITH {fx.GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM gaps"""
    for c in [*fx.LINEITEM_KEY, *_NUMERIC]))
def missing(t):
    return pr.missing_counts(fx.gaps(t))


_DESCRIBE = {
    "count": "count({c})::DOUBLE", "mean": "round(avg({c}), 4)", "std": "round(stddev_samp({c}), 4)",
    "min": "min({c})::DOUBLE", "25%": "round(quantile_cont({c}, 0.25), 4)", "50%": "round(median({c}), 4)",
    "75%": "round(quantile_cont({c}, 0.75), 4)", "max": "max({c})::DOUBLE",
}


@query("prof_describe", " UNION ALL ".join(
    f"SELECT '{name}' AS statistic, {e.format(c='s_acctbal')} AS s_acctbal, "
    f"{e.format(c='s_nationkey')} AS s_nationkey FROM supplier" for name, e in _DESCRIBE.items()))
def describe(t):
    return fx.rounded(pr.describe(t.supplier, ["s_acctbal", "s_nationkey"]), ["s_acctbal", "s_nationkey"])


@query("prof_column_report", """
WITH first50 AS (SELECT * FROM part ORDER BY p_partkey LIMIT 50)
SELECT c AS "column", kind AS logical_type, samples, is_feature, is_target FROM (
  SELECT 'p_partkey' AS c, 'numeric' AS kind, string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey) AS samples,
         false AS is_feature, false AS is_target FROM first50
  UNION ALL SELECT 'p_name', 'categorical', string_agg(p_name, '|' ORDER BY p_partkey), false, false FROM first50
  UNION ALL SELECT 'p_brand', 'categorical', string_agg(p_brand, '|' ORDER BY p_partkey), true, false FROM first50
  UNION ALL SELECT 'p_type', 'categorical', string_agg(p_type, '|' ORDER BY p_partkey), true, false FROM first50
  UNION ALL SELECT 'p_size', 'numeric', string_agg(p_size::VARCHAR, '|' ORDER BY p_partkey), true, false FROM first50
  UNION ALL SELECT 'p_retailprice', 'numeric', string_agg(p_retailprice::VARCHAR, '|' ORDER BY p_partkey),
         false, true FROM first50)""")
def column_report(t):
    report = pr.column_report(t.part, ["p_brand", "p_type", "p_size"], "p_retailprice", ["p_partkey"])
    return report.withColumn("samples", F.array_join("samples", "|"))


@query("prof_full", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'numeric' AS logical_type, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std,
        count(*) - count({c}) AS missing, CAST(NULL AS BIGINT) AS unique_count, CAST(NULL AS VARCHAR) AS top
        FROM customer""" for c in ("c_custkey", "c_nationkey", "c_acctbal")) + """
UNION ALL SELECT 'c_name', 'categorical', NULL, NULL, NULL, NULL, NULL, 0, count(DISTINCT c_name),
  (SELECT string_agg(c_name || '=' || n, ';' ORDER BY n DESC, c_name)
   FROM (SELECT c_name, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) FROM customer
UNION ALL SELECT 'c_mktsegment', 'categorical', NULL, NULL, NULL, NULL, NULL, 0, count(DISTINCT c_mktsegment),
  (SELECT string_agg(c_mktsegment || '=' || n, ';' ORDER BY n DESC, c_mktsegment)
   FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) FROM customer""")
def full(t):
    table = pr.profile(t.customer).withColumn("top", _top_text())
    return fx.rounded(table, ["mean", "median", "std"]).select(
        "column", "logical_type", "min", "max", "mean", "median", "std", "missing", "unique_count", "top"
    )


@query("prof_info", f"WITH {fx.GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(*) AS rows, CAST(8 AS BIGINT) AS columns,
        count(*) - count({c}) AS null_count FROM gaps"""
    for c, kind in zip([*fx.LINEITEM_KEY, *_NUMERIC], ["bigint", "int", "bigint", "bigint"] + ["double"] * 4)))
def info(t):
    return pr.info(fx.gaps(t))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("prof_corr", " UNION ALL ".join(
    f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr({a}, {b}), 4) AS correlation FROM lineitem"""
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def corr(t):
    return fx.rounded(pr.correlations(t.lineitem, _CORR), ["correlation"])


@query("prof_outlier_counts", f"""
WITH {fx.SPIKES_SQL}, """ + ", ".join(
    f"""b_{c} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM spikes)"""
    for c in ("price", "l_quantity")) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_bound,
        round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_bound,
        count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM spikes, b_{c}""" for c in ("price", "l_quantity")))
def outliers(t):
    return fx.rounded(
        pr.outlier_counts(fx.spikes(t), ["price", "l_quantity"]), ["lower_bound", "upper_bound"]
    )
