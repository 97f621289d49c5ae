"""Cleaning queries."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import clean as cl
from tabwright.operators import profile as pr
from tabwright.plans import cleaning as plan
from tabwright.queries import fixtures as fx
from tabwright.queries.registry import query


@query("clean_drop_any", f"WITH {fx.GAPS_SQL} SELECT * FROM gaps WHERE qty IS NOT NULL AND disc IS NOT NULL")
def drop_any(t):
    return plan.clean(fx.gaps(t), [{"type": "dropMissingRows", "columns": ["qty", "disc"]}])


@query("clean_drop_threshold", f"""
WITH {fx.GAPS_SQL} SELECT * FROM gaps
WHERE (qty IS NULL)::INT + (disc IS NULL)::INT + (tax IS NULL)::INT <= 1""")
def drop_threshold(t):
    return plan.clean(
        fx.gaps(t), [{"type": "dropMissingRows", "columns": ["qty", "disc", "tax"], "threshold": 0.5}]
    )


@query("clean_fill_mean", f"""
WITH {fx.GAPS_SQL}
SELECT {fx.KEY_SQL}, round(coalesce(qty, (SELECT avg(qty) FROM gaps)), 4) AS qty,
       round(coalesce(disc, (SELECT avg(disc) FROM gaps)), 4) AS disc, tax, div
FROM gaps""")
def fill_mean(t):
    filled = plan.clean(fx.gaps(t), [{"type": "fillMissing", "columns": ["qty", "disc"], "method": "mean"}])
    return fx.rounded(filled, ["qty", "disc"])


@query("clean_fill_median", f"""
WITH {fx.GAPS_SQL}
SELECT {fx.KEY_SQL}, round(coalesce(qty, (SELECT median(qty) FROM gaps)), 4) AS qty,
       round(coalesce(disc, (SELECT median(disc) FROM gaps)), 4) AS disc, tax, div
FROM gaps""")
def fill_median(t):
    filled = plan.clean(fx.gaps(t), [{"type": "fillMissing", "columns": ["qty", "disc"], "method": "median"}])
    return fx.rounded(filled, ["qty", "disc"])


@query("clean_fill_mode", f"""
WITH {fx.PRIO_SQL}
SELECT o_orderkey, o_totalprice, o_orderstatus,
       coalesce(prio, (SELECT prio FROM prio WHERE prio IS NOT NULL
                       GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)) AS prio
FROM prio""")
def fill_mode(t):
    return plan.clean(fx.prio(t), [{"type": "fillMissing", "columns": ["prio"], "method": "mode"}])


@query("clean_fill_constant", f"""
WITH {fx.PRIO_SQL}
SELECT o_orderkey, o_totalprice, o_orderstatus, coalesce(prio, 'unknown') AS prio FROM prio""")
def fill_constant(t):
    return plan.clean(
        fx.prio(t), [{"type": "fillMissing", "columns": ["prio"], "method": "constant", "value": "unknown"}]
    )


@query("clean_fill_drop", f"WITH {fx.PRIO_SQL} SELECT * FROM prio WHERE prio IS NOT NULL")
def fill_drop(t):
    return plan.clean(fx.prio(t), [{"type": "fillMissing", "columns": ["prio"], "method": "drop"}])


@query("clean_outlier_iqr", f"""
WITH {fx.SPIKES_SQL},
b1 AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM spikes),
s1 AS (SELECT spikes.* FROM spikes, b1
       WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
b2 AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM s1)
SELECT s1.* FROM s1, b2 WHERE l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def outlier_iqr(t):
    return plan.clean(
        fx.spikes(t), [{"type": "removeOutliers", "columns": ["price", "l_quantity"], "method": "iqr"}]
    )


@query("clean_outlier_iqr_single_pass", f"""
WITH {fx.SPIKES_SQL},
b AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3,
             quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM spikes)
SELECT spikes.* FROM spikes, b
WHERE price BETWEEN p1 - 1.5 * (p3 - p1) AND p3 + 1.5 * (p3 - p1)
  AND l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def outlier_iqr_single(t):
    return cl.remove_outliers(fx.spikes(t), ["price", "l_quantity"], "iqr", single_pass=True)


@query("clean_outlier_zscore", f"""
WITH {fx.SPIKES_SQL}, b AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM spikes)
SELECT spikes.* FROM spikes, b WHERE abs((price - m) / s) < 3""")
def outlier_zscore(t):
    return plan.clean(fx.spikes(t), [{"type": "removeOutliers", "columns": ["price"], "method": "zscore"}])


_SEGMENTS = "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()


@query("clean_onehot", """
SELECT c_custkey, """ + ", ".join(
    f"c_custkey % 9 <> 0 AND c_mktsegment = '{s}' AS segment_{s}" for s in _SEGMENTS) + " FROM customer")
def onehot(t):
    df = t.customer.select(
        "c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("segment")
    )
    return plan.clean(df, [{"type": "encodeCategorical", "columns": ["segment"], "method": "onehot"}])


@query("clean_onehot_vector", """
WITH gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part),
codes AS (SELECT brand, row_number() OVER (ORDER BY brand) AS place FROM (SELECT DISTINCT brand FROM gaps WHERE brand IS NOT NULL))
SELECT p_partkey, coalesce(place, 0) AS place, (SELECT count(*) FROM codes) AS width, (place IS NOT NULL)::BIGINT AS ones
FROM gaps LEFT JOIN codes USING (brand)""")
def onehot_vector(t):
    df = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"))
    coded = plan.clean(df, [{"type": "encodeCategorical", "columns": ["brand"], "method": "onehot_vector"}])
    flags = coded.select("p_partkey", vector_to_array("brand").alias("flags"))
    return flags.select(
        "p_partkey",
        F.array_position("flags", 1.0).alias("place"),
        F.size("flags").cast("long").alias("width"),
        F.size(F.filter("flags", lambda f: f == 1.0)).cast("long").alias("ones"),
    )


@query("clean_label_encode", """
WITH gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS brand FROM part),
codes AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS code
          FROM (SELECT DISTINCT brand FROM gaps WHERE brand IS NOT NULL))
SELECT p_partkey, CAST(coalesce(code, -1) AS BIGINT) AS brand FROM gaps LEFT JOIN codes USING (brand)""")
def label(t):
    df = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("brand"))
    return plan.clean(df, [{"type": "encodeCategorical", "columns": ["brand"], "method": "label"}])


@query("clean_label_encode_large", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS o_custkey FROM orders""")
def label_large(t):
    """A codebook of many values."""
    return cl.label_encode(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


_REPORT_OPS = [
    {"type": "dropMissingRows", "columns": ["qty"]},
    {"type": "fillMissing", "columns": ["disc"], "method": "mean"},
    {"type": "dropColumn", "columns": ["tax"]},
]


@query("clean_report", f"""
WITH {fx.GAPS_SQL}
SELECT CAST(3 AS BIGINT) AS operations, count(*) AS rows_before, CAST(8 AS BIGINT) AS columns_before,
       count(qty) AS rows_after, CAST(7 AS BIGINT) AS columns_after,
       count(*) - count(qty) AS rows_removed, CAST(1 AS BIGINT) AS columns_removed
FROM gaps""")
def report(t):
    before = fx.gaps(t)
    return plan.cleaning_report(before, plan.clean(before, _REPORT_OPS), _REPORT_OPS)


@query("clean_assess", f"""
WITH {fx.GAPS_SQL}
SELECT count(*) > count(qty) OR count(*) > count(disc) OR count(*) > count(tax) AS needs_cleaning,
       CAST((count(*) > count(qty))::INT + (count(*) > count(disc))::INT + (count(*) > count(tax))::INT
            AS BIGINT) AS columns_with_missing
FROM gaps""")
def assess(t):
    return plan.needs_cleaning(pr.profile(fx.gaps(t)))


_PLAN_SQL = """mixed AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS rare,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio
  FROM orders),
miss AS (
  SELECT 'rare' AS "column", 'mean' AS fill, 100.0 * (count(*) - count(rare)) / count(*) AS pct FROM mixed
  UNION ALL SELECT 'price', 'mean', 100.0 * (count(*) - count(price)) / count(*) FROM mixed
  UNION ALL SELECT 'prio', 'mode', 100.0 * (count(*) - count(prio)) / count(*) FROM mixed
  UNION ALL SELECT 'o_orderkey', 'mean', 0 FROM mixed WHERE false)"""


@query("clean_default_plan", f"""
WITH {_PLAN_SQL}
SELECT "column", CASE WHEN pct > 50 THEN 'dropColumn' ELSE 'fillMissing' END AS type,
       CASE WHEN pct > 50 THEN NULL ELSE fill END AS method
FROM miss WHERE pct > 0""")
def default_plan(t):
    key = F.col("o_orderkey")
    mixed = t.orders.select(
        key,
        F.when(key % 4 == 0, F.col("o_totalprice")).alias("rare"),
        F.when(key % 4 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("prio"),
    )
    return plan.plan_cleaning(pr.profile(mixed))
