"""Shared derived inputs: the same expression as a Spark table and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.queries.registry import Tables

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

GAPS_SQL = f"""gaps AS (
  SELECT {KEY_SQL},
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS qty,
         CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount END AS disc,
         CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE l_tax END AS tax,
         CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS div
  FROM lineitem)"""


def gaps(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    return t.lineitem.select(
        *LINEITEM_KEY,
        F.when(line % 3 == 0, None).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(line % 4 == 0, None).otherwise(F.col("l_discount")).alias("disc"),
        F.when(line.isin(2, 3), None).otherwise(F.col("l_tax")).alias("tax"),
        F.when(line == 1, 0.0).otherwise(F.col("l_quantity")).alias("div"),
    )


PRIO_SQL = """prio AS (
  SELECT o_orderkey, o_totalprice, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS prio
  FROM orders)"""


def prio(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderpriority")).alias("prio"),
    )


SPIKES_SQL = f"""spikes AS (
  SELECT {KEY_SQL}, l_quantity,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL
              WHEN l_orderkey % 500 = 1 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price
  FROM lineitem)"""


def spikes(t: Tables) -> DataFrame:
    order = F.col("l_orderkey")
    return t.lineitem.select(
        *LINEITEM_KEY,
        "l_quantity",
        F.when(order % 7 == 0, None)
        .when(order % 500 == 1, F.col("l_extendedprice") * 20)
        .otherwise(F.col("l_extendedprice"))
        .alias("price"),
    )


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


CUTOFF = "2024-01-16"

# prediction events: ten projects, one of which drifts after the cutoff; one event
# in three lacks feature k, one in eleven has no truth
EVENTS_SQL = f"""ev AS (
  SELECT user_id % 10 AS project, event_id, ts,
         value + CASE WHEN user_id % 10 = 3 AND ts >= TIMESTAMP '{CUTOFF}' THEN 5000 ELSE 0 END AS value,
         CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
         value AS prediction,
         CASE WHEN event_id % 11 <> 0 THEN value + event_id % 5 END AS truth,
         event_type AS predicted_type,
         CASE WHEN event_id % 4 = 0 THEN 'view' WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS true_type
  FROM events)"""


def flat_events(t: Tables) -> DataFrame:
    ident, project = F.col("event_id"), F.col("user_id") % 10
    drifted = (project == 3) & (F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    return t.events.select(
        project.alias("project"),
        "event_id",
        "ts",
        (F.col("value") + F.when(drifted, 5000).otherwise(0)).alias("value"),
        F.when(ident % 3 != 0, F.get_json_object("props", "$.k").cast("double")).alias("k"),
        F.col("value").alias("prediction"),
        F.when(ident % 11 != 0, F.col("value") + ident % 5).alias("truth"),
        F.col("event_type").alias("predicted_type"),
        F.when(ident % 4 == 0, "view").when(ident % 11 == 0, None).otherwise(F.col("event_type")).alias("true_type"),
    )


def with_features(flat: DataFrame) -> DataFrame:
    both = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k"))
    return flat.withColumn("features", F.map_filter(both, lambda _, v: v.isNotNull())).drop("value", "k")


def before_cutoff(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))


def from_cutoff(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz"))


LABELLED_SQL = """preds AS (
  SELECT l_returnflag AS label,
         CASE WHEN l_quantity > 34 THEN 'R' WHEN l_quantity > 17 THEN 'A' ELSE 'N' END AS prediction
  FROM lineitem)"""


def labelled(t: Tables) -> DataFrame:
    qty = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_returnflag").alias("label"),
        F.when(qty > 34, "R").when(qty > 17, "A").otherwise("N").alias("prediction"),
    )


NUMERIC_PREDS_SQL = "preds AS (SELECT l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem)"


def numeric_preds(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )
