"""Sources, sinks and streams; written data goes to a fresh folder of the shared scratch space."""

from pyspark.sql import functions as F

from tabwright.operators import monitor as mo
from tabwright.plans.lineage import scratch_path
from tabwright.queries import fixtures as fx
from tabwright.queries.monitoring import BASE_SQL, base_stats, events, typed_events
from tabwright.queries.registry import query
from tabwright.sources import readers, writers
from tabwright.streaming import events as log
from tabwright.streaming import monitor as live


@query("src_csv_roundtrip", "SELECT * FROM nation")
def csv_roundtrip(t):
    path = writers.save_version(t.nation, scratch_path(t.spark, "csv"), "1")
    return readers.read_csv(t.spark, path)


@query("src_csv_schema", "SELECT * FROM orders")
def csv_schema(t):
    path = writers.save_version(t.orders, scratch_path(t.spark, "csv"), "1")
    return readers.read_csv(t.spark, path, t.orders.schema)


@query("src_json_lines", "SELECT c_custkey, c_name FROM customer")
def json_lines(t):
    """Lines that the reader has to recognise."""
    path = scratch_path(t.spark, "lines") + ".json"
    t.customer.select("c_custkey", "c_name").write.json(path)
    return readers.read_any(t.spark, path)


@query("src_json_mixed", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal FROM customer")
def json_mixed(t):
    """One folder with files of lines and files of one pretty-printed document each."""
    path = scratch_path(t.spark, "mixed") + ".json"
    odd, even = (t.customer.filter(F.col("c_custkey") % 2 == rest) for rest in (1, 0))
    odd.select("c_custkey", "c_name").write.json(path)
    rows = F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))
    documents = even.groupBy("c_nationkey").agg(F.to_json(rows, {"pretty": "true"}).alias("value"))
    documents.select("value").write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return readers.read_any(t.spark, path)


@query("src_json_roundtrip", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def json_roundtrip(t):
    path = scratch_path(t.spark, "json")
    t.customer.write.json(path)
    return readers.read_json(t.spark, path, lines=True)


@query("src_text_lines", r"""
SELECT line AS value FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents)
WHERE regexp_matches(line, '\S')""")
def text_lines(t):
    path = scratch_path(t.spark, "text")
    t.documents.select("text").write.text(path)
    return readers.read_text(t.spark, path)


@query("src_parquet", "SELECT * FROM part")
def parquet(t):
    return readers.read_parquet(t.spark, f"{t.folder}/part.parquet")


@query("src_dispatch", """
SELECT '.csv' AS extension, count(*) AS rows FROM supplier UNION ALL SELECT '.json', count(*) FROM supplier
UNION ALL SELECT '.txt', count(*) FROM supplier UNION ALL SELECT '.parquet', count(*) FROM supplier
UNION ALL SELECT '.data', count(*) FROM supplier""")
def dispatch(t):
    folder = scratch_path(t.spark, "dispatch")
    small = t.supplier
    small.write.option("header", True).csv(f"{folder}/a.csv")
    small.write.option("header", True).csv(f"{folder}/a.data")
    small.write.parquet(f"{folder}/a.parquet")
    small.select("s_name").write.text(f"{folder}/a.txt")
    # one document per file, each an array of at most fifty rows
    per_file = small.groupBy(F.floor(F.col("s_suppkey") / 50)).agg(
        F.to_json(F.collect_list(F.struct(*small.columns))).alias("value")
    )
    per_file.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/a.json")
    parts = [
        readers.read_any(t.spark, f"{folder}/a{e}").agg(F.lit(e).alias("extension"), F.count(F.lit(1)).alias("rows"))
        for e in [*readers.EXTENSIONS, ".data"]
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("sink_versioned", """
SELECT 'backup' AS version, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT 'newest', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_totalprice > 100000""")
def sink(t):
    folder = scratch_path(t.spark, "versions")
    writers.save_version(t.orders, folder, "1")
    before = writers.read_version(t.spark, folder, schema=t.orders.schema)
    writers.save_version(before.filter(F.col("o_totalprice") > 100000), folder, "2")
    read = [
        ("backup", writers.read_version(t.spark, folder, "1", schema=t.orders.schema)),
        ("newest", writers.read_version(t.spark, folder, schema=t.orders.schema)),
    ]
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn(
            "version", F.lit(name)
        )
        for name, df in read
    ]
    return parts[0].unionByName(parts[1])


def _stream(t, table):
    """The table as files of a stream that takes several batches to read."""
    path = scratch_path(t.spark, "arriving")
    table.repartition(6, "event_id").write.parquet(path)
    return log.event_stream(t.spark, path, table.schema, files_per_batch=2)


@query("stream_event_log", "SELECT * FROM events")
def event_log(t):
    path = scratch_path(t.spark, "log")
    log.finish(log.append_events(_stream(t, t.events), path, scratch_path(t.spark, "checkpoint")))
    return readers.read_parquet(t.spark, path)


@query("stream_event_dedup", "SELECT * FROM events")
def event_dedup(t):
    """Every tenth event is sent twice."""
    again = t.events.filter(F.col("event_id") % 10 == 0)
    path = scratch_path(t.spark, "log")
    once = log.without_resent(_stream(t, t.events.unionByName(again)), ["event_id"], "ts", "1000 days")
    log.finish(log.append_events(once, path, scratch_path(t.spark, "checkpoint")))
    return readers.read_parquet(t.spark, path)


@query("stream_feature_stats", f"""
WITH {fx.EVENTS_SQL},
long AS (SELECT project, 'value' AS feature, value AS v FROM ev UNION ALL SELECT project, 'k', k FROM ev)
SELECT project, feature, count(v) AS n, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std
FROM long WHERE v IS NOT NULL GROUP BY project, feature""")
def feature_stats(t):
    path = scratch_path(t.spark, "stats")
    stats = live.stream_feature_stats(_stream(t, events(t)))
    log.finish(log.keep_batches(stats, path, scratch_path(t.spark, "checkpoint"), merge=live.merged_batches, merge_every=2))
    return fx.rounded(live.latest_stats(log.read_batches(t.spark, path)), ["mean", "std"])


@query("stream_monitor", f"""
WITH {fx.EVENTS_SQL}, {BASE_SQL},
ends AS (SELECT project, max(struct_pack(t := ts, i := event_id)) AS e FROM ev WHERE truth IS NOT NULL GROUP BY project),
last500 AS (SELECT ev.* FROM ev JOIN ends USING (project) WHERE struct_pack(t := ts, i := event_id) <= e
            QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) <= 500),
rolled AS (SELECT project, round(sqrt(avg((prediction - truth) ^ 2)), 4) AS rolling_rmse FROM last500 GROUP BY project)
SELECT project, count(*) AS recent_count, any_value(rolling_rmse) AS rolling_rmse,
       round((least(abs(avg(value) - any_value(mv)) / any_value(sv), 10)
              + least(abs(avg(k) - any_value(mk)) / any_value(sk), 10)) / 2, 3) AS drift_score
FROM ev JOIN rolled USING (project), base GROUP BY project""")
def stream_monitor(t):
    return _monitored(t, events(t)).drop("rolling_accuracy")


@query("stream_monitor_accuracy", f"""
WITH {fx.EVENTS_SQL},
ends AS (SELECT project, max(struct_pack(t := ts, i := event_id)) AS e FROM ev
         WHERE predicted_type IS NOT NULL AND true_type IS NOT NULL GROUP BY project),
last500 AS (SELECT ev.* FROM ev JOIN ends USING (project) WHERE struct_pack(t := ts, i := event_id) <= e
            QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) <= 500)
SELECT project, round(avg((predicted_type = true_type)::INT), 4) AS rolling_accuracy FROM last500 GROUP BY project""")
def stream_monitor_accuracy(t):
    return _monitored(t, typed_events(t)).select("project", "rolling_accuracy")


def _monitored(t, table):
    path = scratch_path(t.spark, "monitor")
    snapshots = live.monitor_stream(_stream(t, table), shards=4)
    log.finish(log.keep_batches(snapshots, path, scratch_path(t.spark, "checkpoint"), merge=live.merged_snapshots, merge_every=2))
    newest = live.latest_snapshots(log.read_batches(t.spark, path))
    return live.monitor_view(newest, base_stats(t), mo.LAST_EVENTS)
