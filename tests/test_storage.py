"""Sources, sinks and streams."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabwright.operators import monitor as mo
from tabwright.plans.lineage import scratch_path
from tabwright.sources import inventory, readers, writers
from tabwright.streaming import events as log
from tabwright.streaming import monitor as live


def test_json_documents(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "c": True}]))
    (tmp_path / "one.json").write_text(json.dumps({"a": 3}))
    array = readers.read_any(spark, str(tmp_path / "array.json"))
    assert sorted(array.columns) == ["a", "b", "c"] and array.count() == 2
    assert readers.read_any(spark, str(tmp_path / "one.json")).collect()[0]["a"] == 3


def test_csv_inference_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,2.5,"x, ""y"""\n2,,z\n')
    df = readers.read_any(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 2.5, 'x, "y"'), (2, None, "z")]


def test_text_skips_blank_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\n  \t\ntwo\n")
    assert [r["value"] for r in readers.read_any(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]


def test_spreadsheets_are_refused(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "/nowhere/book.xlsx")


def test_a_version_is_never_overwritten(spark):
    folder = scratch_path(spark, "versions")
    writers.save_version(spark.range(3), folder, "1")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.save_version(spark.range(5), folder, "1")
    writers.save_version(spark.range(5), folder, "2")
    assert {r["version"] for r in writers.versions(spark, folder).collect()} == {"1", "2"}
    assert writers.read_version(spark, folder).count() == 5
    assert writers.read_version(spark, folder, "1").count() == 3


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(900).select(
        (F.col("id") % 3 == 0).cast("int").alias("project"),
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 977 % 1000)).alias("ts"),
        F.create_map(F.lit("x"), (F.col("id") % 17).cast("double")).alias("features"),
        F.col("id").cast("double").alias("prediction"),
        F.when(F.col("id") % 5 != 0, F.col("id") + F.col("id") % 7).cast("double").alias("truth"),
        F.lit(False).alias("reset"),
    )


def run(spark, table, files, per_batch, last=50, shards=3):
    arriving, path = scratch_path(spark, "arriving"), scratch_path(spark, "monitor")
    for i in range(files):
        table.filter(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(arriving)
    stream = log.event_stream(spark, arriving, table.schema, per_batch)
    log.finish(log.keep_batches(live.monitor_stream(stream, last, shards), path, scratch_path(spark, "checkpoint")))
    return live.latest_snapshots(spark.read.parquet(path))


@pytest.mark.parametrize("files, per_batch", [(1, 1), (5, 2)])
def test_stream_equals_batch(spark, events, files, per_batch):
    base = mo.baseline(spark.range(20).select(F.col("id").cast("double").alias("x")), ["x"])
    snapshots = run(spark, events, files, per_batch)
    got = {r["project"]: r for r in live.monitor_view(snapshots, base, 50).collect()}
    rmse = mo.rolling_rmse(events, 50)
    scored = mo.running_drift(rmse, base)
    for row in mo.monitor_status(scored, mo.drift_alerts(scored)).collect():
        live_row = got[row["project"]]
        assert live_row["recent_count"] == row["recent_count"]
        assert live_row["drift_score"] == row["drift_score"]
        assert live_row["rolling_rmse"] == row["rolling_rmse"]


def test_reset_clears_a_project(spark, events):
    at = F.lit("2024-01-01 00:08:20").cast("timestamp_ntz")
    mark = spark.range(1).select(
        F.lit(0).alias("project"), F.lit(10_000).cast("long").alias("event_id"), at.alias("ts"),
        F.lit(None).cast("map<string,double>").alias("features"), F.lit(None).cast("double").alias("prediction"),
        F.lit(None).cast("double").alias("truth"), F.lit(True).alias("reset"),
    )
    snapshots = run(spark, events.unionByName(mark), 1, 1)
    counts = {r["project"]: r["n"] for r in snapshots.groupBy("project").agg(F.sum("n").alias("n")).collect()}
    after = {r["project"]: r["count"] for r in events.filter(F.col("ts") > at).groupBy("project").count().collect()}
    whole = {r["project"]: r["count"] for r in events.groupBy("project").count().collect()}
    same_moment = events.filter((F.col("ts") == at) & (F.col("project") == 0) & (F.col("event_id") > 10_000)).count()
    assert counts == {0: after[0] + same_moment, 1: whole[1]}


def test_stream_equals_batch_where_pairs_are_rare(spark, events):
    # one pair in about 3,000 events, and one that arrives last but belongs into the middle
    times = F.make_dt_interval(secs=F.col("id"))
    rare = spark.range(9001).select(
        F.lit(0).alias("project"), F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.when(F.col("id") == 9000, F.make_dt_interval(secs=F.lit(7500))).otherwise(times)).alias("ts"),
        F.create_map(F.lit("x"), (F.col("id") % 17).cast("double")).alias("features"), F.col("id").cast("double").alias("prediction"),
    ).withColumn("truth", F.when(F.col("event_id").isin(1000, 4000, 7000, 7400, 9000), F.col("event_id") + F.col("event_id") % 7 + 3).cast("double"))
    rare = rare.withColumn("reset", F.lit(False)).select(events.columns)
    arriving, path = scratch_path(spark, "arriving"), scratch_path(spark, "monitor")
    for i in range(3):
        part = rare.filter((F.col("event_id") >= 3000 * i) & (F.col("event_id") < 3000 * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(arriving)
    rare.filter("event_id = 9000").coalesce(1).write.mode("append").parquet(arriving)
    stream = log.event_stream(spark, arriving, rare.schema, 1)
    log.finish(log.keep_batches(live.monitor_stream(stream, 50, 3), path, scratch_path(spark, "checkpoint")))
    base = mo.baseline(spark.range(20).select(F.col("id").cast("double").alias("x")), ["x"])
    got = live.monitor_view(live.latest_snapshots(spark.read.parquet(path)), base, 50).first()
    newest = mo.rolling_rmse(rare, 50).filter("rolling_rmse IS NOT NULL").orderBy(F.desc("ts"), F.desc("event_id")).first()
    assert (got["recent_count"], got["rolling_rmse"]) == (9001, newest["rolling_rmse"])


def test_append_events_batch(spark, events):
    path = scratch_path(spark, "log")
    log.append_events(events, path)
    log.append_events(events, path)
    assert spark.read.parquet(path).count() == 1800
    with pytest.raises(ValueError):
        log.append_events(log.event_stream(spark, path, events.schema), path)


def test_json_lines_keep_every_row(spark, tmp_path):
    for name in ("a.json", "b.jsonl", "c.ndjson"):
        (tmp_path / name).write_text("".join(json.dumps({"a": i}) + "\n" for i in range(5)))
        assert readers.read_any(spark, str(tmp_path / name)).count() == 5
    (tmp_path / "spread.json").write_text('{"a":\n 1}\n{"a":\n 2}\n')
    with pytest.raises(ValueError, match="more than one value"):
        readers.read_any(spark, str(tmp_path / "spread.json"))
    (tmp_path / "nested.json").write_text(json.dumps({"a": {"b": [1, {"c": 2}]}}, indent=1))
    assert readers.read_any(spark, str(tmp_path / "nested.json")).count() == 1


def test_json_files_of_both_forms(spark, tmp_path):
    folder = tmp_path / "two forms.json"
    folder.mkdir()
    (folder / "lines.json").write_text(json.dumps({"a": 1, "pad": "x" * 500}) + "\n")
    (folder / "document.json").write_text("\n" + json.dumps({"a": 2, "b": {"c": 3}}, indent=2))
    got = {r["a"]: r for r in readers.read_any(spark, str(folder)).collect()}
    assert sorted(got) == [1, 2] and got[2]["b"]["c"] == 3 and got[1]["b"] is None and got[2]["pad"] is None
    (folder / "more.json").write_text('{"a": "text", "b": {"c": 1}}\n{"a": null}\n')
    mixed = readers.read_any(spark, str(folder))
    assert sorted(r["a"] or "" for r in mixed.collect()) == ["", "1", "2", "text"]


def test_events_sent_again_are_dropped(spark, events):
    again = events.filter("event_id % 10 = 0")
    arriving, path = scratch_path(spark, "arriving"), scratch_path(spark, "log")
    for part in (events, again, again.limit(20)):
        part.coalesce(1).write.mode("append").parquet(arriving)
    once = log.without_resent(log.event_stream(spark, arriving, events.schema, 1), ["event_id"], "ts", "1 day")
    log.finish(log.append_events(once, path, scratch_path(spark, "checkpoint")))
    kept = spark.read.parquet(path)
    assert kept.columns == events.columns and kept.count() == 900 and kept.select("event_id").distinct().count() == 900


def test_batches_are_merged_and_survive_a_restart(spark, events):
    arriving, path, mark = (scratch_path(spark, x) for x in ("arriving", "stats", "checkpoint"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for start in (0, 25):
            for i in range(start, start + 25):
                events.filter(F.col("event_id") % 50 == i).coalesce(1).write.mode("append").parquet(arriving)
            stats = live.stream_feature_stats(log.event_stream(spark, arriving, events.schema, 1))
            log.finish(log.keep_batches(stats, path, mark, merge=live.merged_batches, merge_every=8))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert log._folders(spark, path, "merged") == [39, 47]
    assert log._folders(spark, path, "batch") == list(range(40, 50)), "what two merged folders have replaced is gone"
    (Path(path) / "merged=49").mkdir()  # a merge that never ended
    got = {(r["project"], r["feature"]): (r["n"], r["mean"]) for r in live.latest_stats(log.read_batches(spark, path)).collect()}
    expected = {(r["project"], r["feature"]): (r["n"], r["mean"]) for r in mo.feature_stats(events).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_merged_snapshots_answer_as_all_batches(spark):
    schema = "project int, shard int, n long, ids array<long>, epoch long, moved_ts array<long>, moved_ids array<long>, batch long"
    rows = [
        (0, 0, 5, [1], 0, [7], [70], 0), (0, 0, 6, [2], 1, [8], [80], 1), (0, 0, 7, [3], 1, [], [], 2), (0, 0, 8, [4], 1, [9], [90], 3),
        (0, 1, 2, [5], 0, [], [], 0), (1, 0, 1, [6], 0, None, None, 2),
    ]
    batches = spark.createDataFrame(rows, schema)
    merged = live.merged_snapshots(batches)
    assert merged.columns == batches.columns and merged.count() == 4
    kept = {(r["project"], r["shard"], r["batch"]): (r["n"], r["moved_ids"]) for r in merged.collect()}
    assert kept == {(0, 0, 1): (None, [80]), (0, 0, 3): (8, [90]), (0, 1, 0): (2, []), (1, 0, 2): (1, None)}
    again = live.merged_snapshots(merged)
    assert again.exceptAll(merged).isEmpty() and merged.exceptAll(again).isEmpty()


def test_storage_totals(spark, small):
    on_disk = {p.name: p.stat().st_size for p in Path(small).glob("*.parquet")}
    stats = inventory.storage_stats(spark, {"events": f"{small}/events.parquet", "tables": small}).collect()
    sizes = {r["kind"]: (r["files"], r["total_size"]) for r in stats}
    assert sizes["tables"] == (len(on_disk), sum(on_disk.values()))
    assert sizes["events"] == (1, on_disk["events.parquet"])
    assert sizes["total"] == (len(on_disk) + 1, sum(on_disk.values()) + on_disk["events.parquet"])


def test_newest_version_is_the_last_finished(spark, tmp_path):
    for name, n in (("10", 1), ("9", 2), ("8", 3)):
        writers.save_version(spark.range(n), str(tmp_path), name, "parquet")
        time.sleep(0.05)
    (tmp_path / "version=8" / "_SUCCESS").unlink()
    assert writers.read_version(spark, str(tmp_path), fmt="parquet").count() == 2
    assert {r["version"] for r in writers.versions(spark, str(tmp_path)).collect()} == {"9", "10"}
