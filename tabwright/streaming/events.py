"""The log of prediction events as a stream source and sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwright.sources.readers import Schema

FILES_PER_BATCH = 1000
MERGE_EVERY = 50


def event_stream(
    spark: SparkSession, path: str, schema: Schema, files_per_batch: int = FILES_PER_BATCH, fmt: str = "parquet"
) -> DataFrame:
    """Files arriving in a folder; the batch size is bounded, so is a task's share of a batch."""
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def append_events(
    df: DataFrame, path: str, checkpoint: str | None = None, partition_by: Sequence[str] = ()
) -> StreamingQuery | None:
    """Append a table, or a stream from where its checkpoint stands, to the log."""
    if not df.isStreaming:
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
        return None
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start()
    )


def without_resent(
    events: DataFrame, keys: Sequence[str], at: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Drop events of a stream that come again within ``delay`` of event time.

    The state holds one entry per key until the watermark has passed it; events that come later than the watermark
    are dropped, so ``delay`` has to cover how late an event may be.
    """
    kind = dict(events.dtypes)[at]
    clock = "_event_clock"
    timed = events.withColumn(clock, F.col(at).cast("timestamp") if kind != "timestamp" else F.col(at))
    return timed.withWatermark(clock, delay).dropDuplicatesWithinWatermark(list(keys)).drop(clock)


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``kind=…`` below a path, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    marks = hadoop.Path(f"{path}/{kind}=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(s.getPath().getParent().getName().removeprefix(f"{kind}=")) for s in found or [])


def _remove(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_batches(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of all batches kept below ``path``, with the number of their batch as ``batch``.

    That is the newest merged folder and the batches after it, whatever number of batches has run.
    """
    merged = [n for n in _folders(spark, path, "merged") if upto is None or n < upto]
    since = merged[-1] if merged else -1
    batches = [n for n in _folders(spark, path, "batch") if n > since and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{path}/merged={since}")] if merged else []
    if batches:
        folders = [f"{path}/batch={n}" for n in batches]
        parts.append(spark.read.option("basePath", path).parquet(*folders).withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        raise ValueError(f"no finished batch in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def keep_batches(
    df: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "update",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Write each batch of changed rows to its own folder; a repeated batch replaces itself.

    With ``merge``, which makes of the rows of many batches those that still count, every ``merge_every`` batches
    become one merged folder.  It counts once its writing has ended; only then do the folders go that the
    merged folder before it had already replaced, so a reader that has just listed them still finds its files.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if merge and (number + 1) % merge_every == 0:
            spark = batch.sparkSession
            merge(read_batches(spark, path, number)).write.mode("overwrite").parquet(f"{path}/merged={number}")
            older = [n for n in _folders(spark, path, "merged") if n < number]
            for n in _folders(spark, path, "batch"):
                if older and n <= older[-1]:
                    _remove(spark, f"{path}/batch={n}")
            for n in older[:-1]:
                _remove(spark, f"{path}/merged={n}")

    return (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
