"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import unit_hash


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of


def sample_ids(labels: DataFrame, label: str, id_col: str, per_class: int) -> DataFrame:
    """Ids and labels of about ``per_class`` rows of each class (0 and 1), chosen by hash.

    The share of a class that is kept is ``per_class`` over its number of rows, so the sample is bounded.
    """
    marked = labels.select(F.col(id_col).alias("sample_id"), F.col(label).cast("int").alias("label"))
    marked = marked.filter(F.col("sample_id").isNotNull() & F.col("label").isin(0, 1))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, per_class / max(1, sizes.get(1, 0))).otherwise(per_class / max(1, sizes.get(0, 0)))
    kept = marked.filter(unit_hash(F.col("sample_id"), "sample") < share)
    weight = F.when(F.col("label") == 1, max(1.0, sizes.get(1, 0) / per_class)).otherwise(max(1.0, sizes.get(0, 0) / per_class))
    return kept.groupBy("sample_id").agg(F.max("label").alias("label")).withColumn("weight", weight.cast("double"))


def fit_once(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, fit: Callable[[list, list, list], object]):
    """Gather the sampled texts, whole, in one task and fit there; only the model comes back.

    ``fit`` gets the texts, labels and weights (rows a sampled row stands for), ordered by id.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("id", "text", "label", "weight")), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        model = fit([r[1] or "" for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), texts["id"] == chosen["sample_id"]).select("id", "text", "label", "weight")
    fitted = sample.repartition(1).mapInArrow(work, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit([], [], [])  # no labelled rows, no task
