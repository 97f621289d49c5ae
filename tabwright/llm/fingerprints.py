"""Bottom-k sketches of shingle hashes.

A sketch is the sorted ``k`` smallest distinct 64-bit hashes of a text's
five-word shingles (words lower-cased A-Z; fewer words count as one shingle,
no words give the empty sketch).  A sketch with fewer than ``k`` hashes holds
the whole set, and every estimate from such sketches is exact.  The sketch of a
union is the bottom k of the united sketches, so parts can be sketched apart.
Equal texts have equal sketches; two empty sketches resemble each other fully.

The edited texts of the query need each document's successor.  Ids are cut
into ranges by quantiles, the first document of a range is copied into the
range before it, and one shuffle brings each range together in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.batches import SLICE_BYTES, slices, text_shingles
from tabwright.llm.columns import free_names
from tabwright.llm.registry import llm_query

K = 128
HASHES = 2.0**64
LEAST_ID = -(1 << 63)


def sketches(texts: list[str | None] | pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of each text."""
    values, counts = text_shingles(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    out = []
    for begin, end in zip(ends - counts, ends, strict=True):
        part = values[begin:end]
        if len(part) > 8 * k:  # the k smallest distinct are among these unless repeats crowd them out
            few = np.unique(np.partition(part, 4 * k)[: 4 * k])
            part = few if len(few) >= k else part
        out.append(np.unique(part)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all, exact when both sketches are whole sets."""
    whole = len(a) < k and len(b) < k
    union = np.union1d(a, b)
    if not whole:
        union = union[:k]
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= union[-1])) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles, exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1.0) / HASHES)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set's shingles that the second has too."""
    if not len(a):
        return 1.0
    # up to the last hash of every full sketch, both sketches hold all hashes of their sets
    reach = min((s[-1] for s in (a, b) if len(s) >= k), default=a[-1])
    within = a[a <= reach]
    return float(np.isin(within, b).mean()) if len(within) else 0.0


def packed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", k: int = K) -> DataFrame:
    """Append the packed sketch of every text."""
    (name,) = free_names(docs, name)
    schema = docs.withColumn(name, F.lit("")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                prints = [packed(s) for s in sketches(part.column(text_col), k)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints, pa.string())], names=schema.names)

    return docs.mapInArrow(work, schema)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    outer = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda c: c <= key))
    inner = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    within = F.size(F.filter(F.element_at(inner, outer), lambda c: c <= key))
    return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * step + within)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Arrange (id, text) in ranges of descending id, each followed by the document after it.

    Columns: ``chain`` (the range), ``guest`` (true for the copy of the next range's
    first document), ``id``, ``text``; sorted inside every partition.  After
    the smallest id comes the largest again.  A null id counts as the smallest; of rows
    with one id the smaller text comes first.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col), F.lit(LEAST_ID))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * tasks
    quantiles = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    ranged = rows.withColumn("chain", _range_of(F.col("key"), sorted(set(quantiles or []))))
    heads = {r["chain"]: r["head"] for r in ranged.groupBy("chain").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {heads[chain]: order[i - 1] for i, chain in enumerate(order)}  # the first one's is the last
    own = ranged.withColumn("guest", F.lit(False))
    if not before:
        return own.drop("key")
    home = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("key"))
    firsts = rows.filter(F.col("key").isin(list(before)))
    # rows may repeat an id; the one that its range begins with is the copy
    firsts = firsts.groupBy("key").agg(F.min(F.struct("text", "id")).alias("least"))
    guests = firsts.select("key", F.col("least.id").alias("id"), F.col("least.text").alias("text"), home.alias("chain"), F.lit(True).alias("guest"))
    both = own.unionByName(guests).repartition(tasks, "chain")
    return both.sortWithinPartitions("chain", "guest", F.col("key").desc(), "text").drop("key")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited_rows(chain: list[tuple]) -> Iterator[tuple]:
    """Results for all but the last row of a stretch of one chain."""
    texts = [row[3] for row in chain]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
    own, new = sketches(texts), sketches(edited)
    for i, text in enumerate(edited):
        yield (
            chain[i][2], len(texts[i]), hashlib.sha256(text.encode()).hexdigest(), packed(own[i]), packed(new[i]),
            resemblance(own[i], new[i]), resemblance(own[i], own[i + 1]),
        )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how near they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def result(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names
            )

        stretch: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for row in zip(*(part.column(c).to_pylist() for c in ("chain", "guest", "id", "text")), strict=True):
                    if stretch and row[0] != stretch[0][0] or size > SLICE_BYTES:
                        if len(stretch) > 1:
                            yield result(list(_edited_rows(stretch)))
                        stretch = stretch[-1:] if row[0] == stretch[0][0] else []
                        size = len(stretch[0][3]) if stretch else 0
                    stretch.append(row)
                    size += len(row[3])
        if len(stretch) > 1:
            yield result(list(_edited_rows(stretch)))

    return with_next(docs).select("chain", "guest", "id", "text").mapInArrow(work, EDITED)


@llm_query("op2_fingerprints", "documents")
def op2_fingerprints(docs: DataFrame, folder: str) -> DataFrame:
    return fingerprint_edits(docs.select("doc_id", "text"))
