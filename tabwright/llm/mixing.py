"""Mix sources to target weights by repeating or thinning documents.

Words are summed per source; targets share a multiple of all words by weight,
no target above a multiple of its source's own words.  A document of a source
with repetition rate r is emitted floor(r) times, plus once more when its hash
falls below the fraction of r, so reruns agree.

A null text has no words, a null source is a source of its own and comes last,
a source without words has rate 0.  Rows that repeat an id get the same
decision.  The table of sources is sorted by range and ranked without a
single-task window; it is broadcast only after its rows and bytes were counted,
and joined with salt beyond that, so a hot source is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.columns import free_names, unit_hash, word_count
from tabwright.llm.registry import llm_query
from tabwright.plans.lineage import cut_lineage, written

BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 50_000, 4 << 20, 64


@dataclass(frozen=True)
class Mix:
    """Weights by rank of the source, total as a share of all words, largest rate, seed of the hash."""

    weights: Sequence[int] = (3, 1, 2)
    total: float = 1.5
    most: int = 2
    seed: str = "mix"


def _ranked(sizes: DataFrame) -> DataFrame:
    """Append the 0-based ``rank`` of each source: its place in a sorted partition after the partitions before.

    The ranked table is written, since every step of the water filling reads it.
    """
    fixed = cut_lineage(sizes.orderBy(F.col("source").asc_nulls_last())).withColumn("part", F.spark_partition_id())
    counts = fixed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = fixed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + place - 1).drop("part", "before")
    return written(ranked, "sources")


def source_targets(docs: DataFrame, mix: Mix = Mix(), source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(F.col(text_col))).alias("source_size"))
    ranked = _ranked(sizes)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    table = ranked.select("source", "source_size", weights[(F.col("rank") % len(mix.weights)).cast("int")].alias("weight"))
    cap = F.col("source_size") * F.lit(float(mix.most))
    # raise the words per unit of weight until no source that is not capped exceeds its cap
    words, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    share, left, capped = mix.total * (words or 0), weight or 1.0, -1
    while True:
        above = F.col("weight") * share > cap * left
        held = table.filter(above).agg(F.count(F.lit(1)), F.sum(cap), F.sum("weight")).first()
        if held[0] == capped or held[0] == 0:
            break
        capped, share, left = held[0], mix.total * words - held[1], weight - held[2]
    return table.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * share / left))


def mix_decisions(
    docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The documents with ``mix_source_size``, ``mix_target`` and ``mix_copies`` (renamed if taken) appended."""
    targets = source_targets(docs, mix, source_col, text_col)
    key, salt, size, target, copies = free_names(
        docs, "mix_source", "mix_salt", "mix_source_size", "mix_target", "mix_copies"
    )
    targets = targets.select(F.col("source").alias(key), F.col("source_size").alias(size), F.col("target").alias(target))
    rows, width = targets.agg(F.count(F.lit(1)), F.sum(F.octet_length(key))).first()
    same = F.col(source_col).eqNullSafe(F.col(key))
    if rows <= BROADCAST_ROWS and (width or 0) <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(targets), same)
    else:
        spread = targets.withColumn(salt + "_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, same & (F.col(salt) == F.col(salt + "_t")))
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    extra = (unit_hash(F.col(id_col), mix.seed) < rate - F.floor(rate)).cast("long")
    return joined.select(*[docs[c] for c in docs.columns], size, target, (F.floor(rate) + extra).alias(copies))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents: every row as often as decided, columns untouched."""
    decided = mix_decisions(docs, mix, id_col, source_col, text_col)
    copies = decided.columns[-1]
    repeated = decided.filter(F.col(copies) > 0).select(
        *docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copies)
    )
    return repeated.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), filled AS (
  SELECT *, row_number() OVER o AS k,
         1.5 * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS num,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS den
  FROM ranked
  WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST),
         b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT num::DOUBLE AS num, den::DOUBLE AS den FROM filled WHERE w * num <= 2.0 * source_size * den ORDER BY k LIMIT 1
), t AS (
  SELECT r.source, r.source_size,
         CASE WHEN w * num > 2.0::DOUBLE * source_size * den THEN 2.0::DOUBLE * source_size ELSE w * num / den END AS target
  FROM ranked r, level
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""


@llm_query("op3_mix", "documents", SQL)
def op3_mix(docs: DataFrame, folder: str) -> DataFrame:
    columns = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    decided = mix_decisions(columns)
    return decided.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
    )
