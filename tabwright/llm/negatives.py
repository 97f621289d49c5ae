"""Hard-negative mining by slots: for every anchor and each of its positives the best other-class rows near that score.

An anchor's positives are its best rows of the same label.  Their scores are the upper limits of windows that
overlap: a window reaches from a share of its limit up to the limit.  The limits also cut the scores into
disjoint slots, one below each limit down to the next.  Tasks keep the best ``k`` rows of each slot (a combiner:
the best of a union are the best of the parts' best), so an anchor needs ``positives * k`` rows at most.  Laid end to
end from the highest slot down, every window's answer is the run of ``k`` rows that begins with its own slot, that is a merge
of that slot with those after it, cut off at the lower end of the window.  One sorted array answers all windows.

Anchors and rows meet block by block: both sides are dealt evenly into blocks of bounded size by a number that
is written with the prepared rows, so neither copies nor a hot id make a block larger, and a block pair returns its best rows only.

Defined cases.  Rows with a null label, a null vector, or a null or non-finite component take no part.  A row
without id is never an anchor; as another's candidate it comes after all ids on a tie.  Rows that carry the anchor's own id are
never its positives or negatives.  An anchor row that is repeated gets its answers once per row.  Vectors of other lengths are compared
as if the shorter one went on with zeros.  Scores are whole numbers; a component of 2^31 or more,
or a score beyond 64 bits, is an error.  Anchors without positives, and windows without rows, have no result; an empty table
has none either.  Columns other than id, vector and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.llm.components import stored
from tabwright.llm.registry import llm_query

ANCHORS_PER_BLOCK, ROWS_PER_BLOCK = 2_048, 16_384
NO_ID = np.iinfo(np.int64).max
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Mining:
    """Positives an anchor has, negatives per window, and the window's lower end in hundredths of its limit."""

    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    scale: float = 256.0


def usable_rows(table: DataFrame, label: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``at, id, label, v`` of the rows that take part, written once: ``at`` is a number no other row has."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return stored(rows.select(F.monotonically_increasing_id().alias("at"), "id", "label", whole.alias("v")), "vectors")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal length, short vectors filled up with zeros."""
    lengths = vectors.map(len).to_numpy()
    out = np.zeros((len(vectors), width))
    flat = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros(0)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = flat
    return out


def _scores(anchors: pd.DataFrame, rows: pd.DataFrame) -> Iterator[np.ndarray]:
    """Per anchor its whole-number inner products with all rows of the block.

    Floating point is exact as long as no sum can pass 2^53; beyond that Python's integers are used.
    """
    width = max(anchors["v"].map(len).max(), rows["v"].map(len).max())
    a, r = _matrix(anchors["v"], width), _matrix(rows["v"], width)
    if width and np.abs(a).max() * np.abs(r).max() * width >= EXACT:
        whole_r = r.astype(np.int64).astype(object)
        for line in a.astype(np.int64).astype(object):
            yield (whole_r @ line).astype(np.int64)  # raises where 64 bits do not hold a score
        return
    step = max(1, (4 << 20) // max(1, len(r)))
    for start in range(0, len(a), step):
        yield from (a[start : start + step] @ r.T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller id, highest first."""
    among = np.arange(len(scores))
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def _blocked(side: DataFrame, rows_per_block: int, own: str, other: str, others: int) -> DataFrame:
    """Rows dealt evenly into blocks of their own side and copied to every block of the other."""
    blocks = max(1, -(-side.count() // rows_per_block))
    return side.withColumn(own, F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(max(1, others) - 1)))
    )


def _meet(anchors: DataFrame, rows: DataFrame, fn, schema: str, anchors_per_block: int, rows_per_block: int) -> DataFrame:
    """``fn`` on every pair of an anchor block and a row block."""
    row_blocks = -(-rows.count() // rows_per_block)
    anchor_blocks = -(-anchors.count() // anchors_per_block)
    left = _blocked(anchors, anchors_per_block, "a", "b", row_blocks)
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides come from one table
    right = _blocked(rows, rows_per_block, "b", "a", anchor_blocks)
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(fn, schema)


def _top(found: DataFrame, k: int, *group: str) -> DataFrame:
    """The best ``k`` rows per group; Spark keeps ``k`` per group and task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _ids(column: pd.Series) -> np.ndarray:
    return column.astype("Int64").fillna(NO_ID).to_numpy(np.int64)


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [()] * len(names))]
    frame = pd.DataFrame(dict(zip(names, columns, strict=True)))
    other = frame["other"].astype("Int64")
    return frame.assign(other=other.mask(other == NO_ID))


def best_positives(anchors: DataFrame, rows: DataFrame, mining: Mining, blocks: tuple[int, int]) -> DataFrame:
    """``at, anchor, other, score, place``: the best rows of the anchor's own label."""
    k = mining.positives

    def meet(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(asked) and len(block):
            ids, labels = _ids(block["id"]), block["label"].to_numpy()
            for at, own, label, scores in zip(asked["at"], asked["id"], asked["label"], _scores(asked, block), strict=True):
                among = np.flatnonzero((labels == label) & (ids != own))
                best = among[_best(scores[among], ids[among], k)]
                parts.append((np.repeat(at, len(best)), np.repeat(own, len(best)), ids[best], scores[best]))
        return _frame(parts, ["at", "anchor", "other", "score"])

    return _top(_meet(anchors, rows, meet, "at long, anchor long, other long, score long", *blocks), k, "at")


def slot_rows(anchors: DataFrame, rows: DataFrame, mining: Mining, blocks: tuple[int, int]) -> DataFrame:
    """``at, slot, other, score, place``: the best other-label rows of each slot.

    ``anchors`` carry ``limits``, the scores of their positives, highest first.  A slot's number is the number of limits
    its rows lie at or under: slot 1 belongs to the first window only, the last slot to all.
    """
    k, share = mining.negatives, mining.least_percent

    def meet(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(asked) and len(block):
            ids, labels = _ids(block["id"]), block["label"].to_numpy()
            for at, own, label, limits, scores in zip(
                asked["at"], asked["id"], asked["label"], asked["limits"], _scores(asked, block), strict=True
            ):
                upper = np.sort(np.asarray(limits, np.int64))
                least = min(-((-share * int(p)) // 100) for p in upper)  # the lowest window's lower end, rounded up
                among = np.flatnonzero((scores <= upper[-1]) & (scores >= least) & (labels != label) & (ids != own))
                slots = len(upper) - np.searchsorted(upper, scores[among], "left")
                for slot in np.unique(slots):
                    inside = among[slots == slot]
                    best = inside[_best(scores[inside], ids[inside], k)]
                    parts.append((np.repeat(at, len(best)), np.repeat(slot, len(best)), ids[best], scores[best]))
        return _frame(parts, ["at", "slot", "other", "score"])

    return _top(_meet(anchors, rows, meet, "at long, slot int, other long, score long", *blocks), k, "at", "slot")


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    mining: Mining = Mining(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    anchors_per_block: int = ANCHORS_PER_BLOCK,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``; ``label`` an expression on the table, by default its column ``label``.
    """
    blocks = (anchors_per_block, rows_per_block)
    rows = usable_rows(table, F.col("label") if label is None else label, id_col, vector_col, mining.scale)
    anchors = rows.filter(F.col("id").isNotNull() & is_anchor)
    positives = stored(best_positives(anchors, rows, mining, blocks), "positives")
    limits = positives.groupBy("at").agg(F.collect_list("score").alias("limits"))
    found = slot_rows(anchors.join(limits, "at"), rows, mining, blocks)
    # slots in order, each from its best row down: every window is a run of this array that begins with its own slot
    row = F.struct("slot", (-F.col("score")).alias("down"), F.col("other").isNull().alias("last"), "other")
    merged = found.groupBy("at").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    limit = F.col("score")
    window = positives.join(merged, "at").select(
        F.col("anchor").alias("anchor_id"),
        F.col("other").alias("positive_id"),
        limit.alias("positive_score"),
        F.slice(F.filter("rows", lambda r: -r["down"] <= limit), F.lit(1), F.lit(mining.negatives)).alias("rows"),
    )
    hundredths = lambda score, share: score.cast("decimal(24,0)") * F.lit(share)  # noqa: E731 - beyond 64 bits
    inside = F.filter(
        "rows", lambda r: hundredths(-r["down"], 100) >= hundredths(F.col("positive_score"), mining.least_percent)
    )
    return window.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("rank", "row")).select(
        "anchor_id",
        "positive_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("row.other").alias("negative_id"),
        "positive_score",
        (-F.col("row.down")).alias("negative_score"),
    )


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same,
         list_dot_product(a.v::DOUBLE[], o.v::DOUBLE[])::BIGINT AS score
  FROM r a, r o WHERE a.vec_id % 100 = 0 AND o.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@llm_query("op12_negatives", "embeddings", SQL)
def op12_negatives(table: DataFrame, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table, F.col("id") % 100 == 0, moved)
