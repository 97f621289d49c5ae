"""k-nearest-neighbour join: exact in two passes, or approximate by projection buckets.

Pivots, a spread-out sample of the training rows, cut the space into cells, and neighbouring cells are joined to groups of
about a block.  In the first pass a query meets its own group only, which gives it k candidates and the distance of the
worst of them.  In the second it visits the other groups with a cell that can hold a nearer row: by the triangle inequality
a cell is out of reach if its ring around the pivot is, and by the bisector between two pivots if the query lies too far on
its own side.  A crowded cell is cut into blocks of bounded size; in a block a ball tree tells which balls a query has to
look into.  Queries are handled together, ball by ball, and a block returns the k best per query, so no task holds or emits
all pairs of a group.

The approximate mode lets a query meet the rows that share a bucket of a random projection with it in one of the hash tables:
bucket by bucket, or, where buckets are so wide that they hold more pairs than there are, in the two passes above.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwright.plans.lineage import written

BLOCK_ROWS = 20_000
BALL_ROWS = 256
QUERIES_AT_ONCE = 4_096
PAIRS_AT_ONCE = 65_536
MOST_PIVOTS = 4_096
FEWEST_GROUPS, LEAST_BLOCK = 12, 2_048
SINGLE = float(np.finfo(np.float32).eps)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, up to rounding: good for bounds and preselection."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _slack(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What rounding of ``_distances`` can amount to, per query: about 1e-8 of the lengths, taken 100 times."""
    most = (rows * rows).sum(1).max() if len(rows) else 0.0
    return 1e-6 * np.sqrt((queries * queries).sum(1) + most) + 1e-12


def ball_tree(points: np.ndarray, ball_rows: int = BALL_ROWS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows, centre and radius of the balls: halved at the median of the widest dimension until small enough."""
    open_, balls = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= ball_rows:
            balls.append(rows)
            continue
        inside = points[rows]
        widest = int(np.argmax(inside.max(0) - inside.min(0))) if inside.shape[1] else 0
        order = np.argpartition(inside[:, widest], len(rows) // 2) if inside.shape[1] else np.arange(len(rows))
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    centres = np.stack([points[b].mean(0) for b in balls])
    radii = np.array([np.sqrt(((points[b] - c) ** 2).sum(1).max()) for b, c in zip(balls, centres, strict=True)])
    return balls, centres, radii


def _first_of_each(query: np.ndarray, distance: np.ndarray, row_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query, ties by row id."""
    order = np.lexsort((row_id, distance, query))
    sorted_query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query, "left")
    return order[rank < k]


def _beside(points: np.ndarray, last: np.ndarray | float, kind: type) -> np.ndarray:
    """The points with one more coordinate."""
    wide = np.empty((len(points), points.shape[1] + 1), kind)
    wide[:, :-1], wide[:, -1] = points, last
    return wide


class _Ball:
    """Rows around their centre, in single precision with known error where their size allows it."""

    def __init__(self, rows: np.ndarray, members: np.ndarray, centre: np.ndarray):
        inside = rows[members] - centre
        square = (inside * inside).sum(1)
        self.members, self.centre, self.most = members, centre, float(square.max())
        self.kind = np.float32 if self.most < 1e30 else np.float64
        self.side = _beside(inside, -square / 2, self.kind).T

    def scores(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half the squared length of a query less half its squared distance, that length, and what rounding can amount to."""
        moved = asked - self.centre
        square = (moved * moved).sum(1)
        single = self.kind is np.float32 and square.max() < 1e30
        side = self.side if single else self.side.astype(np.float64)
        eps = SINGLE if self.kind is np.float32 else float(np.finfo(np.float64).eps)
        error = (asked.shape[1] + 8) * eps * (np.sqrt(square * self.most) + self.most + square) + 1e-40
        return _beside(moved, 1.0, side.dtype.type) @ side, square, error


def block_neighbours(
    rows: np.ndarray,
    row_ids: np.ndarray,
    queries: np.ndarray,
    own_ids: np.ndarray | None,
    limit: np.ndarray,
    k: int,
    row_codes: np.ndarray | None = None,
    query_codes: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and exact distances: the k best rows per query that lie within its ``limit``.

    The limits shrink as balls are searched, the nearest ball of each query first.  With codes, only
    rows that have one of them in common with the query count.
    """
    trees, centres, radii = ball_tree(rows)
    balls = [_Ball(rows, members, c) for members, c in zip(trees, centres, strict=True)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def allowed(query: np.ndarray, row: np.ndarray) -> np.ndarray:
        fine = np.ones(np.broadcast(query, row).shape, bool)
        if own_ids is not None:
            fine &= own_ids[query] != row_ids[row]
        if row_codes is not None:
            shared = np.zeros(fine.shape, bool)
            for t in range(row_codes.shape[1]):
                shared |= row_codes[row, t] == query_codes[query, t]
            fine &= shared
        return fine

    for start in range(0, len(queries), QUERIES_AT_ONCE):
        part = queries[start : start + QUERIES_AT_ONCE]
        near, slack = limit[start : start + QUERIES_AT_ONCE].copy(), _slack(part, rows)
        least = _distances(part, centres) - radii[None, :] - slack[:, None]
        nearest_ball = least.argmin(1)
        best, best_row = np.full((len(part), k), np.inf), np.full((len(part), k), -1)
        for first in (True, False):
            for b, ball in enumerate(balls):
                here = nearest_ball == b
                visits = np.flatnonzero((here if first else ~here) & (least[:, b] <= near))
                if not len(visits):
                    continue
                scores, square, error = ball.scores(part if len(visits) == len(part) else part[visits])
                blind = np.flatnonzero(np.isinf(near[visits]))
                if len(blind) and len(ball.members) > k:  # a first limit, from the k-th best of this ball
                    seen = np.where(allowed(start + visits[blind, None], ball.members[None, :]), scores[blind], -np.inf)
                    worst = np.partition(seen, len(ball.members) - k, axis=1)[:, len(ball.members) - k].astype(np.float64)
                    near[visits[blind]] = np.sqrt(np.maximum(square[blind] - 2 * worst + 2 * error[blind], 0.0))
                reach = near[visits] + slack[visits]
                floor = ((square - reach * reach) / 2 - error).astype(scores.dtype)
                floor = np.nextafter(floor, scores.dtype.type(-np.inf))
                hits = np.flatnonzero(scores >= floor[:, None])
                for at in range(0, len(hits), PAIRS_AT_ONCE):
                    query, row = np.divmod(hits[at : at + PAIRS_AT_ONCE], len(ball.members))
                    query, row = visits[query], ball.members[row]
                    fine = allowed(start + query, row)
                    query, row = query[fine], row[fine]
                    exact = np.sqrt(((rows[row] - part[query]) ** 2).sum(1))
                    fine = exact <= near[query] + slack[query]
                    _keep_best(best, best_row, query[fine], row[fine], exact[fine], row_ids, k)
                near[visits] = np.minimum(near[visits], best[visits, k - 1])
        query, rank = np.nonzero(best_row >= 0)
        found.append((query + start, best_row[query, rank], best[query, rank]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _keep_best(
    best: np.ndarray, best_row: np.ndarray, query: np.ndarray, row: np.ndarray, exact: np.ndarray, row_ids: np.ndarray, k: int
) -> None:
    """Merge new pairs into the k best of each query, ties by row id."""
    if not len(query):
        return
    order = _first_of_each(query, exact, row_ids[row], k)
    query, row, exact = query[order], row[order], exact[order]
    changed, begin, place = np.unique(query, return_index=True, return_inverse=True)
    rank = np.arange(len(query)) - begin[place]
    far, who = np.full((len(changed), 2 * k), np.inf), np.full((len(changed), 2 * k), -1)
    far[:, :k], who[:, :k] = best[changed], best_row[changed]
    far[place, k + rank], who[place, k + rank] = exact, row
    order = np.lexsort((row_ids[who], who < 0, far), axis=1)[:, :k]
    best[changed], best_row[changed] = np.take_along_axis(far, order, 1), np.take_along_axis(who, order, 1)


def _vectors(df: DataFrame, vector: str) -> Column:
    """Single-precision vectors travel as they are; distances are of doubles in any case."""
    kind = dict(df.select(F.col(vector).alias("_v")).dtypes)["_v"]
    return F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("_v")


def _training(train: DataFrame, vector: str, train_id: str, label: str) -> DataFrame:
    return train.select(F.col(train_id).cast("long").alias("_id"), F.col(label).alias("_label"), _vectors(train, vector))


def _asked(queries: DataFrame, vector: str, query_id: str) -> DataFrame:
    return queries.select(F.col(query_id).cast("long").alias("_q"), _vectors(queries, vector))


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"{c} {kind}" for c, kind in df.dtypes), added])


def _in_blocks(rows: DataFrame, visits: DataFrame, k: int, exclude_self: bool, block_rows: int) -> DataFrame:
    """``_q, _id, _label, _d``: rows and queries with the same ``_cell`` meet, block by block on both sides.

    ``visits`` carry ``_limit``, the farthest a neighbour can be.  Where both sides have ``_codes``, a query only meets
    rows that share one with it.
    """
    label_type = dict(rows.dtypes)["_label"]
    codes_kept = ["_codes"] if "_codes" in rows.columns else []
    sizes = rows.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_tb"))
    loads = visits.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_qb"))
    sides = written(sizes.join(loads, "_cell"), "cells")  # one row per cell that has both

    def copied(df: DataFrame, own: str, mine: str, other: str, mine_name: str, other_name: str) -> DataFrame:
        """Rows in one block of their own side, copied to every block of the other."""
        return (
            df.join(sides, "_cell")
            .withColumn(mine_name, F.pmod(F.xxhash64(own), F.col(mine)).cast("int"))
            .withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_tb", "_qb")
        )

    def meet(rows_block: pd.DataFrame, query_block: pd.DataFrame) -> pd.DataFrame:
        if not len(rows_block) or not len(query_block):
            return pd.DataFrame({"_q": [], "_id": [], "_label": [], "_d": []})
        ids, own = rows_block["_id"].to_numpy(), query_block["_q"].to_numpy()
        codes = [np.stack(side["_codes"]) for side in (rows_block, query_block)] if codes_kept else []
        query, row, far = block_neighbours(
            _matrix(rows_block["_v"]), ids, _matrix(query_block["_v"]), own if exclude_self else None,
            query_block["_limit"].to_numpy(), k, *codes,
        )
        return pd.DataFrame({"_q": own[query], "_id": ids[row], "_label": rows_block["_label"].to_numpy()[row], "_d": far})

    left = copied(rows.select("_id", "_label", "_v", "_cell", *codes_kept), "_id", "_tb", "_qb", "_t", "_u")
    right = copied(visits.select("_q", "_v", "_cell", "_limit", *codes_kept), "_q", "_qb", "_tb", "_u", "_t")
    return (
        left.groupBy("_cell", "_t", "_u")
        .cogroup(right.groupBy("_cell", "_t", "_u"))
        .applyInPandas(meet, f"_q long, _id long, _label {label_type}, _d double")
    )


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy("_d", "_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("_q").alias("query_id"), F.col("_id").alias("neighbour_id"), F.col("_label").alias("label"),
        F.col("_d").alias("distance"), "rank",
    )


class Cells:
    """Pivots with the ring of distances their rows lie in; what a query has to visit."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.low, self.high = np.full(len(points), np.inf), np.full(len(points), -np.inf)
        between = _distances(points, points)
        # a bisector between pivots that almost touch would be placed by rounding alone
        self.between = np.where(between > 0.05 * np.sqrt((points * points).sum(1).max()), between, np.inf)
        self.rows = np.zeros(len(points), np.int64)
        self.group = np.arange(len(points))

    def learn(self, placed: DataFrame, block_rows: int) -> None:
        """One row per pivot: the nearest and the farthest of its rows, and their number."""
        facts = [F.min("_far").alias("low"), F.max("_far").alias("high"), F.count(F.lit(1)).alias("rows")]
        for r in placed.groupBy("_pivot").agg(*facts).collect():
            self.low[r["_pivot"]], self.high[r["_pivot"]], self.rows[r["_pivot"]] = r["low"], r["high"], r["rows"]
        self._join(block_rows)

    def _join(self, block_rows: int) -> None:
        """Groups of neighbouring cells: halved by rows along the widest dimension until they fit a block or are one cell."""
        open_, groups = [np.arange(len(self.points))], 0
        while open_:
            cells = open_.pop()
            if len(cells) == 1 or self.rows[cells].sum() <= block_rows:
                self.group[cells], groups = groups, groups + 1
                continue
            inside = self.points[cells]
            order = cells[np.argsort(inside[:, np.argmax(inside.max(0) - inside.min(0))], kind="stable")]
            filled = np.cumsum(self.rows[order])
            cut = min(max(int(np.searchsorted(filled, filled[-1] / 2)) + 1, 1), len(cells) - 1)
            open_ += [order[:cut], order[cut:]]
        self.member = np.zeros((len(self.points), groups), np.float32)
        self.member[np.arange(len(self.points)), self.group] = 1.0

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all pivots, the nearest pivot that has rows, and the distance to it."""
        d = _distances(v, self.points)
        own = np.where(np.isfinite(self.low)[None, :], d, np.inf).argmin(1)
        return d, own, d[np.arange(len(d)), own]

    def in_reach(self, v: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which groups other than the own one have a cell that can hold a row within the limit."""
        d, own, nearest_d = self.place(v)
        margin = _slack(v, self.points)[:, None] * 4
        ring = np.maximum(d - self.high[None, :], self.low[None, :] - d)
        side = (d**2 - nearest_d[:, None] ** 2) / (2 * self.between[own])  # a cell lies on its pivot's side of the bisector
        reach = (np.maximum(ring, side) <= limit[:, None] + margin) & np.isfinite(self.low)[None, :]
        groups = reach.astype(np.float32) @ self.member > 0
        groups[np.arange(len(d)), self.group[own]] = False
        return groups


def cells_of(rows: DataFrame, pivots: int | None, block_rows: int) -> tuple[Cells, DataFrame, int]:
    """The cells, the rows with the group of their cell as ``_cell``, written once, and the rows of a block."""
    total = rows.count()
    if total == 0:
        raise ValueError("the training table is empty")
    wanted = min(MOST_PIVOTS, pivots or max(1, int(math.sqrt(total)) // 2))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(wanted).select("_v").collect()
    cells = Cells(np.unique(np.array([r["_v"] for r in chosen], dtype=np.float64), axis=0))
    points = cells.points

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = _distances(_matrix(batch["_v"]), points)
                cell = d.argmin(1)
                yield batch.assign(_pivot=cell.astype("int32"), _far=d[np.arange(len(d)), cell])

    placed = written(rows.mapInPandas(to_cells, _schema(rows, "_pivot int, _far double")), "placed")
    block = min(block_rows, max(LEAST_BLOCK, -(-total // FEWEST_GROUPS)))  # enough groups for all cores of small tables too
    cells.learn(placed, block)
    groups = rows.sparkSession.createDataFrame(list(enumerate(cells.group.tolist())), "_pivot int, _cell int")
    return cells, placed.join(F.broadcast(groups), "_pivot").drop("_pivot", "_far"), block


def nearest(
    train: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "features",
    train_id: str = "id",
    query_id: str = "id",
    label: str = "label",
    exclude_self: bool = False,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    count_visits: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """``query_id, neighbour_id, label, distance, rank`` of the k nearest training rows.

    ``exclude_self`` leaves out the training row with the query's own id.
    Ids are whole numbers, unique on either side; vectors are arrays of equal length without nulls.
    ``count_visits`` is called with the groups of cells each query visits in the second pass.
    """
    rows, asked = _training(train, vector, train_id, label), _asked(queries, vector, query_id)
    return _in_two_passes(rows, asked, k, exclude_self, pivots, block_rows, count_visits)


def _in_two_passes(
    rows: DataFrame,
    asked: DataFrame,
    k: int,
    exclude_self: bool,
    pivots: int | None,
    block_rows: int,
    count_visits: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    cells, placed, block = cells_of(rows, pivots, block_rows)

    def to_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = cells.group[cells.place(_matrix(batch["_v"]))[1]]
                yield batch.assign(_cell=own.astype("int32"), _limit=np.inf)

    def to_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                reach = cells.in_reach(_matrix(batch["_v"]), batch["_limit"].to_numpy())
                yield batch.assign(_cells=[np.flatnonzero(r).astype("int32") for r in reach])

    home = written(asked.mapInPandas(to_own, _schema(asked, "_cell int, _limit double")), "queries")
    first = written(_in_blocks(placed, home, k, exclude_self, block), "near")
    kept = _best(first, k).groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_worst"))
    known = F.when(F.col("_n") >= k, F.col("_worst")).otherwise(float("inf"))
    limited = home.select(*asked.columns).join(kept, "_q", "left")
    limited = limited.select(*asked.columns, F.coalesce(known, F.lit(float("inf"))).alias("_limit"))
    # a query is written once, with the list of what it visits, and only copied on the way there
    reached = written(limited.mapInPandas(to_others, _schema(limited, "_cells array<int>")), "visits")
    visits = reached.select(*limited.columns, F.explode("_cells").alias("_cell"))
    if count_visits:
        count_visits(visits)
    return _best(first.unionByName(_in_blocks(placed, visits, k, exclude_self, block)), k)


def nearest_by_projection(
    train: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "features",
    train_id: str = "id",
    query_id: str = "id",
    label: str = "label",
    exclude_self: bool = False,
    tables: int = 8,
    bucket_length: float | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Approximate form of ``nearest``: rows that share a bucket of a random projection in one of ``tables``.

    ``bucket_length`` is the width of a bucket, by default half the spread of the vectors; wider buckets and more tables find
    more.  A query may get fewer than ``k`` rows.
    """
    rows, asked = _training(train, vector, train_id, label), _asked(queries, vector, query_id)
    if bucket_length is None:
        spread = rows.select(F.posexplode("_v")).groupBy("pos").agg(F.var_pop("col").alias("v")).agg(F.sum("v")).first()[0]
        bucket_length = max(1e-9, math.sqrt(spread or 0.0) / 2)
    hashing = BucketedRandomProjectionLSH(
        inputCol="_vector", outputCol="_hashes", bucketLength=float(bucket_length), numHashTables=tables, seed=seed
    )
    as_vector = array_to_vector(F.col("_v").cast("array<double>"))
    model = hashing.fit(rows.select(as_vector.alias("_vector")))

    def coded(df: DataFrame) -> DataFrame:
        hashed = model.transform(df.withColumn("_vector", as_vector))
        codes = F.transform("_hashes", lambda h: vector_to_array(h)[0].cast("long"))
        return hashed.select(*df.columns, codes.alias("_codes"))

    def bucketed(df: DataFrame) -> DataFrame:
        cell: Column = F.concat_ws(":", F.col("_table"), F.col("_code"))
        placed = df.select("*", F.posexplode("_codes").alias("_table", "_code"))
        return placed.withColumn("_cell", cell).drop("_table", "_code", "_codes")

    rows, asked = written(coded(rows), "coded"), written(coded(asked), "asked")
    placed, visits = bucketed(rows), bucketed(asked).withColumn("_limit", F.lit(float("inf")))
    loads = (df.groupBy("_cell").agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in ((placed, "_n"), (visits, "_m")))
    held = next(loads).join(next(loads), "_cell").agg(F.sum(F.col("_n") * F.col("_m"))).first()[0]
    if (held or 0.0) >= float(rows.count()) * asked.count() > 0:
        # the buckets hold pairs several times over: each pair once, if any table has both in one bucket
        near = _in_two_passes(rows, asked, k, exclude_self, None, block_rows)
        found = near.select(
            F.col("query_id").alias("_q"), F.col("neighbour_id").alias("_id"), F.col("label").alias("_label"), F.col("distance").alias("_d")
        )
    else:
        found = _in_blocks(placed, visits, k, exclude_self, block_rows)
    return _best(found.groupBy("_q", "_id").agg(F.any_value("_label").alias("_label"), F.min("_d").alias("_d")), k)


def vote(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """The winning label per query, the smallest one on a tie.

    With ``distance`` weights a neighbour counts 1/distance, and neighbours at
    distance 0 outvote all others.
    """
    if weights == "uniform":
        weight = F.lit(1.0)
    elif weights == "distance":
        touching = F.min("distance").over(Window.partitionBy("query_id")) == 0
        weight = F.when(touching, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
    else:
        raise ValueError(f"unknown weights {weights!r}")
    ballots = neighbours.withColumn("_w", weight).groupBy("query_id", "label").agg(F.sum("_w").alias("_w"))
    best = Window.partitionBy("query_id").orderBy(F.desc("_w"), "label")
    return (
        ballots.withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") == 1)
        .select("query_id", F.col("label").alias("prediction"))
    )
