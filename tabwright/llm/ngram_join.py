"""Exact Jaccard join on word 5-gram sets with count-vector R-trees.

Method.  The shingles of a set are hashed into groups, a power of two of them so that a group
holds two to four; the group counts are a point, and halving the groups adds neighbours.  No two sets share more shingles than the sum of the
coordinate minima of their points, and no point in a box more than the minima with
the box's upper corner, so R-trees over the points discard pairs and whole
boxes; what survives is verified on the sets.

One tree over all documents cannot prune: in many dimensions the upper
corners of boxes of unrelated documents soon reach everything.  The points are therefore
partitioned first, without loss: sets that link share one of their first
n - ceil(3n/4) + 1 shingles in any fixed order.  The order here puts shingles that a
sample by hash shows to be frequent last (which ones affects speed only).  Each such
shingle is a bucket, and every bucket with two sets gets a tree.

* Equal sets are one class (128-bit signature and size) with the smallest id as its representative;
  classes, not copies, are joined.
* First every class is verified against the first few classes of each of its buckets; that ties groups of near copies
  together without their pairs.  Then only classes that are not tied yet are
  joined through the trees, inside blocks first, where spanning forests of the candidates are verified, so that a group costs
  links in proportion to its classes, then across blocks what carries different labels still.  Crowded buckets are cut into blocks, and pairs of blocks are spread over tasks.
* Sets are fetched only for classes with a candidate, chosen by a bitmap of fixed size.

Words are split at ASCII white space after lower-casing A-Z; with fewer than five words the whole
sequence is one shingle; null and empty texts have no set and link with nothing.  Rows
with one id count as one document; rows with a null id are documents without links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.batches import mix, slices, text_shingles
from tabwright.llm.components import components, stored
from tabwright.llm.frequent import head_of, least_count
from tabwright.llm.registry import llm_query

GROUP_BITS = 16
HEADS = 3
SAMPLE_OF, LEAST_FREQUENT, MOST_FREQUENT = 16, 3, 1 << 17
BITS = 1 << 25
BLOCK, LEAF, SMALL_RUN = 512, 16, 48
FORESTS = 4


# ---- sets ----------------------------------------------------------------------------------------


def set_members(texts: pa.Array, frequent: np.ndarray | None = None, counts: np.ndarray | None = None):
    """The distinct shingles of all texts, ordered by text, frequency and hash; their texts; set sizes."""
    values, per_text = text_shingles(texts)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        seen = np.where(frequent[at] == values, counts[at], 0)
        order = np.lexsort((values, seen, owner))
    else:
        order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, owner, np.bincount(owner, minlength=len(per_text))


def signatures(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over differently mixed hashes of each set."""
    out = []
    for salt in (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, mix(values ^ salt))
        out.append(total.view(np.int64))
    return out[0], out[1]


def groups_for(size: int, finer: int = 1) -> int:
    """A power of two of groups so that two to four shingles share one, or ``finer`` times as many groups."""
    return min(1 << GROUP_BITS, finer << max(6, int(size).bit_length() - 2))


def pack_points(values: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The coarse point of each set: its counts in one byte each if they fit, else in four, after a byte that tells."""
    tops = (values >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
    out = []
    for size, end in zip(n.tolist(), np.cumsum(n).tolist(), strict=True):
        groups = groups_for(size)
        counts = np.bincount(tops[end - size : end] >> (GROUP_BITS - groups.bit_length() + 1), minlength=groups)
        wide = counts.max() > 255
        out.append((b"\x04" if wide else b"\x01") + counts.astype("<u4" if wide else np.uint8).tobytes())
    return out


def fine_point(members: bytes) -> bytes:
    """The point of a sorted set among the most groups, as the sorted numbers of its shingles' groups."""
    return b"\x02" + (np.frombuffer(members, np.uint64) >> np.uint64(64 - GROUP_BITS)).astype("<u2").tobytes()


class Points:
    """Points of either form, read at any smaller number of groups: the highest bits choose a group."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed
        kind = np.array([p[0] for p in packed], np.int64)
        self.fine = kind == 2
        self.groups = np.where(self.fine, 1 << GROUP_BITS, (np.array([len(p) for p in packed], np.int64) - 1) // np.maximum(kind, 1))

    def at(self, groups: int, rows: np.ndarray) -> np.ndarray:
        """Group counts of the rows."""
        table = np.zeros((len(rows), groups), np.int32)
        for k, i in enumerate(rows):
            p = self.packed[i]
            if p[0] == 2:
                table[k] = np.bincount(np.frombuffer(p, "<u2", offset=1) >> (GROUP_BITS - groups.bit_length() + 1), minlength=groups)
            else:
                table[k] = np.frombuffer(p, np.uint8 if p[0] == 1 else "<u4", offset=1).reshape(groups, -1).sum(axis=1)
        return table if table.size and table.max() > 255 else table.astype(np.uint8)


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many classes of one text in ``SAMPLE_OF`` hold, with their counts, ``MOST_FREQUENT`` at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, owner, n = set_members(part.column("text"))
                s1, s2 = signatures(values, owner, len(n))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), lists], names=["s1", "s2", "shingles"])

    some = docs.select(F.col(text_col).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_OF)) == 0)
    sets = some.mapInArrow(work, "s1 long, s2 long, shingles array<long>").dropDuplicates(["s1", "s2"])
    counted = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    counted = stored(counted.filter(F.col("c") >= LEAST_FREQUENT), "frequent")
    table = head_of(counted, least_count(counted, MOST_FREQUENT))
    values = table["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], table["c"].to_numpy(np.int64)[order]


def describe_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One stored row per document: id, set size, signature, prefix shingles, point."""
    frequent, counts = _frequent(docs, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, owner, n = set_members(part.column("text"), frequent, counts)
                s1, s2 = signatures(values, owner, len(n))
                prefix = np.where(n > 0, n - (3 * n + 3) // 4 + 1, 0)
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                keys = values[place < np.repeat(prefix, n)].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                        pa.array(pack_points(values, n), pa.binary()),
                    ],
                    names=["id", "n", "s1", "s2", "prefix", "point"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(work, "id long, n long, s1 long, s2 long, prefix array<long>, point binary"), "sets")


# ---- buckets -------------------------------------------------------------------------------------


def _shared_buckets(keys: DataFrame) -> DataFrame:
    """Rows of the buckets that hold two classes or more, with their place and the first ``HEADS`` classes before them.

    Rows arrive sorted by (key, class); one row is held back between batches, and the heads of its bucket.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads, met = None, None, 0  # the last row, the heads of its bucket, its place
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "cls", "n")])
            if held is not None:
                rows = np.concatenate([held[:, None], rows], axis=1)
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            lengths = np.diff(np.append(starts, rows.shape[1]))
            first = np.repeat(starts, lengths)
            place = np.arange(rows.shape[1]) - first + np.where(first == 0, met, 0)
            # the first run may go on from the batch before
            own = np.concatenate([heads[:, :met], rows[1:, : lengths[0]]], axis=1)[:, :HEADS] if met else None
            yield from _with_heads(rows[:, :-1], place[:-1], first[:-1], np.append(same, False)[: rows.shape[1] - 1], own)
            last = first[-1]
            held, met = rows[:, -1], int(place[-1])
            tail = rows[1:, last : last + HEADS]
            heads = own if last == 0 and own is not None else tail
        if held is not None and met:
            yield from _with_heads(held[:, None], np.array([met]), np.array([0]), np.array([False]), heads)

    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartition(tasks, "key").sortWithinPartitions("key", "cls")
    return ordered.mapInArrow(work, "key long, cls long, n long, place long, heads array<long>, head_sizes array<long>")


def _with_heads(rows: np.ndarray, place: np.ndarray, first: np.ndarray, more: np.ndarray, own: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows that share their bucket; ``first`` is where a row's bucket begins, ``own`` are the heads of the first bucket."""
    at = np.flatnonzero((place > 0) | more)
    if not len(at):
        return
    many = np.minimum(place[at], HEADS)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(first[at], many)
    if own is None:
        values = rows[1:, start + turn]
    else:
        inside = rows[1:, np.minimum(start + turn, rows.shape[1] - 1)]
        values = np.where(start == 0, own[:, np.minimum(turn, own.shape[1] - 1)], inside)
    ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(x[at]) for x in (*rows, place)), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in values)],
        names=["key", "cls", "n", "place", "heads", "head_sizes"],
    )


# ---- R-trees -------------------------------------------------------------------------------------


class RTree:
    """A bulk-loaded tree over points: boxes halve along their widest coordinate down to small leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        self.points, self.sizes, self.rows = points, sizes, rows
        self.upper, self.least, self.most = points.max(axis=0), sizes.min(), sizes.max()
        self.parts: list[RTree] = []
        if len(rows) > LEAF:
            spread = np.append(self.upper.astype(np.int64) - points.min(axis=0), self.most - self.least)
            axis = int(spread.argmax())
            order = np.argsort(sizes if axis == points.shape[1] else points[:, axis], kind="stable")
            half = len(rows) // 2
            self.parts = [RTree(points[o], sizes[o], rows[o]) for o in (order[:half], order[half:])]


def overlap_allows(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A link needs a common part of three sevenths of both sizes together."""
    return 7 * overlap >= 3 * sizes


def tree_join(left: RTree, right: RTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the bounds leave over; of a tree with itself, each pair once at least."""
    if 4 * left.most < 3 * right.least or 4 * right.most < 3 * left.least:
        return
    if not overlap_allows(int(np.minimum(left.upper, right.upper).sum(dtype=np.int64)), int(left.least + right.least)):
        return
    if left.parts and (not right.parts or len(left.rows) >= len(right.rows)):
        if left is right:
            a, b = left.parts
            for x, y in ((a, a), (a, b), (b, b)):
                yield from tree_join(x, y)
        else:
            for part in left.parts:
                yield from tree_join(part, right)
    elif right.parts:
        for part in right.parts:
            yield from tree_join(left, part)
    else:
        common = np.minimum(left.points[:, None, :], right.points[None, :, :]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(overlap_allows(common, left.sizes[:, None] + right.sizes[None, :]))
        yield left.rows[i], right.rows[j]


def bounded(points: Points, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the points of two rows allow enough overlap, in coarse groups and, where both are known so, in fine ones."""
    ok = np.ones(len(i), bool)
    most = np.minimum(points.groups[i], points.groups[j])
    for finer in (1, 8):
        wanted = np.array([groups_for(n, finer) for n in np.maximum(sizes[i], sizes[j])], np.int64)
        level = np.minimum(wanted, most)
        asked = ok if finer == 1 else ok & points.fine[i] & points.fine[j]
        for groups in np.unique(level[asked]):
            at = np.flatnonzero(asked & (level == groups))
            step = max(1, (8 << 20) // int(groups))
            for k in range(0, len(at), step):
                few = at[k : k + step]
                rows, place = np.unique(np.concatenate([i[few], j[few]]), return_inverse=True)
                table = points.at(int(groups), rows)
                common = np.minimum(table[place[: len(few)]], table[place[len(few) :]]).sum(axis=1, dtype=np.int64)
                ok[few] = overlap_allows(common, sizes[i[few]] + sizes[j[few]])
    return ok


def run_pairs(rows: np.ndarray, side: np.ndarray, sizes: np.ndarray, points: Points) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Join the rows of one large run, or its two sides, by trees."""
    groups = int(min(groups_for(sizes[rows].max()), points.groups[rows].min()))
    parts = [rows[side[rows] == s] for s in (0, 1)]
    if len(parts[0]) and len(parts[1]):
        yield from tree_join(*(RTree(points.at(groups, p), sizes[p], p) for p in parts))
    else:
        tree = RTree(points.at(groups, rows), sizes[rows], rows)
        yield from tree_join(tree, tree)


def bucket_pairs(run: np.ndarray, side: np.ndarray, cls: np.ndarray, label: np.ndarray, sizes: np.ndarray, points: Points):
    """Candidate pairs inside runs of equal ``run``: across sides where a run has two, of different labels.

    Classes and labels of the pairs as rows ``a, b, label of a, label of b``, sorted, each pair once.
    """
    if not len(run):
        return np.zeros((4, 0), np.int64)
    starts = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]])
    lengths = np.diff(starts)
    found = []
    for length in np.unique(lengths[lengths <= SMALL_RUN]):  # a small run is a single leaf: all of one length at once
        i, j = np.triu_indices(length, 1)
        base = starts[:-1][lengths == length][:, None]
        found.append(((base + i).ravel(), (base + j).ravel()))
    for k in np.flatnonzero(lengths > SMALL_RUN):
        found += list(run_pairs(np.arange(starts[k], starts[k + 1]), side, sizes, points))
    two_sided = np.repeat(np.minimum.reduceat(side, starts[:-1]) != np.maximum.reduceat(side, starts[:-1]), lengths)
    pairs = [np.zeros((4, 0), np.int64)]
    for i, j in found:
        keep = (label[i] != label[j]) & (cls[i] != cls[j]) & ((side[i] != side[j]) | ~two_sided[i])
        keep &= 4 * np.minimum(sizes[i], sizes[j]) >= 3 * np.maximum(sizes[i], sizes[j])
        i, j = i[keep], j[keep]
        i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
        # a pair meets in many buckets: bound it once
        _, first = np.unique(np.stack([cls[i], cls[j]]), axis=1, return_index=True)
        i, j = i[first], j[first]
        ok = bounded(points, sizes, i, j)
        pairs.append(np.stack([cls[i[ok]], cls[j[ok]], label[i[ok]], label[j[ok]]]))
    return np.unique(np.concatenate(pairs, axis=1), axis=1)


def spanning(left: np.ndarray, right: np.ndarray, forests: int) -> np.ndarray:
    """Which of the pairs ``forests`` spanning forests need, one after the other; at most nodes - 1 pairs each.

    In each round of a forest every tree takes its first pair that leaves it.
    """
    kept = np.zeros(len(left), bool)
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    for _ in range(forests):
        root = np.arange(len(nodes))
        rest = np.flatnonzero(~kept)
        while len(rest):
            rest = rest[root[a[rest]] != root[b[rest]]]
            if not len(rest):
                break
            trees = np.concatenate([root[a[rest]], root[b[rest]]])
            _, first = np.unique(trees, return_index=True)
            taken = np.unique(rest[first % len(rest)])
            for k in taken:  # pointers go to the smaller root, so that no ring can close
                x, y = a[k], b[k]
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    kept[k] = True
            while (root != root[root]).any():
                root = root[root]
    return kept


def _bounded_pairs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs whose points allow enough overlap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = Points(batch.column("p").to_pylist() + batch.column("q").to_pylist())
            sizes = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")])
            ok = bounded(both, sizes, np.arange(n), np.arange(n, 2 * n))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = points.select(F.col("cls").alias("a"), "n", F.col("point").alias("p"))
    right = points.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("point").alias("q"))
    joined = pairs.join(left, "a").join(right, "b").filter("4 * least(n, m) >= 3 * greatest(n, m)")
    return joined.select("a", "b", "n", "p", "m", "q").mapInArrow(work, "a long, b long").distinct()


def _fine_points(sets: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [fine_point(m) for m in batch.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(points, pa.binary())], names=["cls", "point"])

    return sets.select("id", "members").mapInArrow(work, "cls long, point binary")


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that hold two labels or more, the heads apart, with the number of blocks of their bucket."""
    labelled = shared.filter(F.col("place") >= HEADS).select("key", "cls", "n").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    labelled = stored(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"))
    open_keys = open_keys.filter("lo <> hi").select("key", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    return labelled.join(stored(open_keys, "open"), "key")


def _loose_pairs(rows: DataFrame, points: DataFrame, fine: DataFrame | None, across: bool, forests: int | None) -> DataFrame:
    """Candidates among classes of one bucket that carry different labels: ``a, b``.

    Small buckets are a leaf each and use the coarse points.  Crowded ones are cut into blocks, joined by trees over the
    ``fine`` points, each block with itself or, ``across``, all pairs of blocks.  With ``forests`` a task returns those of
    its candidates that so many spanning forests over their labels need, without it all.
    """
    dealt = rows.filter(F.col("m") <= SMALL_RUN).join(points, ["cls", "n"]).select(
        "key", F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.lit(0).alias("side"), "cls", "label", "n", "point"
    )
    if fine is not None:
        block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        pairs = rows.filter(F.col("m") > SMALL_RUN).join(fine, "cls").withColumn("block", block)
        others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across else F.col("block")
        pairs = pairs.withColumn("other", others)
        dealt = dealt.unionByName(pairs.select(
            "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
            F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "cls", "label", "n", "point",
        ))
    order = ["key", "b1", "b2"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        found = np.zeros((4, 0), np.int64)

        def pairs_of(table: pa.Table) -> np.ndarray:
            key, b1, b2, side, cls, label, n = (
                table.column(c).to_numpy() for c in ("key", "b1", "b2", "side", "cls", "label", "n")
            )
            change = np.ones(len(key), bool)
            change[1:] = (key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
            points = Points(table.column("point").to_pylist())
            return bucket_pairs(np.cumsum(change), side, cls, label, n.astype(np.int64), points)

        def needed(pairs: np.ndarray) -> np.ndarray:
            """Of what the task has found so far."""
            pairs = np.unique(np.concatenate([found, pairs], axis=1), axis=1)
            return pairs if forests is None else pairs[:, spanning(pairs[2], pairs[3], forests)]

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key, b1, b2 = (table.column(c).to_numpy() for c in order)
            last = np.flatnonzero((key == key[-1]) & (b1 == b1[-1]) & (b2 == b2[-1]))[0]
            if last:
                found = needed(pairs_of(table.slice(0, last)))
                if forests is None and found.shape[1] > 200_000:  # a pair may show in several buckets; the rest is made distinct later
                    yield out(found)
                    found = found[:, :0]
            held = table.slice(last)
        if held is not None:
            found = needed(pairs_of(held))
        yield out(found)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(tasks, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(work, "a long, b long")


# ---- verification --------------------------------------------------------------------------------


def _fetch_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored sorted sets of the documents whose id is in ``ids`` (repeats do no harm), and of a few more that the bitmap lets by."""

    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    marks = ids.select((slot(F.col("id")) + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket"))
    rows = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    bitmap = np.zeros(BITS // 8, np.uint8)
    for row in rows:  # at most BITS / 32768 rows
        at = (row["bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("slot").to_numpy()
            asked = pa.array((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)
            for part in slices(batch.filter(asked), "text"):
                values, owner, n = set_members(part.column("text"))
                ends = np.cumsum(n)
                sets = [values[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "members"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), slot(F.col(id_col).cast("long")).alias("slot")
    )
    return stored(rows.mapInArrow(work, "id long, members binary"), "members")


def linked(a: bytes, b: bytes) -> bool:
    """100 * intersection >= 75 * union."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int(np.count_nonzero(large[at] == small)) if len(small) else 0
    return common > 0 and 100 * common >= 75 * (len(x) + len(y) - common)


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The candidate pairs that link."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = _fetch_sets(docs, ids, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    return stored(both.select("a", "b", "x", "y").mapInArrow(work, "a long, b long"), "verified")


def class_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ties between classes that leave the components of all links: ``a``, ``b``.

    After the heads come two rounds.  The first looks inside the blocks of the buckets and verifies what ``FORESTS``
    spanning forests of its candidates need, so that a group of near copies is joined by links in proportion to its
    classes.  Classes that are joined carry one label from then on, and buckets with one label are done.  The
    second verifies all candidates that are left, across blocks too.  Labels found stand for the links they come from, so that
    components go on from them and do not begin anew.
    """
    keys = classes.select(F.explode("prefix").alias("key"), F.col("id").alias("cls"), "n")
    shared = stored(_shared_buckets(keys), "buckets")
    heads = F.explode(F.arrays_zip("heads", "head_sizes"))
    met = shared.select("cls", "n", heads.alias("h")).filter("h.heads <> cls AND 4 * least(n, h.head_sizes) >= 3 * greatest(n, h.head_sizes)")
    tested = stored(met.select(F.col("h.heads").alias("a"), F.col("cls").alias("b")).distinct(), "tested")
    points = classes.select(F.col("id").alias("cls"), "n", "point")
    links = _verified(docs, stored(_bounded_pairs(tested, points), "likely"), id_col, text_col)
    fine = None
    for across in (False, True):
        labels = stored(components(links).select(F.col("node").alias("cls"), F.col("component").alias("label")), "labels")
        links = labels.select(F.col("cls").alias("a"), F.col("label").alias("b"))
        rows = stored(_open_rows(shared, labels), "rows")
        if rows.isEmpty():
            break
        if not across:
            crowded = rows.filter(F.col("m") > SMALL_RUN).select(F.col("cls").alias("id"))
            if not crowded.isEmpty():  # the second round asks for some of these only
                fine = stored(_fine_points(_fetch_sets(docs, crowded, id_col, text_col)), "fine")
        found = _loose_pairs(rows, points, fine, across, None if across else FORESTS)
        fresh = stored(found.distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
        links = links.unionByName(_verified(docs, fresh, id_col, text_col))
        tested = tested.unionByName(fresh)
    return links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (the smallest id that links reach)."""
    sets = describe_sets(docs, id_col, text_col)
    full = F.col("n") > 0
    groups = sets.filter(full & F.col("id").isNotNull()).groupBy("s1", "s2", "n").agg(F.min("id").alias("id"))
    groups = stored(groups, "classes")
    # rows that repeat the representative do no harm: a class is never paired with itself
    classes = sets.join(groups, ["s1", "s2", "n", "id"]).select("id", "n", "prefix", "point")
    links = class_links(docs, classes, id_col, text_col)
    found = components(links)
    of_class = groups.join(found, groups["id"] == found["node"], "left").select(
        "s1", "s2", "n", F.coalesce("component", "id").alias("component")
    )
    narrow = sets.select("id", "n", "s1", "s2")
    return narrow.join(of_class, ["s1", "s2", "n"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest id, as do rows without an id."""
    found = ngram_components(docs, id_col, text_col)
    stay = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("stay_id")).distinct()
    stay = stay.select(F.col("stay_id"))
    kept = docs.join(stay, docs[id_col] == stay["stay_id"], "left_semi")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


@llm_query("op10_ngram_join", "documents")
def op10_ngram_join(docs: DataFrame, folder: str) -> DataFrame:
    return ngram_components(docs.select("doc_id", "text"))
