"""Exact quantiles of whole columns: a sketch says where to look, counting says what is there.

The first scan takes approximate quantiles around every wanted one.  They bracket it, and the next scan counts
exactly how many rows lie below and inside each bracket.  A bracket that holds too many rows is narrowed by
approximate quantiles of its own rows; if one missed its rank, the search goes on in the part beside it.  Every count leaves
strictly less to search.  At last the few values inside the brackets are grouped, and the one at the wanted rank is read off.  Nothing is sorted or gathered; a table needs
three scans, and one more for every factor of about a hundred in rows beyond some hundred million.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Accuracy of the sketch: its rank error is at most one part in so many.
ACCURACY = 10_000
#: Cuts of a bracket that is narrowed, and the rows a bracket may hold to be grouped.
CUTS, GROUP_ROWS = 256, 200_000
#: How far from a wanted quantile the brackets of the first scan may end.
REACH = (2 / ACCURACY, 20 / ACCURACY, 0.02, 0.2)
ENDLESS = float("inf")


def number(name: str) -> Column:
    """The column as double with NaN read as missing."""
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Search:
    """Where the value at a ``rank`` of a column lies: counted bounds, and the part of them to count next."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    probe: tuple[float, float]
    crowded: bool = False
    counted: bool = False

    @property
    def done(self) -> bool:
        return self.low == self.high or (self.counted and self.inside <= GROUP_ROWS)

    def learn(self, below: int, inside: int, cuts: Sequence[float]) -> None:
        """Go on inside the part that was counted, or in what lies left or right of it; each is strictly less."""
        self.counted, self.crowded = True, False
        start, end = self.probe
        if self.rank < below:
            self.high, self.inside, cuts = math.nextafter(start, -ENDLESS), below - self.below, ()
        elif self.rank >= below + inside:
            self.inside = self.below + self.inside - below - inside
            self.low, self.below, cuts = math.nextafter(end, ENDLESS), below + inside, ()
        else:
            self.low, self.high, self.below, self.inside = start, end, below, inside
        if not cuts:
            self.probe, self.crowded = (self.low, self.high), True
            return
        at = (self.rank - self.below) / self.inside * (len(cuts) + 1) - 1  # its place among the cuts
        left, right = math.floor(at) - 2, math.ceil(at) + 2
        self.probe = cuts[left] if left >= 0 else self.low, cuts[right] if right < len(cuts) else self.high
        self.crowded = self.inside * (right - left) > GROUP_ROWS * (len(cuts) + 1)
        if self.probe == (self.low, self.high):  # equal values fill the cuts: look at one of them alone
            alone = cuts[min(max(0, round(at)), len(cuts) - 1)]
            self.probe = alone, alone


def _within(column: str, low: float, high: float) -> Column:
    value = number(column)
    return (value >= F.lit(low)) & (value <= F.lit(high))


def _sketched(df: DataFrame, columns: list[str], probs: Sequence[float]) -> dict[str, tuple[int, dict[float, float]]]:
    """Rows with a value, and approximate quantiles at and around the wanted ones, per column."""
    near = sorted({min(1.0, max(0.0, p + sign * reach)) for p in probs for reach in (0.0, *REACH) for sign in (-1, 1)} | {0.0, 1.0})
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [
            F.count(number(c)).alias(f"n{i}"),
            F.percentile_approx(number(c), [float(p) for p in near], ACCURACY).alias(f"q{i}"),
            F.min(number(c)).alias(f"low{i}"),
            F.max(number(c)).alias(f"high{i}"),
        ]
    row = df.agg(*aggregates).first()
    found = {}
    for i, c in enumerate(columns):
        at = dict(zip(near, row[f"q{i}"] or [], strict=False)) | {0.0: row[f"low{i}"], 1.0: row[f"high{i}"]}
        found[c] = (row[f"n{i}"], at)
    return found


def _searches(column: str, p: float, rows: int, at: dict[float, float]) -> list[_Search]:
    """The ranks around ``p``, first looked for where the sketch's error and one rank to either side leave them."""
    place = p * (rows - 1)
    reach = next((r for r in REACH if r >= 2 / ACCURACY + 1.5 / rows), 1.0)
    probe = (at[max(0.0, p - reach)], at[min(1.0, p + reach)]) if reach < 1 else (at[0.0], at[1.0])
    ranks = sorted({math.floor(place), math.ceil(place)})
    return [_Search(column, r, at[0.0], at[1.0], 0, rows, probe, 4 * reach * rows > GROUP_ROWS) for r in ranks]


def _count(df: DataFrame, searches: list[_Search]) -> None:
    """One scan: rows below and inside each part, and cuts of the rows inside where they may be many."""
    cuts = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    parts: dict[tuple, list[_Search]] = {}
    for s in searches:
        parts.setdefault((s.column, *s.probe), []).append(s)
    aggregates = []
    for i, ((column, low, high), members) in enumerate(parts.items()):
        inside = _within(column, low, high)
        aggregates += [F.count_if(number(column) < F.lit(low)).alias(f"below{i}"), F.count_if(inside).alias(f"inside{i}")]
        if any(s.crowded for s in members):
            aggregates.append(F.percentile_approx(F.when(inside, number(column)), cuts, ACCURACY).alias(f"cuts{i}"))
    row = df.agg(*aggregates).first().asDict()
    for i, members in enumerate(parts.values()):
        for s in members:
            s.learn(row[f"below{i}"], row[f"inside{i}"], row.get(f"cuts{i}") or ())


def _read(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    """One scan: the values inside the bounds are grouped, and those at the ranks come back."""
    if not searches:
        return {}
    parts = list(dict.fromkeys((s.column, s.low, s.high, s.below) for s in searches))
    inside = [
        F.when(_within(c, low, high), F.struct(F.lit(i).alias("part"), number(c).alias("value")))
        for i, (c, low, high, _) in enumerate(parts)
    ]
    some = F.lit(False)
    for c, low, high, _ in parts:
        some = some | _within(c, low, high)
    values = df.filter(some).select(F.explode(F.array_compact(F.array(*inside))).alias("h"))
    counts = values.groupBy("h.part", "h.value").agg(F.count(F.lit(1)).alias("n"))
    # at most GROUP_ROWS values per part
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    wanted, ranks = F.lit(False), {}
    for s in searches:
        part = parts.index((s.column, s.low, s.high, s.below))
        at = F.lit(s.rank - s.below)
        wanted = wanted | ((F.col("part") == part) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))
        ranks.setdefault(part, []).append(s)
    found = {}
    for r in upto.filter(wanted).collect():
        for s in ranks[r["part"]]:
            if r["upto"] - r["n"] <= s.rank - s.below < r["upto"]:
                found[s.column, s.rank] = r["value"]
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; ``None`` for an all-missing column."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    sketched = _sketched(df, columns, probs)
    searches = [s for c, (rows, at) in sketched.items() if rows for p in dict.fromkeys(probs) for s in _searches(c, p, rows, at)]
    while still := [s for s in searches if not s.done]:
        _count(df, still)
    found = {(s.column, s.rank): s.low for s in searches if s.low == s.high}
    found |= _read(df, [s for s in searches if s.low != s.high])
    result: dict[str, list[float | None]] = {}
    for c, (rows, _) in sketched.items():
        result[c] = [None] * len(probs)
        if rows:
            places = [p * (rows - 1) for p in probs]
            ends = [(at, found[c, math.floor(at)], found[c, math.ceil(at)]) for at in places]
            result[c] = [low if low == high else low + (high - low) * (at - math.floor(at)) for at, low, high in ends]
    return result
