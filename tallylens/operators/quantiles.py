"""Exact order statistics without sorting or shuffling the column.

A sketch proposes pivots around the wanted rank; one counting scan then says
exactly in which cell between the pivots the rank lies. Cells shrink by a large
factor per round, and values equal to a pivot are settled at once, so a single
very frequent value does no harm. Only a cell that is known to be small is
sorted. The counts, not the sketch, decide: a poor pivot costs a round, never a
wrong answer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallylens.operators.columnwise import (
    collect_aggregates, collect_per_column, dtype_of, sql_number, sql_text, sql_usable,
)

SMALL_CELL = 1_000_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Search:
    """Where the value of one rank can still be: strictly between low and high."""

    column: str
    rank: int
    size: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    answer: float | None = None

    @property
    def cell(self) -> tuple:
        return (self.low, self.high)

    def inside(self, value: str) -> str:
        """SQL for the value where it lies in the cell, else null."""
        bounds = [f"{value} > {sql_number(self.low)}"] if self.low is not None else []
        bounds += [f"{value} < {sql_number(self.high)}"] if self.high is not None else []
        return f"CASE WHEN {' AND '.join(bounds)} THEN {value} END" if bounds else value


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], counts: Mapping[str, int], small_cell: int = SMALL_CELL
) -> dict[tuple[str, int], float]:
    """The value at each zero-based rank of the sorted non-missing column."""
    searches = [
        _Search(c, r, counts[c]) for c, wanted in ranks.items() for r in sorted(set(wanted)) if 0 <= r < counts[c]
    ]
    while True:
        pending = [s for s in searches if s.answer is None]
        if not pending:
            return {(s.column, s.rank): s.answer for s in searches}
        small = [s for s in pending if s.size <= small_cell]
        if small:
            _pick_from_small_cells(df, small)
        large = [s for s in pending if s.size > small_cell]
        if large:
            _narrow(df, large, _propose_pivots(df, large))


def _by_column(searches: Sequence[_Search]) -> dict[str, list[_Search]]:
    grouped: dict[str, list[_Search]] = {}
    for s in searches:
        grouped.setdefault(s.column, []).append(s)
    return grouped


def _pick_from_small_cells(df: DataFrame, searches: Sequence[_Search]) -> None:
    """Sort cells of at most ``small_cell`` values and read the wanted positions."""
    groups = _by_column(searches)

    def measures(name: str, raw: str, number: str) -> dict[str, str]:
        cells: dict[tuple, list[_Search]] = {}
        for s in groups[name]:
            cells.setdefault(s.cell, []).append(s)
        # the one-element array binds the sorted values, so they are sorted once
        picked = [
            f"element_at(transform(array(sort_array(collect_list({ranks[0].inside(number)}))), cell -> array("
            + ", ".join(f"element_at(cell, {s.rank - s.below + 1})" for s in ranks) + ")), 1)"
            for ranks in cells.values()]
        order = [s for ranks in cells.values() for s in ranks]
        groups[name] = order
        return {"found": f"flatten(array({', '.join(picked)}))"}

    for row in collect_aggregates(df, list(groups), measures):
        for search, value in zip(groups[row["column"]], row["found"]):
            search.answer = value


def _propose_pivots(df: DataFrame, searches: Sequence[_Search]) -> dict[str, list[float]]:
    """Three values around each rank, from one sketch per cell."""
    groups = _by_column(searches)
    margin = 2.0 / SKETCH_ACCURACY

    def fractions(ranks: list[_Search]) -> list[float]:
        at = [(s.rank - s.below + 0.5) / s.size for s in ranks]
        return sorted({min(1.0, max(0.0, f + d)) for f in at for d in (-margin, 0.0, margin)})

    def measures(name: str, raw: str, number: str) -> dict[str, str]:
        cells: dict[tuple, list[_Search]] = {}
        for s in groups[name]:
            cells.setdefault(s.cell, []).append(s)
        sketches = ", ".join(
            f"percentile_approx({ranks[0].inside(number)}, array({', '.join(map(sql_number, fractions(ranks)))}), "
            f"{SKETCH_ACCURACY})" for ranks in cells.values())
        return {"pivots": f"array_sort(array_distinct(flatten(array({sketches}))))"}

    return {r["column"]: r["pivots"] for r in collect_aggregates(df, list(groups), measures)}


def _narrow(df: DataFrame, searches: Sequence[_Search], pivots: Mapping[str, list[float]]) -> None:
    """Count the rows in the cells between the pivots and move each rank to its cell.

    Cell ``2i`` lies below pivot ``i`` (and above the one before), cell
    ``2i + 1`` is the pivot itself, so there are few groups to count.
    """
    groups = _by_column(searches)
    marks = {
        c: sorted({*pivots[c], *(e for s in ranks for e in s.cell if e is not None)}) for c, ranks in groups.items()
    }

    def build(one: DataFrame, name: str) -> DataFrame:
        cell = " + ".join(
            f"CAST(value >= {p} AS INT) + CAST(value > {p} AS INT)" for p in map(sql_number, marks[name]))
        return (
            one.selectExpr(f"{sql_usable(dtype_of(df, name))} AS value").where("value IS NOT NULL")
            .selectExpr(f"{cell} AS cell")
            .groupBy("cell").count().selectExpr(f"{sql_text(name)} AS column", "cell", "count"))

    counted: dict[str, dict[int, int]] = {c: {} for c in groups}
    for row in collect_per_column(df, list(groups), build):
        counted[row["column"]][row["cell"]] = row["count"]
    for name, ranks in groups.items():
        edges = [None, *marks[name], None]
        for s in ranks:
            start = 0
            for cell in range(2 * len(marks[name]) + 1):
                size = counted[name].get(cell, 0)
                if start <= s.rank < start + size:
                    break
                start += size
            if cell % 2:
                s.answer = marks[name][cell // 2]
            else:
                s.low, s.high = edges[cell // 2], edges[cell // 2 + 1]
                s.below, s.size = start, size


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], counts: Mapping[str, int],
    rule: str = "linear", small_cell: int = SMALL_CELL,
) -> dict[str, list[float | None]]:
    """Exact quantiles per column.

    ``rule="linear"`` interpolates between neighbours; ``rule="nearest"`` takes
    the value at the closest rank.
    """
    def place(n: int, p: float) -> float:
        return (n - 1) * p if rule == "linear" else math.floor((n - 1) * p + 0.5)

    ranks = {
        c: [r for p in probabilities for r in (math.floor(place(counts[c], p)), math.ceil(place(counts[c], p)))]
        for c in columns if counts[c] > 0
    }
    found = order_statistics(df, ranks, counts, small_cell)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if counts[c] == 0:
            out[c] = [None] * len(probabilities)
            continue
        out[c] = []
        for p in probabilities:
            at = place(counts[c], p)
            low, high = found[(c, math.floor(at))], found[(c, math.ceil(at))]
            out[c].append(low + (high - low) * (at - math.floor(at)))
    return out
