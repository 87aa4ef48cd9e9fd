"""Facts about numeric columns, distinct counts and the analytic-column filter."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylens.functions import names
from tallylens.functions.numbers import FLOAT_TYPES, INTEGER_TYPES, STATISTIC_TYPES
from tallylens.operators.columnwise import col, collect_aggregates, collect_per_column, dtype_of, sql_text

LONG_TEXT = 64


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that take part in statistics."""
    return [f.name for f in df.schema if isinstance(f.dataType, STATISTIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    """String columns."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value in every one of ``columns``."""
    return df.dropna(subset=list(columns))


def group_key(value: Column, dtype: T.DataType) -> Column:
    """A grouping key that keeps long texts out of the shuffle.

    Texts of ``LONG_TEXT`` bytes or more are represented by their SHA-256 hex
    digest; shorter ones stand for themselves, and the two cannot meet because
    of their lengths. Maps cannot be grouped and become sorted entry lists.
    """
    if isinstance(dtype, T.StringType):
        return F.when(F.octet_length(value) < LONG_TEXT, value).otherwise(F.sha2(value.cast("binary"), 256))
    if isinstance(dtype, T.BinaryType):
        return F.when(F.octet_length(value) < LONG_TEXT, F.hex(value)).otherwise(
            F.concat(F.lit("#"), F.sha2(value, 256)))
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(value))
    return value


@dataclass(frozen=True)
class NumberFacts:
    """Moments of one numeric column; NaN and null values are left out."""

    column: str
    rows: int
    nulls: int
    n: int
    mean: float | None
    std_pop: float | None
    skew: float | None
    kurtosis: float | None
    low: float | None
    high: float | None

    @property
    def std_samp(self) -> float | None:
        if self.n < 2 or self.std_pop is None:
            return None
        return self.std_pop * math.sqrt(self.n / (self.n - 1))

    @property
    def varies(self) -> bool:
        return self.std_pop is not None and math.isfinite(self.std_pop) and self.std_pop > 0 and self.low != self.high


def number_facts(df: DataFrame, columns: Sequence[str] | None = None, shape: bool = False) -> dict[str, NumberFacts]:
    """One scan of every numeric column; one row per column reaches the driver."""
    chosen = list(numeric_columns(df) if columns is None else columns)

    def measures(name: str, raw: str, number: str) -> dict[str, str]:
        return {
            "rows": "count(*)", "nulls": f"count_if({raw} IS NULL)", "n": f"count({number})", "mean": f"avg({number})",
            "std_pop": f"stddev_pop({number})",
            "skew": f"skewness({number})" if shape else "CAST(NULL AS DOUBLE)",
            "kurtosis": f"kurtosis({number})" if shape else "CAST(NULL AS DOUBLE)",
            "low": f"min({number})", "high": f"max({number})",
        }

    found = {r["column"]: NumberFacts(**r.asDict()) for r in collect_aggregates(df, chosen, measures)}
    return {c: found[c] for c in chosen}


def distinct_counts(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, int]:
    """Distinct values per column; null counts as one value.

    The exact form is a distributed group-by per column. ``exact=False`` uses
    a sketch of fixed size and no shuffle of values.
    """

    def build(one: DataFrame, name: str) -> DataFrame:
        keys = one.select(group_key(F.col("value"), dtype_of(df, name)).alias("value"))
        if exact:
            return keys.groupBy("value").agg(F.lit(1)).selectExpr(f"{sql_text(name)} AS column", "count(*) AS n")
        return keys.selectExpr(
            f"{sql_text(name)} AS column",
            "approx_count_distinct(value, 0.02D) + max(CAST(value IS NULL AS BIGINT)) AS n")

    return {r["column"]: r["n"] or 0 for r in collect_per_column(df, list(columns), build)}


def sketch_ceiling(distinct: int, registers: int = 512) -> float:
    """The largest estimate the default sketch can give for this many distinct values.

    With few values the sketch counts its empty registers, and ``d`` values
    leave at least ``registers - d`` of them empty. A larger estimate therefore
    proves that there are more than ``distinct`` values.
    """
    return registers * math.log(registers / (registers - distinct)) + 1


@dataclass(frozen=True)
class ValueSketch:
    """Null count and estimated distinct count of one column."""

    rows: int
    nulls: int
    distinct: int

    def may_have(self, at_most: int) -> bool:
        return self.distinct <= sketch_ceiling(at_most)


def value_sketches(df: DataFrame, columns: Sequence[str]) -> dict[str, ValueSketch]:
    """One scan per column, no shuffle of values."""
    rows = collect_aggregates(df, list(columns), lambda name, raw, number: {
        "rows": "count(*)", "nulls": f"count_if({raw} IS NULL)", "n": f"approx_count_distinct({raw})"})
    return {r["column"]: ValueSketch(r["rows"], r["nulls"], r["n"]) for r in rows}


def few_valued(df: DataFrame, columns: Sequence[str], at_most: int) -> list[str]:
    """Columns that may have ``at_most`` distinct values; the rest provably has more.

    A cheap pre-filter; the caller still counts exactly in the columns that remain.
    """
    return [c for c, sketch in value_sketches(df, columns).items() if sketch.may_have(at_most)]


@dataclass(frozen=True)
class ColumnChoice:
    column: str
    kept: bool
    reason: str


def choose_columns(
    df: DataFrame, exact: bool = True, max_string_uniques: int | None = None,
    facts: Mapping[str, NumberFacts] | None = None,
) -> list[ColumnChoice]:
    """Decide which columns are worth analysing (P2), with the reason.

    Integer columns that are nearly unique and float columns that look like
    coordinates are dropped. The value range settles most columns without a
    distinct count: an integer column has at most ``max - min + 1`` values.
    ``max_string_uniques`` adds the stricter limit on text columns and the stricter rule on names (P9).
    """
    by_name = {c: (names.not_analytic if max_string_uniques is None else names.not_useful)(c) for c in df.columns}
    open_columns = [c for c in df.columns if not by_name[c]]
    numbers = [c for c in open_columns if isinstance(dtype_of(df, c), INTEGER_TYPES + FLOAT_TYPES)]
    known = dict(facts or {})
    known.update(number_facts(df, [c for c in numbers if c not in known]))
    limit = {}
    for c in numbers:
        f = known[c]
        rows, low, high = max(f.rows, 1), f.low or 0.0, f.high or 0.0
        if isinstance(dtype_of(df, c), INTEGER_TYPES):
            if min(high - low + 1, f.n) + (f.n < f.rows) > 0.8 * rows:
                limit[c] = (0.8, rows, "nearly_unique_integer")
        elif -180 <= low and high <= 180:
            limit[c] = (0.9, rows, "coordinate_like")
    texts = [c for c in open_columns if isinstance(dtype_of(df, c), T.StringType)]
    if max_string_uniques is None:
        texts = []
    maybe_short = few_valued(df, texts, max_string_uniques)
    counted = distinct_counts(df, [*limit, *maybe_short], exact)

    choices = []
    for c in df.columns:
        reason = ""
        if by_name[c]:
            reason = "name"
        elif c in limit and counted[c] / limit[c][1] > limit[c][0]:
            reason = limit[c][2]
        elif c in texts and (c not in maybe_short or counted[c] > max_string_uniques):
            reason = "many_texts"
        choices.append(ColumnChoice(c, not reason, reason or "kept"))
    return choices


def analytic_frame(df: DataFrame, exact: bool = True) -> DataFrame:
    """``df`` without the columns that are not worth analysing."""
    return df.select(*[col(c.column) for c in choose_columns(df, exact) if c.kept])
