"""Run aggregates over a few columns each instead of one very wide aggregate.

A union of branches with four columns each reads every column's bytes once,
keeps the generated code of a branch small enough to be compiled (with eight
columns the moments already run many times slower), and lets Spark run the
branches at the same time. Every branch returns a bounded number of rows.
Branches are written as SQL expressions: building many of them from single
``Column`` calls would cost more driver time than planning them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRANCHES_PER_JOB = 48
COLUMNS_PER_BRANCH = 4


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def col(name: str):
    """A column reference that is safe for names with dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float) -> str:
    """A SQL double literal with the value's full precision."""
    return f"{float(value)!r}D" if math.isfinite(value) else f"double('{float(value)!r}')"


def sql_usable(dtype: T.DataType, name: str = "value") -> str:
    """``value`` as double with NaN as missing, as SQL text."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN NOT isnan({name}) THEN CAST({name} AS DOUBLE) END"
    return f"CAST({name} AS DOUBLE)"


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def per_column(
    df: DataFrame, columns: Sequence[str], build: Callable[[DataFrame, str], DataFrame], also: Mapping[str, str] | None = None
) -> DataFrame:
    """Union of ``build(one-column frame named value, column name)``; ``also`` adds columns, by their new names."""
    more = [col(c).alias(k) for k, c in (also or {}).items()]
    return union_all([build(df.select(col(c).alias("value"), *more), c) for c in columns])


def collect_per_column(
    df: DataFrame, columns: Sequence[str], build: Callable[[DataFrame, str], DataFrame], also: Mapping[str, str] | None = None
) -> list[Row]:
    """Collect :func:`per_column`; the result has few rows per column.

    Very wide tables are worked off in several jobs to keep each plan small.
    """
    rows: list[Row] = []
    for start in range(0, len(columns), BRANCHES_PER_JOB):
        rows += per_column(df, columns[start : start + BRANCHES_PER_JOB], build, also).collect()
    return rows


def aggregate_columns(
    df: DataFrame, columns: Sequence[str], measures: Callable[[str, str, str], dict[str, str]],
    also: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per column: ``column`` and the given aggregates.

    ``measures(column, raw, number)`` returns SQL aggregates by result name;
    ``raw`` and ``number`` name the column as it is and as usable number.
    ``also`` names further columns that the aggregates need, by the name they use.
    """
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_BRANCH):
        group = list(enumerate(columns[start : start + COLUMNS_PER_BRANCH]))
        numbers = [
            f"{sql_usable(dtype_of(df, c), f'raw{i}')} AS num{i}" for i, c in group
            if isinstance(dtype_of(df, c), T.NumericType)
        ]
        structs = [
            f"named_struct('column', {sql_text(c)}, "
            + ", ".join(f"'{k}', {e}" for k, e in measures(c, f"raw{i}", f"num{i}").items()) + f") AS row{i}"
            for i, c in group
        ]
        shown = [col(c).alias(f"raw{i}") for i, c in group] + [col(c).alias(k) for k, c in (also or {}).items()]
        rows = df.select(*shown).selectExpr("*", *numbers).selectExpr(*structs)
        parts.append(rows.selectExpr(f"inline(array({', '.join(f'row{i}' for i, _ in group)}))"))
    return union_all(parts)


def collect_aggregates(
    df: DataFrame, columns: Sequence[str], measures: Callable[[str, str, str], dict[str, str]],
    also: Mapping[str, str] | None = None,
) -> list[Row]:
    """Collect :func:`aggregate_columns`, in several jobs for very wide tables."""
    step = BRANCHES_PER_JOB * COLUMNS_PER_BRANCH
    rows: list[Row] = []
    for start in range(0, len(columns), step):
        rows += aggregate_columns(df, columns[start : start + step], measures, also).collect()
    return rows


def together(spark: SparkSession, *tasks: Callable[[], Any]) -> list[Any]:
    """Run independent Spark jobs at the same time; results in the given order.

    Short jobs leave most of a cluster idle, so passes that do not need each
    other share it. Job groups and pools of the calling thread are kept.
    """
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [r.result() for r in running]


def small_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A local relation for a result whose size depends on the columns only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = schema.fieldNames()
    table = pa.Table.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def computed_once(df: DataFrame) -> DataFrame:
    """Keep the columns of ``df`` from being merged into later expressions.

    Without it the optimizer may push a filter on a derived column down by
    repeating everything the column is made of.
    """
    return df.select(F.inline(F.array(F.struct(*[col(c) for c in df.columns]))))


def pinned(df: DataFrame) -> DataFrame:
    """Collect a small result once and return it as a local relation.

    For findings, insights and the like, whose row count is bounded by the
    number of columns and not by the data.
    """
    return small_frame(df.sparkSession, [r.asDict(recursive=True) for r in df.collect()], df.schema)
