"""Duplicate counting and the quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens import schemas
from tallylens.functions.numbers import round_to
from tallylens.operators.columnwise import col
from tallylens.operators.facts import group_key
from tallylens.operators.multiset import Multiset


def _digests(df: DataFrame) -> Multiset:
    """The distinct rows of a table with long texts as digests.

    Repeats merge on the map side, so a row that makes up a third of the table
    does not load a single task. Map columns are compared as entry lists.
    """
    keys = [group_key(col(f.name), f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema)]
    grouped = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("copies"))
    return Multiset(grouped, "copies")


def duplicates_of(counted: Multiset) -> DataFrame:
    """Rows, distinct rows and surplus copies of a multiset (A12), without an exchange of rows."""
    rows = F.coalesce(F.sum(counted.weight), F.lit(0))
    return counted.rows.agg(
        rows.alias("total_rows"), F.count("*").alias("distinct_rows"), (rows - F.count("*")).alias("duplicate_rows"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies (A12); nulls are equal to each other."""
    return duplicates_of(_digests(df))


def quality_report(
    df: DataFrame, null_threshold: float = 0.30, duplicate_threshold_pct: float = 0.05
) -> DataFrame:
    """Score and verdict on a table (A13), from a single grouped scan."""
    return quality_of(_digests(df), df.columns, null_threshold, duplicate_threshold_pct)


def quality_of(
    counted: Multiset, columns: Sequence[str] | None = None, null_threshold: float = 0.30,
    duplicate_threshold_pct: float = 0.05,
) -> DataFrame:
    """The quality report of a multiset (A13): shares are weighted by copies and no row is exchanged.

    ``columns`` names the columns in the report, in the order of the multiset.
    """
    held = [c for c in counted.rows.columns if c != counted.copies]
    columns = held if columns is None else columns
    total = F.coalesce(F.sum(counted.weight), F.lit(0))
    null_shares: list[Column] = [
        F.try_divide(F.coalesce(F.sum(F.when(F.isnull(col(c)), counted.weight)), F.lit(0)), total) for c in held
    ]
    rows = counted.rows.agg(
        total.alias("total_rows"), (total - F.count("*")).alias("duplicate_rows"),
        F.array(*null_shares).alias("shares"))
    width = float(max(len(columns), 1))
    duplicate_pct = F.coalesce(F.try_divide("duplicate_rows", "total_rows"), F.lit(0.0))
    failing = F.filter(
        F.transform(F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("name"), F.col("shares").alias("share")),
                    lambda s: F.when(s["share"] > null_threshold, s["name"])), F.isnotnull)
    scored = rows.select(
        "total_rows", "duplicate_rows",
        (F.aggregate("shares", F.lit(0.0), lambda a, s: a + s) / F.lit(width)).alias("avg_null"),
        failing.alias("columns_failing"), duplicate_pct.alias("duplicate_pct"))
    score = F.greatest(F.lit(0.0), round_to(
        F.lit(1.0) - F.least(F.col("avg_null") * 2, F.lit(0.4)) - F.least(F.col("duplicate_pct") * 3, F.lit(0.3))
        - F.size("columns_failing") * F.lit(0.05), 3))
    known = F.col("total_rows") > 0
    return scored.select(
        "total_rows", "duplicate_rows", round_to(F.col("avg_null"), 4).alias("null_row_pct"), "columns_failing",
        F.when(known, score).alias("overall_score"), "duplicate_pct",
    ).select(
        *[c for c in schemas.ddl(schemas.QUALITY).fieldNames() if c != "passed"],
        F.when(known, (F.col("overall_score") >= 0.6) & (F.col("duplicate_pct") < duplicate_threshold_pct))
        .alias("passed"))
