"""A table as a multiset: every distinct row once, with the number of its copies.

Duplicate counts, quality, profiles and the cleaned table all follow from it, so a table is shuffled by whole rows once
and not once for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylens.operators.columnwise import col
from tallylens.operators.facts import group_key
from tallylens.session import staged


def fresh_name(df: DataFrame, wish: str) -> str:
    """``wish``, made longer until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


@dataclass(frozen=True)
class Multiset:
    """Distinct ``rows``; the column named ``copies`` tells how often each occurs."""

    rows: DataFrame
    copies: str

    @property
    def weight(self) -> Column:
        return col(self.copies)

    def table(self) -> DataFrame:
        """Every distinct row once."""
        return self.rows.drop(self.copies)

    def expanded(self) -> DataFrame:
        """All rows, copies included; each task repeats its own rows."""
        return self.rows.withColumn(self.copies, F.explode(F.sequence(F.lit(1).cast("long"), self.weight))).drop(self.copies)


def counted_rows(df: DataFrame) -> Multiset:
    """The distinct rows of a table by one exchange; nulls equal each other, NaN equals NaN.

    Copies merge on the map side, so a row that makes up a third of the table is one row per task in the exchange. Map
    columns are compared by their sorted entries. A table without columns has at most one distinct row.
    """
    copies = fresh_name(df, "copies")
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return Multiset(df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias(copies)).where(col(copies) > 0), copies)
    keys = {c: fresh_name(df, f"entries_{i}") for i, c in enumerate(maps)}
    keyed = df.select("*", *[group_key(col(c), df.schema[c].dataType).alias(k) for c, k in keys.items()])
    merged = keyed.groupBy(*[col(c) for c in df.columns if c not in maps], *keys.values()).agg(
        *[F.first(col(c)).alias(c) for c in maps], F.count("*").alias(copies))
    return Multiset(merged.select(*[col(c) for c in df.columns], col(copies)), copies)


def staged_rows(df: DataFrame) -> Multiset:
    """:func:`counted_rows`, written once so that any number of passes can read it."""
    counted = counted_rows(df)
    return Multiset(staged(counted.rows, "distinct"), counted.copies)
