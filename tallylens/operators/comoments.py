"""Counts, sums and products of all pairs of numeric columns by one scan.

A block of rows gives, for all pairs of its columns at once, how many rows have
both values, the sums and squares of each side over these rows and the sum of
products: five products of matrices, of the values (missing ones as zero) and of
the masks of what is there. Such sums can be added up, so every task moves one
row per pair, and the number of scans does not depend on the number of columns.
Values are shifted by the known means, so that the sums lose no digits.

It is the one place of the statistics that leaves generated code: as SQL
aggregates the sums of all pairs would be split over many scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens.functions.numbers import guarded_corr, usable_number
from tallylens.operators.columnwise import col, dtype_of

SUMS = ("n", "x", "y", "xx", "yy", "xy")
SCHEMA = "i int, j int, n bigint, x double, y double, xx double, yy double, xy double"


def _summed(shifts: list[float], complete: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shifts)
        total = np.zeros((6, k, k))
        for batch in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if complete:
                there = there.all(1, keepdims=True) & there
            values = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns], 1) - shifts
            values[~there] = 0.0
            there = there.astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                x, xx = values.T @ there, (values * values).T @ there
                total += np.stack([there.T @ there, x, x.T, xx, xx.T, values.T @ values])
        i, j = np.triu_indices(k)
        sums = [total[s][i, j] for s in range(6)]
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])],
                              names=["i", "j", *SUMS])

    return run


def co_moments(df: DataFrame, columns: Sequence[str], shifts: Mapping[str, float | None], complete: bool = False) -> DataFrame:
    """i, j (places of two columns, i <= j), n and ``covar``, ``sd_x``, ``sd_y`` over the rows that have both values.

    ``complete`` takes only rows that have a value in all of the columns.
    """
    numbers = df.select(*[usable_number(col(c), dtype_of(df, c)).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = numbers.mapInArrow(_summed([float(shifts.get(c) or 0.0) for c in columns], complete), SCHEMA).groupBy("i", "j").agg(
        *[F.sum(s).alias(s) for s in SUMS])

    def moment(both: str, a: str, b: str) -> Column:
        return F.try_divide(F.col(both) - F.try_divide(F.col(a) * F.col(b), F.col("n")), F.col("n"))

    def deviation(side: str) -> Column:
        # what is left of equal values are rounding errors of the shift
        size = F.col(side + side) / F.col("n")
        found = moment(side + side, side, side)
        return F.when(found > 1e-12 * size, F.sqrt(found)).otherwise(F.when(F.isnan(found), found).otherwise(0.0))

    return sums.where("n > 0").select(
        "i", "j", "n", moment("xy", "x", "y").alias("covar"), *[deviation(s).alias(f"sd_{s}") for s in ("x", "y")])


def correlations(moments: DataFrame) -> DataFrame:
    """i, j, n and r; null where a side does not vary."""
    return moments.select("i", "j", "n", guarded_corr(F.col("covar"), F.col("sd_x"), F.col("sd_y")).alias("r"))
