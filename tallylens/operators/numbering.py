"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylens.sources.files import staged

ONE_TASK_ROWS = 100_000


def number_rows(df: DataFrame, order: str, name: str, at_most: int | None = None) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... in the order of the unique column ``order``.

    Rows known to be few are numbered by a plain window. Otherwise they are
    written once, so that what they are made of is not computed again, and
    counted; many rows are then range partitioned, written again so that
    partitions keep their numbers even when a task is repeated, and numbered
    within their partition from an offset. Pass compact rows.
    """
    if at_most is None:
        df = staged(df, "rows")
        at_most = df.count()
    if at_most <= ONE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(order)))
    ranged = staged(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    counts = [sizes.get(p, 0) for p in range(max(sizes) + 1)]
    starts = list(accumulate([0] + counts[:-1]))
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("__part") + 1)
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn(name, within + offset).drop("__part")
