"""Load, describe and clean a table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallylens import schemas
from tallylens.operators.clean import tidy
from tallylens.operators.columnwise import pinned, small_frame, together
from tallylens.operators.domain import domain_of
from tallylens.operators.multiset import staged_rows
from tallylens.operators.profile import profile, warnings
from tallylens.operators.quality import quality_of
from tallylens.session import scratch_path
from tallylens.sources.files import exact_sample, read_split, staged


@dataclass(frozen=True)
class Ingested:
    """The cleaned table, what is known about the raw one, and the raw records that did not fit it."""

    table: DataFrame
    profile: DataFrame
    quality: DataFrame
    context: DataFrame
    domain: str
    row_count: int
    rejected: DataFrame | None = None
    table_path: str | None = None
    processing_ms: int = 0


def describe_and_clean(
    raw: DataFrame, source_type: str, exact: bool = True, with_warnings: bool = True, table_path: str | None = None,
    rejected: DataFrame | None = None,
) -> Ingested:
    """Profile, domain and quality of the raw rows, then cleaning.

    The raw rows are merged to distinct ones with counts by one exchange of whole
    rows; profile, quality and the cleaned table are made from these. The cleaned
    table is written once, to ``table_path`` or the shared folder, because every
    later pass reads it.
    Counts in the context are those of the cleaned table; ``rejected`` records
    are counted in its warnings.
    """
    begun = time.monotonic()
    table_path = table_path or scratch_path(raw.sparkSession, "clean.parquet")
    counted, domain = staged_rows(raw), domain_of(raw)
    profiled, quality, table = together(
        raw.sparkSession, lambda: profile(raw, exact, counted), lambda: pinned(quality_of(counted)),
        lambda: staged(tidy(counted.table()), "clean", table_path))
    row_count = table.count()
    notes = [r["warning"] for r in warnings(profiled, quality).collect()] if with_warnings else []
    n_rejected = rejected.count() if rejected is not None else 0
    if n_rejected:
        notes.append(f"Rejected records: {n_rejected}")
    context = small_frame(raw.sparkSession, [{
        "source_type": source_type, "domain": domain, "row_count": row_count, "column_count": len(table.columns),
        "warnings": notes,
    }], schemas.ddl(schemas.CONTEXT))
    return Ingested(
        table, profiled, quality, context, domain, row_count, rejected, table_path, int((time.monotonic() - begun) * 1000))


def ingest(
    spark: SparkSession, path: str, schema: str | StructType | None = None, sample: int | None = None,
    exact: bool = True, table_path: str | None = None,
) -> Ingested:
    """Read a file and describe and clean it.

    Row formats are staged as Parquet first: profiling reads column by column,
    and parsing text once is cheaper than parsing it in every pass. Records that
    do not fit are kept as ``rejected``.
    """
    raw, rejected = read_split(spark, path, schema)
    if sample is not None:
        raw = staged(exact_sample(raw, sample), "sample")
    return describe_and_clean(raw, "static_csv", exact, table_path=table_path, rejected=rejected)


def context_frame(ingested: Ingested) -> DataFrame:
    """Context, quality and column profiles as one nested row."""
    columns = ingested.profile.agg(F.collect_list(F.struct(*ingested.profile.columns)))
    quality = ingested.quality.select(F.struct(*ingested.quality.columns))
    return ingested.context.select("*", quality.scalar().alias("quality"), columns.scalar().alias("columns"))
