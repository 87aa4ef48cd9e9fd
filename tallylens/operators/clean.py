"""Cleaning steps. Each takes and returns a DataFrame, for ``df.transform``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylens.functions import names, text
from tallylens.operators.columnwise import col, dtype_of
from tallylens.operators.multiset import counted_rows


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Keep one of several equal rows."""
    return counted_rows(df).table()


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores (P1); two equal names are an error."""
    return df.toDF(*names.normalised(df.columns))


def _rewrite_texts(df: DataFrame, parts: tuple[str, ...], change: Callable[[Column], Column]) -> DataFrame:
    """Apply ``change`` to the string columns whose name has one of ``parts``."""
    hit = {
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and names.has_part(f.name, parts)
    }
    return df.select(*[change(col(c)).alias(c) if c in hit else col(c) for c in df.columns])


def fix_dates(df: DataFrame) -> DataFrame:
    """Bring date texts into ISO form (F1)."""
    return _rewrite_texts(df, names.CLEAN_DATE_PARTS, text.iso_date)


def fix_currency(df: DataFrame) -> DataFrame:
    """Turn amounts written as text into doubles (F2)."""
    return _rewrite_texts(df, names.CURRENCY_PARTS, text.currency)


def normalise_status(df: DataFrame) -> DataFrame:
    """Lower-case and strip status-like texts."""
    return _rewrite_texts(df, names.STATUS_PARTS, text.lowered)


def fill_totals(df: DataFrame) -> DataFrame:
    """Recompute a missing ``total_amount`` from quantity and unit price."""
    if not {"total_amount", "quantity", "unit_price"} <= set(df.columns):
        return df

    def number(name: str) -> Column:
        return text.to_double(F.col(name)) if isinstance(dtype_of(df, name), T.StringType) else F.col(name)

    return df.withColumn("total_amount", F.coalesce(F.col("total_amount"), number("quantity") * number("unit_price")))


def tidy(df: DataFrame) -> DataFrame:
    """All steps but dropping repeats, which have to be gone already."""
    return (
        df.transform(normalise_names)
        .transform(fix_dates)
        .transform(fix_currency)
        .transform(normalise_status)
        .transform(fill_totals)
    )


def clean(df: DataFrame) -> DataFrame:
    """All steps in order.

    Repeats are dropped before texts are normalised, so rows that become equal
    only by cleaning are kept.
    """
    return df.transform(drop_repeated_rows).transform(tidy)
