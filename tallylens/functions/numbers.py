"""Numeric column expressions and the p-value of a correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.DecimalType)
CHART_TYPES = STATISTIC_TYPES + (T.ShortType, T.ByteType)
INTEGER_TYPES = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
FLOAT_TYPES = (T.DoubleType, T.FloatType)


def round_to(col: Column, digits: int) -> Column:
    """Half-to-even rounding that stays inside generated code.

    The last digit is off by one where ``col * 10 ** digits`` itself rounds to a half.
    """
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def usable_number(col: Column, dtype: T.DataType) -> Column:
    """The column as double, with NaN treated as missing."""
    if isinstance(dtype, FLOAT_TYPES):
        return F.when(~F.isnan(col), col.cast("double"))
    return col.cast("double")


def number_from_text(col: Column) -> Column:
    """``$1,234.5`` as a double; null where the text is no number."""
    return to_double(F.regexp_replace(col, "[$,]", ""))


def to_double(text: Column) -> Column:
    """Non-raising text to double that refuses Java's ``1d`` / ``1f`` suffixes."""
    return F.when(~text.rlike("[0-9.][dDfF]\\s*$"), text.try_cast("double"))


def guarded_corr(covar: Column, sd_x: Column, sd_y: Column) -> Column:
    """Correlation from its parts; null where a side does not vary."""
    return F.when((sd_x > 0) & (sd_y > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), covar / (sd_x * sd_y))))


def _tail(start: Column, width: Column, dof: Column, steps: int = 1000) -> Column:
    """Simpson integral of ``cos(t) ** (dof - 1)`` over ``[start, start + width]``."""
    step = width / F.lit(float(steps))

    def height(i: Column) -> Column:
        sine = F.sin(start + i * step)
        return F.exp((dof - 1) * 0.5 * F.log1p(F.greatest(-sine * sine, F.lit(-1.0 + 1e-16))))

    def weight(i: Column) -> Column:
        return F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + weight(i) * height(i))
    return total * step / 3


def p_value(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` points.

    The same value is the p-value of the slope of a simple regression. With
    ``sin(t) = |r|`` it is the tail of ``cos(t) ** (dof - 1)`` beyond ``t``
    over the whole, so it needs no special function. Meant for a handful of
    aggregated rows.
    """
    dof = (F.col(n) - 2).cast("double")
    start = F.asin(F.least(F.lit(1.0), F.abs(F.col(r))))
    reach = F.try_divide(F.lit(10.0), F.sqrt(dof))
    width = F.least(F.lit(math.pi / 2) - start, reach, F.try_divide(F.lit(40.0), (dof - 1) * F.tan(start)))
    share = _tail(start, width, dof) / _tail(F.lit(0.0), F.least(F.lit(math.pi / 2), reach), dof)
    return F.when(F.isnull(r), F.lit(None).cast("double")).when(dof <= 0, 1.0).otherwise(F.least(F.lit(1.0), share))
