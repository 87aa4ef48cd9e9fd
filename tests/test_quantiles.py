from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallylens.operators import facts
from tallylens.operators.quantiles import order_statistics, quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("small_cell", [1, 7, 1_000_000])
@pytest.mark.parametrize("values", [
    list(np.random.default_rng(1).normal(size=2000)),
    [1.0] * 700 + list(np.random.default_rng(2).exponential(5, 1400)),
    [1.0] * 500 + [2.0] * 500,
    [-1e-7, 3e12, 0.0, -5.5, 2.5],
    [4.0],
])
def test_exact_quantiles(spark, values, small_cell):
    found = quantiles(frame(spark, values), ["x"], PROBABILITIES, {"x": len(values)}, small_cell=small_cell)["x"]
    assert found == pytest.approx(list(np.percentile(values, [100 * p for p in PROBABILITIES])), rel=1e-12)


def test_nearest_rank(spark):
    values = [float(v) for v in range(10)]
    assert quantiles(frame(spark, values), ["x"], [0.25, 0.75], {"x": 10}, rule="nearest")["x"] == [2.0, 7.0]


def test_missing_values_are_left_out(spark):
    df = frame(spark, [1.0, None, float("nan"), 3.0])
    known = facts.number_facts(df)["x"]
    assert (known.n, known.nulls, known.rows) == (2, 1, 4)
    assert quantiles(df, ["x"], [0.5], {"x": known.n})["x"] == [2.0]
    assert quantiles(df.limit(0), ["x"], [0.5], {"x": 0})["x"] == [None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, 2.0, 1e9, -3.25]), min_size=1, max_size=60), st.integers(1, 5))
def test_order_statistics_with_many_ties(spark, values, small_cell):
    ranks = sorted({0, len(values) // 3, len(values) - 1})
    found = order_statistics(frame(spark, values), {"x": ranks}, {"x": len(values)}, small_cell)
    assert [found[("x", r)] for r in ranks] == [sorted(values)[r] for r in ranks]


def test_partitioning_does_not_matter(spark):
    df = frame(spark, list(np.random.default_rng(3).gamma(2, 3, 3000)))
    results = [
        quantiles(df.repartition(n), ["x"], [0.1, 0.9], {"x": 3000}, small_cell=50)["x"] for n in (1, 3, 16)]
    assert results[0] == results[1] == results[2]
