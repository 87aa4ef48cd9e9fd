from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylens.operators import facts, statistics as st


def columns_frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), names)


def only(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_summary_and_shape_match_numpy(spark):
    values = np.random.default_rng(5).gamma(2.0, 10.0, 500)
    df = columns_frame(spark, x=values.tolist())
    numbers = st.numbers_table(df)
    row = only(st.summary_rows(numbers))
    assert (row["mean"], row["median"], row["std"]) == (
        round(values.mean(), 2), round(float(np.median(values)), 2), round(values.std(ddof=1), 2))
    m = only(st.distribution_findings(numbers))["metrics"]
    z = (values - values.mean()) / values.std()
    assert m["skew"] == round((z**3).mean(), 3) and m["kurtosis"] == round((z**4).mean() - 3, 3)
    q1, q3 = np.percentile(values, [25, 75])
    reach = 1.5 * (q3 - q1)
    assert m["outlier_count"] == ((values < q1 - reach) | (values > q3 + reach)).sum()


def test_missing_values_and_one_row(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    numbers = st.numbers_table(df)
    assert [r["column"] for r in st.summary_rows(numbers).collect()] == ["a"]
    assert only(st.summary_rows(numbers))["std"] is None
    finding = only(st.summary_finding(numbers))
    assert finding["columns"] == ["a", "b"] and "b.mean" not in finding["metrics"] and "a.mean" in finding["metrics"]


@pytest.mark.parametrize("n, expected", [(19, 0), (20, 1)])
def test_distribution_needs_twenty_rows(spark, n, expected):
    df = columns_frame(spark, x=[float(i) for i in range(n)])
    assert st.distribution_findings(st.numbers_table(df)).count() == expected


def test_constant_columns_give_nothing(spark):
    df = columns_frame(spark, x=[0.1] * 100, y=list(range(100)))
    numbers = st.numbers_table(df)
    assert [r["columns"] for r in st.distribution_findings(numbers).collect()] == [["y"]]
    assert st.anomaly_findings(numbers).count() == 0
    assert st.correlation_findings(df).count() == 0


@pytest.mark.parametrize("outliers, severity, actionable", [
    (3, "info", False), (4, "warning", False), (5, "warning", False), (6, "warning", True), (10, "warning", True), (11, "critical", True)])
def test_distribution_severity_is_strict(spark, outliers, severity, actionable):
    values = [float(i % 10) for i in range(100 - outliers)] + [1000.0 + i for i in range(outliers)]
    row = only(st.distribution_findings(st.numbers_table(columns_frame(spark, x=values))))
    assert row["metrics"]["outlier_count"] == outliers
    assert (row["severity"], row["actionable"]) == (severity, actionable)


@pytest.mark.parametrize("nulls, severity, actionable", [
    (5, None, None), (6, "warning", False), (20, "warning", False), (21, "warning", True), (30, "warning", True), (31, "critical", True)])
def test_null_severity_is_strict(spark, nulls, severity, actionable):
    df = spark.range(100).select(F.when(F.col("id") >= nulls, "v").alias("x"))
    rows = st.null_findings(df).collect()
    assert [(r["severity"], r["actionable"]) for r in rows] == ([(severity, actionable)] if severity else [])


@pytest.mark.parametrize("top, severity, actionable", [
    (70, "info", False), (71, "warning", True), (90, "warning", True), (91, "critical", True)])
def test_category_severity_is_strict(spark, top, severity, actionable):
    df = columns_frame(spark, kind=["a"] * top + ["b"] * (100 - top))
    row = only(st.categorical_findings(df))
    assert (row["severity"], row["actionable"]) == (severity, actionable)
    assert row["metrics"]["imbalance_ratio"] == round(top / (100 - top + 1e-7), 2)


@pytest.mark.parametrize("uniques, expected", [(1, 0), (2, 1), (50, 1), (51, 0)])
def test_category_limits(spark, uniques, expected):
    df = spark.range(600).selectExpr(f"concat('v', id % {uniques}) AS x", "CAST(NULL AS STRING) AS empty")
    assert st.categorical_findings(df).count() == expected


def test_category_ties_go_by_value(spark):
    row = only(st.categorical_findings(columns_frame(spark, x=list("bbaaccd"))))
    assert row["labels"]["top_value"] == "a" and row["series"] == [2.0, 2.0, 2.0, 1.0]


def trend(spark, counts):
    rows = [(f"2024-{m + 1:02d}-15 08:00", 1.0) for m, n in enumerate(counts) for _ in range(n)]
    return st.trend_finding(spark.createDataFrame(rows, "order_date string, x double"))


def test_trend_matches_a_fitted_line(spark):
    counts = [10, 12, 11, 15, 14, 18]
    row = only(trend(spark, counts))
    slope, _ = np.polyfit(range(6), counts, 1)
    r = np.corrcoef(range(6), counts)[0, 1]
    assert row["metrics"]["slope"] == round(slope, 4) and row["metrics"]["r_squared"] == round(r * r, 4)
    assert row["metrics"]["trend_pct_per_period"] == round(slope / np.mean(counts) * 100, 2)
    assert row["series"] == counts and row["labels"] == {"direction": "up", "significant": "true"}


@pytest.mark.parametrize("counts, severity, actionable", [
    ([10, 10, 10], "info", False), ([8, 10, 12], "warning", False), ([7, 10, 13], "warning", True), ([13, 10, 7], "critical", True),
    ([12, 10, 8], "warning", False)])
def test_trend_severity(spark, counts, severity, actionable):
    row = only(trend(spark, counts))
    assert (row["severity"], row["actionable"]) == (severity, actionable)


def test_trend_needs_three_months_and_a_number(spark):
    assert trend(spark, [5, 6]).count() == 0
    assert st.trend_finding(spark.createDataFrame([("2024-01-01",)], "order_date string")).count() == 0


def test_flat_trend_has_no_fit(spark):
    row = only(trend(spark, [4, 4, 4, 4]))
    assert row["metrics"]["r_squared"] == 0.0 and row["metrics"]["p_value"] == 1.0 and row["labels"]["direction"] == "down"


def test_trend_column_must_hold_dates(spark):
    df = spark.createDataFrame([("open", "2024-01-01", 1)], "status string, order_date string, n int")
    assert st.trend_date_column(df) == "order_date"
    assert st.trend_date_column(df.select("status")) is None


def test_correlation_uses_pairwise_rows(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=200)
    b = 2 * a + rng.normal(scale=0.5, size=200)
    rows = [(float(x), float(y) if i % 4 else None) for i, (x, y) in enumerate(zip(a, b))]
    row = only(st.correlation_findings(spark.createDataFrame(rows, "a double, b double")))
    keep = np.arange(200) % 4 != 0
    assert row["metrics"]["pearson_r"] == round(np.corrcoef(a[keep], b[keep])[0, 1], 4)
    assert row["metrics"]["n"] == 150 and row["labels"] == {"strength": "strong", "direction": "positive"}


def test_pair_limit_counts_only_long_pairs(spark):
    # column g is nearly empty, so pairs with it do not use up the limit of eleven
    rows = [tuple(float(i + k) for k in range(6)) + (1.0 if i < 29 else None,) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, g2 double, c double, d double, e double, f double, g double")
    columns = ["g", "a", "g2", "c", "d", "e", "f"]
    known = facts.number_facts(df, columns)
    assert len(st.eligible_pairs(df, columns, known)) == 15
    pairs = st.eligible_pairs(df, columns, known, most=11)
    assert len(pairs) == 11 and pairs[0] == ("a", "g2") and not any("g" in p for p in pairs)


def test_all_strong_pairs_are_reported_without_copies_of_rows(spark):
    df = spark.range(100).selectExpr(*[f"id * {k} + {k} AS c{k}" for k in range(1, 9)])
    assert st.correlation_findings(df).count() == 28


def test_correlations_of_many_columns_need_one_scan(spark, monkeypatch):
    """With missing values, constants and large offsets, 30 columns; the plan reads the table once."""
    from tallylens.operators import comoments

    rng = np.random.default_rng(2)
    values = rng.normal(size=(400, 30)) @ rng.normal(size=(30, 30)) + 1e6
    values[:, 3] = 0.1
    hidden = rng.random(values.shape) < 0.2
    rows = [tuple(None if h else float(v) for v, h in zip(vs, hs, strict=True)) for vs, hs in zip(values, hidden, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(30))).repartition(5)
    means = {c: f.mean for c, f in facts.number_facts(df).items()}
    frame = comoments.co_moments(df, df.columns, means)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    for r in comoments.correlations(frame).collect():
        both = ~hidden[:, r.i] & ~hidden[:, r.j]
        assert r.n == both.sum()
        if 3 in (r.i, r.j):
            assert r.r is None
        else:
            assert r.r == pytest.approx(np.corrcoef(values[both, r.i], values[both, r.j])[0, 1], abs=1e-9)
    whole = comoments.co_moments(df, ["c0", "c1", "c2"], means, complete=True)
    all_there = (~hidden[:, :3]).all(1)
    assert {(r.i, r.j): r.n for r in whole.collect()} == {(i, j): all_there.sum() for i in range(3) for j in range(i, 3)}


def test_pairs_left_open_are_counted(spark):
    rows = [(float(i) if i < 45 else None, float(i) if i >= n else None) for n in (15,) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert st.eligible_pairs(df, ["a", "b"], facts.number_facts(df)) == [("a", "b")]
    rows = [(float(i) if i < 45 else None, float(i) if i >= 16 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert st.eligible_pairs(df, ["a", "b"], facts.number_facts(df)) == []


@pytest.mark.parametrize("extremes, n, severity, actionable", [
    (1, 1000, "info", False), (3, 1000, "warning", False), (20, 1000, "warning", True), (21, 1000, "critical", True)])
def test_anomaly_severity(spark, extremes, n, severity, actionable):
    values = [float(i % 5) for i in range(n - extremes)] + [1000.0 + i for i in range(extremes)]
    row = only(st.anomaly_findings(st.numbers_table(columns_frame(spark, x=values))))
    assert row["metrics"]["n_anomalies"] == extremes
    assert (row["severity"], row["actionable"]) == (severity, actionable)
    assert row["series"] == [1000.0 + i for i in range(extremes)][-5:]


def test_full_analysis_order_and_empty_table(spark, dirty):
    from tallylens.operators.clean import clean

    found = st.full_analysis(clean(dirty)).collect()
    ranks = [st.SEVERITIES.index(r["severity"]) for r in found]
    assert ranks == sorted(ranks)
    for rank in set(ranks):
        seqs = [r["seq"] for r, k in zip(found, ranks) if k == rank]
        assert seqs == sorted(seqs)
    empty = spark.createDataFrame([], "a double, t string, order_date string")
    assert [r["stat_type"] for r in st.full_analysis(empty).collect()] == ["summary"]


def test_partition_count_does_not_matter(spark, dirty):
    from tallylens.operators.clean import clean

    table = clean(dirty).cache()
    a = st.finding_metrics(st.full_analysis(table.coalesce(1))).collect()
    b = st.finding_metrics(st.full_analysis(table.repartition(13))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
