from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallylens.operators import domain, facts, profile, quality


def by_column(frame):
    return {r["column"]: r for r in frame.collect()}


def test_profile_of_a_dirty_table(dirty):
    rows = by_column(profile.profile(dirty))
    assert rows["order_date"]["issues"] == ["mixed_date_formats"]
    assert rows["unit_price"]["issues"] == ["leading_dollar_sign"]
    assert rows["status"]["issues"] == ["case_inconsistency"]
    assert rows["region"]["issues"] == ["high_null_rate_45%"]
    assert rows["region"]["unique_count"] == 6
    assert len(rows["region"]["sample_vals"]) == 5
    assert rows["order_id"]["semantic_tag"] == "id"


def test_approximate_profile_is_close(dirty):
    exact, rough = by_column(profile.profile(dirty)), by_column(profile.profile(dirty, exact=False))
    for c, row in exact.items():
        assert rough[c]["unique_count"] == pytest.approx(row["unique_count"], rel=0.05)
        assert rough[c]["null_pct"] == row["null_pct"] and rough[c]["issues"] == row["issues"]


@pytest.mark.parametrize("nulls, issues", [(15, []), (16, ["high_null_rate_16%"])])
def test_null_issue_is_strict(spark, nulls, issues):
    df = spark.range(100).select(F.when(F.col("id") >= nulls, F.col("id")).alias("x"))
    assert profile.profile(df).head()["issues"] == issues


@pytest.mark.parametrize("n, expected", [(10, ["case_inconsistency"]), (11, [])])
def test_case_issue_needs_few_values(spark, n, expected):
    df = spark.range(n).selectExpr("explode(array(concat('a', id), concat('A', id))) AS x")
    assert profile.profile(df).head()["issues"] == expected


def test_samples_are_found_beyond_the_head(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 990, F.col("id")).alias("x")).coalesce(1)
    assert profile.sample_values(df, ["x"])["x"] == ["990", "991", "992", "993", "994"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert [r["null_pct"] for r in profile.profile(df).collect()] == [None, None]
    report = quality.quality_report(df).head()
    assert report["total_rows"] == 0 and report["overall_score"] is None and report["passed"] is None


def test_quality_score(spark):
    # 100 rows, 4 surplus copies, one column 40% null and one full
    df = spark.range(96).select("id", F.when(F.col("id") % 10 >= 4, 1).alias("gap")).unionAll(
        spark.createDataFrame([(95, 1)] * 4, "id long, gap int"))
    report = quality.quality_report(df).head()
    share = df.where("gap is null").count() / 100
    assert report["duplicate_rows"] == 4 and report["columns_failing"] == ["gap"]
    assert report["overall_score"] == round(1 - min(share, 0.4) - 0.12 - 0.05, 3)
    assert report["null_row_pct"] == round(share / 2, 4)


@pytest.mark.parametrize("copies, passed", [(4, True), (5, False)])
def test_quality_limit_on_duplicates(spark, copies, passed):
    df = spark.range(100 - copies).unionAll(spark.createDataFrame([(0,)] * copies, "id long"))
    assert quality.quality_report(df).head()["passed"] is passed


def test_long_texts_are_compared_in_full(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("short",), (None,), (None,)], "t string")
    assert quality.duplicate_count(df).head()["distinct_rows"] == 4
    assert facts.distinct_counts(df, ["t"]) == {"t": 4}


def test_maps_can_be_compared(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert quality.duplicate_count(df).head()["duplicate_rows"] == 1


def test_domain(spark):
    shop = spark.createDataFrame([], "Order_ID string, product_id string, x int")
    assert domain.detect_domain(shop).head()["domain"] == "ecommerce"
    assert domain.detect_domain(spark.createDataFrame([], "order_id string")).head()["domain"] == "unknown"
    tied = spark.createDataFrame([], "debit int, credit int, user_id int, plan int")
    assert domain.detect_domain(tied).head()["domain"] == "finance"


def test_column_choice(spark):
    df = spark.range(100).selectExpr(
        "id AS row_id", "id * 1000 AS code", "id % 80 AS near", "id % 81 AS over", "id / 7.0D AS place", "id * 3.0D AS price",
        "CAST(id % 51 AS STRING) AS many", "CAST(id % 50 AS STRING) AS few")
    kept = {c.column: c.reason for c in facts.choose_columns(df, max_string_uniques=50)}
    assert kept == {
        "row_id": "name", "code": "nearly_unique_integer", "near": "kept", "over": "nearly_unique_integer",
        "place": "coordinate_like", "price": "kept", "many": "many_texts", "few": "kept"}


def test_sketch_ceiling_never_rules_out_few_values(spark):
    for n in (1, 2, 30, 50):
        df = spark.range(5000).selectExpr(f"concat('value ', id % {n}) AS x")
        assert facts.few_valued(df, ["x"], 50) == ["x"]
    assert facts.few_valued(spark.range(5000).selectExpr("CAST(id AS STRING) AS x"), ["x"], 50) == []


def test_chart_column_stats_show_full_texts(spark):
    long = "long text " * 30
    df = spark.createDataFrame([(long, 1.0), (long, 2.0), ("b", 6.0), (None, 3.0)], "note string, price double")
    rows = by_column(profile.column_chart_stats(df))
    assert rows["price"]["mean"] == 3.0 and rows["price"]["kind"] == "numeric"
    assert rows["note"]["n_unique"] == 3
    assert [(v["value"], v["n"]) for v in rows["note"]["top_vals"]] == [(long, 2), ("b", 1)]


def test_long_texts_with_equal_counts_are_ranked_by_text(spark):
    from tallylens.operators.profile import column_chart_stats

    texts = [c + "x" * 80 for c in "fbdace"] + ["short"]
    df = spark.createDataFrame([(t,) for t in texts * 2 + ["z" * 90] * 3], "note string").repartition(4)
    top = column_chart_stats(df).head()["top_vals"]
    assert [(v["value"][0], len(v["value"]), v["n"]) for v in top] == [
        ("z", 90, 3), ("a", 81, 2), ("b", 81, 2), ("c", 81, 2), ("d", 81, 2)]
