from __future__ import annotations

import contextlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallylens.operators import clean, multiset, profile, quality
from tallylens.plans import ingest


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def mixed(spark):
    hot = [(1, "x" * 300, float("nan"), None)] * 40
    return spark.createDataFrame(
        hot + [(2, None, 0.5, 3), (2, None, 0.5, 3), (None, None, None, None), (3, "", 1.0, 9)],
        "id int, `a.b` string, v double, copies int").repartition(4)


def test_rows_and_copies(mixed):
    counted = multiset.counted_rows(mixed)
    assert counted.copies == "copies_" and counted.table().columns == mixed.columns
    assert sorted(r["copies_"] for r in counted.rows.collect()) == [1, 1, 2, 40]
    assert Counter(map(str, counted.expanded().collect())) == Counter(map(str, mixed.collect()))


def test_maps_count_by_their_entries(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 1 AS entries_0 UNION ALL SELECT map('b', 2, 'a', 1), 1 UNION ALL SELECT NULL, 1")
    counted = multiset.counted_rows(df)
    assert counted.table().columns == ["m", "entries_0"]
    assert sorted(r["copies"] for r in counted.rows.collect()) == [1, 2]


def test_empty_table(spark):
    counted = multiset.counted_rows(spark.createDataFrame([], "a string, b double"))
    assert counted.rows.collect() == []
    assert quality.duplicates_of(counted).head().asDict() == {"total_rows": 0, "distinct_rows": 0, "duplicate_rows": 0}
    assert quality.quality_of(counted).head()["overall_score"] is None


def test_reports_equal_those_of_the_raw_rows(mixed, dirty):
    for df in (mixed, dirty):
        counted = multiset.counted_rows(df)
        assert quality.duplicates_of(counted).collect() == quality.duplicate_count(df).collect()
        assert quality.quality_of(counted).collect() == quality.quality_report(df).collect()
        for exact in (True, False):
            raw, weighted = (profile.profile(df, exact, c).drop("sample_vals").collect() for c in (None, counted))
            assert weighted == raw


def test_one_exchange_of_whole_rows(dirty, mixed):
    """Only counting the rows exchanges them; the report and the cleaned table of the staged rows do not."""
    assert plan_of(multiset.counted_rows(mixed).rows).count("Arguments: hashpartitioning(") == 1
    counted = multiset.staged_rows(dirty)
    assert "hashpartitioning" not in plan_of(quality.quality_of(counted))
    assert "Exchange" not in plan_of(clean.tidy(counted.table()))


def test_ingest_reads_the_distinct_rows(dirty):
    done = ingest.describe_and_clean(dirty, "static_csv")
    clean_rows = clean.clean(dirty)
    assert done.row_count == clean_rows.count() and done.domain == "ecommerce"
    assert done.table.exceptAll(clean_rows).count() == 0
    report = done.quality.head()
    assert report["total_rows"] == dirty.count() and report["duplicate_rows"] == dirty.count() - done.row_count
    assert done.profile.where(F.col("column") == "region").head()["null_pct"] == pytest.approx(
        dirty.where("region IS NULL").count() / dirty.count(), abs=1e-4)
