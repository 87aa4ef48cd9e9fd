from __future__ import annotations

from tallylens.operators import clean
from tallylens.plans.ingest import context_frame, describe_and_clean


def test_dirty_orders_come_out_clean(spark, dirty):
    done = describe_and_clean(dirty, "static_csv")
    table = done.table.cache()
    assert done.domain == "ecommerce"
    assert table.where("total_amount IS NULL").count() < 0.01 * done.quality.head()["total_rows"]
    assert dict(table.dtypes)["unit_price"] == "double"
    assert table.where("status <> lower(status)").count() == 0
    assert table.where("order_date NOT RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'").count() == 0
    assert done.row_count == table.count() == dirty.distinct().count()
    row = context_frame(done).head()
    assert row["column_count"] == 10 and len(row["columns"]) == 10 and row["quality"]["total_rows"] == dirty.count()
    assert any("mixed_date_formats" in w for w in row["warnings"])


def test_cleaning_twice_changes_nothing(dirty):
    once = clean.clean(dirty)
    twice = clean.clean(once)
    assert once.columns == twice.columns
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_rows_equal_after_cleaning_are_kept(spark):
    df = spark.createDataFrame([("DONE",), ("done",), ("done",)], "status string")
    assert [r[0] for r in clean.clean(df).collect()] == ["done", "done"]


def test_only_matching_columns_change(spark):
    df = spark.createDataFrame([(" A ", "$5", " B ")], "note string, price string, Type string")
    assert clean.clean(df).head().asDict() == {"note": " A ", "price": 5.0, "type": "b"}


def test_fill_needs_all_three_columns(spark):
    full = spark.createDataFrame([(None, 2, 3.5), (1.0, 2, 3.5)], "total_amount double, quantity int, unit_price double")
    assert sorted(r[0] for r in clean.clean(full).collect()) == [1.0, 7.0]
    partial = full.drop("quantity")
    assert clean.clean(partial).where("total_amount IS NULL").count() == 1


def test_map_columns_do_not_stop_deduplication(spark):
    df = spark.sql("SELECT 1 AS a, map('x', 1) AS m UNION ALL SELECT 1, map('x', 1)")
    assert clean.drop_repeated_rows(df).count() == 1
