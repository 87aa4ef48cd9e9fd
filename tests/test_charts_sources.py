from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallylens.operators import charts
from tallylens.sources import files


def test_bar_shares_and_defaults(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 5.0)], "kind string, x double")
    assert [tuple(r) for r in charts.bar_chart(df).collect()] == [(1, "a", 2.0, 66.7), (2, "b", 1.0, 33.3)]
    assert [(r["label"], r["value"]) for r in charts.bar_chart(df, "kind", "x", "mean").collect()] == [
        ("b", 10.0), (None, 5.0), ("a", 2.0)]
    assert [(r["label"], r["value"]) for r in charts.bar_chart(df, "kind", "x", "sum").collect()][2] == ("a", 4.0)
    assert charts.bar_chart(df.select("x")) is None


def test_bar_shows_twelve(spark):
    df = spark.range(400).selectExpr("concat('v', CAST(floor(sqrt(id)) AS INT)) AS kind")
    rows = charts.bar_chart(df, "kind").collect()
    assert len(rows) == 12 and rows[0]["label"] == "v19" and sum(r["share"] for r in rows) == pytest.approx(100, abs=0.6)
    assert charts.pie_chart(df, "kind").count() == 6 and charts.pie_chart(df, "nope") is None


def test_first_category_counts_null_as_a_value(spark):
    df = spark.range(300).selectExpr(
        "CASE WHEN id % 31 < 30 THEN concat('a', id % 31) END AS wide", "concat('b', id % 30) AS fits")
    assert charts.first_category(df) == "fits"


def test_histogram_covers_all_values(spark):
    values = np.random.default_rng(4).exponential(10, 1000)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    bins = charts.histogram(df, "x").collect()
    assert sum(r["n"] for r in bins) == 1000
    ordered = sorted(values)
    q1, q3 = ordered[int((999) * 0.25 + 0.5)], ordered[int(999 * 0.75 + 0.5)]
    fence = q3 + 1.5 * (q3 - q1)
    assert sum(r["n"] for r in bins if r["series"] == "outlier") == (values > fence).sum()
    assert max(r["bin"] for r in bins if r["series"] == "normal") == 39
    assert charts.histogram(df.selectExpr("CAST(x AS STRING) AS x"), "x") is None
    same = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert [(r["bin"], r["n"]) for r in charts.histogram(same, "x").collect()] == [(0, 3)]


def test_line_fits_monthly_sums(spark):
    df = spark.createDataFrame(
        [("2024-01-05", 1.0), ("2024-01-09", 2.0), ("2024-02-01", 7.0), ("2024-03-01", None), (None, 9.0)], "day_date string, x double")
    rows = charts.line_chart(df).collect()
    assert [(r["month"], r["value"]) for r in rows] == [("2024-01", 3.0), ("2024-02", 7.0), ("2024-03", 0.0)]
    assert [r["trend"] for r in rows] == pytest.approx(list(np.polyval(np.polyfit(range(3), [3, 7, 0], 1), range(3))))
    assert charts.line_chart(df.limit(1)) is None


def test_scatter_keeps_colour_and_repeats(spark):
    df = spark.range(2000).selectExpr("id AS x", "2.0D * id + 1 AS y", "id % 3 AS c")
    a, b = (charts.scatter(df.repartition(n), "x", "y", "c").collect() for n in (2, 9))
    assert len(a) == 500 and sorted(a) == sorted(b) and a[0].asDict().keys() == {"x", "y", "color"}
    ends = charts.scatter_trend(charts.scatter(df, "x", "y")).collect()
    assert all(e["y"] == pytest.approx(2 * e["x"] + 1) for e in ends)


def test_matrix_uses_complete_rows(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(100, 3))
    rows = [tuple(float(v) if not (i % 10 == 0 and j == 2) else None for j, v in enumerate(r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "a_1 double, b double, c double")
    cells = {(r["x"], r["y"]): r["r"] for r in charts.correlation_matrix(df).collect()}
    kept = data[np.arange(100) % 10 != 0]
    assert cells[("a 1", "b")] == pytest.approx(np.corrcoef(kept.T)[0, 1]) and cells[("c", "c")] == pytest.approx(1.0)
    assert len(cells) == 9


def test_chart_data_dispatch(spark, dirty):
    from tallylens.operators.clean import clean

    table = clean(dirty).cache()
    for kind, x, y in (("bar", "status", None), ("histogram", "quantity", None), ("line", "order_date", "total_amount"),
                       ("scatter", "quantity", "total_amount"), ("pie", "status", None), ("heatmap", None, None)):
        assert charts.chart_data({"chart_type": kind, "x_column": x, "y_column": y}, table).count() > 0
    assert charts.chart_data({"chart_type": "radar"}, table) is None


@pytest.mark.parametrize("suffix", [".csv", ".json", ".jsonl", ".parquet", ".PARQUET"])
def test_tables_survive_writing_and_reading(spark, dirty, tmp_path, suffix):
    path = str(tmp_path / f"orders{suffix}")
    files.write_table(dirty, path)
    back = files.read_table(spark, path, None if suffix == ".csv" else dirty.schema).select(*[F.col(f"`{c}`") for c in dirty.columns])
    back = back.withColumn("quantity", F.col("quantity").cast("long"))
    assert back.exceptAll(dirty).count() == 0 and back.count() == dirty.count()


def test_unknown_and_missing_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_table(spark, "book.xlsx")
    for suffix in (".csv", ".parquet"):
        with pytest.raises(FileNotFoundError):
            files.read_table(spark, str(tmp_path / f"none{suffix}"))


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_csv_separator_is_found(spark, tmp_path, separator):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(separator.join(r) for r in (["name", "n", "x"], ["a, b" if separator != "," else "a", "1", "2.5"])))
    row = files.read_table(spark, str(path)).head()
    assert (row["n"], row["x"]) == (1, 2.5)


def test_csv_without_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,1\nb,2\n")
    assert files.read_table(spark, str(path)).count() == 2


@pytest.mark.parametrize("text", [
    '[{"a": 1}, {"a": 2}]', '{"a": 1}\n{"a": 2}\n', '[\n {"a": 1},\n {"a": 2}\n]'])
def test_json_records_and_lines(spark, tmp_path, text):
    path = tmp_path / "t.json"
    path.write_text(text)
    assert sorted(r["a"] for r in files.read_table(spark, str(path)).collect()) == [1, 2]


def test_one_json_record_over_several_lines(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"a": 1, "b": "x"}, indent=2))
    assert files.read_table(spark, str(path)).head()["b"] == "x"


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id", "concat('v', id) AS v")
    a, b = (files.exact_sample(df.repartition(n), 100, seed=7).collect() for n in (1, 8))
    assert len(a) == 100 and sorted(a) == sorted(b)
    assert sorted(a) != sorted(files.exact_sample(df, 100, seed=8).collect())
    assert files.exact_sample(df.limit(5), 100).count() == 5


ODD_TEXTS = ["two\nlines", "a\r\nb", "say \"hi\"\n\"", "\"", "x, y\n", "5\" pipe,\"", "plain", "back\\slash", "cr\rcr", None]


@pytest.mark.parametrize("files_written", [1, 4])
def test_line_breaks_in_csv_values(spark, tmp_path, files_written):
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, text string").repartition(files_written)
    files.write_table(df, str(tmp_path / "t.csv"))
    back = files.read_table(spark, str(tmp_path / "t.csv"))
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect()) and back.count() == len(ODD_TEXTS)


def test_files_with_and_without_line_breaks(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('id,t\n1,"a ""b"", c"\n2,""\n3,"""x"""\n')
    assert not files._spans_lines(spark, str(folder), ",", {})
    (folder / "b c.csv").write_text('id,t\n4,"a\nb"\n')
    (folder / "d.csv").write_text('id,t\n5,7" x,\n6,y\n')
    assert files._spans_lines(spark, str(folder), ",", {})
    good, rejected = files.read_split(spark, str(folder))
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3, 4, 6]
    assert [r["record"] for r in rejected.collect()] == ['5,7" x,']


@pytest.fixture
def many_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")}
    for k, v in zip(kept, ("150", "1", "2000"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_one_csv_file_is_cut_by_many_tasks(spark, tmp_path, many_ranges):
    """Records that cross the borders of ranges, or cover several of them, in one file."""
    texts = [*ODD_TEXTS, "long\n" * 200, 'quotes ""\n""' * 60, ",\n," * 50, *(f"row {i}\n{'x' * (i % 90)}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    files.write_table(df, str(tmp_path / "t.csv"))
    assert files.pieces(spark, str(tmp_path / "t.csv"), "\n", {}).select("block").distinct().count() > 10
    back = files.read_table(spark, str(tmp_path / "t.csv"))
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    typed = files.read_table(spark, str(tmp_path / "t.csv"), "id long, text string")
    assert sorted(r["id"] for r in typed.select("id").collect()) == list(range(len(texts)))


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_one_json_array_is_cut_by_many_tasks(spark, tmp_path, many_ranges, layout):
    texts = ["plain", "}{", '"}', "\\", '\\"', "[1, 2}", "{" * 300, 'x"y' * 100, "line\nbreak", "日本 😀", "", None]
    rows = [{"id": i, "text": t, "in": {"a": [1, {"b": t}], "c": {}}} for i, t in enumerate(texts * 3)]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(rows, **layout))
    assert files.pieces(spark, str(path), "}", {}).select("block").distinct().count() > 5
    back = files.read_table(spark, str(path))
    got = sorted((r["id"], r["text"], json.loads(r["in"]["a"][1])["b"]) for r in back.where("text IS NOT NULL").collect())
    assert got == sorted((r["id"], r["text"], r["text"]) for r in rows if r["text"] is not None) and back.count() == len(rows)
    path.write_text("\n".join(json.dumps(r, indent=1) for r in rows))
    assert sorted(r["id"] for r in files.read_table(spark, str(path)).collect()) == list(range(len(rows)))


def test_json_array_without_records(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text("[\n]\n")
    with pytest.raises(ValueError):
        files.read_table(spark, str(path))
    path.write_text('[{"a": 1}, {"a": 2, "b": "x')
    good, rejected = files.read_split(spark, str(path))
    assert [r["a"] for r in good.collect()] == [1] and rejected.count() == 1


@pytest.mark.parametrize("name, text, record", [
    ("t.csv", "a,b\n1,2\n3,4,5\n6,7\n", "3,4,5"), ("t.csv", 'a,b\n1,"2\n"\n3,4,5\n6,7\n', "3,4,5"),
    ("t.jsonl", '{"a": 1, "b": 2}\n{"a": 3,\n{"a": 6, "b": 7}\n', '{"a": 3,')])
def test_rows_that_do_not_fit_are_kept_apart(spark, tmp_path, name, text, record):
    from tallylens.plans.ingest import ingest

    (tmp_path / name).write_text(text)
    good, rejected = files.read_split(spark, str(tmp_path / name))
    assert sorted(r["a"] for r in good.collect()) == [1, 6] and [r["record"].strip() for r in rejected.collect()] == [record]
    with pytest.raises(Exception, match="does not fit"):
        files.read_table(spark, str(tmp_path / name)).select("a").count()
    done = ingest(spark, str(tmp_path / name))
    assert done.row_count == 2 and done.rejected.count() == 1
    assert "Rejected records: 1" in done.context.head()["warnings"]


def test_bar_with_rest(spark):
    rows = spark.createDataFrame([(x,) for x in [*"aaabbc", "other", None]], "x string")
    found = {(r.label, r.n_labels): (r.place, r.value, r.share) for r in charts.bar_with_rest(rows, "x", top=2).collect()}
    assert found == {("a", 1): (1, 3.0, 42.9), ("b", 1): (2, 2.0, 28.6), ("other", 2): (3, 2.0, 28.6)}
    assert charts.bar_with_rest(rows, "x", top=4).count() == 4
    assert charts.bar_with_rest(rows.limit(0), "x").count() == 0
