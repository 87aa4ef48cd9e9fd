from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_multiset import plan_of

from tallylens.operators import statistics
from tallylens.sources import files


def ranked(rows, k):
    return sorted(Counter(r for r in rows if r is not None).items(), key=lambda v: (-v[1], v[0].encode()))[:k]


def found(df, columns, k):
    return {r["column"]: [(v["value"], v["n"]) for v in r["top_vals"]] for r in statistics.top_values(df, columns, k).collect()}


def texts_with_ties():
    rng = random.Random(3)
    shared = "the same first characters for every text of this kind, and then "
    rows = [shared + "x" * 80 + str(i) for i in range(300)] * 2 + [shared + "often " + "y" * 90] * 500
    rows += ["é" * 70, "é" * 31 + "z" * 60, "short", "short", "", "", "", None] * 2 + ["w" * 63, "w" * 64, "w" * 65]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_top_values_with_ties_and_long_texts(spark, k):
    rows = texts_with_ties()
    df = spark.createDataFrame([(t, str(i % 3)) for i, t in enumerate(rows)], "`a.b` string, `column` string").repartition(5)
    assert found(df, ["a.b", "column"], k) == {"a.b": ranked(rows, k), "column": ranked([str(i % 3) for i in range(len(rows))], k)}


def test_top_values_beyond_the_lookup(spark, monkeypatch):
    monkeypatch.setattr(statistics, "LOOKUP_DIGESTS", 3)
    rows = texts_with_ties()
    assert found(spark.createDataFrame([(t,) for t in rows], "t string"), ["t"], 40)["t"] == ranked(rows, 40)


def test_top_values_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert found(df, ["t"], 3) == {} and found(df.limit(0), ["t"], 3) == {}


def test_counting_moves_no_full_text(spark, sf_dir):
    counted = statistics.value_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["text"])
    exchanged = [p for p in plan_of(counted).split("\n\n") if ") Exchange" in p]
    assert len(exchanged) == 1 and "[value#" in exchanged[0] and "text#" not in exchanged[0]
    assert max(len(r["value"]) + len(r["head"]) for r in counted.collect()) <= 64 + statistics.HEAD


@pytest.mark.parametrize("n", [0, 1, 7, 650, 999, 1000, 5000])
def test_sample_is_the_smallest_digests(spark, n):
    """A third of all rows are equal and the cut may fall among them."""
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "CASE WHEN id % 3 = 0 THEN NULL ELSE id / 7 END AS v")
    rows = df.withColumn("at", files.row_digest(df, 42)).collect()
    expected = Counter((r["k"], r["v"]) for r in sorted(rows, key=lambda r: r["at"])[:n])
    assert Counter(map(tuple, files.exact_sample(df.repartition(6), n).collect())) == expected


def test_cut_among_equal_rows(spark):
    df = spark.range(900).selectExpr("'same' AS digest", "CAST(NULL AS INT) AS v")
    picked = files.exact_sample(df, 350)
    assert picked.columns == ["digest", "v"] and Counter(map(tuple, picked.collect())) == {("same", None): 350}


def test_sample_by_a_given_order_takes_ties_by_row(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    first, again = (files.exact_sample(df.repartition(p), 30, order=F.md5(F.col("g").cast("string"))).collect() for p in (1, 7))
    assert sorted(first) == sorted(again) and len(first) == 30 and len({r["g"] for r in first}) == 2


def test_nulls_and_empty_texts_have_digests_of_their_own(spark):
    df = spark.createDataFrame([(None, ""), ("", None), ("1:a", "b"), ("1", "a1:b")], "a string, b string")
    assert df.select(files.row_digest(df, 1)).distinct().count() == 4


def test_empty_table(spark):
    assert files.exact_sample(spark.createDataFrame([], "a int"), 5).collect() == []
