from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallylens.functions import names, text
from tallylens.functions.numbers import number_from_text, p_value, round_to


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).head()[0]


@pytest.mark.parametrize("given, wanted", [
    ("2024-03-05", "2024-03-05"), ("2024-3-5", "2024-03-05"), (" 05/03/2024 ", "2024-03-05"), ("03/25/2024", "2024-03-25"),
    ("04/05/2024", "2024-05-04"), ("2024-03-05T10:20:30", "2024-03-05"), ("05-03-2024", "2024-03-05"),
    ("2024-03-05T10:20:30.123456", "2024-03-05T10:20:30.123456"), ("2024-02-30", "2024-02-30"), ("soon", "soon"),
    ("\t2024-03-05\n", "2024-03-05"), ("2024-03-05T25:00:00", "2024-03-05T25:00:00"), ("31/31/2024", "31/31/2024"), (None, None),
])
def test_iso_date(spark, given, wanted):
    assert one(spark, given, text.iso_date) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("$1,234.50", 1234.5), ("£ 7", 7.0), ("€9.1", 9.1), ("12", 12.0), ("abc", None), ("1d", None), ("", None), ("-3.5", -3.5),
    ("1e3", 1000.0), (None, None),
])
def test_currency(spark, given, wanted):
    assert one(spark, given, text.currency) == wanted


def test_number_from_text(spark):
    assert one(spark, "$1,234", number_from_text) == 1234.0
    assert one(spark, "n/a", number_from_text) is None


@pytest.mark.parametrize("given, wanted", [
    ("2024-03-05 10:00", "2024-03-05"), ("2024-03-05T1", "2024-03-05"), ("05/03/2024", None), ("2024-13-01", None)])
def test_leading_date(spark, given, wanted):
    found = one(spark, given, text.leading_date)
    assert (found.isoformat() if found else None) == wanted


def test_words_and_titles(spark):
    assert one(spark, "  a\tb\n c ", text.word_count) == 3
    assert one(spark, "   ", text.word_count) == 0
    assert one(spark, "it could be unclear", text.vague_phrase_count) == 2
    assert one(spark, "a b c d e f g", text.short_title) == "a b c d e f g"
    assert one(spark, "a b c d e f g h", text.short_title) == "a b c d e f g…"
    assert one(spark, "unit_price", text.column_label) == "Unit Price"


def test_reply_lines(spark):
    replies = ["\n **Sales up** \n\nfirst *line*\r\nsecond\n", "only", " \n "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = text.title_and_rest(df, "reply", "title", "rest").orderBy("i").collect()
    assert [(r["title"], r["rest"]) for r in rows] == [("Sales up", "first line second"), ("only", "only"), (None, None)]


@pytest.mark.parametrize("reply, wanted", [
    ('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('```\n{"k": 3}```', 3), ('Sure: {"k": 4} done', 4), ("nothing", None)])
def test_record_from_json(spark, reply, wanted):
    found = one(spark, reply, lambda c: text.record_from_json(c, "k long"))
    assert (found.k if found else None) == wanted


@pytest.mark.parametrize("value, digits", [(0.125, 2), (0.375, 2), (1.005, 2), (-0.125, 2), (1234.5678, 3), (0.0, 4)])
def test_rounding_follows_python(spark, value, digits):
    assert one(spark, value, lambda c: round_to(c, digits), "double") == round(value, digits)


def beta_tail(r: float, n: int) -> float:
    """Regularised incomplete beta by midpoint sums, as an independent check."""
    a, x, steps = (n - 2) / 2, 1 - r * r, 400_000
    top = (1 - math.sqrt(1 - x)) if x < 1 else 1.0
    front = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5))
    # u = 1 - (1 - s)^2 removes the singularity at 1
    total = sum(
        2 * (1 - (1 - s) ** 2) ** (a - 1) for s in ((i + 0.5) / steps * top for i in range(steps))) * top / steps
    return front * total


@pytest.mark.parametrize("r, n", [(0.5, 10), (0.1, 80), (-0.3, 25), (0.02, 5000), (0.9, 6)])
def test_p_value_matches_beta_tail(spark, r, n):
    found = spark.createDataFrame([(r, n)], "r double, n long").select(p_value("r", "n")).head()[0]
    assert found == pytest.approx(beta_tail(r, n), rel=1e-4)


@pytest.mark.parametrize("t, dof, p", [(12.7062, 1, 0.05), (2.22814, 10, 0.05), (4.58689, 10, 0.001), (2.61742, 120, 0.01)])
def test_p_value_matches_tables(spark, t, dof, p):
    r = t / math.sqrt(t * t + dof)
    found = spark.createDataFrame([(r, dof + 2)], "r double, n long").select(p_value("r", "n")).head()[0]
    assert found == pytest.approx(p, rel=1e-4)


def test_p_value_limits(spark):
    rows = spark.createDataFrame([(1.0, 9), (0.0, 9), (0.4, 2), (None, 9)], "r double, n long").select(p_value("r", "n")).collect()
    assert [r[0] for r in rows] == [0.0, pytest.approx(1.0), 1.0, None]


def test_name_rules():
    assert all(map(names.not_analytic, ["order_id", "paid", "Index", "latitude", "plate", "zip_code", "event_time", "row_key"]))
    assert not any(map(names.not_analytic, ["quantity", "total_amount", "order_date", "indexed"]))
    assert names.skip_in_chart("user_id") and names.skip_in_chart("postal") and not names.skip_in_chart("width")
    assert names.normalised([" Unit  Price", "Status "]) == ["unit_price", "status"]
    with pytest.raises(ValueError):
        names.normalised(["a b", "A  B"])


@pytest.mark.parametrize("name, is_text, dollar, tag", [
    ("unit_price", False, False, "currency"), ("note", True, True, "currency"), ("order_date", True, False, "date"),
    ("status", True, False, "date"), ("category", True, False, "date"), ("user_id", False, False, "id"),
    ("kind", True, False, "category"), ("email", True, False, "email"), ("city", True, False, "geo"), ("size", False, False, None)])
def test_semantic_tag(name, is_text, dollar, tag):
    assert names.semantic_tag(name, is_text, True, dollar) == tag


def test_stricter_names_hold_an_id_mark_anywhere():
    assert [n for n in ("row_hash", "HASH", "sort_key_2", "uuid_of", "price") if names.not_useful(n)] == ["row_hash", "HASH", "sort_key_2", "uuid_of"]
    assert not names.not_analytic("row_hash")
