from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_multiset import plan_of

from tallylens.catalog import QUERIES
from tallylens.fixtures import document_insights, table
from tallylens.functions.text import ascii_words, leading_word, short_title, title_and_rest
from tallylens.operators import decisions, domain
from tallylens.schemas import RULE_TABLE, ddl

INSIGHT = "id string, type string, severity string, title string, act string"


def rule(place, type=None, severity=None, keyword=None, owner="x"):
    return (place, type, severity, keyword, "fix", "low", "low", owner, "k", 0.1)


def first_fit(rules, row):
    for r in sorted(rules):
        if (r[1] in (None, row[1])) and (r[2] in (None, row[2])) and (r[3] is None or (row[3] is not None and r[3] in row[3].lower())):
            return r[7]
    return None


@pytest.mark.parametrize("at_once", [100, 2])
def test_first_rule_of_a_table_wins(spark, at_once):
    rules = [rule(7, "a", owner="late"), rule(1, "a", "info", "ab", "one"), rule(3, None, "info", owner="three"),
             rule(2, "b", None, "", "two"), rule(5, None, "warning", "ü", "five")]
    rows = [(str(i), t, s, k, "old") for i, (t, s, k) in enumerate(
        (t, s, k) for t in ("a", "b", None) for s in ("info", "warning", None) for k in ("xABx", "Ü", "", None))]
    rows += rows[:3]
    found = decisions.match_rules(
        spark.createDataFrame(rows, INSIGHT), spark.createDataFrame(rules, ddl(RULE_TABLE)), at_once=at_once)
    assert found.columns == ["id", "type", "severity", "title", "act"]
    assert sorted((r["id"], r["act"] and r["act"]["owner"]) for r in found.collect()) == sorted(
        ((r[0], first_fit(rules, r)) for r in rows), key=lambda v: (v[0], v[1] or ""))


def test_table_of_the_fixed_rules_gives_the_same_actions(spark, sf_dir):
    insights = document_insights(spark, sf_dir).select("id", "type", "severity", "title")
    by_table = decisions.match_rules(insights, decisions.rules_table(spark))
    by_code = insights.withColumn("act", decisions.matching_action())
    assert sorted(by_table.select("id", "act").collect()) == sorted(by_code.select("id", "act").collect())
    assert "Exchange" not in plan_of(decisions.match_rules(
        table(spark, sf_dir, "events").selectExpr("event_type AS type", "event_type AS severity", "props AS title"),
        decisions.rules_table(spark))).split("Subqueries")[0]


def test_no_rules(spark):
    rows = spark.createDataFrame([("1", "a", "info", "t", "")], INSIGHT)
    assert decisions.match_rules(rows, spark.createDataFrame([], ddl(RULE_TABLE))).head()["act"] is None


def test_domains_from_tables(spark):
    signatures = domain.signatures_table(spark, {"b": ["x", "y"], "a": ["X", "y", "z"], "c": ["q"]})
    held = spark.createDataFrame(
        [("s", "X"), ("s", "x"), ("s", "y"), ("t", "z"), ("u", None), ("v", "other"), (None, "q")], "source string, name string")
    found = {r["source"]: (r["domain"], round(r["score"], 6)) for r in domain.match_domains(held, signatures).collect()}
    assert found == {"s": ("b", 1.0), "t": ("a", 0.333333), "u": ("unknown", 0.0), "v": ("unknown", 0.0), None: ("c", 1.0)}
    assert domain.match_domains(held.limit(0), signatures).count() == 0
    assert {r["domain"] for r in domain.match_domains(held, signatures.limit(0)).collect()} == {"unknown"}


def test_words_of_documents_without_a_split(spark, sf_dir):
    texts = ["Order_id, the  end.", " x", "", "...", "é", "été à la", "_a1b\nC", "日本 one", "a😀b", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cut = F.split("text", "[^A-Za-z_]+")
    found = rows.select(ascii_words(F.col("text")).alias("all"), leading_word(F.col("text")).alias("one"), cut.alias("cut")).collect()
    for r in found:
        assert r["one"] == (r["cut"] and r["cut"][0])
        assert (r["all"] and [w for w in r["all"] if w]) == (r["cut"] and [w for w in r["cut"] if w]) and (r["all"] is None or "" in r["all"])
    assert "split(text" not in plan_of(QUERIES["domain_match_table"](spark, sf_dir))


def test_sources_without_words_are_kept(spark, tmp_path):
    rows = [(1, "the price", "en", "a"), (2, "... 12", "en", "b"), (3, "", "fr", "c"), (4, None, "fr", "d"), (5, "THE end", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["source"]: (r["domain"], r["score"]) for r in QUERIES["domain_match_table"](spark, str(tmp_path)).collect()}
    assert found["a"] == found[None] == ("first_en", 1.0) and found["b"] == found["c"] == ("unknown", 0.0) and "d" not in found


def test_unused_columns_of_documents_are_not_read(spark, sf_dir):
    def read(df):
        return [p.split("ReadSchema: ")[1].split("\n")[0] for p in plan_of(df).split("\n\n") if "documents.parquet" in p and "ReadSchema" in p]

    severities = read(decisions.severity_breakdown(document_insights(spark, sf_dir)))
    assert severities and all("text" not in s and "lang" not in s for s in severities)
    titles = title_and_rest(table(spark, sf_dir, "documents"), "text", "title", "rest").select("doc_id", short_title("title"))
    assert read(titles) == ["struct<doc_id:bigint,text:string>"]
