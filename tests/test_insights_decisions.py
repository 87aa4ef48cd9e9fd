from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallylens import schemas
from tallylens.operators import critic, decisions, insights, numbering
from tallylens.operators.critic import Plausible

INSIGHT = (
    f"place int, id string, type string, severity string, title string, explanation string, evidence {schemas.EVIDENCE}, "
    "affected_columns array<string>, confidence double, actionable boolean"
)
LONG = "these are fifteen words that explain what was found in the column of the table today"


def insight(spark, **given):
    row = {
        "place": 1, "id": "INS-001", "type": "anomaly", "severity": "warning", "title": "3 odd values", "explanation": LONG,
        "evidence": [("max_z_score", 3.0, None, "x")], "affected_columns": ["x"], "confidence": 0.0, "actionable": True, **given}
    return spark.createDataFrame([tuple(row.values())], INSIGHT)


def verdict(spark, **given):
    return critic.verdicts(insight(spark, **given), ["x", "y"], {"x": Plausible(10.0, 1.0, 5.0, 15.0)}).head()


def test_full_marks(spark):
    row = verdict(spark, evidence=[("peak", 12.0, None, "x")])
    assert (row["passed"], row["confidence_score"], row["flags"], row["rejection_reason"]) == (True, 1.0, [], None)


@pytest.mark.parametrize("given, score, flags", [
    ({"title": "odd values"}, 0.95, []),
    ({"title": "possibly 3 odd values"}, 0.6, ["vague_title_language"]),
    ({"title": "**3** values"}, 0.6, ["markdown_in_title"]),
    ({"title": "1 " + "w " * 20}, 0.6, ["title_too_long: 21 words"]),
    ({"explanation": "too short"}, 0.65, ["explanation_too_short: 2 words"]),
    ({"explanation": LONG + " it could be unclear"}, 0.65, ["too_vague: 2 vague phrases"]),
    ({"explanation": LONG + " it could be"}, 1.0, []),
    ({"evidence": []}, 0.65, ["no_evidence_attached"]),
])
def test_scoring(spark, given, score, flags):
    row = verdict(spark, **{"evidence": [("peak", 12.0, None, "x")], **given})
    assert (row["confidence_score"], row["flags"]) == (score, flags)


def test_missing_column_blocks(spark):
    row = verdict(spark, affected_columns=["x", "nope", "gone"], evidence=[("peak", 12.0, None, "x")])
    assert row["flags"] == ["column_not_in_data: ['nope', 'gone']"] and not row["passed"]
    assert row["rejection_reason"] == "Critical flag: column_not_in_data: ['nope', 'gone']"


@pytest.mark.parametrize("evidence, flags", [
    (("peak", 16.0, None, "x"), ["evidence_value_implausible: peak=16.0"]),
    (("peak", 14.0, None, "x"), []),
    (("peak", 10.4, None, "x"), []),
    (("mean", 99.0, None, "x"), []),
    (("peak", 99.0, None, "y"), []),
    (("peak", None, "$1,600", "x"), ["evidence_value_implausible: peak=1600.0"]),
    (("peak", None, "many", "x"), ["invalid_numeric_evidence: peak"]),
])
def test_evidence(spark, evidence, flags):
    assert verdict(spark, evidence=[evidence])["flags"] == flags
    assert verdict(spark, evidence=[evidence], type="distribution")["flags"] == []


def test_penalty_is_capped(spark):
    row = verdict(spark, title="**possibly** " + "w " * 20, explanation="short", evidence=[])
    assert len(row["flags"]) == 5 and row["confidence_score"] == 0.0


def test_report(spark):
    verdicts = spark.createDataFrame(
        [("a", True, 0.9, None, []), ("b", False, 0.4, "Score too low: 0.4", ["no_evidence_attached"])],
        "insight_id string, passed boolean, confidence_score double, rejection_reason string, flags array<string>")
    row = critic.critic_report(verdicts).head()
    assert (row["passed_count"], row["rejected_count"], row["flagged_count"], row["overall_quality"]) == (1, 1, 1, 0.9)
    assert not row["needs_human_review"] and not row["retry_recommended"] and row["retry_reason"] is None
    row = critic.critic_report(verdicts.where("NOT passed")).head()
    assert row["retry_recommended"] and row["retry_reason"] == "Only 0/1 insights passed with avg quality 0.00"
    row = critic.critic_report(verdicts.limit(0)).head()
    assert row["overall_quality"] == 0.0 and not row["retry_recommended"]


def test_both_ways_to_keep_passed_insights_agree(spark):
    df = insight(spark, evidence=[("peak", 12.0, None, "x")]).unionAll(insight(spark, id="INS-002", affected_columns=["z"]))
    judged = critic.judged(df, ["x"], {})
    joined = critic.passed_insights(df, critic.verdicts(df, ["x"], {}))
    assert critic.accepted(judged).collect() == joined.collect()
    assert [r["id"] for r in joined.collect()] == ["INS-001"]


@pytest.mark.parametrize("kind, severity, title, action, kpi", [
    ("anomaly", "critical", "x", "investigate", "anomaly_resolution_rate"),
    ("summary", "warning", "NULL rate", "fix", "data_completeness_pct"),
    ("summary", "warning", "other", "investigate", "issue_resolution_rate"),
    ("trend", "critical", "Declining and increasing", "escalate", "monthly_revenue_growth"),
    ("trend", "critical", "increasing", "monitor", "fulfillment_rate"),
    ("trend", "critical", "flat", "escalate", "business_health_score"),
    ("distribution", "warning", "Cancelled and pending", "fix", "cancellation_rate"),
    ("distribution", "info", "x", "monitor", "distribution_stability"),
    ("comparison", "info", "x", "monitor", "kpi_dashboard"),
    ("comparison", "odd", "x", "monitor", "kpi_dashboard"),
])
def test_first_matching_rule(spark, kind, severity, title, action, kpi):
    row = insight(spark, type=kind, severity=severity, title=title).select(decisions.matching_action().alias("a")).head()["a"]
    assert (row["action_type"], row["kpi"]) == (action, kpi)


def test_decisions_are_numbered_then_ranked(spark):
    df = insight(spark, id="A", severity="info", actionable=False, place=1).unionAll(
        insight(spark, id="B", severity="info", type="comparison", place=2)).unionAll(
        insight(spark, id="C", severity="critical", confidence=1.0, place=3))
    rows = decisions.decisions_for(df).collect()
    assert [(r["id"], r["insight_id"], r["priority_score"]) for r in rows] == [("DEC-002", "C", 1.0), ("DEC-001", "B", 0.2)]
    assert rows[0]["title"] == "Address 3 odd values" and rows[0]["why"] == LONG
    made = decisions.decisions_for(df)
    assert [r["id"] for r in made.where(decisions.is_quick_win()).collect()] == ["DEC-002"]
    assert [(r["effort"], r["impact"]) for r in decisions.effort_impact(made).collect()] == [(1, 3), (1, 1)]
    assert decisions.effort_impact(made.limit(1)).count() == 0
    assert decisions.action_summary(made, "shop").head()["n"] == 2


def test_severity_breakdown_keeps_zeros(spark):
    rows = decisions.severity_breakdown(insight(spark)).collect()
    assert [(r["severity"], r["n"], len(r["bar"])) for r in rows] == [("critical", 0, 0), ("warning", 1, 20), ("info", 0, 0)]
    assert sum(r["n"] for r in decisions.severity_breakdown(insight(spark).limit(0)).collect()) == 0


def test_rows_are_numbered_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ONE_TASK_ROWS", 100)
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("v")).repartition(11)
    rows = numbering.number_rows(df, "k", "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 5001))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_evidence_values(spark):
    one = spark.createDataFrame([([1.0, 2.0, 6.0], [], {"max": 9.0, "median": 4.0}, {"other": 1.0})],
                                "a array<double>, b array<double>, c map<string,double>, d map<string,double>")
    row = one.select(insights.list_value(F.col("a")), insights.list_value(F.col("b")), insights.map_value(F.col("c")),
                     insights.map_value(F.col("d"))).head()
    assert list(row) == [3.0, 0.0, 4.0, None]


def test_all_findings_become_numbered_insights(spark):
    rows = [(i, "distribution", ["c"], s, False, {"mean": 1.0, "std": 2.0, "outlier_pct": 0.05, "q1": 0.0, "q3": 1.0, "outlier_count": 5.0},
             {}, []) for i, s in enumerate(["info"] * 7 + ["warning", "critical"] + ["info"] * 3)]
    found = insights.insights_from(spark.createDataFrame(rows, schemas.FINDING)).collect()
    assert [r["id"] for r in found] == [f"INS-{i:03d}" for i in range(1, 13)]
    assert [r["severity"] for r in found] == ["critical", "warning"] + ["info"] * 10
    assert insights.insights_from(spark.createDataFrame(rows, schemas.FINDING), most=8).count() == 8
    worst = spark.createDataFrame([(*r[:3], "critical", *r[4:]) for r in rows], schemas.FINDING)
    assert insights.insights_from(worst).where("severity = 'critical'").count() == 12
    assert found[0]["title"] == "Outliers make up 5.0% of c"
    assert [e["metric"] for e in found[0]["evidence"]] == ["mean", "std", "skew", "kurtosis"]
    assert all(len(r["explanation"].split()) >= critic.MIN_EXPLANATION_WORDS for r in found)
