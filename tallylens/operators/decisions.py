"""Ranked actions for insights, from an ordered rule table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.functions.numbers import round_to
from tallylens.operators.columnwise import col, small_frame
from tallylens.operators.multiset import fresh_name
from tallylens.operators.numbering import number_rows
from tallylens.schemas import RULE_TABLE, ddl

RULES_AT_ONCE = 10_000


@dataclass(frozen=True)
class Action:
    action_type: str
    impact_level: str
    effort_level: str
    owner: str
    kpi: str
    boost: float


@dataclass(frozen=True)
class Rule:
    """Applies to insights of a type and severity whose title has the keyword."""

    type: str
    severity: str
    keyword: str | None
    action: Action


# The rule table, in order of preference.
RULES = (
    Rule("anomaly", "critical", None,
         Action("investigate", "high", "low", "Data Engineering", "anomaly_resolution_rate", 0.3)),
    Rule("anomaly", "warning", None,
         Action("investigate", "medium", "low", "Data Engineering", "anomaly_resolution_rate", 0.2)),
    Rule("summary", "critical", "null",
         Action("fix", "high", "medium", "Data Engineering", "data_completeness_pct", 0.25)),
    Rule("summary", "warning", "null",
         Action("fix", "medium", "low", "Data Engineering", "data_completeness_pct", 0.15)),
    Rule("trend", "critical", "declin",
         Action("escalate", "high", "medium", "Product / Marketing", "monthly_revenue_growth", 0.35)),
    Rule("trend", "warning", "declin",
         Action("optimise", "medium", "medium", "Marketing", "conversion_rate", 0.2)),
    Rule("trend", "critical", "increas",
         Action("monitor", "medium", "low", "Operations", "fulfillment_rate", 0.1)),
    Rule("distribution", "warning", "cancel",
         Action("fix", "high", "medium", "Product / CX", "cancellation_rate", 0.3)),
    Rule("distribution", "warning", "pending",
         Action("investigate", "medium", "low", "Operations", "order_fulfillment_rate", 0.15)),
    Rule("correlation", "info", None,
         Action("optimise", "medium", "medium", "Analytics", "revenue_per_order", 0.05)),
    Rule("distribution", "info", None,
         Action("monitor", "low", "low", "Analytics", "distribution_stability", 0.0)),
)
FALLBACKS = {
    "critical": Action("escalate", "high", "medium", "Leadership", "business_health_score", 0.25),
    "warning": Action("investigate", "medium", "low", "Operations", "issue_resolution_rate", 0.10),
    "info": Action("monitor", "low", "low", "Analytics", "kpi_dashboard", 0.0),
}
SEVERITY_BASE = {"critical": 0.7, "warning": 0.5, "info": 0.2}
DEFAULT_WHAT = "Find out why the data looks like this, then decide what to change."
DEFAULT_IMPACT = "Figures that later reports can rely on."
DEFAULT_RISK = "Left alone, the effect stays in every later report."


def _as_struct(action: Action) -> Column:
    return F.struct(*[F.lit(getattr(action, k)).alias(k) for k in Action.__dataclass_fields__])


def matching_action(
    rules: Sequence[Rule] = RULES, fallbacks: Mapping[str, Action] = FALLBACKS,
    kind: str = "type", severity: str = "severity", title: str = "title",
) -> Column:
    """The action of the first rule that fits, else of the severity.

    The rule table is small and fixed when the plan is built, so it becomes one
    conditional expression and insights need no join, sort or shuffle.
    """
    low = F.lower(F.col(title))
    out = _as_struct(fallbacks["info"])
    for name, action in fallbacks.items():
        out = F.when(F.col(severity) == name, _as_struct(action)).otherwise(out)
    for rule in reversed(rules):
        fits = (F.col(kind) == rule.type) & (F.col(severity) == rule.severity)
        if rule.keyword is not None:
            fits = fits & F.coalesce(low.contains(rule.keyword), F.lit(False))
        out = F.when(F.coalesce(fits, F.lit(False)), _as_struct(rule.action)).otherwise(out)
    return out


def rules_table(
    spark: SparkSession, rules: Sequence[Rule] = RULES, fallbacks: Mapping[str, Action] = FALLBACKS
) -> DataFrame:
    """The rules as a table for :func:`match_rules`: a null type or severity fits all, ``place`` gives the order."""
    rows = [{"type": r.type, "severity": r.severity, "keyword": r.keyword, **asdict(r.action)} for r in rules]
    rows += [{"severity": s, **asdict(a)} for s, a in fallbacks.items()] + [asdict(fallbacks["info"])]
    return small_frame(spark, [{"place": i, **r} for i, r in enumerate(rows)], ddl(RULE_TABLE))


def match_rules(
    insights: DataFrame, rules: DataFrame, kind: str = "type", severity: str = "severity", title: str = "title",
    at_once: int = RULES_AT_ONCE,
) -> DataFrame:
    """The insights with the action ``act`` of the first rule of a table that fits (J4, J5), null if none does.

    ``rules`` has the columns of :func:`rules_table` and a ``place`` of its own in each row. It reaches the tasks as one
    sorted array from a scalar subquery, so insights are neither exchanged nor multiplied. A table of more than
    ``at_once`` rules goes in several arrays. A null severity or type of an insight fits only rules that leave it
    open; a null title holds no keyword.
    """
    columns = ddl(RULE_TABLE).fieldNames()
    size, low = rules.count(), F.lower(col(title))
    given = rules.select(*columns) if size <= at_once else number_rows(rules.select(*columns), "place", "rank")
    found, held = [], {}
    for start in range(0, max(size, 1), at_once):
        part = given if size <= at_once else given.where(F.col("rank").between(start + 1, start + at_once))
        table = part.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rules")).scalar()
        name = fresh_name(insights, f"rules_{start}")
        held[name] = table
        first = F.try_element_at(F.filter(col(name), lambda r: (
            F.coalesce(r["type"] == col(kind), r["type"].isNull())
            & F.coalesce(r["severity"] == col(severity), r["severity"].isNull())
            & F.coalesce(low.contains(r["keyword"]), r["keyword"].isNull()))), F.lit(1))
        found.append(F.when(F.isnotnull(first), F.struct(*[first[k].alias(k) for k in Action.__dataclass_fields__])))
    return insights.withColumns(held).withColumn("act", F.coalesce(*found)).drop(*held)


def needs_decision() -> Column:
    """Actionable, or of critical or warning severity (P10)."""
    return F.col("actionable") | F.col("severity").isin("critical", "warning")


def priority_score(severity: Column, boost: Column, confidence: Column) -> Column:
    """Base of the severity, rule boost and a tenth of the confidence, at most 1."""
    base = F.lit(SEVERITY_BASE["info"])
    for name, value in SEVERITY_BASE.items():
        base = F.when(severity == name, F.lit(value)).otherwise(base)
    return round_to(F.least(F.lit(1.0), base + boost + confidence * 0.1), 3)


def decisions_for(
    insights: DataFrame, rules: Sequence[Rule] = RULES, order: str = "place", at_most: int | None = None
) -> DataFrame:
    """One ranked action per insight that needs one.

    ``order`` is the column that holds the order of the insights; ids count the
    chosen insights in that order. ``at_most`` states a known bound on their
    number and avoids counting them first.
    """
    chosen = insights.where(needs_decision()).select(
        "id", order, "severity", "confidence", matching_action(rules).alias("act"),
        "title", F.col("explanation").alias("why"))
    numbered = number_rows(chosen, order, "number", at_most)
    made = numbered.select(
        F.format_string("DEC-%03d", "number").alias("id"), F.col("id").alias("insight_id"), "act.action_type",
        F.concat(F.lit("Address "), F.col("title")).alias("title"), F.lit(DEFAULT_WHAT).alias("what"), "why", F.lit(DEFAULT_IMPACT).alias("expected_impact"),
        F.lit(DEFAULT_RISK).alias("risk_if_ignored"), "act.impact_level", "act.effort_level", "act.owner", "act.kpi",
        priority_score(F.col("severity"), F.col("act.boost"), F.col("confidence")).alias("priority_score"), "number")
    return made.orderBy(F.desc("priority_score"), "number").drop("number")


def is_quick_win() -> Column:
    """High or medium impact for low effort."""
    return F.col("impact_level").isin("high", "medium") & (F.col("effort_level") == "low")


def action_summary(decisions: DataFrame, domain: str) -> DataFrame:
    """Two sentences over the three most urgent actions."""
    top = decisions.orderBy(F.desc("priority_score"), "id").limit(3)
    ranked = top.agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct((-F.col("priority_score")).alias("minus"), "id", "title", "impact_level")))
        .alias("ranked"))
    lines = F.transform("ranked", lambda d: F.concat(F.lit("["), F.upper(d["impact_level"]), F.lit("] "), d["title"]))
    return ranked.select("n", F.when(F.col("n") > 0, F.concat(
        F.lit(f"For this {domain} table, the first action is: "), F.try_element_at(lines, F.lit(1)),
        F.lit(". The most urgent actions are "), F.array_join(lines, "; "), F.lit("."))).otherwise("").alias("summary"))


def severity_breakdown(insights: DataFrame) -> DataFrame:
    """Insights per severity with zeros kept, and a bar of up to 20 blocks."""
    counts = insights.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_BASE], F.count("*").alias("total"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"), F.col(s).alias("n")) for i, s in enumerate(SEVERITY_BASE)
    ])
    share = F.col("n") / F.greatest(F.col("total"), F.lit(1))
    return counts.select("total", F.inline(rows)).select(
        "rank", "severity", "n", F.repeat(F.lit("█"), F.floor(share * 20).cast("int")).alias("bar")).orderBy("rank")


def effort_impact(decisions: DataFrame) -> DataFrame:
    """Effort and impact as 1 to 3; empty unless there are at least two decisions."""
    level = F.create_map(F.lit("low"), F.lit(1), F.lit("medium"), F.lit(2), F.lit("high"), F.lit(3))
    points = decisions.select(
        "id", "title",
        F.coalesce(F.try_element_at(level, F.col("effort_level")), F.lit(2)).alias("effort"),
        F.coalesce(F.try_element_at(level, F.col("impact_level")), F.lit(2)).alias("impact"),
        F.col("priority_score").alias("priority"), "action_type", F.coalesce("owner", F.lit("—")).alias("owner"))
    return points if len(decisions.select("id").head(2)) == 2 else points.where(F.lit(False))
