"""From a table to findings, insights, decisions and chart plans."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.operators.charts import chart_plans
from tallylens.operators.columnwise import pinned
from tallylens.operators.critic import critic_report, passed_insights, plausible_ranges, verdicts
from tallylens.operators.decisions import action_summary, decisions_for, is_quick_win
from tallylens.operators.facts import numeric_columns
from tallylens.operators.insights import executive_summary, insights_from
from tallylens.operators.statistics import full_analysis
from tallylens.plans.ingest import Ingested, ingest


@dataclass(frozen=True)
class Analysis:
    """All results of one run; each is a small local relation."""

    findings: DataFrame
    insights: DataFrame
    verdicts: DataFrame
    report: DataFrame
    validated: DataFrame
    decisions: DataFrame
    plans: DataFrame
    summary: DataFrame
    action_summary: DataFrame
    processing_ms: int = 0


def analyze(df: DataFrame, domain: str = "unknown", row_count: int | None = None, exact: bool = True) -> Analysis:
    """Findings, insights, verdicts, decisions and plans of a clean table.

    Everything after the findings works on one row per finding, so those steps
    are kept as local relations and cost no further scan. Validation
    reads the columns that have single values as evidence.
    """
    begun = time.monotonic()
    rows = df.count() if row_count is None else row_count
    findings = full_analysis(df, exact)
    insights = pinned(insights_from(findings))
    quoted = sorted({
        e["column"] for r in insights.collect() if r["type"] in ("anomaly", "trend") for e in r["evidence"]
        if e["column"] in df.columns
    })
    ranges = plausible_ranges(df, [c for c in numeric_columns(df) if c in quoted])
    checked = pinned(verdicts(insights, df.columns, ranges))
    validated = pinned(passed_insights(insights, checked).orderBy("place"))
    decisions = pinned(decisions_for(validated, at_most=insights.count()))
    return Analysis(
        findings, insights, checked, critic_report(checked), validated, decisions, chart_plans(validated),
        executive_summary(insights, domain, rows), action_summary(decisions, domain), int((time.monotonic() - begun) * 1000))


def document(ingested: Ingested, analysis: Analysis) -> DataFrame:
    """One nested row with the whole result, ready for ``write.json``.

    ``total_insights`` counts the listed insights, ``top_priority`` is the first decision (null without one), ``df_path``
    is where the cleaned table lies, and ``processing_ms`` the time of both steps as far as they ran at once. No step is
    ever tried again with other wording, so ``retry_was_used`` is false.
    """
    def listed(frame: DataFrame, *order: Column) -> Column:
        """All rows of a small result as an array, in the given order."""
        keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
        rows = frame.select(F.struct(*keys, F.struct(*frame.columns).alias("row")).alias("entry"))
        return rows.agg(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["row"])).scalar()

    def single(frame: DataFrame) -> Column:
        return frame.select(F.struct(*frame.columns)).scalar()

    insights = analysis.validated.drop("stat_type", "metrics", "labels", "series")
    ranked = (-F.col("priority_score"), F.col("id"))
    report = analysis.report.withColumn("retry_was_used", F.lit(False))
    made = ingested.context.select(
        F.lit(True).alias("success"), "domain", "source_type", F.col("row_count").alias("total_rows"), "warnings",
        analysis.summary.select("summary").scalar().alias("executive_summary"),
        listed(insights, F.col("place")).alias("insights"),
        single(ingested.quality).alias("quality"),
        single(report).alias("critic"),
        listed(ingested.profile).alias("columns"),
        listed(analysis.decisions, *ranked).alias("decisions"),
        listed(analysis.decisions.where(is_quick_win()), *ranked).alias("quick_wins"),
        analysis.action_summary.select("summary").scalar().alias("action_summary"),
        listed(analysis.plans, F.col("insight_id")).alias("chart_plans"),
        F.lit(ingested.processing_ms + analysis.processing_ms).alias("processing_ms"),
        F.lit(ingested.table_path).alias("df_path"), F.current_timestamp().alias("analysed_at"))
    return made.select(
        "*", F.size("insights").alias("total_insights"), F.try_element_at("decisions", F.lit(1)).alias("top_priority"))


def run(spark: SparkSession, path: str, **options) -> tuple[Ingested, Analysis]:
    """Read, clean and analyse a file."""
    ingested = ingest(spark, path, **options)
    return ingested, analyze(ingested.table, ingested.domain, ingested.row_count)
