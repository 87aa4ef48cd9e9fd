"""Findings to insights: typed, titled, explained and backed by evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylens import schemas
from tallylens.functions import text
from tallylens.operators.columnwise import sql_text
from tallylens.operators.statistics import severity_rank

# Insight type per finding type, and the metrics quoted as evidence.
INSIGHT_TYPES = {
    "summary": "summary",
    "time_trend": "trend",
    "anomaly": "anomaly",
    "correlation": "correlation",
    "distribution": "distribution",
    "categorical_distribution": "distribution",
    "high_nulls": "summary",
}
EVIDENCE_METRICS = {
    "high_nulls": ("null_pct", "null_count"),
    "distribution": ("mean", "std", "skew", "kurtosis"),
    "categorical_distribution": ("n_unique", "top_value", "top_pct", "bottom_pct"),
    "time_trend": ("slope", "trend_pct_per_period", "r_squared", "p_value"),
    "correlation": ("pearson_r", "p_value", "strength", "direction"),
    "anomaly": ("n_anomalies", "anomaly_pct", "max_z_score", "anomaly_values"),
}
VALUE_PRIORITY = ("mean", "avg", "median", "value", "count", "sum", "max", "min")


def list_value(values: Column) -> Column:
    """A list as one number: its mean, 0 for an empty list."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def map_value(values: Column) -> Column:
    """A map as one number: the first of mean, avg, median ... that it has."""
    return F.coalesce(*[F.try_element_at(values, F.lit(k)) for k in VALUE_PRIORITY])


def insight_type(stat_type: Column) -> Column:
    """The insight type of a finding type; ``summary`` where unknown."""
    known = F.create_map(*[F.lit(x) for pair in INSIGHT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, stat_type), F.lit("summary"))


def _metric(name: str) -> str:
    return f"try_element_at(metrics, '{name}')"


def _label(name: str) -> str:
    return f"try_element_at(labels, '{name}')"


def evidence() -> Column:
    """The first four metrics of a finding as evidence.

    The summary finding quotes all its columns by their mean; lists are quoted
    by their mean.
    """
    first = "try_element_at(columns, 1)"
    mean = "CASE WHEN size(series) > 0 THEN aggregate(series, 0D, (a, v) -> a + v) / size(series) ELSE 0D END"

    def item(metric: str, number: str, note: str) -> str:
        return f"named_struct('metric', {metric}, 'num', {number}, 'txt', {note}, 'column', {first})"

    cases = " ".join(
        f"WHEN '{kind}' THEN array(" + ", ".join(
            item(f"'{m}'", mean if m == "anomaly_values" else _metric(m), _label(m)) for m in metrics) + ")"
        for kind, metrics in EVIDENCE_METRICS.items())
    summarised = "filter(columns, c -> map_contains_key(metrics, concat(c, '.count')))"
    quoted = item("c", "try_element_at(metrics, concat(c, '.mean'))", "CAST(NULL AS STRING)")
    return F.expr(f"CASE stat_type {cases} ELSE transform({summarised}, c -> {quoted}) END").cast(schemas.EVIDENCE)


def title_and_explanation() -> tuple[Column, Column]:
    """Template wording per finding type; it always carries the numbers."""
    def number(name: str, digits: int = 2) -> str:
        return f"format_number({_metric(name)}, {digits})"

    def percent(name: str) -> str:
        return f"concat(format_number({_metric(name)} * 100, 1), '%')"

    values = {
        "first": "replace(try_element_at(columns, 1), '_', ' ')", "second": "replace(try_element_at(columns, 2), '_', ' ')",
        "width": "CAST(size(columns) AS STRING)", "move": f"if({_label('direction')} = 'up', 'increasing', 'declining')",
        "null_pct": percent("null_pct"), "null_count": number("null_count", 0),
        "outlier_pct": percent("outlier_pct"), "outliers": number("outlier_count", 0), "q1": number("q1"), "q3": number("q3"),
        "mean": number("mean"), "top": _label("top_value"), "top_pct": percent("top_pct"), "bottom_pct": percent("bottom_pct"),
        "uniques": number("n_unique", 0), "pct": number("trend_pct_per_period"), "periods": number("n_periods", 0),
        "slope": number("slope", 4), "fit": number("r_squared", 4), "r": number("pearson_r", 4), "n": number("n", 0),
        "strength": _label("strength"), "direction": _label("direction"), "anomalies": number("n_anomalies", 0),
        "column_mean": number("column_mean"), "furthest": number("max_z_score"),
    }
    wording = {
        "summary": (
            "Overview of {width} numeric columns",
            "The table has {width} numeric columns, and their mean, median, spread and range were computed over "
            "all rows that hold a value."),
        "high_nulls": (
            "Null rate of {null_pct} in {first}",
            "The column {first} has no value in {null_count} rows, a null rate of {null_pct}, so results that rely "
            "on it cover only part of the data."),
        "distribution": (
            "Outliers make up {outlier_pct} of {first}",
            "The middle half of {first} lies between {q1} and {q3}, and {outliers} values fall outside the usual "
            "range around a mean of {mean}."),
        "categorical_distribution": (
            "Value {top} holds {top_pct} of {first}",
            "Among the {uniques} values of {first}, the most frequent one is {top} with {top_pct} of the rows, and "
            "the rarest one has {bottom_pct}."),
        "time_trend": (
            "Monthly rows {move} by {pct}% per period",
            "Over {periods} months the number of rows per month was {move} with a slope of {slope} rows and a fit "
            "of {fit} on a straight line."),
        "correlation": (
            "{first} and {second} correlate at {r}",
            "The columns {first} and {second} show a {strength} {direction} correlation of {r} over {n} rows that "
            "hold both values."),
        "anomaly": (
            "{anomalies} extreme values in {first}",
            "In {first} there are {anomalies} values more than three standard deviations from the mean of "
            "{column_mean}, the furthest one by {furthest} deviations."),
    }

    def filled(template: str) -> str:
        parts = re.split(r"\{(\w+)\}", template)
        return "concat(" + ", ".join(values[p] if i % 2 else sql_text(p) for i, p in enumerate(parts)) + ")"

    def choice(which: int, default: str) -> Column:
        cases = " ".join(f"WHEN '{kind}' THEN {filled(texts[which])}" for kind, texts in wording.items())
        return F.expr(f"CASE stat_type {cases} ELSE {default} END")

    return (
        choice(0, "concat(initcap(replace(stat_type, '_', ' ')), ' in ', array_join(columns, ', '))"),
        choice(1, "'A notable statistical pattern was detected in this data.'"))


def top_findings(findings: DataFrame, most: int | None = None) -> DataFrame:
    """Critical and warning findings first, then the rest; the first ``most`` where only these are shown (L3)."""
    ranked = findings.orderBy(severity_rank(F.col("severity")), "seq")
    return ranked if most is None else ranked.limit(most)


def insights_from(findings: DataFrame, most: int | None = None) -> DataFrame:
    """All findings, or the top ``most``, as insights, numbered ``INS-001`` and up.

    The window sees one row per finding; their number depends on the columns.
    """
    title, explanation = title_and_explanation()
    order = Window.orderBy(severity_rank(F.col("severity")), "seq")
    return top_findings(findings, most).select(
        F.row_number().over(order).alias("place"), "*"
    ).select(
        "place", F.format_string("INS-%03d", "place").alias("id"), insight_type(F.col("stat_type")).alias("type"),
        "severity", text.without_stars(title).alias("title"), text.without_stars(explanation).alias("explanation"),
        evidence().alias("evidence"), F.col("columns").alias("affected_columns"), F.lit(0.0).alias("confidence"),
        "actionable", "stat_type", "metrics", "labels", "series")


def executive_summary(insights: DataFrame, domain: str, row_count: int) -> DataFrame:
    """Three sentences over the insights: state, top insight, next step."""
    ranked = F.struct(severity_rank(F.col("severity")).alias("rank"), "place", "title", "severity")
    found = insights.agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"), F.min(ranked).alias("top"))
    return found.select("n", "critical", "warning", F.concat_ws(
        " ",
        F.format_string(f"The {domain} table with {row_count:,} rows gave %d findings, %d critical and %d of warning level.",
                        "n", "critical", "warning"),
        F.when(F.col("n") > 0, F.concat(F.lit("Most important: "), F.col("top.title"), F.lit("."))),
        F.when((F.col("critical") + F.col("warning")) > 0, "Resolve this finding first.")
        .otherwise("No finding calls for immediate action."),
    ).alias("summary"))
