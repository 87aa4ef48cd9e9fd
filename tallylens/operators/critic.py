"""Checks insights against the data and scores them.

A verdict is a function of one insight and of a few numbers per column, so it
is computed by a projection: no join, no shuffle, whatever the number of insights.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylens.functions import text
from tallylens.functions.numbers import number_from_text, round_to
from tallylens.operators.columnwise import computed_once
from tallylens.operators.facts import number_facts, numeric_columns
from tallylens.operators.quantiles import quantiles

# Thresholds, weights and names of the scoring rules.
MIN_CONFIDENCE = 0.50
MAX_TITLE_WORDS = 20
MIN_EXPLANATION_WORDS = 15
FLAG_PENALTY = 0.15
MAX_FLAG_PENALTY = 0.45
CRITICAL_FLAGS = ("column_not_in_data", "evidence_value_implausible")
UNCHECKED_TYPES = ("summary", "distribution", "correlation")
AGGREGATE_METRICS = (
    "mean", "median", "std", "q1", "q3", "count", "null_pct", "null_count", "n_unique", "top_pct", "bottom_pct",
    "imbalance_ratio", "outlier_pct", "slope", "r_squared", "p_value", "trend_pct_per_period", "pearson_r",
    "anomaly_pct", "column_mean", "column_std", "skew", "kurtosis",
)


@dataclass(frozen=True)
class Plausible:
    """What is needed to judge a single value of a column."""

    mean: float
    std: float
    lower: float
    upper: float


def plausible_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Plausible]:
    """Mean, sample deviation and the fences at three quartile ranges.

    Quartiles are the values at the nearest rank, found exactly.
    """
    chosen = list(numeric_columns(df) if columns is None else columns)
    facts = {c: f for c, f in number_facts(df, chosen).items() if f.n > 1}
    cuts = quantiles(df, list(facts), [0.25, 0.75], {c: f.n for c, f in facts.items()}, rule="nearest")
    out = {}
    for c, f in facts.items():
        q1, q3 = cuts[c]
        reach = 3.0 * (q3 - q1)
        out[c] = Plausible(f.mean, f.std_samp or 1.0, q1 - reach, q3 + reach)
    return out


def is_implausible(value: Column, mean: Column, std: Column, lower: Column, upper: Column) -> Column:
    """More than three deviations off and outside the fences, but not near the mean."""
    near = F.when(mean != 0, F.abs(value - mean) / F.abs(mean) < 0.05).otherwise(False)
    return ~near & (F.abs(value - mean) / std > 3) & ((value < lower) | (value > upper))


def evidence_flags(ranges: Mapping[str, Plausible], kind: str = "type", evidence: str = "evidence") -> Column:
    """Flags of the evidence items that cannot be true for their column.

    Only insight types that quote single values are checked, and only metrics
    that are no aggregates. ``ranges`` has one entry per numeric column.
    """
    empty = F.array().cast("array<string>")
    if not ranges:
        return empty
    known = F.create_map(*[
        x for c, p in ranges.items()
        for x in (F.lit(c), F.struct(F.lit(p.mean).alias("mean"), F.lit(p.std).alias("std"),
                                     F.lit(p.lower).alias("lower"), F.lit(p.upper).alias("upper")))
    ])

    def flag(item: Column) -> Column:
        about = F.try_element_at(known, item["column"])
        value = F.coalesce(item["num"], number_from_text(item["txt"]))
        off = is_implausible(value, about["mean"], about["std"], about["lower"], about["upper"])
        return F.when(item["metric"].isin(*AGGREGATE_METRICS) | F.isnull(about), F.lit(None)).when(
            F.isnull(value), F.concat(F.lit("invalid_numeric_evidence: "), item["metric"])
        ).when(off, F.concat(F.lit("evidence_value_implausible: "), item["metric"], F.lit("="), value.cast("string")))

    checked = F.filter(F.transform(F.col(evidence), flag), F.isnotnull)
    return F.when(F.col(kind).isin(*UNCHECKED_TYPES), empty).otherwise(checked)


def missing_columns(columns: Sequence[str]) -> Column:
    """Affected columns that the table does not have."""
    have = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    return F.filter("affected_columns", lambda c: ~F.array_contains(have, c))


def judged(
    insights: DataFrame, columns: Sequence[str], ranges: Mapping[str, Plausible], keep: Sequence[str] | None = None
) -> DataFrame:
    """The insights with score, flags and verdict (A25) as struct ``verdict``.

    ``keep`` names the insight columns that are needed afterwards, by default all.
    """
    base = computed_once(computed_once(insights.select(
        F.struct(*(insights.columns if keep is None else keep)).alias("insight"), "affected_columns", "evidence", "type", "title", "explanation",
        F.lower("title").alias("low_title"), F.lower("explanation").alias("low_explanation"),
    )).select(
        "insight", F.size("evidence").alias("n_evidence"),
        missing_columns(columns).alias("missing"), evidence_flags(ranges).alias("odd"),
        text.word_count(F.col("title")).alias("title_words"),
        (text.vague_phrase_count(F.col("low_title")) > 0).alias("vague_title"),
        F.col("title").contains("**").alias("bold_title"),
        F.col("title").rlike("[0-9]").alias("number_in_title"),
        text.word_count(F.col("explanation")).alias("explanation_words"),
        text.vague_phrase_count(F.col("low_explanation")).alias("vague_phrases")))
    grounded = F.size("missing") == 0
    good_title = (F.col("title_words") <= MAX_TITLE_WORDS) & ~F.col("vague_title") & ~F.col("bold_title")
    good_text = (F.col("explanation_words") >= MIN_EXPLANATION_WORDS) & (F.col("vague_phrases") <= 1)
    named = F.concat(F.lit("['"), F.array_join("missing", "', '"), F.lit("']"))
    single = F.filter(F.array(
        F.when(F.col("vague_title"), "vague_title_language"),
        F.when(F.col("bold_title"), "markdown_in_title"),
        F.when(F.col("title_words") > MAX_TITLE_WORDS, F.format_string("title_too_long: %d words", "title_words")),
        F.when(F.col("explanation_words") < MIN_EXPLANATION_WORDS,
               F.format_string("explanation_too_short: %d words", "explanation_words")),
        F.when(F.col("vague_phrases") > 1, F.format_string("too_vague: %d vague phrases", "vague_phrases")),
        F.when(F.col("n_evidence") < 1, "no_evidence_attached"),
    ), F.isnotnull)
    flags = F.concat(
        F.when(grounded, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("column_not_in_data: "), named))),
        F.col("odd"), single)
    points = (
        F.when(grounded, 0.35).otherwise(0.0)
        + F.when(good_title, F.when(F.col("number_in_title"), 0.25).otherwise(0.20)).otherwise(0.0)
        + F.when(good_text, 0.20).otherwise(0.0)
        + F.when(F.col("n_evidence") >= 1, 0.20).otherwise(0.0))
    flagged = computed_once(base.select("insight", flags.alias("flags"), points.alias("points")))
    scored = computed_once(flagged.select(
        "insight", "flags", round_to(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("points") - F.least(
            F.size("flags") * FLAG_PENALTY, F.lit(MAX_FLAG_PENALTY)))), 3).alias("confidence_score"),
        F.try_element_at(F.filter("flags", is_critical), F.lit(1)).alias("critical")))
    passed = (F.col("confidence_score") >= MIN_CONFIDENCE) & F.isnull("critical")
    reason = F.when(F.isnotnull("critical"), F.concat(F.lit("Critical flag: "), F.col("critical"))).when(
        ~passed, F.concat(F.lit("Score too low: "), F.col("confidence_score").cast("string")))
    return scored.select("insight.*", F.struct(
        passed.alias("passed"), "confidence_score", reason.alias("rejection_reason"), "flags").alias("verdict"))


def verdicts(insights: DataFrame, columns: Sequence[str], ranges: Mapping[str, Plausible]) -> DataFrame:
    """One verdict per insight."""
    return judged(insights, columns, ranges, ["id"]).select(F.col("id").alias("insight_id"), "verdict.*")


def accepted(checked: DataFrame) -> DataFrame:
    """Of the insights with a verdict those that passed, scored (P12); needs no join."""
    return checked.where("verdict.passed").withColumn("confidence", F.col("verdict.confidence_score")).drop("verdict")


def is_critical(flag: Column) -> Column:
    hit = flag.contains(CRITICAL_FLAGS[0])
    for name in CRITICAL_FLAGS[1:]:
        hit = hit | flag.contains(name)
    return hit


def critic_report(checked: DataFrame) -> DataFrame:
    """Counts, mean score of the passed and what to do next, as one row."""
    counted = checked.agg(
        F.count_if("passed").alias("passed_count"), F.count_if(~F.col("passed")).alias("rejected_count"),
        F.count_if(F.size("flags") > 0).alias("flagged_count"),
        F.coalesce(F.avg(F.when(F.col("passed"), F.col("confidence_score"))), F.lit(0.0)).alias("quality"),
        F.coalesce(F.bool_or(F.exists("flags", is_critical)), F.lit(False)).alias("critical"), F.count("*").alias("n"))
    retry = (F.col("rejected_count") > F.col("passed_count")) | ((F.col("quality") < 0.55) & (F.col("n") > 2))
    return counted.select(
        "passed_count", "rejected_count", "flagged_count", round_to(F.col("quality"), 3).alias("overall_quality"),
        (F.col("critical") | (F.col("flagged_count") > 2)).alias("needs_human_review"),
        retry.alias("retry_recommended"),
        F.when(retry, F.format_string("Only %d/%d insights passed with avg quality %.2f",
                                      "passed_count", "n", "quality")).alias("retry_reason"))


def passed_insights(insights: DataFrame, checked: DataFrame) -> DataFrame:
    """Insights that passed, with their score as confidence.

    For verdicts that were stored on their own; see :func:`accepted` otherwise.
    """
    scores = checked.where("passed").select(F.col("insight_id").alias("id"), "confidence_score")
    return (
        insights.join(scores, "id").withColumn("confidence", F.col("confidence_score")).drop("confidence_score")
        .select(*insights.columns))
