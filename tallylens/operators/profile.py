"""Column profiles, their issues and the warnings made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylens import schemas
from tallylens.functions import names
from tallylens.functions.numbers import round_to
from tallylens.operators.columnwise import (
    aggregate_columns, col, collect_aggregates, collect_per_column, dtype_of, small_frame, sql_text,
)
from tallylens.operators.facts import group_key, number_facts
from tallylens.operators.multiset import Multiset
from tallylens.operators.statistics import top_values, value_counts
from tallylens.session import staged

SAMPLE_ROWS = 100


def value_facts(df: DataFrame, columns: Sequence[str], exact: bool = True, copies: str | None = None) -> list[dict]:
    """Per column: rows, nulls, distinct values and text marks, one row each.

    Rows are first merged per value, so marks are looked at once per value
    after map-side merging and frequent values cost nothing extra. ``copies``
    names a column that tells how many equal rows a row stands for.
    """
    also = {"copies": copies} if copies else None
    count, weight = ("sum(copies)", ["copies"]) if copies else ("count(*)", [])

    def marks_of(name: str, value: str) -> dict[str, str]:
        is_text = isinstance(dtype_of(df, name), T.StringType)
        dated = is_text and names.has_part(name.lower(), ("date", "time"))
        off = "CAST(NULL AS BOOLEAN)"
        return {
            "dollar": f"startswith({value}, '$')" if is_text else off,
            "iso": f"NOT contains({value}, '/') AND contains({value}, '-')" if dated else off,
            "slash": f"contains({value}, '/')" if dated else off,
        }

    def build(one: DataFrame, name: str) -> DataFrame:
        dtype, marks = dtype_of(df, name), marks_of(name, "value")
        marked = one.selectExpr("value", *weight, *[f"{m} AS {k}" for k, m in marks.items()])
        values = (
            marked.withColumn("value", group_key(F.col("value"), dtype)).groupBy("value")
            .agg(F.expr(count).alias("n"), *[F.bool_or(k).alias(k) for k in marks]))
        return values.selectExpr(
            f"{sql_text(name)} AS column", "coalesce(sum(n), 0) AS rows",
            "coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS nulls", "count(*) AS uniques",
            *[f"bool_or({k}) AS {k}" for k in marks])

    def sketched(name: str, raw: str, number: str) -> dict[str, str]:
        return {
            "rows": f"coalesce({count}, 0)", "nulls": f"coalesce({count} FILTER (WHERE {raw} IS NULL), 0)",
            "uniques": f"approx_count_distinct({raw}, 0.02D) + max(CAST({raw} IS NULL AS BIGINT))",
            **{k: f"bool_or({m})" for k, m in marks_of(name, raw).items()}}

    found = collect_per_column(df, columns, build, also) if exact else collect_aggregates(df, columns, sketched, also)
    rows = {r["column"]: r.asDict() for r in found}
    return [rows[c] for c in columns]


def case_variants(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns in which two values differ by letter case only.

    Meant for columns that are known to hold few values; these merge on the
    map side and hardly anything is shuffled.
    """
    if not columns:
        return set()

    def build(one: DataFrame, name: str) -> DataFrame:
        return one.agg(
            F.lit(name).alias("column"),
            (F.count_distinct(F.lower("value")) < F.count_distinct("value")).alias("mixed"))

    return {r["column"] for r in collect_per_column(df, columns, build) if r["mixed"]}


def sample_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> dict[str, list[str]]:
    """The first ``k`` non-null values of every column as text.

    Reads the head of the table only; columns that are nearly empty there are
    searched on their own.
    """
    found: dict[str, list[str]] = {c: [] for c in columns}
    head = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).head(SAMPLE_ROWS)
    for row in head:
        for i, c in enumerate(columns):
            if row[i] is not None and len(found[c]) < k:
                found[c].append(row[i])
    if len(head) == SAMPLE_ROWS:
        for c in columns:
            if len(found[c]) < k:
                found[c] = [r[0] for r in df.select(col(c).cast("string")).where(col(c).isNotNull()).head(k)]
    return found


def issues_of(facts: dict, is_text: bool, mixed_case: bool) -> list[str]:
    """Issue labels in a fixed order; thresholds are strict."""
    if not facts["rows"]:
        return []
    share = facts["nulls"] / facts["rows"]
    checks = (
        (share > 0.15, f"high_null_rate_{share:.0%}"),
        (is_text and facts["iso"] and facts["slash"], "mixed_date_formats"),
        (is_text and facts["dollar"], "leading_dollar_sign"),
        (is_text and mixed_case, "case_inconsistency"),
    )
    return [label for hit, label in checks if hit]


def profile(df: DataFrame, exact: bool = True, counted: Multiset | None = None) -> DataFrame:
    """One row per column: type, null share, distinct count, samples, tag, issues (A5).

    A table without rows has null as null share and no issues. With the table as
    multiset in ``counted``, only the sample values are read from ``df``.
    """
    rows = df if counted is None else counted.rows
    facts = value_facts(rows, df.columns, exact, counted.copies if counted else None)
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    suspects = [f["column"] for f in facts if f["column"] in texts and 2 <= f["uniques"] - (f["nulls"] > 0) <= 20]
    mixed = case_variants(rows, suspects)
    samples = sample_values(df, df.columns)
    found = []
    for f in facts:
        name = f["column"]
        found.append({
            "column": name,
            "dtype": df.schema[name].dataType.simpleString(),
            "null_pct": round(f["nulls"] / f["rows"], 4) if f["rows"] else None,
            "unique_count": f["uniques"],
            "sample_vals": samples[name],
            "semantic_tag": names.semantic_tag(name, name in texts, f["rows"] > f["nulls"], bool(f["dollar"])),
            "issues": issues_of(f, name in texts, name in mixed),
        })
    return small_frame(df.sparkSession, found, schemas.ddl(schemas.PROFILE))


def null_fractions(df: DataFrame) -> DataFrame:
    """Null count and share per column (A2), lazily and without a shuffle of values."""

    return aggregate_columns(df, df.columns, lambda name, raw, number: {
        "rows": "count(*)", "null_count": f"count_if({raw} IS NULL)",
        "null_pct": f"try_divide(count_if({raw} IS NULL), count(*))"})


def warnings(profile_rows: DataFrame, quality: DataFrame) -> DataFrame:
    """Failing columns and issues as sentences."""
    failing = quality.where(~F.col("passed")).select(
        F.format_string("Quality score %.2f — review columns: %s", F.col("overall_score"),
                        F.array_join("columns_failing", ", ")).alias("warning"))
    issues = profile_rows.select("column", F.explode("issues").alias("issue")).select(
        F.format_string("Column '%s': %s", "column", "issue").alias("warning"))
    return failing.unionByName(issues)


def column_chart_stats(df: DataFrame, first: int | None = None, top: int = 5) -> DataFrame:
    """Number ranges and top texts of all (or the ``first``) columns, for charts.

    Long texts are counted by their digests, see ``statistics.top_values``.
    """
    shown = [c for c in df.columns[:first] if not names.skip_in_chart(c)]
    part = df.select(*[col(c) for c in shown])
    numbers = [c for c in shown if isinstance(dtype_of(df, c), (T.DoubleType, T.FloatType, T.IntegralType))]
    texts = [c for c in shown if isinstance(dtype_of(df, c), T.StringType)]
    rows = [
        {"column": c, "kind": "numeric", **{
            k: round(v or 0.0, 2) for k, v in (("mean", f.mean), ("low", f.low), ("high", f.high))}}
        for c, f in (number_facts(part, numbers) if numbers else {}).items()
    ]
    if texts:
        counted = staged(value_counts(part, texts, keep_nulls=True), "value_counts")
        uniques = counted.groupBy("column").agg(F.count("*").alias("uniques"), F.sum("n").alias("rows"))
        found = {r["column"]: r["top_vals"] for r in top_values(part, texts, top, counted).collect()}
        for r in uniques.orderBy("column").collect():
            c = r["column"]
            rows.append({"column": c, "kind": "categorical", "n_unique": r["uniques"],
                         "top_vals": [{"value": v["value"], "n": v["n"]} for v in found.get(c, [])]})
    return small_frame(df.sparkSession, rows, schemas.ddl(
        "column string, kind string, mean double, low double, high double, n_unique long, "
        "top_vals array<struct<value:string,n:long>>"))


def slim_chart_stats(stats: DataFrame, affected: Sequence[str], few: int = 15) -> DataFrame:
    """Affected columns, and categories with at most ``few`` values (A30, slim form)."""
    return stats.where(
        F.col("column").isin(list(affected)) | ((F.col("kind") == "categorical") & (F.col("n_unique") <= few)))
