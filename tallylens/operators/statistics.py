"""Statistical findings: summary, nulls, distributions, categories, trend, correlation, anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylens import schemas
from tallylens.functions import names, text
from tallylens.functions.numbers import guarded_corr, p_value, round_to
from tallylens.operators.columnwise import (
    aggregate_columns, col, collect_aggregates, collect_per_column, dtype_of, per_column, pinned, small_frame,
    sql_number, sql_text, sql_usable, together, union_all,
)
from tallylens.operators.comoments import co_moments, correlations
from tallylens.operators.facts import (
    LONG_TEXT, NumberFacts, ValueSketch, choose_columns, group_key, number_facts, numeric_columns, string_columns, value_sketches,
)
from tallylens.operators.quantiles import quantiles
from tallylens.session import staged

# Order of the checks, severities and thresholds.
CHECKS = ("summary", "high_nulls", "distribution", "categorical_distribution", "time_trend", "correlation", "anomaly")
SEVERITIES = ("critical", "warning", "info")
MIN_DISTRIBUTION_ROWS = 20
MIN_PAIR_ROWS = 30
MIN_ANOMALY_ROWS = 30
MAX_CATEGORIES = 50
HEAD = 32
LOOKUP_DIGESTS = 100_000


# ---------------------------------------------------------------- building blocks

def severity_rank(severity: Column) -> Column:
    """0 for critical, 1 for warning, 2 for info, 3 for anything else."""
    rank = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == s, i).otherwise(rank)
    return rank


def by_severity(findings: DataFrame) -> DataFrame:
    """Critical first; the original order within a severity (L1)."""
    return findings.orderBy(severity_rank(F.col("severity")), "seq")


def _finding(
    check: str, place: Column, columns: Column, severity: Column, actionable: Column,
    metrics: Mapping[str, Column] | Column, labels: Mapping[str, Column] | None = None, series: Column | None = None,
) -> list[Column]:
    """The select list of one finding row."""
    if not isinstance(metrics, Column):
        metrics = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))])
    notes = [x for k, v in (labels or {}).items() for x in (F.lit(k), v.cast("string"))]
    return [
        (F.lit(CHECKS.index(check) * 100_000) + place).cast("int").alias("seq"),
        F.lit(check).alias("stat_type"),
        columns.alias("columns"),
        severity.alias("severity"),
        actionable.alias("actionable"),
        metrics.alias("metrics"),
        (F.create_map(*notes) if notes else F.create_map()).cast("map<string,string>").alias("labels"),
        (F.array() if series is None else series).cast("array<double>").alias("series"),
    ]


def _graded(critical: Column, warning: Column) -> Column:
    return F.when(critical, "critical").when(warning, "warning").otherwise("info")


# ---------------------------------------------------------------- numeric columns

def numbers_table(
    df: DataFrame, columns: Sequence[str] | None = None, facts: Mapping[str, NumberFacts] | None = None,
    shape: bool = True, quartiles: bool = True, extremes: bool = True,
) -> DataFrame:
    """One row per numeric column with moments, quartiles, outliers and extremes.

    Works in passes: moments, exact quartiles, then counts that need both. Only
    one row per column and pass reaches the driver, so the result is a local
    relation that the findings below can read any number of times.
    """
    chosen = list(numeric_columns(df) if columns is None else columns)
    known = {c: facts[c] for c in chosen} if facts else number_facts(df, chosen, shape)
    cuts = quantiles(df, chosen, [0.25, 0.5, 0.75], {c: f.n for c, f in known.items()}) if quartiles else {}
    marks = _count_marks(df, known, cuts) if extremes else {}
    tops = _largest_extremes(df, known, [c for c in marks if marks[c]["extremes"]])
    rows = []
    for place, c in enumerate(chosen):
        f = known[c]
        q1, median, q3 = cuts.get(c, (None, None, None))
        rows.append({
            "seq": place, "column": c, "rows": f.rows, "nulls": f.nulls, "n": f.n, "mean": f.mean,
            "std_samp": f.std_samp, "std_pop": f.std_pop, "skew": f.skew, "kurtosis": f.kurtosis,
            "low": f.low, "high": f.high, "q1": q1, "median": median, "q3": q3,
            **marks.get(c, {}), "top_extremes": tops.get(c, []),
        })
    return small_frame(df.sparkSession, rows, schemas.ddl(schemas.NUMBERS))


def _z_score(f: NumberFacts, value: str = "value") -> str:
    return f"abs(({value} - {sql_number(f.mean)}) / {sql_number(f.std_pop)})"


def _count_marks(df: DataFrame, facts: Mapping[str, NumberFacts], cuts: Mapping[str, list]) -> dict[str, dict]:
    """Values outside the quartile fences and beyond three deviations, per column."""
    varied = [c for c, f in facts.items() if f.varies]

    def measures(name: str, raw: str, number: str) -> dict[str, str]:
        fenced = "false"
        if name in cuts:
            q1, _, q3 = cuts[name]
            reach = 1.5 * (q3 - q1)
            fenced = f"{number} < {sql_number(q1 - reach)} OR {number} > {sql_number(q3 + reach)}"
        z = _z_score(facts[name], number)
        return {"outliers": f"count_if({fenced})", "extremes": f"count_if({z} > 3)", "max_z": f"max({z})"}

    return {
        r["column"]: {"outliers": r["outliers"], "extremes": r["extremes"], "max_z": r["max_z"]}
        for r in collect_aggregates(df, varied, measures)
    }


def _largest_extremes(
    df: DataFrame, facts: Mapping[str, NumberFacts], columns: Sequence[str], k: int = 5
) -> dict[str, list[float]]:
    """The ``k`` largest values beyond three deviations, ascending (a top-k per column)."""

    def build(one: DataFrame, name: str) -> DataFrame:
        return (
            one.selectExpr(f"{sql_usable(dtype_of(df, name))} AS value").where(f"{_z_score(facts[name])} > 3")
            .orderBy(F.desc("value")).limit(k).selectExpr(f"{sql_text(name)} AS column", "value"))

    tops: dict[str, list[float]] = {}
    for r in collect_per_column(df, columns, build):
        tops.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(v) for c, v in tops.items()}


def summary_rows(numbers: DataFrame) -> DataFrame:
    """Mean, median, sample deviation, range and count per column."""
    return numbers.where("n > 0").select(
        "seq", "column", round_to(F.col("mean"), 2).alias("mean"), round_to(F.col("median"), 2).alias("median"),
        round_to(F.col("std_samp"), 2).alias("std"), round_to(F.col("low"), 2).alias("min"),
        round_to(F.col("high"), 2).alias("max"), F.col("n").alias("count"))


def summary_finding(numbers: DataFrame) -> DataFrame:
    """One finding over all numeric columns; metric keys are ``column.statistic``."""
    kinds = ("mean", "median", "std", "min", "max", "count")
    shown = numbers.select("seq", "column").join(summary_rows(numbers).drop("column"), "seq", "left")
    entries = F.flatten(F.transform("all", lambda r: F.array(*[
        F.struct(F.concat(r["column"], F.lit("." + k)).alias("key"), r[k].cast("double").alias("value"))
        for k in kinds])))
    return shown.agg(F.array_sort(F.collect_list(F.struct("seq", "column", *kinds))).alias("all")).where(
        F.size("all") > 0).select(*_finding(
            "summary", F.lit(0), F.transform("all", lambda r: r["column"]), F.lit("info"), F.lit(False),
            F.map_from_entries(F.filter(entries, lambda e: F.isnotnull(e["value"])))))


def null_findings(df: DataFrame, known: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Columns with more than 5% nulls.

    ``known`` gives ``(rows, nulls)`` of columns that were already scanned.
    """
    known = known or {}
    parts = [small_frame(df.sparkSession, [
        {"column": c, "rows": n, "null_count": k} for c, (n, k) in known.items() if c in df.columns
    ], schemas.ddl("column string, rows long, null_count long"))]
    left = [c for c in df.columns if c not in known]
    if left:
        parts.append(aggregate_columns(df, left, lambda name, raw, number: {
            "rows": "count(*)", "null_count": f"count_if({raw} IS NULL)"}))
    share = F.try_divide("null_count", "rows")
    place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column")) - 1
    return union_all(parts).withColumn("share", share).where("share > 0.05").select(*_finding(
        "high_nulls", place, F.array("column"),
        F.when(F.col("share") > 0.3, "critical").otherwise("warning"), F.col("share") > 0.2,
        {"null_pct": round_to(F.col("share"), 4), "null_count": F.col("null_count")}))


def distribution_findings(numbers: DataFrame) -> DataFrame:
    """Shape and fence outliers of every column that varies."""
    share = F.col("outliers") / F.col("n")
    return numbers.where((F.col("n") >= MIN_DISTRIBUTION_ROWS) & (F.col("low") < F.col("high"))).select(*_finding(
        "distribution", F.col("seq"), F.array("column"), _graded(share > 0.10, share > 0.03), share > 0.05,
        {
            "mean": round_to(F.col("mean"), 2), "std": round_to(F.col("std_pop"), 2),
            "skew": round_to(F.col("skew"), 3), "kurtosis": round_to(F.col("kurtosis"), 3),
            "outlier_count": F.col("outliers"), "outlier_pct": round_to(share, 4),
            "q1": round_to(F.col("q1"), 2), "q3": round_to(F.col("q3"), 2),
            "iqr": round_to(F.col("q3") - F.col("q1"), 2),
        }))


def anomaly_findings(numbers: DataFrame) -> DataFrame:
    """Columns with values beyond three deviations."""
    share = F.col("extremes") / F.col("n")
    return numbers.where((F.col("n") >= MIN_ANOMALY_ROWS) & (F.col("extremes") > 0)).select(*_finding(
        "anomaly", F.col("seq"), F.array("column"), _graded(share > 0.02, F.col("extremes") >= 3), share > 0.01,
        {
            "n_anomalies": F.col("extremes"), "anomaly_pct": round_to(share, 4),
            "max_z_score": round_to(F.col("max_z"), 2), "column_mean": round_to(F.col("mean"), 2),
            "column_std": round_to(F.col("std_pop"), 2),
        },
        series=F.transform("top_extremes", lambda v: round_to(v, 2))))


# ---------------------------------------------------------------- categories

def value_counts(df: DataFrame, columns: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """``(column, value, head, n)`` for text columns, merged per value before the shuffle.

    Long texts are named by their digest, see :func:`group_key`; ``head`` holds the first characters of every text, which
    settles most ties of the ranking. No full text takes part in the exchange.
    """
    def build(one: DataFrame, name: str) -> DataFrame:
        rows = one if keep_nulls else one.where("value IS NOT NULL")
        keyed = rows.select(group_key(F.col("value"), T.StringType()).alias("value"), F.substring("value", 1, HEAD).alias("head"))
        return keyed.groupBy("value", "head").agg(F.count("*").alias("n")).selectExpr(
            f"{sql_text(name)} AS column", "value", "head", "n")

    return per_column(df, columns, build)


def _full_texts(df: DataFrame, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, whole)``: the texts behind the digests in ``wanted``.

    Up to ``LOOKUP_DIGESTS`` digests, about 8 MB, are sent to the tasks that scan the texts, so that only wanted texts
    move; more of them are joined by an exchange.
    """
    known = wanted.select("column", "value")
    if known.count() <= LOOKUP_DIGESTS:
        known = F.broadcast(known)
    texts = per_column(df, columns, lambda one, name: one.where(F.octet_length("value") >= LONG_TEXT).select(
        F.lit(name).alias("column"), group_key(F.col("value"), T.StringType()).alias("digest"), F.col("value").alias("whole")))
    match = (texts["column"] == known["column"]) & (texts["digest"] == known["value"])
    # copies merge on the map side: a text of a third of all rows is one row per task
    return texts.join(known, match, "left_semi").groupBy("column", "digest", "whole").agg(F.lit(1)).select(
        "column", F.col("digest").alias("value"), "whole")


def top_values(df: DataFrame, columns: Sequence[str], k: int, counted: DataFrame | None = None) -> DataFrame:
    """The ``k`` most frequent values per text column, in full, as ``top_vals`` (L4); ties by value, nulls left out.

    The k-th place by count and first characters bounds what can be among the first k. Texts are looked up only for
    values at or above that bound. ``counted`` is a written :func:`value_counts` of the columns.
    """
    counted = staged(value_counts(df, columns), "value_counts") if counted is None else counted
    values = counted.where("value IS NOT NULL")
    order = Window.partitionBy("column").orderBy(F.desc("n"), "head", "value")
    bounds = (
        values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        .groupBy("column").agg(F.max_by(F.struct("n", "head"), "place").alias("last")).collect())
    near = F.lit(False)
    for b in bounds:
        at = (F.col("n") > b["last"]["n"]) | ((F.col("n") == b["last"]["n"]) & (F.col("head") <= b["last"]["head"]))
        near = near | ((F.col("column") == b["column"]) & at)
    reach = values.where(near)
    # digests have LONG_TEXT characters, shorter texts stand for themselves
    is_digest = F.octet_length("value") >= LONG_TEXT
    whole = _full_texts(df, reach.where(is_digest), columns)
    full = reach.where(~is_digest).select("column", "value", "n").unionByName(
        reach.where(is_digest).join(whole, ["column", "value"]).select("column", F.col("whole").alias("value"), "n"))
    final = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        full.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k)
        .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("ranked"))
        .select("column", F.transform("ranked", lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n")))
                .alias("top_vals")))


def categorical_findings(df: DataFrame, sketches: Mapping[str, ValueSketch] | None = None) -> DataFrame:
    """Balance of text columns with 2 to 50 values (A18); ties by value.

    A sketch first rules out columns that provably have more values, so free
    text is never shuffled.
    """
    known = value_sketches(df, string_columns(df)) if sketches is None else sketches
    texts = [c for c in string_columns(df) if known[c].may_have(MAX_CATEGORIES)]
    if not texts:
        return small_frame(df.sparkSession, [], schemas.ddl(schemas.FINDING))

    def build(one: DataFrame, name: str) -> DataFrame:
        counts = one.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
        return counts.selectExpr(
            f"{df.columns.index(name)} AS place", f"{sql_text(name)} AS column", "sum(n) AS total",
            "array_sort(collect_list(struct(-n AS minus, value))) AS ranked")

    counted = per_column(df, texts, build).where(F.size("ranked").between(2, MAX_CATEGORIES)).select(
        "place", "column", F.size("ranked").alias("uniques"), F.col("ranked")[0]["value"].alias("top_value"),
        (-F.col("ranked")[0]["minus"] / F.col("total")).alias("top"),
        (-F.element_at("ranked", -1)["minus"] / F.col("total")).alias("bottom"),
        F.slice("ranked", 1, 5).alias("top_5"))
    named = F.to_json(F.map_from_entries(F.transform("top_5", lambda r: F.struct(r["value"], -r["minus"]))))
    return counted.select(*_finding(
        "categorical_distribution", F.col("place"), F.array("column"),
        _graded(F.col("top") > 0.90, F.col("top") > 0.70), F.col("top") > 0.70,
        {
            "n_unique": F.col("uniques"), "top_pct": round_to(F.col("top"), 4),
            "bottom_pct": round_to(F.col("bottom"), 4),
            "imbalance_ratio": round_to(F.col("top") / (F.col("bottom") + 1e-9), 2),
        },
        {"top_value": F.col("top_value"), "top_5": named},
        F.transform("top_5", lambda r: -r["minus"])))


# ---------------------------------------------------------------- time trend

def _as_date(df: DataFrame, name: str) -> Column:
    return text.leading_date(col(name)) if isinstance(dtype_of(df, name), T.StringType) else col(name).cast("date")


def trend_date_column(df: DataFrame) -> str | None:
    """The first date-like column that holds at least one date (P5)."""
    candidates = [
        f.name for f in df.schema
        if names.has_part(f.name, names.DATE_PARTS)
        and isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    for c in candidates:
        if df.select(_as_date(df, c).alias("day")).where(F.isnotnull("day")).head(1):
            return c
    return None


def monthly(df: DataFrame, date_column: str, numbers: Sequence[str] | None = None) -> DataFrame:
    """Rows and means of all (or the given) numeric columns per month."""
    means = list(numeric_columns(df) if numbers is None else numbers)
    return (
        df.select(F.trunc(_as_date(df, date_column), "month").alias("month"), *[col(c) for c in means])
        .where(F.isnotnull("month")).groupBy("month")
        .agg(F.count("*").alias("order_count"), *[F.avg(col(c)).alias(f"{c}_mean") for c in means])
        .orderBy("month"))


def trend_finding(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """Straight-line trend of the monthly row count.

    Months without rows are not filled in. The months of a table fit in one
    row, so they are numbered inside an array.
    """
    name = date_column or trend_date_column(df)
    if name is None or not numeric_columns(df):
        return small_frame(df.sparkSession, [], schemas.ddl(schemas.FINDING))
    months = (
        df.select(F.trunc(_as_date(df, name), "month").alias("month")).where(F.isnotnull("month"))
        .groupBy("month").agg(F.count("*").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("months")))
    y, x = F.col("y"), F.col("x")
    fit = (
        months.where(F.size("months") >= 3)
        .select("months", F.posexplode("months").alias("x", "m"))
        .select("months", F.col("x").cast("double").alias("x"), F.col("m.n").cast("double").alias("y"))
        .agg(
            F.regr_slope(y, x).alias("slope"), F.avg(y).alias("mean"), F.count("*").alias("n"),
            F.coalesce(guarded_corr(F.covar_pop(y, x), F.stddev_pop(x), F.stddev_pop(y)), F.lit(0.0)).alias("r"),
            F.any_value("months").alias("months"))
        .where("n >= 3")
        .select("*", (F.col("slope") / (F.col("mean") + 1e-9) * 100).alias("pct"), p_value("r", "n").alias("p")))
    size = F.abs("pct")
    return fit.select(*_finding(
        "time_trend", F.lit(0), F.array(F.lit(name), F.lit("order_count")),
        F.when(size > 20, F.when(F.col("pct") < -20, "critical").otherwise("warning"))
        .when(size > 10, "warning").otherwise("info"),
        size > 20,
        {
            "slope": round_to(F.col("slope"), 4), "trend_pct_per_period": round_to(F.col("pct"), 2),
            "r_squared": round_to(F.col("r") * F.col("r"), 4), "p_value": round_to(F.col("p"), 4),
            "n_periods": F.col("n"),
        },
        {"direction": F.when(F.col("slope") > 0, "up").otherwise("down"),
         "significant": F.when(F.col("p") < 0.05, "true").otherwise("false")},
        F.transform("months", lambda m: m["n"])))


# ---------------------------------------------------------------- correlation

def eligible_pairs(
    df: DataFrame, columns: Sequence[str], facts: Mapping[str, NumberFacts], most: int | None = None
) -> list[tuple[str, str]]:
    """All (or the first ``most``) pairs in column order with at least 30 common rows.

    The counts of the single columns settle nearly all pairs; if they leave any
    open, one scan counts the common rows of all pairs.
    """
    pairs = list(combinations(columns, 2))
    counted: dict[tuple[int, int], int] = {}

    def sure(pair: tuple[str, str]) -> bool | None:
        a, b = facts[pair[0]], facts[pair[1]]
        return True if a.n + b.n - a.rows >= MIN_PAIR_ROWS else False if min(a.n, b.n) < MIN_PAIR_ROWS else None

    known = {pair: sure(pair) for pair in pairs}
    if None in known.values():
        counted = {(r["i"], r["j"]): r["n"] for r in co_moments(df, columns, {}).collect()}
    place = {c: i for i, c in enumerate(columns)}
    return [p for p in pairs if (known[p] if known[p] is not None else counted.get((place[p[0]], place[p[1]]), 0) >= MIN_PAIR_ROWS)][:most]


def pair_correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]], facts: Mapping[str, NumberFacts] | None = None
) -> DataFrame:
    """``(place, a, b, n, r, p)`` per pair; ``r`` is null where a side is constant. One scan for all pairs."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    known = facts or number_facts(df, columns)
    found = {(r["i"], r["j"]): r for r in correlations(co_moments(df, columns, {c: known[c].mean for c in columns})).collect()}
    at = {c: i for i, c in enumerate(columns)}
    rows = []
    for place, (a, b) in enumerate(pairs):
        r = found.get((min(at[a], at[b]), max(at[a], at[b])))
        if r is not None:
            rows.append({"place": place, "a": a, "b": b, "n": r["n"], "r": r["r"]})
    return small_frame(df.sparkSession, rows, schemas.ddl("place int, a string, b string, n long, r double")).select(
        "place", "a", "b", "n", "r", p_value("r", "n").alias("p"))


def correlation_findings(
    df: DataFrame, columns: Sequence[str] | None = None, facts: Mapping[str, NumberFacts] | None = None
) -> DataFrame:
    """Pairs with an absolute correlation above 0.5 that is significant."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    known = facts or number_facts(df, chosen)
    pairs = eligible_pairs(df, chosen, known)
    if not pairs:
        return small_frame(df.sparkSession, [], schemas.ddl(schemas.FINDING))
    strong = pair_correlations(df, pairs, known).where((F.abs("r") > 0.5) & (F.col("p") < 0.05))
    return strong.select(*_finding(
        "correlation", F.col("place"), F.array("a", "b"), F.lit("info"), F.lit(False),
        {"pearson_r": round_to(F.col("r"), 4), "p_value": round_to(F.col("p"), 6), "n": F.col("n")},
        {"strength": F.when(F.abs("r") > 0.7, "strong").otherwise("moderate"),
         "direction": F.when(F.col("r") > 0, "positive").otherwise("negative")}))


# ---------------------------------------------------------------- everything

def full_analysis(df: DataFrame, exact: bool = True) -> DataFrame:
    """All checks over the analytic columns, most severe first.

    Checks that do not need each other run at the same time. The result is a
    local relation: its size depends on the number of columns.
    """
    spark = df.sparkSession
    wanted = [c for c in numeric_columns(df) if not names.not_analytic(c)]
    texts = [c for c in string_columns(df) if not names.not_analytic(c)]
    facts, sketches = together(
        spark, lambda: number_facts(df, wanted, shape=True), lambda: value_sketches(df, texts))
    kept = [c.column for c in choose_columns(df, exact, facts=facts) if c.kept]
    part = df.select(*[col(c) for c in kept])
    columns = numeric_columns(part)
    nulls = {c: (f.rows, f.nulls) for c, f in facts.items()} | {c: (k.rows, k.nulls) for c, k in sketches.items()}

    def from_numbers() -> DataFrame:
        numbers = numbers_table(part, columns, facts)
        return pinned(union_all([summary_finding(numbers), distribution_findings(numbers), anomaly_findings(numbers)]))

    found = together(
        spark, from_numbers, lambda: pinned(null_findings(part, nulls)),
        lambda: pinned(categorical_findings(part, sketches)), lambda: pinned(trend_finding(part)),
        lambda: pinned(correlation_findings(part, columns, facts)))
    return by_severity(union_all(found))


def finding_metrics(findings: DataFrame) -> DataFrame:
    """Long form of the metrics: one row per finding and metric."""
    return findings.select(
        "seq", "stat_type", F.array_join("columns", ",").alias("columns"), "severity", "actionable",
        F.explode("metrics").alias("metric", "value"))
