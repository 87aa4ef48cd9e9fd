"""Named queries over the given tables.

Every query takes ``(spark, folder of parquet tables)`` and returns a
DataFrame. The SQL that a second engine runs for comparison is in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.fixtures import (
    dirty_orders, document_insights, event_claims, priced_lineitem, table, wrapped_json,
)
from tallylens.functions.numbers import round_to
from tallylens.functions.text import ascii_words, leading_word, record_from_json, short_title, title_and_rest, word_count
from tallylens.operators import charts, critic, decisions, domain, facts, insights, profile, quality, statistics
from tallylens.operators.clean import clean
from tallylens.operators.columnwise import small_frame, union_all
from tallylens.plans.analyze import analyze, document
from tallylens.plans.ingest import Ingested, describe_and_clean, ingest
from tallylens.schemas import ddl
from tallylens.session import scratch_path
from tallylens.sources.files import exact_sample, read_table, staged, write_table
from tallylens.streaming.live import file_events, start_live, stored
from tallylens.streaming.message_queue import drained, enqueue, queue_length, queued_events, read_up_to

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(name: str, separator: str = ",") -> Column:
    return F.array_join(name, separator).alias(name)


def _context(done: Ingested) -> DataFrame:
    return done.context.select(
        "source_type", "domain", "row_count", F.col("column_count").cast("long").alias("column_count"),
        F.size("warnings").cast("long").alias("n_warnings"))


# ---------------------------------------------------------------- sources and sinks

@query
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "orders.csv")
    write_table(dirty_orders(spark, sf_dir), path)
    return read_table(spark, path).withColumn("quantity", F.col("quantity").cast("long"))


@query
def csv_text_scan(spark, sf_dir):
    path = scratch_path(spark, "documents.csv")
    write_table(table(spark, sf_dir, "documents"), path)
    return read_table(spark, path).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "n_chars")})


@query
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "conversations.json")
    write_table(table(spark, sf_dir, "conversations"), path)
    return read_table(spark, path).select("conv_id", "turn", "role", "text")


@query
def jsonl_scan(spark, sf_dir):
    path = scratch_path(spark, "events.jsonl")
    write_table(table(spark, sf_dir, "events"), path)
    kinds = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return read_table(spark, path, kinds).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))


def _as_arrays(batches):
    """The objects of each task as one JSON array."""
    begun = False
    for batch in batches:
        texts = batch["object"].to_pylist()
        if texts:
            yield pa.record_batch({"value": pa.array([("," if begun or i else "[") + t for i, t in enumerate(texts)])})
            begun = True
    yield pa.record_batch({"value": pa.array(["]" if begun else "[]"])})


@query
def json_array_scan(spark, sf_dir):
    """All documents from files that hold one array each, of objects that take several lines."""
    path = scratch_path(spark, "documents.json")
    table(spark, sf_dir, "documents").select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("object")).mapInArrow(
        _as_arrays, "value string").write.text(path)
    return read_table(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query
def parquet_scan(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query
def sampled_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return exact_sample(events, 1000, order=F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string"))))


@query
def sampled_scan_row_hash(spark, sf_dir):
    picked = exact_sample(table(spark, sf_dir, "lineitem"), 1000)
    return picked.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query
def result_document(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ingested = describe_and_clean(events, "static_csv")
    path = scratch_path(spark, "result.json")
    write_table(document(ingested, analyze(ingested.table, ingested.domain, ingested.row_count)), path)
    return spark.read.json(path).select(
        "success", "domain", "total_rows", F.size("insights").alias("n_insights"),
        F.col("critic.passed_count").alias("passed_count"), F.col("critic.rejected_count").alias("rejected_count"),
        F.size("decisions").alias("n_decisions"), F.size("chart_plans").alias("n_plans"),
        F.col("quality.overall_score").alias("overall_score"))


@query
def ingest_file(spark, sf_dir):
    """From a CSV file to what is known about its table."""
    path = scratch_path(spark, "orders.csv")
    write_table(dirty_orders(spark, sf_dir), path)
    return _context(ingest(spark, path))


# ---------------------------------------------------------------- profile, quality, domain

@query
def column_profile(spark, sf_dir):
    return profile.profile(dirty_orders(spark, sf_dir)).select(
        "column", "null_pct", "unique_count", "semantic_tag", joined("issues"), F.size("sample_vals").alias("n_samples"))


@query
def profile_warnings(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir)
    return profile.warnings(profile.profile(orders), quality.quality_report(orders))


@query
def null_fractions(spark, sf_dir):
    return profile.null_fractions(dirty_orders(spark, sf_dir)).withColumn("null_pct", round_to(F.col("null_pct"), 6))


@query
def quality_report(spark, sf_dir):
    return quality.quality_report(dirty_orders(spark, sf_dir)).withColumn(
        "columns_failing", F.array_join("columns_failing", ","))


@query
def duplicate_rows(spark, sf_dir):
    return union_all([
        quality.duplicate_count(frame).select(F.lit(name).alias("source"), "*")
        for name, frame in (("dirty_orders", dirty_orders(spark, sf_dir)),
                            ("documents", table(spark, sf_dir, "documents").drop("doc_id", "n_chars")))
    ])


@query
def domain_detect(spark, sf_dir):
    frames = {"dirty_orders": dirty_orders(spark, sf_dir)}
    frames |= {n: table(spark, sf_dir, n) for n in ("lineitem", "events", "customer")}
    return union_all([
        domain.detect_domain(f).select(F.lit(n).alias("source"), "*").withColumn("score", round_to(F.col("score"), 6))
        for n, f in frames.items()
    ])


@query
def domain_match_table(spark, sf_dir):
    """The words of all documents, by source, against the built-in signatures and one of languages' words."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(ascii_words(F.col("text"))).alias("name"))
    own = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("first_"), "lang").alias("domain"), F.lit(9).alias("place"),
        leading_word(F.col("text")).alias("name")).where("name <> ''").distinct()
    found = domain.match_domains(words, domain.signatures_table(spark).unionByName(own))
    return found.withColumn("score", round_to(F.col("score"), 6))


def _choices(spark, sf_dir, **options) -> DataFrame:
    rows = [
        {"source": name, "column": c.column, "kept": c.kept, "reason": c.reason}
        for name in ("orders", "lineitem", "events", "part", "customer", "documents")
        for c in facts.choose_columns(table(spark, sf_dir, name), **options)
    ]
    return small_frame(spark, rows, ddl("source string, column string, kept boolean, reason string"))


@query
def analytic_columns(spark, sf_dir):
    return _choices(spark, sf_dir)


@query
def useful_columns(spark, sf_dir):
    return _choices(spark, sf_dir, max_string_uniques=50)


@query
def distinct_values(spark, sf_dir):
    orders = dirty_orders(spark, sf_dir)
    counts = facts.distinct_counts(orders, orders.columns)
    return small_frame(spark, [{"column": c, "n": n} for c, n in counts.items()], ddl("column string, n long"))


# ---------------------------------------------------------------- cleaning

@query
def clean_orders(spark, sf_dir):
    return clean(dirty_orders(spark, sf_dir)).withColumn("total_amount", round_to(F.col("total_amount"), 4))


@query
def ingest_context(spark, sf_dir):
    return _context(describe_and_clean(dirty_orders(spark, sf_dir), "static_csv"))


@query
def json_replies(spark, sf_dir):
    parsed = wrapped_json(spark, sf_dir).select("event_id", record_from_json(F.col("reply"), "k long").alias("r"))
    return parsed.select("event_id", F.col("r.k").alias("k"))


@query
def text_titles(spark, sf_dir):
    documents = title_and_rest(table(spark, sf_dir, "documents"), "text", "title", "rest")
    return documents.select(
        "doc_id", short_title(F.col("title")).alias("short_title"),
        word_count(F.col("title")).cast("long").alias("title_words"), word_count(F.col("rest")).cast("long").alias("rest_words"))


# ---------------------------------------------------------------- statistics

def _flat(findings: DataFrame, *metrics: str, **extra: Column) -> DataFrame:
    return findings.select(
        F.array_join("columns", ",").alias("columns"), "severity", "actionable",
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics], *[c.alias(k) for k, c in extra.items()])


def _counts(name: str) -> Column:
    """A list of counts as text."""
    return F.array_join(F.transform(name, lambda v: v.cast("long")), ",")


@query
def summary_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    numbers = statistics.numbers_table(lines, shape=False, extremes=False)
    return statistics.summary_rows(numbers).drop("seq")


@query
def null_findings(spark, sf_dir):
    return _flat(statistics.null_findings(dirty_orders(spark, sf_dir)), "null_pct", "null_count")


DISTRIBUTION = ("mean", "std", "skew", "kurtosis", "outlier_count", "outlier_pct", "q1", "q3", "iqr")


@query
def distribution_events(spark, sf_dir):
    numbers = statistics.numbers_table(table(spark, sf_dir, "events"), ["value"])
    return _flat(statistics.distribution_findings(numbers), *DISTRIBUTION)


@query
def distribution_lineitem(spark, sf_dir):
    numbers = statistics.numbers_table(table(spark, sf_dir, "lineitem"))
    return _flat(statistics.distribution_findings(numbers), *DISTRIBUTION)


@query
def categorical(spark, sf_dir):
    found = union_all([
        statistics.categorical_findings(f)
        for f in (table(spark, sf_dir, "orders"), table(spark, sf_dir, "events"), dirty_orders(spark, sf_dir))
    ])
    return _flat(found, "n_unique", "top_pct", "bottom_pct", "imbalance_ratio",
                 top_value=F.col("labels")["top_value"], top_5=_counts("series"))


@query
def monthly_means(spark, sf_dir):
    months = statistics.monthly(table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"])
    return months.select(
        F.date_format("month", "yyyy-MM-dd").alias("month"), "order_count",
        round_to(F.col("o_totalprice_mean"), 2).alias("o_totalprice_mean"))


@query
def monthly_trend(spark, sf_dir):
    found = statistics.trend_finding(table(spark, sf_dir, "orders"))
    return _flat(found, "slope", "trend_pct_per_period", "r_squared", "p_value", "n_periods",
                 direction=F.col("labels")["direction"], significant=F.col("labels")["significant"],
                 monthly_counts=_counts("series"))


CORRELATED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]


@query
def correlation(spark, sf_dir):
    found = statistics.correlation_findings(priced_lineitem(spark, sf_dir).select(*CORRELATED))
    return found.select(
        F.array_join("columns", ",").alias("columns"), F.col("metrics")["pearson_r"].alias("pearson_r"),
        F.col("metrics")["p_value"].alias("p_value"), F.col("metrics")["n"].cast("long").alias("n"),
        F.col("labels")["strength"].alias("strength"), F.col("labels")["direction"].alias("direction"))


@query
def pair_p_values(spark, sf_dir):
    lines = priced_lineitem(spark, sf_dir).select(*CORRELATED)
    pairs = statistics.eligible_pairs(lines, CORRELATED, facts.number_facts(lines))
    return statistics.pair_correlations(lines, pairs).select(
        "a", "b", "n", round_to(F.col("r"), 6).alias("r"), round_to(F.col("p"), 5).alias("p"))


@query
def zscore_anomaly(spark, sf_dir):
    found = statistics.anomaly_findings(
        statistics.numbers_table(table(spark, sf_dir, "events"), ["value"], shape=False, quartiles=False))
    return _flat(found, "n_anomalies", "anomaly_pct", "max_z_score", "column_mean", "column_std",
                 anomaly_values=F.array_join("series", ","))


@query
def full_analysis(spark, sf_dir):
    return statistics.finding_metrics(statistics.full_analysis(table(spark, sf_dir, "events")))


@query
def full_analysis_orders(spark, sf_dir):
    cleaned = staged(clean(dirty_orders(spark, sf_dir)), "clean")
    return statistics.full_analysis(cleaned).select(
        "seq", "stat_type", F.array_join("columns", ",").alias("columns"), "severity", "actionable")


# ---------------------------------------------------------------- insights and their checks

@query
def event_insights(spark, sf_dir):
    found = insights.insights_from(statistics.full_analysis(table(spark, sf_dir, "events")))
    return found.select("id", "type", "severity", "title", "explanation", "actionable", joined("affected_columns"))


@query
def insight_evidence(spark, sf_dir):
    found = insights.insights_from(statistics.full_analysis(table(spark, sf_dir, "events")))
    return found.select("id", F.inline("evidence"))


@query
def executive_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = insights.insights_from(statistics.full_analysis(events))
    return insights.executive_summary(found, "unknown", events.count())


@query
def claim_check(spark, sf_dir):
    ranges = critic.plausible_ranges(table(spark, sf_dir, "events").select("value"))
    return event_claims(spark, sf_dir).select("id", F.array_join(critic.evidence_flags(ranges), ";").alias("flags"))


def _judged_documents(spark, sf_dir, keep=None) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ranges = critic.plausible_ranges(documents.select("n_chars"))
    return critic.judged(document_insights(spark, sf_dir), documents.columns, ranges, keep)


def _verdicts(spark, sf_dir) -> DataFrame:
    return _judged_documents(spark, sf_dir, ["id"]).select(F.col("id").alias("insight_id"), "verdict.*")


@query
def insight_score(spark, sf_dir):
    return _verdicts(spark, sf_dir).withColumn("flags", F.array_join("flags", ";"))


@query
def critic_report(spark, sf_dir):
    return critic.critic_report(_verdicts(spark, sf_dir))


@query
def validated_insights(spark, sf_dir):
    return critic.passed_insights(document_insights(spark, sf_dir), _verdicts(spark, sf_dir)).select(
        "id", "type", "severity", "confidence", "actionable")


def _validated(spark, sf_dir) -> DataFrame:
    return critic.accepted(_judged_documents(spark, sf_dir))


# ---------------------------------------------------------------- decisions

@query
def rule_match(spark, sf_dir):
    matched = document_insights(spark, sf_dir).select("id", "type", "severity", decisions.matching_action().alias("act"))
    return matched.select("id", "type", "severity", "act.*")


@query
def rule_match_table(spark, sf_dir):
    """Every document against a table of rules: one per region in front of the built-in ones."""
    own = table(spark, sf_dir, "region").selectExpr(
        "CAST(r_regionkey - 100 AS INT) AS place", "CAST(NULL AS STRING) AS type",
        "CASE WHEN r_regionkey % 2 = 0 THEN 'info' END AS severity", "lower(left(r_name, 2)) AS keyword", "'route' AS action_type",
        "'low' AS impact_level", "'low' AS effort_level", "r_name AS owner", "'share_of_region' AS kpi", "0.05D AS boost")
    matched = decisions.match_rules(
        document_insights(spark, sf_dir).select("id", "type", "severity", "title"), own.unionByName(decisions.rules_table(spark)))
    return matched.select("id", "type", "severity", "act.*")


@query
def ranked_decisions(spark, sf_dir):
    return decisions.decisions_for(_validated(spark, sf_dir)).select(
        "id", "insight_id", "action_type", "impact_level", "effort_level", "owner", "kpi", "priority_score")


@query
def quick_wins(spark, sf_dir):
    return decisions.decisions_for(_validated(spark, sf_dir)).where(decisions.is_quick_win()).select(
        "id", "insight_id", "impact_level", "priority_score")


@query
def action_summary(spark, sf_dir):
    return decisions.action_summary(decisions.decisions_for(_validated(spark, sf_dir)), "unknown")


@query
def severity_breakdown(spark, sf_dir):
    return decisions.severity_breakdown(document_insights(spark, sf_dir)).select("severity", "n", "bar")


@query
def effort_impact(spark, sf_dir):
    return decisions.effort_impact(decisions.decisions_for(_validated(spark, sf_dir))).drop("title")


# ---------------------------------------------------------------- charts

@query
def chart_bar(spark, sf_dir):
    return charts.bar_chart(table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM")),
                            "l_shipmonth").drop("place")


@query
def chart_bar_rest(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return charts.bar_with_rest(months, "l_shipmonth").withColumn("place", F.col("place").cast("long"))


@query
def chart_bar_default(spark, sf_dir):
    return charts.bar_chart(table(spark, sf_dir, "orders")).withColumn("place", F.col("place").cast("long"))


@query
def chart_bar_mean(spark, sf_dir):
    return charts.bar_chart(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "mean").drop("place")


@query
def chart_bar_sum(spark, sf_dir):
    return charts.bar_chart(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "sum").drop("place")


@query
def chart_pie(spark, sf_dir):
    return charts.pie_chart(table(spark, sf_dir, "part"), "p_brand").withColumn("place", F.col("place").cast("long"))


@query
def chart_hist(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "events"), "value").select(
        "series", F.col("bin").cast("long").alias("bin"), round_to(F.col("start"), 4).alias("start"),
        round_to(F.col("end"), 4).alias("end"), "n")


@query
def chart_line(spark, sf_dir):
    return charts.line_chart(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select(
        "month", round_to(F.col("value"), 2).alias("value"), round_to(F.col("trend"), 2).alias("trend"))


@query
def chart_scatter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return charts.scatter(events, "user_id", "value", "event_type",
                          order=F.md5(F.concat(F.lit("42:"), F.col("event_id").cast("string"))))


@query
def chart_scatter_trend(spark, sf_dir):
    ends = charts.scatter_trend(table(spark, sf_dir, "events"), "user_id", "value")
    return ends.select("x", round_to(F.col("y"), 4).alias("y"))


@query
def chart_corr_matrix(spark, sf_dir):
    return charts.correlation_matrix(priced_lineitem(spark, sf_dir).select(*CORRELATED)).select(
        "x", "y", round_to(F.col("r"), 6).alias("r"))


@query
def chart_column_stats(spark, sf_dir):
    stats = profile.column_chart_stats(table(spark, sf_dir, "orders").drop("o_orderdate"))
    return stats.withColumn("top_vals", F.array_join(F.transform(
        "top_vals", lambda v: F.concat(v["value"], F.lit("="), v["n"].cast("string"))), ","))


@query
def text_top_values(spark, sf_dir):
    """The most frequent whole texts of the documents; most places are ties."""
    found = statistics.top_values(table(spark, sf_dir, "documents"), ["text", "lang", "source"], 25)
    return found.select("column", F.posexplode("top_vals").alias("place", "top")).select("column", "place", "top.*")


@query
def chart_slim_stats(spark, sf_dir):
    stats = profile.column_chart_stats(table(spark, sf_dir, "customer"))
    return profile.slim_chart_stats(stats, ["c_acctbal"]).select("column", "kind", "mean", "low", "high")


@query
def chart_plans(spark, sf_dir):
    return charts.chart_plans(document_insights(spark, sf_dir)).select(
        "insight_id", "chart_type", "title", "x_column", "y_column", "aggregation")


@query
def plan_captions(spark, sf_dir):
    found = document_insights(spark, sf_dir)
    return charts.plan_captions(charts.chart_plans(found), found)


@query
def box_spread(spark, sf_dir):
    numbers = statistics.numbers_table(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return charts.box_spread(statistics.distribution_findings(numbers))


@query
def outlier_annotations(spark, sf_dir):
    numbers = statistics.numbers_table(table(spark, sf_dir, "events"), ["value"], shape=False, quartiles=False)
    return charts.outlier_annotations(statistics.anomaly_findings(numbers)).withColumn("place", F.col("place").cast("long"))


@query
def spec_captions(spark, sf_dir):
    return charts.spec_captions(statistics.full_analysis(table(spark, sf_dir, "events"))).drop("seq")


# ---------------------------------------------------------------- streams

EVENT_COLUMNS = "event_id long, user_id long, event_type string, value double, props string"


@query
def stream_batches(spark, sf_dir):
    source, sink = scratch_path(spark, "incoming"), scratch_path(spark, "live")
    table(spark, sf_dir, "events").drop("ts").repartition(6).write.json(source)
    live = file_events(spark, source, EVENT_COLUMNS, files_per_batch=3)
    start_live(live, sink, scratch_path(spark, "checkpoint"), analyse=False, once=True).awaitTermination()
    return stored(spark, sink, "table").groupBy("event_type").agg(
        F.count("*").alias("n"), round_to(F.sum("value"), 2).alias("total"), F.count_distinct("event_id").alias("ids"))


@query
def stream_findings(spark, sf_dir):
    sink = scratch_path(spark, "live")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    live = file_events(spark, sf_dir, schema, "parquet", pathGlobFilter="events.parquet")
    start_live(live, sink, scratch_path(spark, "checkpoint"), once=True).awaitTermination()
    return statistics.finding_metrics(stored(spark, sink, "findings")).drop("seq")


def _drain_queue(spark, sf_dir, kinds: str, sink: str):
    """The events through a queue of two appends, in batches of a quarter of them; also the queue and the batches' progress."""
    events = table(spark, sf_dir, "events")
    queue, checkpoint = scratch_path(spark, "queue"), scratch_path(spark, "checkpoint")
    enqueue(events.where("event_id % 2 = 0"), queue)
    enqueue(events.where("event_id % 2 <> 0 OR event_id IS NULL"), queue)
    bound = max(-(-queue_length(spark, queue) // 4), 1)
    live = queued_events(spark, queue, f"{checkpoint}/queue", kinds, bound)
    return queue, drained(start_live(live, sink, checkpoint, analyse=False, every="0 seconds"))


@query
def stream_rows(spark, sf_dir):
    sink = scratch_path(spark, "live")
    _drain_queue(spark, sf_dir, f"{EVENT_COLUMNS}, ts timestamp", sink)
    read = stored(spark, sink, "table")
    largest = read.groupBy("batch_id").count().agg(F.max("count")).scalar()
    return read.groupBy("event_type").agg(
        F.count("*").alias("n"), round_to(F.sum("value"), 2).alias("total"), F.count_distinct("event_id").alias("ids"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSS").alias("last_ts")).withColumn("largest_batch", largest)


@query
def stream_backlog(spark, sf_dir):
    queue, batches = _drain_queue(spark, sf_dir, EVENT_COLUMNS, scratch_path(spark, "live"))
    total = queue_length(spark, queue)
    return small_frame(spark, [
        {"batch": at, "rows": p["numInputRows"], "behind": total - read_up_to(p)} for at, p in enumerate(batches)],
        ddl("batch long, rows long, behind long"))


# ---------------------------------------------------------------- everything

@query
def result_fields(spark, sf_dir):
    done = describe_and_clean(dirty_orders(spark, sf_dir), "static_csv")
    path = scratch_path(spark, "result.json")
    write_table(document(done, analyze(done.table, done.domain, done.row_count)), path)
    result = spark.read.json(path)
    cleaned = spark.read.parquet(result.select("df_path").first()[0])
    order_ids = F.filter("columns", lambda c: c["column"] == "order_id")[0]["unique_count"]
    return result.select(
        F.col("total_insights").cast("long").alias("total_insights"), F.col("top_priority.insight_id").alias("top_insight"),
        F.col("top_priority.priority_score").alias("top_score"), F.col("critic.retry_was_used").alias("retry_was_used"),
        (F.col("processing_ms") > 0).alias("timed"), order_ids.alias("order_ids"),
        cleaned.agg(F.count("*")).scalar().alias("clean_rows"))


@query
def analyze_orders(spark, sf_dir):
    done = describe_and_clean(dirty_orders(spark, sf_dir), "static_csv")
    return analyze(done.table, done.domain, done.row_count).decisions.select(
        "id", "insight_id", "action_type", "impact_level", "effort_level", "owner", "kpi", "priority_score")
