"""Tables derived from the given ones, used by the registered queries.

The given tables are clean, so dirt is derived from keys by formulas that a SQL
engine can repeat. Everything here is a projection or union of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.functions.text import title_and_rest
from tallylens.schemas import EVIDENCE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with mixed dates, dollar signs, mixed case, nulls and repeated rows."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "concat('ORD', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS order_id",
        "concat('C', lpad(CAST(o_custkey AS STRING), 8, '0')) AS customer_id",
        "date_format(o_orderdate, CASE WHEN o_orderkey % 10 < 3 THEN 'dd/MM/yyyy' ELSE 'yyyy-MM-dd' END) AS order_date",
        "o_orderkey % 7 + 1 AS quantity", "CAST(o_totalprice AS DECIMAL(18,2)) AS price",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS state",
        "o_orderpriority AS method",
    ).selectExpr(
        "k", "order_id", "customer_id", "order_date", "quantity",
        "concat(CASE WHEN k % 5 = 0 THEN '$' ELSE '' END, CAST(price AS STRING)) AS unit_price",
        "CASE WHEN k % 12 <> 0 THEN quantity * CAST(price AS DOUBLE) END AS total_amount",
        "CASE k % 3 WHEN 0 THEN upper(state) WHEN 1 THEN initcap(state) ELSE state END AS status",
        "CASE WHEN k % 4 = 0 THEN concat('  ', method, ' ') ELSE method END AS `Payment Method`",
        "CASE WHEN k % 20 >= 9 THEN element_at(array('North', 'South', 'East', 'West', 'Central'), "
        "CAST(k % 5 AS INT) + 1) END AS region",
        "CASE WHEN k % 4 <> 0 THEN CAST(k % 10 AS DOUBLE) / 10 END AS discount")
    return rows.unionAll(rows.where("k % 33 = 0")).drop("k")


def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the net price, which depends on the extended price."""
    return table(spark, sf_dir, "lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an insight that claims its value as evidence on ``value``."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('EV', CAST(event_id AS STRING)) AS id",
        "CASE event_type WHEN 'error' THEN 'anomaly' WHEN 'click' THEN 'trend' WHEN 'signup' THEN 'comparison' "
        "WHEN 'view' THEN 'summary' ELSE 'distribution' END AS type",
        "array(named_struct('metric', 'peak', 'num', CASE WHEN event_id % 2 = 0 THEN value END, 'txt', CASE "
        "WHEN event_id % 50 = 1 THEN 'n/a' WHEN event_id % 2 = 1 THEN concat('$', CAST(value AS STRING)) END, 'column', 'value'), "
        "named_struct('metric', 'mean', 'num', value, 'txt', CAST(NULL AS STRING), 'column', 'value'), "
        "named_struct('metric', 'peak', 'num', value, 'txt', CAST(NULL AS STRING), 'column', 'nowhere')) AS evidence",
    ).withColumn("evidence", F.col("evidence").cast(EVIDENCE))


def document_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an insight: first line as title, the rest as explanation."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # split before the join, so that an unused rest does not go through its exchange
    docs = title_and_rest(table(spark, sf_dir, "documents"), "text", "first_line", "rest").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("place"), F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("id"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'summary' WHEN 2 THEN 'trend' "
               "WHEN 3 THEN 'distribution' ELSE 'correlation' END").alias("type"),
        F.expr("CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warning' ELSE 'info' END").alias("severity"),
        F.concat(
            F.expr("element_at(array('', 'Null rate: ', 'Declining: ', 'Cancelled: ', 'Increasing: ', 'Pending: '), "
                   "CAST(doc_id % 6 AS INT) + 1)"),
            F.coalesce("first_line", F.lit(""))).alias("title"),
        F.coalesce("rest", F.lit("")).alias("explanation"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN array() ELSE array(named_struct('metric', 'length', 'num', "
               "CAST(n_chars AS DOUBLE), 'txt', CAST(NULL AS STRING), 'column', 'n_chars')) END").cast(EVIDENCE)
        .alias("evidence"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN array('n_chars', source) ELSE array('n_chars') END").alias("affected_columns"),
        F.lit(0.0).alias("confidence"), F.expr("doc_id % 7 = 0").alias("actionable"))


def wrapped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON that is bare, fenced, embedded in prose or broken."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\\n', props, '\\n```') "
        "WHEN 2 THEN concat('Here it is: ', props, ' as asked.') ELSE 'no record' END AS reply")
