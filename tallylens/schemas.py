"""Schemas of the result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


PROFILE = (
    "column string, dtype string, null_pct double, unique_count long, sample_vals array<string>, "
    "semantic_tag string, issues array<string>"
)
QUALITY = (
    "total_rows long, duplicate_rows long, null_row_pct double, columns_failing array<string>, "
    "overall_score double, passed boolean"
)
CONTEXT = "source_type string, domain string, row_count long, column_count int, warnings array<string>"
NUMBERS = (
    "seq int, column string, rows long, nulls long, n long, mean double, std_samp double, std_pop double, "
    "skew double, kurtosis double, low double, high double, q1 double, median double, q3 double, "
    "outliers long, extremes long, max_z double, top_extremes array<double>"
)
FINDING = (
    "seq int, stat_type string, columns array<string>, severity string, actionable boolean, "
    "metrics map<string,double>, labels map<string,string>, series array<double>"
)
RULE_TABLE = (
    "place int, type string, severity string, keyword string, action_type string, impact_level string, "
    "effort_level string, owner string, kpi string, boost double"
)
SIGNATURE_TABLE = "domain string, place int, name string"
EVIDENCE = "array<struct<metric:string,num:double,txt:string,column:string>>"
ORDER_EVENT = (
    "order_id string, customer_id string, product_id string, order_date string, quantity long, "
    "unit_price double, total_amount double, status string, payment_method string, region string, "
    "source string, ingested_at string"
)
