"""Input tables of the queries, with only the columns an operator names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's named columns; others, whatever their names, are not read."""
    return pick(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


def pick(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fold(doc_id) -> F.Column:
    """The remainder by which rows are held out of training (null ids count as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def agreed(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled document; documents whose labels contradict each other or are null are left out."""
    low, high = F.min(column), F.max(column)
    return (
        pick(labels, "doc_id", column).where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id")
        .agg(low.alias("label"), high.alias("other")).where("label = other").select("doc_id", F.col("label").cast("int")))


def bounded_sample(keys: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of doc_id: a top-n, every task keeps its n best."""
    return keys.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
