"""Which business domain a table belongs to, judged by its column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.functions.names import DOMAIN_SIGNATURES
from tallylens.operators.columnwise import small_frame
from tallylens.schemas import SIGNATURE_TABLE, ddl

THRESHOLD = 0.3


def domain_scores(names: Column, signatures: Mapping[str, Sequence[str]] = DOMAIN_SIGNATURES) -> Column:
    """``array<struct<score, domain>>`` for an array column of lower-case names."""
    return F.array(*[
        F.struct(
            (F.size(F.array_intersect(names, F.array(*[F.lit(c) for c in signature]))) / F.lit(float(len(signature))))
            .alias("score"),
            F.lit(domain).alias("domain"))
        for domain, signature in signatures.items()
    ])


def best_domain(names: Column, signatures: Mapping[str, Sequence[str]] = DOMAIN_SIGNATURES) -> Column:
    """``struct<score, domain>``: the best score, the first declared where tied.

    The domain is ``unknown`` unless the score exceeds the threshold.
    """
    none = F.struct(F.lit(-1.0).alias("score"), F.lit("unknown").alias("domain"))
    best = F.aggregate(
        domain_scores(names, signatures), none, lambda a, s: F.when(s["score"] > a["score"], s).otherwise(a))
    return F.struct(
        best["score"].alias("score"),
        F.when(best["score"] > THRESHOLD, best["domain"]).otherwise("unknown").alias("domain"))


def detect_domain(df: DataFrame, signatures: Mapping[str, Sequence[str]] = DOMAIN_SIGNATURES) -> DataFrame:
    """Row count, column count, domain and score of a table."""
    names = F.array(*[F.lit(c) for c in sorted({c.lower() for c in df.columns})])
    best = best_domain(names, signatures)
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"),
        best["domain"].alias("domain"), best["score"].alias("score"))


def domain_of(df: DataFrame, signatures: Mapping[str, Sequence[str]] = DOMAIN_SIGNATURES) -> str:
    """The domain alone (A11), from the column names; no row is read."""
    names = F.array(*[F.lit(c) for c in sorted({c.lower() for c in df.columns})])
    return df.sparkSession.range(1).select(best_domain(names, signatures)["domain"].alias("domain")).head()["domain"]


def signatures_table(spark: SparkSession, signatures: Mapping[str, Sequence[str]] = DOMAIN_SIGNATURES) -> DataFrame:
    """The signatures as a table for :func:`match_domains`: one row per domain and name, ``place`` gives the order."""
    rows = [{"domain": d, "place": i, "name": n} for i, (d, names) in enumerate(signatures.items()) for n in names]
    return small_frame(spark, rows, ddl(SIGNATURE_TABLE))


def match_domains(held: DataFrame, signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Domain and score of every ``source``, from the names it holds (J6, A11, U4) and a table of signatures.

    ``held`` has ``source`` and ``name``, repeats allowed; names meet in lower case and null names count for nothing. The
    score is the share of a signature's names that are held; the best one wins, then the smallest ``place``, then the
    domain's name. A source below the threshold is ``unknown``. Names merge on the map side, once per source and task.
    """
    wanted = signatures.select("domain", "place", F.lower("name").alias("name")).groupBy("domain", "name").agg(F.min("place").alias("place"))
    sizes = wanted.groupBy("domain").agg(F.count("name").alias("size"), F.min("place").alias("place"))
    names = held.select("source", F.lower("name").alias("name")).distinct()
    hits = names.join(wanted.select("domain", "name"), "name", "left").groupBy("source", "domain").agg(F.count("domain").alias("hits"))
    scored = hits.join(sizes, "domain", "left").select(
        "source", "domain", "place", F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0)).alias("score"))
    best = scored.groupBy("source").agg(F.min(F.struct((-F.col("score")).alias("minus"), "place", "domain")).alias("best"))
    score = F.abs(F.col("best.minus"))
    return best.select(
        "source", F.when(score > threshold, F.col("best.domain")).otherwise("unknown").alias("domain"), score.alias("score"))
