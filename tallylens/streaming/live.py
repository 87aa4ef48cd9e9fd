"""Micro-batches: the batch operators applied to each batch of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallylens import schemas
from tallylens.functions.text import record_from_json
from tallylens.operators.columnwise import col
from tallylens.operators.statistics import full_analysis
from tallylens.plans.ingest import Ingested, describe_and_clean
from tallylens.sources.files import REJECTED, with_rejected

REFRESH = "30 seconds"


def file_events(
    spark: SparkSession, path: str, schema: str | StructType = schemas.ORDER_EVENT, kind: str = "json",
    files_per_batch: int | None = None, keep_rejected: bool = False, **options: str,
) -> DataFrame:
    """A stream over files that arrive in a folder.

    Every batch takes all that has arrived, unless ``files_per_batch`` holds back the rest for later ones.
    A broken CSV or JSON row ends the stream with an error; with ``keep_rejected`` it stays, in the column ``REJECTED``.
    """
    if files_per_batch is not None:
        options["maxFilesPerTrigger"] = str(files_per_batch)
    if kind not in ("csv", "json"):
        return spark.readStream.format(kind).schema(schema).options(**options).load(path)
    if not keep_rejected:
        return spark.readStream.format(kind).schema(schema).options(**{"mode": "FAILFAST", **options}).load(path)
    fields = with_rejected(schema)
    rows = spark.readStream.format(kind).schema(fields).options(columnNameOfCorruptRecord=REJECTED, **options).load(path)
    rejected = F.when(F.isnotnull(REJECTED), F.struct(
        F.col(REJECTED).alias("record"), F.col("_metadata.file_path").alias("origin"), F.lit("broken record").alias("reason")))
    return rows.select(*[col(f.name) for f in fields[:-1]], rejected.alias(REJECTED))


def queue_events(
    spark: SparkSession, servers: str, topic: str, schema: str = schemas.ORDER_EVENT, rows_per_batch: int | None = None
) -> DataFrame:
    """A stream over a Kafka topic of JSON events; needs Spark's Kafka package.

    Messages that are no record stay in it, with their place in the topic (see ``messages_from_text``).
    ``rows_per_batch`` bounds a batch; without it a batch takes all that has arrived.
    """
    bound = {} if rows_per_batch is None else {"maxOffsetsPerTrigger": str(rows_per_batch)}
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").options(**bound).load())
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return messages_from_text(raw.select(F.col("value").cast("string").alias("value"), place.alias("origin")), "value", schema, F.col("origin"))


def messages_from_text(
    df: DataFrame, column: str, schema: str = schemas.ORDER_EVENT, origin: Column | None = None
) -> DataFrame:
    """JSON text to event columns and the column ``REJECTED``: text, origin and reason of a message that is no record,
    or has values of other types, and null for all others (F12)."""
    text = F.col(column)
    broken = F.col("event._corrupt_record")
    reason = (
        F.when(text.isNull(), "no text").when(F.isnull("event"), "no record")
        .when(broken.isNotNull(), "broken record or value of another type"))
    rejected = F.when(reason.isNotNull(), F.struct(
        text.alias("record"), (F.lit(None).cast("string") if origin is None else origin).alias("origin"), reason.alias("reason")))
    parsed = df.withColumn("event", record_from_json(text, f"{schema}, _corrupt_record string"))
    return parsed.select("event.*", rejected.alias(REJECTED)).drop("_corrupt_record")


def events_from_text(df: DataFrame, column: str, schema: str = schemas.ORDER_EVENT) -> DataFrame:
    """Only the messages that are records; ``messages_from_text`` keeps the others."""
    return messages_from_text(df, column, schema).where(F.isnull(REJECTED)).drop(REJECTED)


def describe_batch(
    batch: DataFrame, table_path: str | None = None, rejected: DataFrame | None = None
) -> Ingested | None:
    """Profile, quality, domain and cleaning of one batch; None for an empty one."""
    if not batch.head(1) and (rejected is None or not rejected.head(1)):
        return None
    return describe_and_clean(batch, "live_stream", with_warnings=False, table_path=table_path, rejected=rejected)


def start_live(
    events: DataFrame, sink: str, checkpoint: str, analyse: bool = True, once: bool = False, every: str = REFRESH
) -> StreamingQuery:
    """Describe, clean and analyse every batch and store it below ``sink``.

    Each result goes to a folder of its own batch number and replaces what an
    earlier attempt at that batch left there, so repeating a batch after a
    failure does not store it twice. Rejected messages go to ``sink/rejected``
    and are counted in the warnings of the batch's context.
    """
    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            good, rejected = rows, None
            if REJECTED in rows.columns:
                good = rows.where(F.isnull(REJECTED)).drop(REJECTED)
                rejected = rows.where(F.isnotnull(REJECTED)).select(f"{REJECTED}.*")
                rejected.write.mode("overwrite").parquet(f"{sink}/rejected/batch_id={number}")
            result = describe_batch(good, f"{sink}/table/batch_id={number}", rejected)
            if result is None:
                return
            for name in ("context", "quality", "profile"):
                getattr(result, name).write.mode("overwrite").parquet(f"{sink}/{name}/batch_id={number}")
            if analyse:
                full_analysis(result.table).write.mode("overwrite").parquet(f"{sink}/findings/batch_id={number}")
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stored(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """All batches of one result, with their ``batch_id``."""
    return spark.read.option("basePath", f"{sink}/{name}").parquet(f"{sink}/{name}")


def backlog(query: StreamingQuery) -> dict:
    """Rows of the last batch and, where the source tells, how far it is behind."""
    progress = query.lastProgress
    if progress is None:
        return {"batch_id": None, "rows": 0, "behind": None}
    behind = [
        int(s["metrics"]["maxOffsetsBehindLatest"]) for s in progress["sources"]
        if s.get("metrics") and "maxOffsetsBehindLatest" in s["metrics"]
    ]
    return {"batch_id": progress["batchId"], "rows": progress["numInputRows"], "behind": max(behind, default=None)}
