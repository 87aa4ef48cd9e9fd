"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "tallylens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    The time zone is pinned because month truncation depends on it. Recording
    the call site of every column expression is off, as it slows down building
    plans with many branches. Statistics scan few columns at a time, so on very
    large inputs the number of scan tasks is bounded and each reads a longer
    stretch of its columns. Shuffle partition counts are left to adaptive
    execution unless the caller sets them.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.files.maxPartitionNum", "50000")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, since there the
    driver and the executors are one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallylens-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call names a new one.

    All paths of an application lie below its id, so they can be removed
    together once its results are no longer read.
    """
    return f"{shared_dir(spark)}/tallylens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table once as Parquet and read it back.

    Later passes then read single columns, and a lost executor costs a re-read
    instead of the whole lineage. Without ``path`` the shared folder is used.
    """
    target = path or scratch_path(df.sparkSession, f"{name}.parquet")
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write a table once in buckets of a column and read it back: joins by that column leave it where it is.

    As many buckets as Spark has shuffle partitions, so that the other side of such a join is dealt out the same way. The
    catalog only needs to know the table until it is resolved; its files stay in the shared folder.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"spark_catalog.default.{name}_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", scratch_path(spark, f"{name}.parquet")).format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"drop table {table}")
    return found
