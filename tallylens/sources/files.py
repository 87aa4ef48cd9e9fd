"""Tables from and to files: CSV, JSON, JSON lines and Parquet; exact samples."""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, MapType, StringType, StructField, StructType, _parse_datatype_string

from tallylens.operators.columnwise import col
from tallylens.operators.facts import group_key
from tallylens.operators.multiset import fresh_name
from tallylens.session import scratch_path, staged
from tallylens.sources.records import LISTING, Cut, csv_steps, pieces, records

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}
CELL_DIGITS = 4  # 65,536 cells per division of a sample's histogram
SEPARATORS = (",", ";", "\t", "|")
REJECTED = "__rejected"  # the raw record of a row that does not fit its table, else null
DIALECT = ("quote", "escape", "comment", "lineSep", "encoding", "charset")


def format_of(path: str) -> str:
    """The format that the file suffix names, in any letter case."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"Unsupported file type: {suffix or path}")
    return FORMATS[suffix]


def _head(spark: SparkSession, path: str, end: str | None, n: int) -> list:
    """The first stretches that are not empty, by default lines."""
    try:
        return (spark.read.options(lineSep=end) if end else spark.read).text(path).where(F.trim("value") != "").head(n)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"File not found: {path}") from None
        raise


def _first_lines(spark: SparkSession, path: str, n: int = 2) -> list[str]:
    return [r[0] for r in _head(spark, path, None, n)]


def _separator(lines: list[str]) -> str:
    """The candidate that occurs most often in the header and equally in the next line."""
    def score(sep: str) -> tuple[int, int]:
        counts = [re.sub('"[^"]*"?', "", line).count(sep) for line in lines]
        return (len(set(counts)) == 1 and counts[0] > 0, counts[0] if counts else 0)

    return max(SEPARATORS, key=score)


def _is_number(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def _has_header(lines: list[str], separator: str) -> bool:
    """A first line is a header if it is filled everywhere and holds no number."""
    tokens = [t.strip().strip('"') for t in lines[0].split(separator)] if lines else []
    return bool(tokens) and all(t and not _is_number(t) for t in tokens)


def _spans_lines(spark: SparkSession, path: str, separator: str, options: dict[str, str]) -> bool:
    """Whether a CSV line ends inside of a quoted value, found by a scan of the lines that hold quotes."""
    opened, _ = csv_steps(F.col("text"), separator)
    return not pieces(spark, path, "\n", options).where(opened).select("block").limit(1).isEmpty()


def with_rejected(schema: str | StructType) -> StructType:
    """A schema with the column for raw records."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return StructType([*(f for f in fields if f.name != REJECTED), StructField(REJECTED, StringType())])


# the types that a column of CSV texts may have, tried in this order, and how their values look; other columns stay texts
CSV_TYPES = {
    "int": r"^[+-]?[0-9]+\z", "bigint": r"^[+-]?[0-9]+\z", "double": r"^\S+\z", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\S*\z", "boolean": r"^(?i)(true|false)\z",
}


def _guessed(rows: DataFrame, columns: list[str]) -> StructType:
    """The first type that fits all values of each column, by one pass."""
    def fits(c: str, kind: str) -> Column:
        return F.count_if((col(c) != "") & ~(col(c).rlike(CSV_TYPES[kind]) & F.isnotnull(col(c).try_cast(kind)))) == 0

    found = rows.agg(*[F.struct(*[fits(c, t).alias(t) for t in CSV_TYPES], (F.count_if(col(c) != "") > 0).alias("any")).alias(f"c{i}")
                       for i, c in enumerate(columns)]).first()
    pick = lambda r: next((t for t in CSV_TYPES if r["any"] and r[t]), "string")
    return StructType([StructField(c, _parse_datatype_string(pick(found[f"c{i}"]))) for i, c in enumerate(columns)])


def _csv_records(spark: SparkSession, path: str, schema: str | StructType | None, separator: str, options: dict[str, str]) -> DataFrame:
    """CSV whose values may hold line breaks, cut to records by all tasks; each record is read by Spark's CSV parser."""
    header = options["header"] == "true"
    found = records(spark, path, Cut("\n"), options, separator)
    # a record ends with its line, of which a carriage return is a part; empty lines are no records
    texts = found.where(~F.col("first") if header else F.lit(True)).select(F.regexp_replace("record", "\r$", "").alias("record")).where(
        F.trim("record") != "")
    parser = {k: v for k, v in options.items() if k not in (*LISTING, "header", "inferSchema")}
    names = spark.read.options(**{**options, "inferSchema": "false", "multiLine": "true"}).csv(path).columns

    def parsed(fields: StructType) -> DataFrame:
        # all fields are asked for, so that a row is judged alike whatever is selected
        ddl = ", ".join(f"`{x.name.replace('`', '``')}` {x.dataType.simpleString()}" for x in with_rejected(fields))
        return texts.select(F.from_csv("record", ddl, parser).alias("r")).select("r.*")

    if schema is None:
        plain = [c for c in names if c != REJECTED]
        schema = _guessed(parsed(StructType([StructField(c, StringType()) for c in plain])), plain)
    return parsed(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _csv_rows(spark: SparkSession, path: str, schema: str | StructType | None, options: dict[str, str]) -> DataFrame:
    lines = _first_lines(spark, path)
    separator = options.pop("sep", None) or _separator(lines)
    header = options.pop("header", None)
    if header is None:
        header = str(_has_header(lines, separator)).lower()
    multi_line = options.pop("multiLine", None)
    options = {"sep": separator, "header": str(header).lower(), "escape": '"', "columnNameOfCorruptRecord": REJECTED, "columnPruning": "false", **options}
    if multi_line is None and any(k in options for k in DIALECT if k != "escape") | (options["escape"] != '"') | (len(separator) > 1):
        multi_line = "true"  # the cutting knows the usual quotes only
    elif multi_line is None and _spans_lines(spark, path, separator, options):
        return _csv_records(spark, path, schema, separator, options)
    options["multiLine"] = multi_line or "false"
    if schema is None:
        options["inferSchema"] = "true"
        schema = spark.read.options(**options).csv(path).schema
    return spark.read.schema(with_rejected(schema)).options(**options).csv(path)


def _json_records(spark: SparkSession, path: str, schema: str | StructType | None, base: int, options: dict[str, str]) -> DataFrame:
    """Records of an array, or of objects over several lines, cut by all tasks and written as lines for Spark's JSON reader."""
    found = records(spark, path, Cut("}", base, "}"), options)
    # line breaks stand between the parts of a record only, as texts cannot hold them
    bare = F.regexp_replace(F.regexp_replace("record", "[\\r\\n]", " "), r"^[\s\x{FEFF},]*(?:\[[\s,]*)?" if base else r"^[\s\x{FEFF},]+", "")
    lines = found.select(bare.alias("value")).where(~F.col("value").rlike(r"^[\s\]]*$"))
    target = scratch_path(spark, "records.jsonl")
    lines.write.text(target, compression="gzip")  # a file holds what one task has cut, so files need no splitting
    rest = {k: v for k, v in options.items() if k not in (*LISTING, "multiLine")}
    fields = with_rejected(spark.read.options(**rest).json(target).schema if schema is None else schema)
    return spark.read.schema(fields).options(**rest).json(target)


def _json_rows(
    spark: SparkSession, path: str, kind: str, schema: str | StructType | None, options: dict[str, str]
) -> DataFrame:
    # up to the first closing bracket: no more than the first record, however long its line is
    start = [r[0] for r in _head(spark, path, "}", 1)]
    first = start[0].lstrip("\ufeff \t\r\n") if start else ""
    options = {"columnNameOfCorruptRecord": REJECTED, **options}
    forced = "multiLine" in options or any(k in options for k in ("encoding", "charset", "lineSep", "allowSingleQuotes"))
    if kind == "json" and not forced and (first.startswith("[") or "\n" in first):
        fields = _json_records(spark, path, schema, int(first.startswith("[")), options)
    else:
        known = with_rejected(spark.read.options(**options).json(path).schema if schema is None else schema)
        fields = spark.read.schema(known).options(**options).json(path)
    if fields.columns == [REJECTED] and start:
        raise ValueError(f"No record in {path}")
    return fields


def read_rows(
    spark: SparkSession, path: str, schema: str | StructType | None = None, **options: str
) -> DataFrame:
    """All rows of a file or folder, with the raw text of those that do not fit in the column ``REJECTED``.

    These are CSV rows with more or fewer fields than the header, broken JSON,
    and values that are not of the type in ``schema``. All files are split, also
    CSV with line breaks in quoted values and JSON arrays, see :mod:`records`.
    """
    kind = format_of(path)
    if kind == "parquet":
        try:
            return (spark.read.schema(schema) if schema else spark.read).options(**options).parquet(path).withColumn(
                REJECTED, F.lit(None).cast("string"))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(f"File not found: {path}") from None
            raise
    return _csv_rows(spark, path, schema, options) if kind == "csv" else _json_rows(spark, path, kind, schema, options)


def read_table(
    spark: SparkSession, path: str, schema: str | StructType | None = None, **options: str
) -> DataFrame:
    """Read a file or folder of files by its suffix.

    CSV finds out separator and header from the first lines; JSON may hold
    records, an array or lines. Without ``schema`` CSV and JSON types are
    inferred by an extra pass over the data, so pass one for large inputs.
    A row that does not fit raises an error when it is read; ``read_split``
    keeps such rows apart.
    """
    rows = read_rows(spark, path, schema, **options)
    if format_of(path) == "parquet":
        return rows.drop(REJECTED)
    # all values are named, so that all are parsed and a row is judged alike whatever is selected
    values = F.struct(*[col(c) for c in rows.columns if c != REJECTED]).cast("string")
    found = F.concat(F.lit(f"{path} holds a row that does not fit: "), F.substring(REJECTED, 1, 200), F.lit(" read as "), values)
    return rows.where(F.when(F.isnull(REJECTED), True).otherwise(F.raise_error(found).cast("boolean"))).drop(REJECTED)


def read_split(
    spark: SparkSession, path: str, schema: str | StructType | None = None, **options: str
) -> tuple[DataFrame, DataFrame]:
    """The rows that fit, and the raw ``record`` of every other row; CSV and JSON are read once and staged."""
    rows = read_rows(spark, path, schema, **options)
    if format_of(path) != "parquet":
        rows = staged(rows, "raw")
    return (rows.where(F.isnull(REJECTED)).drop(REJECTED),
            rows.where(F.isnotnull(REJECTED)).select(F.col(REJECTED).alias("record")))


def row_hash(df: DataFrame, seed: int) -> Column:
    """A repeatable pseudo-random number per row, from all its values."""
    return F.xxhash64(F.lit(seed), *[
        group_key(col(f.name), f.dataType) if isinstance(f.dataType, MapType) else col(f.name) for f in df.schema])


def row_digest(df: DataFrame, seed: int) -> Column:
    """A repeatable pseudo-random hex text per row: MD5 of the seed and of all values as text.

    Every value is led by its length, and a null has none, so that rows differ in this text as soon as they differ in the
    text of a value.
    """
    def written(name: str, dtype: DataType) -> Column:
        value = group_key(col(name), dtype) if isinstance(dtype, (MapType, BinaryType)) else col(name)
        value = value.cast("string")
        return F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("~"))

    return F.md5(F.concat(F.lit(f"{seed}|"), *[written(f.name, f.dataType) for f in df.schema]))


def exact_sample(df: DataFrame, n: int = 10_000, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones for the same seed.

    The rows of the smallest digests, for any ``n``: nothing is sorted and no task gathers the sample. A histogram of the
    digests' first four digits tells in which of its cells the n-th row lies; the rows up to that cell are written once,
    and the cell is divided by further digits until the cut is exact. Rows of equal digests are equal, so any of them
    serves. ``order`` is a hex text of even spread, such as an MD5, that goes before the digest of the row. Takes two scans.
    """
    if n <= 0:
        return df.limit(0)
    at = fresh_name(df, "digest")
    digest = row_digest(df, seed)
    hashed = df.withColumn(at, digest if order is None else F.concat(F.coalesce(order, F.lit("")), digest))
    # n rows lie up to ``cell``; ``left`` of them in it, where its digests begin with these digits
    cell, left, kept = "", n, hashed
    while True:
        width = len(cell) + CELL_DIGITS
        counts = sorted(
            kept.where(col(at).startswith(cell)).groupBy(F.substring(col(at), 1, width).alias("cell")).count().collect(),
            key=lambda r: r["cell"])
        step, found = None, left
        for r in counts:
            if r["count"] >= left:
                step, found = r["cell"], r["count"]
                break
            left -= r["count"]
        if step is None:
            return df
        equal = step == cell
        if kept is hashed:
            kept = staged(hashed.where(F.substring(col(at), 1, width) <= step), "sample")
        cell = step
        if found == left:
            return kept.where(F.substring(col(at), 1, len(cell)) <= cell).drop(at)
        if equal:
            break
    # more equal rows than there is room for: one of them, as often as needed, made by many tasks
    one = F.broadcast(kept.where(col(at) == cell).limit(1))
    same = df.sparkSession.range(left).select(F.lit(cell).alias(at)).join(one, at).select(*[col(c) for c in kept.columns])
    return kept.where(col(at) < cell).unionByName(same).drop(at)


def rough_sample(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, without any exchange."""
    return df.sample(fraction=share, seed=seed)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a folder of files in the format the suffix names."""
    kind = format_of(path)
    if kind == "csv":
        df.write.mode(mode).csv(
            path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).json(path, ignoreNullFields=False)
