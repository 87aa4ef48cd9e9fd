"""A queue of messages in a folder, read as a stream in batches of a bounded number of rows.

``enqueue`` appends a table of messages as one numbered folder of Parquet files with the column ``value``; the data
source ``MessageQueue`` reads the messages in the order of folders, files and rows, each once, at most ``rows_per_batch``
in a batch. No server takes part: the folder is the queue.

An offset names the next message by file and row, and says how many messages lie before it. How far a batch reaches
follows from the row counts in the files' footers, so the driver reads no message; a batch is cut into slices of
``SLICE_ROWS`` messages, and every slice is read by a task.

A batch must end ``rows_per_batch`` messages behind the one before, also after a restart, and Spark does not tell a
source where it restarts. So every end that is given to Spark is first written below ``state``. A restarted reader
gives the last written end again: if Spark has logged it there is nothing new, else the batch is what it was meant to
be. Files of ``state`` are never changed, so one that a crash has cut short is told by its text and left out.

Defined results: a null message stays a null ``value``; an empty append adds a folder without messages; an append that
failed is not seen and is replaced by the next one. One writer at a time; folders may be removed once they are read.
The folder must be in a store that Arrow can open from every executor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallylens import schemas
from tallylens.operators.columnwise import col
from tallylens.streaming.live import messages_from_text

FORMAT = "tallylens_messages"
SLICE_ROWS = 50_000
START = {"file": "", "row": 0, "read": 0}


@dataclass
class Slices(InputPartition):
    """What one task reads: file, first row, row behind the last, and the number of messages before the first."""

    parts: list[tuple[str, int, int, int]]


def _names(store: fs.FileSystem, path: str, kind: fs.FileType) -> list[str]:
    """The sorted names of the files or folders in a folder."""
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == kind)


def _complete(store: fs.FileSystem, path: str, since: str = "") -> Iterator[tuple[str, list[str]]]:
    """The numbered folders from ``since`` on with their files, up to the first that is still being written."""
    for folder in _names(store, path, fs.FileType.Directory):
        if folder.startswith("append=") and folder >= since:
            files = _names(store, f"{path}/{folder}", fs.FileType.File)
            if "_SUCCESS" not in files:
                return
            yield folder, [f for f in files if f.endswith(".parquet")]


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str, rows_per_batch: int | None):
        self.path, self.state, self.rows_per_batch = path, state, rows_per_batch
        self.end: dict | None = None
        self.sizes: dict[str, int] = {}

    def _files(self, since: str) -> Iterator[tuple[str, int]]:
        """The files from ``since`` on and their numbers of messages."""
        store, path = fs.FileSystem.from_uri(self.path)
        for folder, files in _complete(store, path, since.split("/")[0]):
            for name in (f"{folder}/{f}" for f in files):
                if name < since:
                    continue
                if name not in self.sizes:
                    with store.open_input_file(f"{path}/{name}") as file:
                        self.sizes[name] = pq.read_metadata(file).num_rows
                yield name, self.sizes[name]

    def _next(self, start: dict) -> dict:
        """The end of the batch that begins at ``start``."""
        end, left = start, self.rows_per_batch
        for name, rows in self._files(start["file"]):
            first = end["row"] if name == end["file"] else 0
            taken = rows - first if left is None else min(rows - first, left)
            end = {"file": name, "row": first + taken, "read": end["read"] + taken}
            if left is not None:
                left -= taken
                if not left:
                    break
        return end if end["read"] > start["read"] else start

    def _written(self) -> dict | None:
        store, state = fs.FileSystem.from_uri(self.state)
        for name in reversed(_names(store, state, fs.FileType.File)):
            with store.open_input_stream(f"{state}/{name}") as file:
                text = file.read().decode()
            if text.endswith("\n"):
                return json.loads(text)
        return None

    def _write(self, end: dict) -> None:
        store, state = fs.FileSystem.from_uri(self.state)
        store.create_dir(state, recursive=True)
        with store.open_output_stream(f"{state}/{end['read']:020d}") as file:
            file.write((json.dumps(end) + "\n").encode())
        for old in _names(store, state, fs.FileType.File)[:-2]:
            store.delete_file(f"{state}/{old}")

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        if self.end is None:
            self.end = self._written()
            if self.end is not None:
                return self.end
            self.end = START
        end = self._next(self.end)
        if end != self.end:
            self._write(end)
            self.end = end
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        tasks: list[Slices] = []
        room, before = 0, start["read"]
        for name, rows in self._files(start["file"]) if start["read"] < end["read"] else ():
            row = start["row"] if name == start["file"] else 0
            last = end["row"] if name == end["file"] else rows
            while row < last:
                if not room:
                    tasks.append(Slices([]))
                    room = SLICE_ROWS
                taken = min(room, last - row)
                tasks[-1].parts.append((name, row, row + taken, before))
                row, before, room = row + taken, before + taken, room - taken
            if name == end["file"]:
                break
        if before != end["read"]:
            raise RuntimeError(f"{self.path} holds {before - start['read']} of the messages {start['read']} to {end['read']}")
        return tasks

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(self.path)
        for name, first, last, before in partition.parts:
            with store.open_input_file(f"{path}/{name}") as file:
                parquet, row = pq.ParquetFile(file), 0
                for group in range(parquet.num_row_groups):
                    rows = parquet.metadata.row_group(group).num_rows
                    if row < last and row + rows > first:
                        at = row
                        for batch in parquet.iter_batches(8192, row_groups=[group], columns=["value"]):
                            a, b = max(first - at, 0), min(last - at, len(batch))
                            if a < b:
                                numbers = before + at + a - first
                                yield pa.record_batch({
                                    "value": batch.column(0).slice(a, b - a).cast(pa.string()),
                                    "position": pa.array(range(numbers, numbers + b - a), pa.int64())})
                            at += len(batch)
                    row += rows


class MessageQueue(DataSource):
    """``value`` and ``position`` (its number in the queue, from 0) of every message."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string, position bigint"

    def streamReader(self, schema: StructType) -> QueueReader:
        bound = self.options.get("rows_per_batch")
        return QueueReader(self.options["path"], self.options["state"], None if bound is None else int(bound))


def enqueue(messages: DataFrame, folder: str, value: str | None = None) -> None:
    """Append the rows of a table: the text column ``value``, or all columns as a JSON record."""
    text = F.to_json(F.struct(*[col(c) for c in messages.columns])) if value is None else col(value).cast("string")
    store, path = fs.FileSystem.from_uri(folder)
    last = [name for name, _ in _complete(store, path)]
    number = int(last[-1].split("=")[1]) + 1 if last else 0
    messages.select(text.alias("value")).write.mode("overwrite").parquet(f"{folder}/append={number:012d}")


def queued_messages(spark: SparkSession, folder: str, state: str, rows_per_batch: int | None = None) -> DataFrame:
    """A stream of ``value`` and ``position``, at most ``rows_per_batch`` messages a batch.

    ``state`` is a folder of the streaming query's own, best within its checkpoint folder.
    """
    if rows_per_batch is not None and rows_per_batch < 1:
        raise ValueError("rows_per_batch is 1 or more")
    spark.dataSource.register(MessageQueue)
    bound = {} if rows_per_batch is None else {"rows_per_batch": str(rows_per_batch)}
    return spark.readStream.format(FORMAT).options(path=folder, state=state, **bound).load()


def queued_events(
    spark: SparkSession, folder: str, state: str, schema: str = schemas.ORDER_EVENT, rows_per_batch: int | None = None
) -> DataFrame:
    """The messages as events; those that are no record stay apart with their position (see ``messages_from_text``)."""
    raw = queued_messages(spark, folder, state, rows_per_batch)
    return messages_from_text(raw, "value", schema, F.concat(F.lit("message "), F.col("position").cast("string")))


def drained(query: StreamingQuery) -> list[dict]:
    """Read on until the queue holds nothing more, stop, and return the progress of every batch that had rows.

    The progress of the last ``spark.sql.streaming.numRecentProgressUpdates`` triggers is kept.
    """
    try:
        query.processAllAvailable()
        # a restarted reader gives its last end once more, which looks like an empty queue
        query.processAllAvailable()
        return [p for p in (json.loads(p.json) for p in query.recentProgress) if p["numInputRows"]]
    finally:
        query.stop()


def read_up_to(progress: dict) -> int:
    """How many messages of the queue lie before the end of a batch."""
    end = progress["sources"][0]["endOffset"]
    return (json.loads(end) if isinstance(end, str) else end)["read"]


def queue_length(spark: SparkSession, folder: str, read: int = 0) -> int:
    """Messages in the queue behind the first ``read`` (S8); counted by the files' footers, in tasks.

    Holds as long as no folder that was read is removed.
    """
    store, path = fs.FileSystem.from_uri(folder)
    names = [f"{folder}/{name}" for name, _ in _complete(store, path)]
    return spark.read.schema("value string").parquet(*names).count() - read if names else 0
