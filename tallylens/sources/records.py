"""Records that span lines, cut from files that many tasks read.

A file is read in pieces: lines of CSV, or stretches up to a ``}`` of JSON.
Whether a record ends with a piece depends on all text in front of it, but only
through a small state: inside or outside of quotes, and for JSON how many
brackets are open. So every piece says where it leads from either side of a
quote, and these answers are composed: first over each byte range on its own,
then over the ranges of a file, whose number is that of the file's splits. Then
every range knows the state it begins in and cuts its records, all at the same
time. The parts of a record that crosses the border of a range are put together
by the range that it began in. Splitting the records into fields is left to
Spark's own CSV and JSON readers.

The ranges are Spark's file splits; if they changed between the two readings,
the second one fails instead of cutting records at wrong places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallylens.session import staged

RANGE = ("file", "block")
LISTING = ("recursiveFileLookup", "pathGlobFilter", "modifiedBefore", "modifiedAfter")


@dataclass(frozen=True)
class Cut:
    """How files are cut: pieces end with ``end``, ``base`` brackets are open between records, which end with ``closing``."""

    end: str
    base: int = 0
    closing: str = ""


def pieces(spark: SparkSession, path: str, end: str, options: dict[str, str]) -> DataFrame:
    """file, block (where the range of the file begins) and text of every piece, in their order within a range."""
    listed = {k: v for k, v in options.items() if k in LISTING}
    return spark.read.options(lineSep=end, **listed).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


# ---------------------------------------------------------------- what a piece does to the state

def csv_steps(text: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line ends inside of quotes if it begins outside, and if it begins inside.

    A quote opens a value only where the value begins. What follows a closing
    quote up to the separator belongs to the value.
    """
    s = re.escape(separator)
    inner = '[^"]*+(?:""[^"]*+)*+'
    opened = f'(?:(?:"{inner}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+"{inner}$'
    outside = f"(?s)^{opened}"
    inside = f'(?s)^{inner}(?:$|"[^{s}]*+{s}{opened})'
    quoted = text.contains('"')
    return quoted & text.rlike(outside.replace("$", r"\z")), ~quoted | text.rlike(inside.replace("$", r"\z"))


def json_steps(text: Column) -> tuple[Column, Column, Column, Column]:
    """For a stretch that ends with ``}``: whether it ends in a string, and by how much more brackets are open behind it,
    if it begins outside of strings, and if it begins inside."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    odd = F.regexp_count(plain, F.lit('"')) % 2 == 1

    def depth(outer: Column, inside: Column) -> Column:
        # without whole strings, and without one that stays open
        bare = F.regexp_replace(outer, r'(?s)"[^"]*+(?:"|\z)', "")
        opened = F.length(F.regexp_replace(bare, r"(?s)[^\[{]", "")) - F.length(F.regexp_replace(bare, r"(?s)[^\]}]", ""))
        return opened - F.when(inside, 0).otherwise(1)

    return odd, ~odd, depth(plain, odd), depth(F.concat(F.lit('"'), plain), ~odd)


# ---------------------------------------------------------------- states of ranges

def _states(steps: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each piece ends inside of quotes. steps: per piece the ends from outside and from inside."""
    settled = steps[:, 0] == steps[:, 1]
    turns = np.cumsum(~settled & steps[:, 0])  # what leads from either side to the same one settles, what crosses turns
    last = np.maximum.accumulate(np.where(settled, np.arange(len(steps)), -1))
    known = last >= 0
    value = np.where(known, steps[last, 0], inside)
    return value ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)


def _followed(steps: np.ndarray, depths: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """State and open brackets behind each piece."""
    after = _states(steps, inside)
    before = np.append(inside, after[:-1]).astype(np.int64)
    return after, depth + np.cumsum(depths[np.arange(len(depths)), before])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flags = [batch[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("outside", "inside")]
    return np.stack(flags, 1), np.stack([batch[c].to_numpy().astype(np.int64) for c in ("deeper", "deeper_inside")], 1)


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """The stretches of a batch that lie in one range."""
    if not batch.num_rows:
        return []
    file, block = batch["file"].dictionary_encode().indices.to_numpy(), batch["block"].to_numpy()
    edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


COMPOSED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()),
                      ("deeper", pa.int64()), ("deeper_inside", pa.int64())])
CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_()),
                 ("record", pa.string())])


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each stretch of pieces leads from outside and from inside; a range has one for each batch that it is in."""
    for batch in batches:
        steps, depths = _columns(batch)
        rows = []
        for a, b in _runs(batch):
            ways = [_followed(steps[a:b], depths[a:b], bool(start), 0) for start in (0, 1)]
            rows.append((batch["file"][a].as_py(), batch["block"][a].as_py(), *(bool(w[0][-1]) for w in ways), *(int(w[1][-1]) for w in ways)))
        yield _batch(rows, COMPOSED)


def _begun(table: pa.Table) -> pa.Table:
    """The states that the ranges of a file begin in."""
    table = table.sort_by([("block", "ascending"), ("place", "ascending")])
    rows, inside, depth = [], False, 0
    for block, *ways in zip(*(table[c].to_pylist() for c in ("block", "outside", "inside", "deeper", "deeper_inside")), strict=True):
        if not rows or rows[-1][0] != block:
            rows.append((block, inside, depth))
        inside, depth = ways[inside], depth + ways[2 + inside]
    blocks, states, depths = zip(*rows, strict=True)
    return pa.table({
        "file": pa.array([table["file"][0].as_py()] * len(rows), pa.string()), "block": pa.array(blocks, pa.int64()),
        "state": pa.array(states, pa.bool_()), "depth": pa.array(depths, pa.int64())})


# ---------------------------------------------------------------- cutting

def _cut(cut: Cut):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, number, state, depth, begins = None, [], 0, False, 0, True
        for batch in batches:
            steps, depths = _columns(batch)
            out: list[tuple] = []
            for a, b in _runs(batch):
                key = batch["file"][a].as_py(), batch["block"][a].as_py()
                if key != now:
                    if held:
                        out.append((*now, number, begins, False, cut.end.join(held)))
                    now, held, number = key, [], 0
                    state, depth = batch["state"][a].as_py(), batch["depth"][a].as_py()
                    if state is None:
                        raise RuntimeError(f"{key[0]} was split in another way when it was read again")
                    # what stands in front of an array's first bracket belongs to its first record
                    begins = not key[1] or not state and depth == cut.base
                after, open_ = _followed(steps[a:b], depths[a:b], state, depth)
                texts = batch["text"].slice(a, b - a).to_pylist()
                begin = 0
                for end in np.flatnonzero(~after & (open_ == cut.base)).tolist():
                    out.append((*now, number, begins, True, cut.end.join([*held, *texts[begin : end + 1]]) + cut.closing))
                    held, begin, begins = [], end + 1, True
                    number += 1
                held += texts[begin:]
                state, depth = bool(after[-1]), int(open_[-1])
            yield _batch(out, CUT)
        if held:
            yield _batch([(*now, number, begins, False, cut.end.join(held))], CUT)

    return run


def records(spark: SparkSession, path: str, cut: Cut, options: dict[str, str], separator: str = ",") -> DataFrame:
    """file, first (whether it is the first of its file) and record of all records of a file or folder of files."""
    read = pieces(spark, path, cut.end, options)
    steps = csv_steps(F.col("text"), separator) + (F.lit(0), F.lit(0)) if not cut.closing else json_steps(F.col("text"))
    named = [c.alias(n) for c, n in zip(steps, ("outside", "inside", "deeper", "deeper_inside"), strict=True)]
    runs = read.select(*RANGE, *named).mapInArrow(_composed, "file string, block bigint, outside boolean, inside boolean, deeper bigint, deeper_inside bigint")
    # one row per file split, a split being a single task's reading
    states = staged(runs.withColumn("place", F.monotonically_increasing_id()).groupBy("file").applyInArrow(
        _begun, "file string, block bigint, state boolean, depth bigint"), "range_states")
    cuts = staged(read.select(*RANGE, "text", *named).join(F.broadcast(states), list(RANGE), "left").mapInArrow(
        _cut(cut), "file string, block bigint, number bigint, begins boolean, ends boolean, record string"), "records")
    whole = cuts.where("begins AND ends").select("file", ((F.col("block") == 0) & (F.col("number") == 0)).alias("first"), "record")
    # two parts per range at most; a record is named by the part that it begins with
    parts = cuts.where("NOT (begins AND ends)")
    order = Window.partitionBy("file").orderBy("block", "number")
    owner = F.last(F.when(F.col("begins"), F.struct("block", "number")), ignorenulls=True).over(order)
    owners = parts.select(*RANGE, "number", "begins").select(*RANGE, "number", owner.alias("owner"))
    joined = parts.join(owners, [*RANGE, "number"]).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "record"))).alias("all"))
    return whole.unionAll(joined.select(
        "file", ((F.col("owner.block") == 0) & (F.col("owner.number") == 0)).alias("first"),
        F.array_join(F.transform("all", lambda p: p["record"]), cut.end).alias("record")))
