"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without white space at both ends, its ASCII letters in
lower case; keys below ``LEAST_CHARS`` code points are left alone. Documents are
read once for their keys, as 128-bit hashes, one row per document and different
key. Keys of two or more documents (their smallest and largest doc_id differ)
are dealt to shards by hash. Each shard becomes one row of arrays: the levels of
a minimal perfect hash, and at the place it gives each key a fingerprint, the
number of documents and the smallest doc_id. A key is looked up by hashing it
once per level; the fingerprint tells keys that are not in the index.

Documents probe the arrays shard by shard: the rows of their keys are sent to
the shard, never joined to line rows. Each shard is there ``SALTS`` times and
documents choose a copy by their id, so that a line in a third of all documents
is spread. What comes back is, per document, the list of keys to drop.

Defined results: null text is one empty line; null ids count together as one
document, after all others; rows with equal ids count as one document, and each
row is answered for its own text. Input columns named like the added ones are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallylens.llm.tables import pick
from tallylens.llm.tokens import cut, mix
from tallylens.sources.files import staged

BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS = 10
SHARD_KEYS = 1 << 16
SALTS = 16
LAST = (1 << 63) - 1  # stands for a null doc_id


def line_key(line: str) -> bytes | None:
    """128 bits for a line's key; None for lines that are left alone."""
    line = line.strip(BLANK)
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= LEAST_CHARS else None


@dataclass
class PerfectHash:
    """Levels of bit arrays. A key lives in the first level where no other key shares its bit; its number is the count
    of set bits in front of it. Keys without a level of their own are kept in order at the end."""

    levels: list[np.ndarray]  # one boolean per bit
    rest: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, most_levels: int = 32) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < most_levels:
            at = PerfectHash.place(keys, len(levels), 2 * len(keys) + 1)
            alone = np.bincount(at, minlength=2 * len(keys) + 1) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return PerfectHash(levels, np.sort(keys))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0xD1342543DE82EF95 % 2**64)) % np.uint64(size)).astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0 .. n-1 for the keys it was built from; any number or -1 for others."""
        out, base, open_ = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
            open_, base = open_[~hit], base + int(bits.sum())
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = base + at[found]
        return out


INDEX = "shard int, sizes array<int>, bits binary, rest binary, fingerprints binary, counts binary, keepers binary"


def index_shard(rows: pa.Table) -> pa.Table:
    """One row of arrays from the repeated keys of a shard: shard, head, tail, keeper, copies."""
    head, tail, keeper, copies = (rows[c].to_numpy() for c in ("head", "tail", "keeper", "copies"))
    keys = head.view(np.uint64) ^ mix(tail.view(np.uint64))
    table = PerfectHash.build(keys)
    order = np.argsort(table.number(keys))
    binary = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({
        "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
        "sizes": pa.array([[len(b) for b in table.levels]], pa.list_(pa.int32())),
        "bits": binary(np.packbits(np.concatenate(table.levels)) if table.levels else np.zeros(0, np.uint8)),
        "rest": binary(table.rest), "fingerprints": binary(tail[order]),
        "counts": binary(np.minimum(copies[order], 2**32 - 1).astype(np.uint32)), "keepers": binary(keeper[order])})


def probe_shard(asked: pa.Table, index: pa.Table) -> pa.Table:
    """The rows of ``asked`` (doc, head, tail) whose key belongs to a document with a smaller id."""
    if not index.num_rows or not asked.num_rows:
        return asked.slice(0, 0).select(["doc", "head"])
    row = index.slice(0, 1).to_pylist()[0]
    edges = np.cumsum([0, *row["sizes"]])
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
    table = PerfectHash([bits[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], np.frombuffer(row["rest"], np.uint64))
    tails, keepers = (np.frombuffer(row[c], np.int64) for c in ("fingerprints", "keepers"))
    doc, head, tail = (asked[c].to_numpy() for c in ("doc", "head", "tail"))
    at = table.number(head.view(np.uint64) ^ mix(tail.view(np.uint64)))
    held = np.flatnonzero(at >= 0)
    held = held[(tails[at[held]] == tail[held]) & (keepers[at[held]] != doc[held])]
    return pa.table({"doc": doc[held], "head": head[held]})


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in cut(batch["text"]):
            docs, found = [], []
            for doc, text in zip(batch["doc"].slice(at, len(part)).to_pylist(), part.to_pylist(), strict=True):
                own = {k for line in set(text.split("\n")) if (k := line_key(line))}
                docs += [doc] * len(own)
                found += sorted(own)
            pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.record_batch({
                "doc": pa.array(docs, pa.int64()), "head": np.ascontiguousarray(pair[:, 0]), "tail": np.ascontiguousarray(pair[:, 1])})


def dropped_keys(docs: DataFrame) -> DataFrame:
    """doc and ``heads``, the keys whose lines each document loses; documents that lose none have no row."""
    keys = staged(
        pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text")
        .mapInArrow(_keys, "doc bigint, head bigint, tail bigint"), "line_keys")
    repeated = staged(
        keys.groupBy("head", "tail").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count("*").alias("copies"))
        .where("keeper < last").drop("last"), "repeated_lines")
    shards = max(SALTS, -(-repeated.count() // SHARD_KEYS))
    shard = F.pmod("head", F.lit(shards)).cast("int").alias("shard")
    index = repeated.select(shard, "*").groupBy("shard").applyInArrow(index_shard, INDEX)
    copies = staged(index, "line_index").withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
    asked = keys.select("doc", "head", "tail", shard, F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    hits = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(
        probe_shard, "doc bigint, head bigint")
    return hits.groupBy("doc").agg(F.collect_set("head").alias("heads"))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their dropped lines, and the numbers of lines; other columns pass."""
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("__doc", "__heads")]
        for at, part in cut(batch["text"]):
            kept, lines, lost = [], [], []
            for text, heads in zip(part.to_pylist(), batch["__heads"].slice(at, len(part)).to_pylist(), strict=True):
                own, gone = text.split("\n"), set(heads or ())
                stay = own if not gone else [
                    x for x in own if not ((k := line_key(x)) and int.from_bytes(k[:8], "little", signed=True) in gone)]
                kept.append("\n".join(stay))
                lines.append(len(own))
                lost.append(len(own) - len(stay))
            out = {n: batch[n].slice(at, len(part)) for n in names} | {
                "text": pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(lost, pa.int64())}
            yield pa.record_batch(out)


def drop_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, text without the repeated lines, and ``n_lines``, ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped", "__doc", "__heads")
    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]
                        + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return (
        docs.withColumn("__doc", F.coalesce("doc_id", F.lit(LAST)))
        .join(dropped_keys(docs).toDF("__doc", "__heads"), "__doc", "left")
        .mapInArrow(_rest, schema))


SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT l.*, r.keeper IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
