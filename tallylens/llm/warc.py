"""WARC archives: writing with segments and revisits, reading with reassembly.

``write`` makes one record per row. Its block is an HTTP response whose payload
has chunked transfer framing. A block longer than ``SEGMENT`` bytes is cut: the
first segment is the record, the others are continuation records that name it
by ``WARC-Segment-Origin-ID`` and carry ``WARC-Segment-Number``; the last one
adds ``WARC-Segment-Total-Length``. A payload that another row with a larger id
has, too, is not written again: the row becomes a revisit that refers to it.

An archive is a stream of records with an empty line behind each, so Spark's
text writer and reader handle it in any store, split by split: the separator is
the end of a record and the first line of the next. ``write`` cuts a chunk
wherever a payload holds that separator, so framing keeps it out of blocks.
Foreign archives whose blocks hold it are found by their Content-Length and
reported.

``read`` parses records, groups segments by origin id, orders them by number,
checks that they are complete and have the stated total length, and decodes the
chunks. Whole records take no part in the grouping. A group is one record.

Defined results: null payloads are empty; null ids rank below all others; rows
with equal ids and payloads are records of the same kind, each of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.llm.tables import pick

SEGMENT, CHUNK = 1 << 16, 1 << 14
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
ANY_VERSION = b"WARC/1."  # archives of 1.0 and 1.1 are read
SEPARATOR = END + ANY_VERSION
BORDERS = (ANY_VERSION, b"\r\n" + ANY_VERSION)  # behind an empty line, both hold the separator
NO_ID = -(1 << 63)
SALTS = 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """Chunked framing, with a chunk border inside every separator."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + CHUNK, len(payload))
        hit = payload.find(SEPARATOR, at, end + len(SEPARATOR) - 1)
        if hit >= 0:
            end = min(end, hit + len(END))
        if payload.startswith(BORDERS[1], at):
            end = at + 1  # the line end behind the chunk's size would complete the separator
        out.append(b"%x\r\n%s\r\n" % (end - at, payload[at:end]))
        at = end
    # a blank at the very end would join the separator behind the record
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk has no size")
        stated = data[at:line].split(b";")[0].strip(b" \t")
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", stated):
            raise ValueError("a chunk's size is no number")
        size = int(stated, 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as stated")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A record without its first line and the empty lines behind it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return lines.encode() + b"\r\n" + block


def segments(block: bytes) -> list[bytes]:
    """The block cut about every ``SEGMENT`` bytes. No part begins with a record's first line, which would read
    as the separator of two records behind the empty line that ends the headers."""
    parts, at = [], 0
    while at < len(block):
        end = at + SEGMENT
        if block.startswith(BORDERS, end):
            end -= 1
        parts.append(block[at:end])
        at = end
    return parts


def records(page: int, url: str | None, payload: bytes, refers: int | None, date: str) -> Iterator[bytes]:
    """All records of one row."""
    own = f"<urn:page:{page}:{uuid.uuid4().hex}>"
    common = {"WARC-Date": date, "Content-Type": "application/http;msgtype=response"}
    top = {"WARC-Target-URI": f"urn:page:{page}", "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    http = f"HTTP/1.1 200 OK\r\nContent-Location: {quote(url or '', safe=':/?&=%#')}\r\n"
    if refers is not None:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": own, **common, **top, "WARC-Refers-To-Target-URI": f"urn:page:{refers}",
                      "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      "X-Payload-Length": str(len(payload))}, http.encode() + b"\r\n")
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = segments(block)
    for i, part in enumerate(parts):
        segment = {"WARC-Segment-Number": str(i + 1)} if len(parts) > 1 else {}
        if i:
            kind = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:segment:{uuid.uuid4().hex}>", "WARC-Segment-Origin-ID": own}
            if i + 1 == len(parts):
                segment["WARC-Segment-Total-Length"] = str(len(block))
            yield record(kind | common | segment, part)
        else:
            yield record({"WARC-Type": "response", "WARC-Record-ID": own} | common | top | segment, part)


def revisits(pages: DataFrame) -> DataFrame:
    """page, sha and keeper for rows whose payload a row with a larger id has. Only ids and digests are moved; a digest
    that very many rows share is salted."""
    light = pages.select("page", "sha")
    keepers = light.groupBy("sha").agg(F.max("page").alias("keeper"), F.min("page").alias("least")).where("least < keeper")
    spread = keepers.select("sha", "keeper", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    return (
        light.distinct().withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(spread, ["sha", "salt"])
        .where("page < keeper").select("page", "sha", "keeper"))


def write(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Archives of page_id, url and html in a folder."""
    held = pick(pages, "page_id", "url", "html").select(
        F.coalesce("page_id", F.lit(NO_ID)).alias("page"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")
    ).withColumn("sha", F.sha1("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch[c][row].as_py() for c in ("page", "url", "html", "keeper")}
                yield pa.record_batch({"value": pa.array(
                    list(records(one["page"], one["url"], one["html"], one["keeper"], date)), pa.binary())})

    written = held.join(revisits(held), ["page", "sha"], "left").mapInArrow(run, "value binary")
    (written.select(F.concat(F.lit(VERSION), "value").cast("string").alias("value"))
     .write.text(path, compression="gzip", lineSep=END.decode()))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To-Target-URI",
             "WARC-Segment-Origin-ID", "WARC-Segment-Number", "WARC-Segment-Total-Length", "X-Payload-Length", "Content-Length")
    for batch in batches:
        rows = []
        for value in batch["value"].to_pylist():
            # the first line is what the separator left of the version
            head, _, block = value.removeprefix(ANY_VERSION).partition(b"\r\n\r\n")
            lines = dict(x.partition(":")[::2] for x in head.decode("utf-8", "replace").split("\r\n")[1:])
            has = {k.strip().lower(): v.strip() for k, v in lines.items()}
            kind, own, uri, sha, refers, origin, *stated = (has.get(n.lower()) for n in names)
            malformed = any(x and not re.fullmatch(f"[0-9]{{1,{digits}}}", x, re.ASCII) for x, digits in zip(stated, (9, 18, 18, 18), strict=True))
            number, total, length, size = (None if malformed or not x else int(x) for x in stated)
            whole = len(block) if size is None else size
            wrong = "a stated number is malformed" if malformed else (
                "a record is not as long as stated" if len(block) < whole or block[whole:].strip() != b"" else None)
            # the last record of a file still has the empty lines behind it
            rows.append({
                "id": origin or own, "kind": kind, "uri": uri, "digest": (sha or "").removeprefix("sha1:"), "refers": refers,
                "number": number, "total": total, "length": length, "block": block[:whole], "wrong": wrong})
        yield pa.RecordBatch.from_pylist(rows, PARSED)


PARSED = pa.schema([
    ("id", pa.string()), ("kind", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()),
    ("number", pa.int32()), ("total", pa.int64()), ("length", pa.int64()), ("block", pa.binary()), ("wrong", pa.string())])
PAGE = re.compile(r"urn:page:(-?\d+)$")


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("segments", pa.int32()), ("problem", pa.string()), ("payload", pa.binary())])

    def page(uri: str | None) -> int | None:
        found = PAGE.search(uri or "")
        return int(found[1]) if found and int(found[1]) != NO_ID else None

    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            parts, problem, payload = row["parts"], None, None
            if wrong := [p["wrong"] for p in parts if p["wrong"]]:
                problem = wrong[0]
            elif len(parts) > 1 or parts[0]["number"] is not None:
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    problem = "segments are missing"
                elif sum(len(p["block"]) for p in parts) != parts[-1]["total"]:
                    problem = "the total length differs"
            if not problem and row["kind"] != "revisit":
                head, _, body = b"".join(p["block"] for p in parts).partition(b"\r\n\r\n")
                try:
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError as e:
                    problem = str(e)
                if payload is not None and row["digest"] and digest(payload) != row["digest"]:
                    problem = "the digest differs"
            rows.append({
                "page_id": page(row["uri"]), "payload_bytes": row["length"] if payload is None else len(payload),
                "payload_digest": row["digest"] if payload is None else digest(payload), "record_type": row["kind"],
                "refers_to": page(row["refers"]), "segments": len(parts), "problem": problem, "payload": payload})
        yield pa.RecordBatch.from_pylist(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, segments, problem (null: none) and payload (null
    for revisits) of every record of a folder of archives."""
    lines = spark.read.text(path, lineSep=SEPARATOR.decode()).select(F.col("value").cast("binary").alias("value"))
    found = lines.mapInArrow(
        _parsed, "id string, kind string, uri string, digest string, refers string, number int, total bigint, length bigint, "
        "block binary, wrong string")
    part = F.struct("number", "total", "block", "wrong")
    same = ("kind", "uri", "digest", "refers", "length")
    whole = found.where("number is null").select(*same, F.array(part).alias("parts"))
    first = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in same]
    pieced = found.where("number is not null").groupBy("id").agg(*first, F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.unionByName(pieced.drop("id")).mapInArrow(
        _payloads, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "segments int, problem string, payload binary")
