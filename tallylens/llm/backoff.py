"""Stupid-backoff scores of documents under the n-gram counts of the corpus.

Every text is cut into words, its ASCII letters in lower case. A word is scored
after the ``order - 1`` words in front of it (marks for the beginning stand in
front of the first): ``count(n-gram) / count(context)`` if the corpus holds the
n-gram ``least`` times or more, else ``BACKOFF`` times the score with one front
word less, and with none ``count(word) / number of words``. A document's score
is the sum of the logarithms.

The n-grams of a run of texts (all levels, each different one once) are sorted by
their 64-bit hashes and sent as blocks: one row per run and hash partition, with
the differences of neighbouring hashes, the counts within the run and how often
the n-gram ends a text, as compressed byte planes. A hash partition is the part
of the count table whose hashes begin alike; it joins the blocks of all runs,
sums the counts and answers every block with the counts of its n-grams in the
whole corpus, in the order of the block. The answers of a run meet its texts
again, and each text sums the logarithms of its own words there. So an n-gram
costs the few bytes by which its hash differs from its neighbour's, no row of its
own, and is sent once per run, however often the run has it; a word of all
documents is one entry per run. The number of hash partitions follows from the
number of words of the corpus, so a partition has about ``PART_GRAMS`` n-grams at
every size. With very many runs and partitions blocks become short, down to a
few n-grams each, and cost about what a row per n-gram would.

The texts are read twice, once for the blocks and once to be scored, and every
task must get the same rows both times: pass a table that is read from files. A
run is told by its task and number; that the answers belong to its n-grams is
checked, and a run that changed between the reads is an error.

Defined results: a null text is empty; a text without words has a score of 0;
rows with equal ids are summed together, a null id being an id of its own. Words
and longer n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylens.llm.mixing import n_words
from tallylens.llm.tables import pick
from tallylens.llm.tokens import cut, find_words, mix, raw

BACKOFF = 0.4
BEGIN = np.uint64(0)  # stands for the word in front of the first
RUN_BYTES, WORDS_BYTES = 8 << 20, 1 << 20
PART_GRAMS = 1 << 21
BLOCK = "run bigint, part bigint, n int, mark bigint, hashes binary, times binary, ends binary"
ANSWER = "run bigint, part bigint, n int, mark bigint, times binary, ends binary"
TEXTS = "run bigint, texts binary"
SCORES = "doc_id bigint, n_words bigint, n_backed_off bigint, n_single bigint, log_score double"


def _name(n: int, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The hashes of n-grams of two words or more; those of single words are the words' own."""
    return mix(context * np.uint64(0xD6E8FEB86659FD93) + lower + np.uint64(n))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, and the words of each text; cut into words a few texts at a time."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, part in cut(column, WORDS_BYTES):
        data, offsets = raw(part)
        words = find_words(data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8), offsets)
        hashes.append(words.hashes)
        counts.append(words.counts)
    return np.concatenate(hashes), np.concatenate(counts)


def _levels(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams that end at every word of all texts, level by level, and the words of each text. The last entry of a
    level is no word: it stands for the beginning of a text."""
    words, counts = _words(column)
    heads = (np.cumsum(counts) - counts)[counts > 0]
    levels = [np.append(words, BEGIN)]
    for n in range(2, order + 1):
        lower = levels[-1]
        context = np.empty_like(lower)
        context[1:] = lower[:-1]
        context[heads] = context[-1] = lower[-1]
        levels.append(_name(n, context, lower))
    return levels, counts


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; high planes of small numbers are zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _marks(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A sum that tells whether two blocks have the same n-grams."""
    return np.add.reduceat(mix(hashes), edges[:-1]).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, pa.Array]]:
    """The texts of a task in runs, each with a number that no other run of the table has."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at, part in cut(batch["text"], RUN_BYTES):
            yield number, batch.slice(at, len(part)), part
            number += 1


def _different(grams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of a run in order, the place of every n-gram among them, the hash partitions that they are
    in and where each begins (one more entry for the end)."""
    hashes, place = np.unique(np.concatenate(grams), return_inverse=True)
    parts, first = np.unique(hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64), return_index=True)
    return hashes, place, parts, np.append(first, len(hashes))


def _blocks(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of every run of texts."""
        for number, _, part in _runs(batches):
            levels, counts = _levels(part, order)
            if not counts.any():
                continue
            hashes, place, parts, edges = _different(levels, bits)
            each = np.ones(len(levels[0]))
            each[-1] = np.count_nonzero(counts)
            last = np.zeros(len(each))
            last[np.cumsum(counts)[counts > 0] - 1] = 1
            times, ends = (np.bincount(place, np.tile(w, order), len(hashes)).astype(np.int64) for w in (each, last))
            cells = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch({
                "run": pa.array(np.full(len(parts), number)), "part": pa.array(parts.view(np.int64)),
                "n": pa.array(np.diff(edges).astype(np.int32)), "mark": pa.array(_marks(hashes, edges)),
                "hashes": pa.array([_packed(np.diff(hashes[c], prepend=np.uint64(0))) for c in cells], pa.binary()),
                "times": pa.array([_packed(times[c]) for c in cells], pa.binary()),
                "ends": pa.array([_packed(ends[c]) for c in cells], pa.binary())})

    return run


def _answers(blocks: pa.Table) -> pa.Table:
    """Counts in the whole corpus for the n-grams of one hash partition, for each block in its order."""
    sizes = np.asarray(blocks["n"])
    edges = np.append(0, np.cumsum(sizes))

    def joined(name: str, sums: bool = False) -> np.ndarray:
        out = np.empty(edges[-1], np.uint64)
        for a, b, data in zip(edges[:-1], edges[1:], blocks[name], strict=True):
            held = _unpacked(data.as_py(), b - a)
            out[a:b] = np.cumsum(held, dtype=np.uint64) if sums else held
        return out

    hashes, place = np.unique(joined("hashes", True), return_inverse=True)
    found = {}
    for name in ("times", "ends"):
        # sums of whole numbers; as floats they are exact up to 2**53
        total = np.bincount(place, joined(name).astype(np.float64), len(hashes)).astype(np.int64)[place]
        found[name] = pa.array([_packed(total[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    return pa.table({**{c: blocks[c] for c in ("run", "part", "n", "mark")}, **found})


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every run as one compressed value."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    for number, rows, _ in _runs(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
            writer.write_batch(rows)
        yield pa.record_batch({"run": pa.array([number]), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _scored(order: int, bits: int, least: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """doc_id, words, words backed off, words without any front word, and the sum of the logarithms, but for the share
        of single words in the corpus, for the texts of a run."""
        where = f"run {(texts if len(texts) else answers)['run'][0]}"
        if len(texts) != 1:
            raise RuntimeError(f"{where} was read {len(texts)} times; pass a table that is read from files")
        with pa.ipc.open_stream(texts["texts"][0].as_py()) as stream:
            rows = stream.read_all().combine_chunks()
        ids, text = rows["doc_id"].combine_chunks(), rows["text"].combine_chunks()
        levels, counts = _levels(text, order)
        n = int(counts.sum())
        value, single, backed = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
        if n:
            hashes, place, parts, edges = _different(levels, bits)
            answers = answers.sort_by("part")
            same = len(answers) == len(parts) and (np.asarray(answers["part"]) == parts.view(np.int64)).all() and (
                np.asarray(answers["mark"]) == _marks(hashes, edges)).all()
            if not same:
                raise RuntimeError(f"{where} changed between two reads; pass a table that is read from files")
            times, followed = (np.concatenate([_unpacked(v.as_py(), s) for v, s in zip(answers[c], np.diff(edges).tolist(), strict=True)])
                               for c in ("times", "ends"))
            times = times.astype(np.float64)
            followed = times - followed
            heads = (np.cumsum(counts) - counts)[counts > 0]
            place = place.reshape(order, n + 1)
            value, single = np.log(times[place[0, :-1]]) + (order - 1) * math.log(BACKOFF), np.ones(n, bool)
            backed = np.full(n, order > 1)
            for level in range(2, order + 1):
                context = np.empty(n, np.int64)
                context[1:] = place[level - 2, : n - 1]
                context[heads] = place[level - 2, n]
                seen = times[place[level - 1, :-1]]
                known = seen >= least
                value = np.where(known, np.log(seen / followed[context]) + (order - level) * math.log(BACKOFF), value)
                single &= ~known
                if level == order:
                    backed = ~known
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = [np.bincount(owner, w, len(counts)) for w in (np.ones(n), backed, single, value)]
        return pa.table({"doc_id": ids, **{
            k: pa.array(s if k == "log_score" else s.astype(np.int64))
            for k, s in zip(("n_words", "n_backed_off", "n_single", "log_score"), sums, strict=True)}})

    return run


def score(docs: DataFrame, least: int = 2, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_backed_off (words whose longest n-gram is too rare), log_score and per_word (their mean; null
    without words) for every document."""
    if least < 1 or order < 1:
        raise ValueError("least and order are 1 or more")
    docs = pick(docs, "doc_id", "text")
    total = docs.agg(F.sum(n_words(F.col("text")))).first()[0] or 0
    bits = max(math.ceil(math.log2(max(order * total, 1) / PART_GRAMS)), 0)
    answers = docs.mapInArrow(_blocks(order, bits), BLOCK).groupBy("part").applyInArrow(_answers, ANSWER)
    texts = docs.mapInArrow(_sent, TEXTS)
    found = texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_scored(order, bits, least), SCORES)
    share = F.sum("n_single") * math.log(max(total, 1))
    return (
        found.groupBy("doc_id")
        .agg(F.sum("n_words").alias("n_words"), F.sum("n_backed_off").alias("n_backed_off"),
             (F.sum("log_score") - share).alias("log_score"))
        .withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))))
