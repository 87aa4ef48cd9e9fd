"""Quality classifier: supervised subword embeddings.

Every word, pair of neighbouring words and character n-gram of a text (3 to 5
characters inside a word, its white space included as a mark of the border) is
hashed to a bucket that owns a learned vector. Pairs of equal words share one. The vectors of all features of
the whole text are averaged and a softmax over two classes follows. Vectors and
output weights are trained by stochastic gradient descent in numpy on the
driver, from a sample of at most ``most_rows`` labelled documents; their
features arrive as bucket numbers and counts.

Averaging and the difference of the two output weights are both linear, so for
scoring each bucket is reduced to one number, its vector times that difference.
The score is the same; a text then costs one look-up per feature in a table of
``4 * buckets`` bytes, which is sent to the tasks. Texts are read once where
they lie and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallylens.llm.tables import agreed, bounded_sample, pick
from tallylens.llm.tokens import SPACE, cut, find_words, per_text, raw
from tallylens.sources.files import staged

BITS = 17
SLICE = 1 << 19


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: buckets of all texts, one text after another, and how many each text has."""
    texts = column.to_pylist()
    joined = "\n".join(["", *texts, ""])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = SPACE[np.minimum(chars, 255)] & (chars < 256)
    chars = np.where(space, np.uint32(32), chars)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    rolled, inner = chars, np.zeros(len(chars), bool)
    for n in (2, 3, 4, 5):
        rolled = rolled[:-1] * np.uint32(0x01000193) + chars[n - 1 :]
        if n == 2:
            continue
        inner = inner[:-1] | space[n - 2 : len(space) - 1] if n > 3 else space[1:-1]
        found = np.flatnonzero(~inner)
        buckets = ((rolled[found] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        yield buckets, np.diff(np.searchsorted(found, edges))
    words = find_words(*raw(column))
    for n in (1, 2):
        grams, counts = words.grams(n)
        buckets = ((grams + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.uint32)
        if n == 2:
            pairs, _ = words.grams(1)
            at = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(grams))
            buckets[pairs[at] == pairs[at + 1]] = 1  # a word said twice is one feature, whatever the word
        yield buckets, counts


@dataclass
class Scorer:
    """A trained model, reduced to one number for each bucket, and the number of the constant feature."""

    weights: np.ndarray
    constant: float
    fixed: float | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, part in cut(column, SLICE):
            total, number = np.full(len(part), self.constant), np.ones(len(part))
            for buckets, counts in features(part):
                total += per_text(self.weights[buckets].astype(np.float64), counts)
                number += counts
            out.append(1 / (1 + np.exp(-total / number)))
        scores = np.concatenate(out) if out else np.zeros(0)
        return scores if self.fixed is None else np.full(len(scores), self.fixed)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in cut(batch["text"], SLICE):
            per_kind = [(b, np.concatenate([[0], np.cumsum(c)])) for b, c in features(part)]
            ids, counts = [], []
            for i in range(len(part)):
                own, number = np.unique(np.concatenate([b[e[i] : e[i + 1]] for b, e in per_kind]), return_counts=True)
                ids.append(own.astype("<u4").tobytes())
                counts.append(number.astype("<u4").tobytes())
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(at, len(part)), "label": batch["label"].slice(at, len(part)),
                "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})


def descend(
    rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 16, epochs: int = 4, rate: float = 30.0, seed: int = 7,
) -> Scorer:
    """Stochastic gradient descent, one document at a time, with a rate that falls to zero."""
    buckets, random = 1 << BITS, np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets + 1, dim)).astype(np.float32)  # the last one is constant
    output = np.zeros((dim, 2), np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            ids, counts, label = rows[i]
            ids, share = np.append(ids, buckets), np.append(counts, 1).astype(np.float32)
            share /= share.sum()
            hidden = share @ vectors[ids]
            logits = hidden @ output
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            now = np.float32(rate * (1 - done / steps))
            back = output @ error
            output -= 0.1 * now * np.outer(hidden, error)
            vectors[ids] -= now * share[:, None] * back
            done += 1
    direction = output[:, 1] - output[:, 0]
    return Scorer((vectors[:-1] @ direction).astype(np.float32), float(vectors[-1] @ direction))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most_rows: int = 4000, **options) -> Scorer:
    """Learn from at most ``most_rows`` labelled documents.

    The chosen ids are at most that many, so they are sent to all tasks and no
    text is shuffled. Without labels of both kinds every text gets the share of
    label 1 among the labels, and 1 if there are none: nothing speaks against it.
    """
    chosen = F.broadcast(bounded_sample(agreed(labels, column), most_rows))
    # at most most_rows rows, fetched file by file. The driver holds them once, as two long arrays: freed as a whole, these
    # go back to the system, which thousands of small ones do not
    found = staged(
        pick(docs, "doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text")
        .mapInArrow(_tally, "doc_id bigint, label int, ids binary, counts binary")
        .groupBy("doc_id", "label").agg(F.min(F.struct("ids", "counts")).alias("f"))  # repeated ids: one row
        .select("doc_id", "label", "f.*"), "training")
    ids, counts, fetched = bytearray(), bytearray(), []
    for r in found.toLocalIterator():
        fetched.append((r["doc_id"], r["label"], slice(len(ids) // 4, (len(ids) + len(r["ids"])) // 4)))
        ids += r["ids"]
        counts += r["counts"]
    every, times = np.frombuffer(ids, "<u4"), np.frombuffer(counts, "<u4")
    rows = [(every[own], times[own], label) for _, label, own in sorted(fetched, key=lambda r: r[0])]
    kinds = {r[2] for r in rows}
    if len(kinds) < 2:
        return Scorer(np.zeros(1 << BITS, np.float32), 0.0, float(kinds.pop()) if kinds else 1.0)
    return descend(rows, **options)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of label 1. Null texts count as empty; an empty text gets
    the score of the constant feature."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in cut(batch["text"], 8 * SLICE):
                scores = pa.array(model.value.score(part), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns, scores], [*batch.schema.names, "score"])

    kept = docs.drop("score")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
