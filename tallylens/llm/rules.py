"""Quality rules: counts of whole texts and an isolation forest over them.

The counts follow fixed rules (see ``COUNTS``). The forest looks at shares made
from them. A tree cuts the box of all values at random: a random share, at a
random place between the box's bounds, again in each half until the half holds
one training document or is ``DEPTH`` cuts deep. Documents like the training
documents share their half with many others and get long paths; unusual ones
are alone, or where no training document is, after few cuts. The anomaly score
is ``2 ** (-mean path / usual path)``.

Every labelled document that passes the base rules takes part; only sums reach
the driver. Cuts are drawn before any document is looked at, within the box of
all of them. Each tree then counts all documents with label 1 in its halves. To
keep paths as long for many documents as for few, counts are scaled to at most
``PER_TREE`` documents in all; a half that holds one of them or less is not cut.
The threshold is the one that makes wrong rejections, each counted ``dear``
times, plus wrongly kept documents fewest, over all distinct scores. Counting
and scoring every document take one pass over the texts and no exchange;
learning takes another one and exchanges the shares, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylens.llm.tables import agreed, pick
from tallylens.llm.tokens import SPACE, cut, find_words, mix, per_text, raw
from tallylens.session import staged

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("word length", "symbols", "repeated words", "capitals", "marks")
TREES, PER_TREE, DEPTH = 128, 256, 14
CELLS = 1 << 16  # ranges of scores within which running sums are taken


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, first: np.ndarray, windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the words inside 3-word windows that the text holds more than once."""
    inside = np.zeros(len(hashes) + 1, bool)
    if len(windows):
        owner = np.repeat(np.arange(len(counts)), counts)
        keys = mix(windows + mix(owner.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        at = at + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)[at]
        for k in range(3):
            inside[at + k] = True
    return per_text(inside[:-1].astype(np.int64), np.diff(first))


def count(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of every text, and the shares the forest looks at (one column each)."""
    data, offsets = raw(column)
    words, sizes = find_words(data, offsets), np.diff(offsets)
    windows, number = words.grams(3)
    of = lambda marked: per_text(marked.astype(np.int64), sizes)
    found = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": of(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": of(SYMBOLS[data]),
        "n_dup_lines": np.fromiter((repeated_lines(t) for t in column.to_pylist()), np.int64, len(column)),
        "n_repeat_words": repeated_words(words.hashes, words.first, windows, number)}
    n, chars = np.maximum(found["n_words"], 1), np.maximum(found["word_chars"], 1)
    shares = np.stack([
        np.minimum(chars / n, 40) / 40, np.minimum(found["n_symbols"] / n, 1), found["n_repeat_words"] / n,
        of((data >= 65) & (data <= 90)) / chars, np.minimum(of((data == 33) | (data == 63)) / n, 1)], axis=1)
    return found, shares


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which n documents are told apart by random cuts; n may be a fraction."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, np.maximum(many, 1), np.maximum(n - 1, 0))


@dataclass
class Forest:
    """Trees as arrays: the share cut at a node (-1: a leaf), the place, the two halves, the path length of a leaf."""

    share: np.ndarray
    place: np.ndarray
    below: np.ndarray
    above: np.ndarray
    path: np.ndarray
    threshold: float

    def score(self, shares: np.ndarray) -> np.ndarray:
        total = np.zeros(len(shares))
        rows = np.arange(len(shares))
        for tree in range(len(self.share)):
            node = np.zeros(len(shares), np.int64)
            for _ in range(DEPTH):
                cut_at = self.share[tree][node]
                low = shares[rows, np.maximum(cut_at, 0)] < self.place[tree][node]
                node = np.where(cut_at < 0, node, np.where(low, self.below[tree][node], self.above[tree][node]))
            total += self.path[tree][node]
        return 2 ** (-total / max(len(self.share), 1) / usual_path(PER_TREE)) if len(self.share) else total


@dataclass
class Cuts:
    """Random trees of full depth, the halves of node i at 2 i and 2 i + 1: the share cut (-1: a leaf) and the place."""

    share: np.ndarray
    place: np.ndarray

    def leaves(self, tree: int, shares: np.ndarray) -> np.ndarray:
        """Where each row ends: 0 to 2 ** DEPTH - 1. A node that is not cut sends its rows below."""
        rows, node = np.arange(len(shares)), np.ones(len(shares), np.int64)
        for _ in range(DEPTH):
            share = self.share[tree][node]
            node = 2 * node + ((share >= 0) & (shares[rows, np.maximum(share, 0)] >= self.place[tree][node]))
        return node - (1 << DEPTH)


def draw_cuts(box: np.ndarray, seed: int = 11) -> Cuts:
    """Cuts of the box (lowest and highest shares), drawn tree by tree and depth by depth."""
    random = np.random.default_rng(seed)
    share, place = np.full((TREES, 1 << DEPTH), -1, np.int8), np.zeros((TREES, 1 << DEPTH))
    for tree in range(TREES):
        low, high = box[:1].copy(), box[1:].copy()
        for depth in range(DEPTH):
            at, rows = slice(1 << depth, 2 << depth), np.arange(1 << depth)
            wide = high > low
            chosen = np.where(wide, random.random(low.shape), -1).argmax(1)
            where = random.uniform(low[rows, chosen], high[rows, chosen])
            share[tree, at], place[tree, at] = np.where(wide.any(1), chosen, -1), where
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            high[2 * rows, chosen] = low[2 * rows + 1, chosen] = where
    return Cuts(share, place)


def forest_of(cuts: Cuts, held: np.ndarray, threshold: float = 2.0) -> Forest:
    """The forest of trees whose full depth holds ``held`` documents (one row per tree)."""
    scale = min(1.0, PER_TREE / max(int(held[0].sum()), 1))
    grown = []
    for tree in range(TREES):
        sums = [held[tree]]
        for _ in range(DEPTH):
            sums.append(sums[-1].reshape(-1, 2).sum(1))
        counts = np.concatenate([[0], *sums[::-1]]) * scale
        paths = usual_path(counts)
        share, place, below, path, todo = [], [], [], [], [(1, 0)]
        for node, depth in todo:  # grows while it is read: a node's halves come one after the other
            is_cut = depth < DEPTH and counts[node] > 1 and cuts.share[tree, node] >= 0
            share.append(int(cuts.share[tree, node]) if is_cut else -1)
            place.append(float(cuts.place[tree, node]) if is_cut else 0.0)
            below.append(len(todo) if is_cut else 0)
            path.append(0.0 if is_cut else depth + float(paths[node]))
            if is_cut:
                todo += [(2 * node, depth + 1), (2 * node + 1, depth + 1)]
        grown.append((share, place, below, path))
    most = max(len(g[0]) for g in grown)
    share, place, below, path = (
        np.array([g[k] + [fill] * (most - len(g[k])) for g in grown], kind)
        for k, (fill, kind) in enumerate(((-1, np.int64), (0.0, float), (0, np.int64), (0.0, float))))
    return Forest(share, place, below, below + 1, path, threshold)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _counted(batches: Iterator[pa.RecordBatch], forest: Forest | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in cut(batch["text"]):
            found, shares = count(part)
            names = [n for n in batch.schema.names if n != "text"]
            out = {n: batch[n].slice(at, len(part)) for n in names} | found
            if forest is None:
                out["shares"] = pa.array(shares.tolist(), pa.list_(pa.float64()))
            else:
                out["anomaly"] = forest.score(shares)
                out["unusual"] = out["anomaly"] > forest.threshold
            yield pa.record_batch(out)


def _rows(shares: pa.Array) -> np.ndarray:
    return np.asarray(shares.flatten(), float).reshape(-1, len(SHARES))


def _held(batches: Iterator[pa.RecordBatch], cuts: Cuts) -> Iterator[pa.RecordBatch]:
    """How many of a task's rows end in each leaf, as far as any do; ``leaf`` counts on over the trees."""
    held = np.zeros((TREES, 1 << DEPTH), np.int64)
    for batch in batches:
        shares = _rows(batch["shares"])
        for tree in range(TREES):
            held[tree] += np.bincount(cuts.leaves(tree, shares), minlength=1 << DEPTH)
    leaf = np.flatnonzero(held)
    yield pa.record_batch({"leaf": leaf, "held": held.ravel()[leaf]})


def _scored(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"good": batch["good"], "score": forest.score(_rows(batch["shares"]))})


def calibrated(scored: DataFrame, dear: float) -> float:
    """The threshold with the fewest errors, halfway to the next score; above all scores if rejecting none is best.

    ``scored`` has ``score`` and ``good``. Equal scores are merged; running sums are taken within small ranges of scores,
    and over the ranges. Of thresholds with as few errors the lowest is taken.
    """
    each = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    each = staged(each.withColumn("cell", F.floor(F.col("score") * CELLS)), "rule_scores")
    cells = each.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).toArrow().sort_by("cell")
    if not cells.num_rows:
        return 2.0
    good, bad, last = (cells[c].to_numpy() for c in ("good", "bad", "last"))
    # what lies in front of a cell: bad rows kept, good rows not kept from the cell on, and the last score
    ahead = scored.sparkSession.createDataFrame(pa.table({
        "cell": cells["cell"], "kept_bad": np.cumsum(bad) - bad, "lost_good": good[::-1].cumsum()[::-1],
        "last": pa.array([None, *last[:-1].tolist()], pa.float64())}))
    before = Window.partitionBy("cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("cell").orderBy("score")
    zero = F.lit(0).cast("long")
    tried = each.join(ahead, "cell").select(
        (F.col("kept_bad") + F.coalesce(F.sum("bad").over(before), zero)
         + F.lit(float(dear)) * (F.col("lost_good") - F.coalesce(F.sum("good").over(before), zero))).alias("errors"),
        "score", F.coalesce(F.lag("score").over(inner), "last", "score").alias("previous"))
    best = tried.agg(F.min(F.struct("errors", "score", "previous")).alias("best")).first()["best"]
    return 2.0 if int(bad.sum()) < best["errors"] else (best["previous"] + best["score"]) / 2


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", dear: float = 10) -> Forest:
    """Fit and calibrate on all labelled documents that pass the base rules; ids that repeat count once."""
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    counted = pick(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(
        _counted, f"doc_id bigint, {counts}, shares array<double>")
    rows = staged(
        counted.where(~base_failed()).select("doc_id", "shares").join(agreed(labels, column), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("shares").alias("shares")).select((F.col("label") == 1).alias("good"), "shares"), "rule_shares")
    bounds = [f(F.col("shares")[i]).alias(f"{f.__name__}_{i}") for f in (F.min, F.max) for i in range(len(SHARES))]
    box = rows.agg(F.count_if("good"), *bounds).first()
    if not box[0]:
        return Forest(*(np.zeros((0, 1)) for _ in range(5)), 2.0)  # nothing is known to be good: nothing is rejected
    context = docs.sparkSession.sparkContext
    cuts = context.broadcast(draw_cuts(np.array(box[1:]).reshape(2, len(SHARES))))
    leaves = (
        rows.where("good").select("shares").mapInArrow(lambda batches: _held(batches, cuts.value), "leaf bigint, held bigint")
        .groupBy("leaf").agg(F.sum("held").alias("held")).toArrow())
    held = np.zeros(TREES << DEPTH, np.int64)
    held[leaves["leaf"].to_numpy()] = leaves["held"].to_numpy()
    forest = forest_of(cuts.value, held.reshape(TREES, -1))
    model = context.broadcast(forest)
    forest.threshold = calibrated(rows.mapInArrow(lambda batches: _scored(batches, model.value), "good boolean, score double"), dear)
    return forest


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``anomaly`` and ``kept`` for every document; a null text has no words."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    counted = pick(docs, "doc_id", "text").mapInArrow(
        lambda batches: _counted(batches, model.value),
        "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", anomaly double, unusual boolean")
    failed = base_failed()
    return counted.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~F.col("unusual")).alias("kept"), "anomaly")
