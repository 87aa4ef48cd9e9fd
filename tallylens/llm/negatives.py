"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers, ``floor(256 * x)``, and a score is their exact
inner product. Candidates are stored as bit planes: plane p holds bit p of all
components (two's complement, the last plane is the sign), eight dimensions to
a byte. For every anchor and group of eight dimensions a table holds the sums of
all 256 subsets of the anchor's components, so a byte of a plane is answered by
one lookup; the lookups of a plane are added, and planes are put together by
shifts: ``score = (..(-top * 2 + next) * 2 + ..)``. The tables of a block of
anchors lie side by side, so that one byte fetches the sums of the whole block.

Anchors are dealt to groups and candidates to stripes. A cell of that grid is a
run of a sorted partition, its anchors in front: a task holds the anchors of one
cell and one tile of candidates, whatever the number of rows. Every cell keeps
the best rows of each of its anchors only, and the cells' results are ranked by
a window whose limit is applied before the exchange. The number of groups and
stripes follows from the row counts. A first pass finds the positives, a second
the negatives, whose score windows follow from the positives.

Defined results: rows with a null id or label, a null vector, or a component that
is null, not finite or of 2**13 or more (whose scores might not fit in 64 bits) take
no part; of rows with equal ids that of the smallest label, then
vector, takes part; vectors of another length than the anchor's are neither
positives nor negatives; equal scores go by the smaller id; an anchor without
positives, or a positive without negatives, has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallylens.llm.tables import pick
from tallylens.sources.files import staged

SCALE, LARGEST = 256, 2.0**13
GROUP_ROWS = 4096  # anchors of a cell
STRIPE_ROWS, FEW_ROWS, STRIPES = 262_144, 8192, 64  # candidates of a cell: at most, at least, and stripes wanted
TILE_ROWS, BLOCK = 4096, 128  # rows and anchors scored at once
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, label, dim and ``v`` (whole numbers) of the rows that take part, one for each id."""
    rows = pick(vectors, "vec_id", "label", vector).select("vec_id", F.col("label").cast("bigint").alias("label"), F.col(
        f"`{vector}`").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    whole = F.transform("x", lambda x: F.floor(x * SCALE))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
        .groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("v"))).alias("row"))
        .select("vec_id", "row.label", F.size("row.v").alias("dim"), "row.v"))


def planes_of(v: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers, ``rows x planes x groups of eight dimensions``, as many planes as they need."""
    rows, dim = v.shape
    planes = int(max(v.max(initial=0), ~v.min(initial=0))).bit_length() + 1
    out = np.empty((rows, planes, -(-dim // 8)), np.uint8)
    for p in range(planes):
        out[:, p] = np.packbits((v >> p & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def numbers_of(planes: np.ndarray, dim: int) -> np.ndarray:
    """The whole numbers behind bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little")[:, :, :dim].astype(np.int64)
    worth = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    worth[-1] = -worth[-1]
    return np.einsum("p,rpd->rd", worth, bits)


def subset_sums(v: np.ndarray, kind: type) -> np.ndarray:
    """``groups x 256 x anchors``: the sums of the components that each byte names."""
    anchors, dim = v.shape
    groups = -(-dim // 8)
    padded = np.zeros((anchors, groups * 8), kind)
    padded[:, :dim] = v
    table = np.zeros((groups, 256, anchors), kind)
    for bit in range(8):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + padded[:, bit::8].T[:, None, :]
    return table


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``rows x anchors``: exact inner products, by lookups, additions and shifts."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    last = planes.shape[1] - 1
    for p in range(last, -1, -1):
        total += total
        for g, table in enumerate(tables):
            found = table.take(planes[:, p, g], axis=0)
            if p == last:
                total -= found
            else:
                total += found
    return total


@dataclass
class Anchors:
    """The anchors of a cell, the score windows of each (``anchors x windows``), and the best rows of each window so far."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    same: bool
    keep: int

    def __post_init__(self) -> None:
        self.best = np.full((*self.lows.shape, self.keep), NONE)
        self.best_ids = np.zeros_like(self.best)
        self.reach = int(np.abs(self.vectors).sum(1).max(initial=0))
        self.tables: dict[tuple[int, type], np.ndarray] = {}

    def table(self, at: int, kind: type) -> np.ndarray:
        if (at, kind) not in self.tables:
            self.tables[at, kind] = subset_sums(self.vectors[at : at + BLOCK], kind)
        return self.tables[at, kind]

    def see(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        """Take note of a tile of candidates, sorted by id."""
        kind = np.int32 if self.reach << planes.shape[1] < 1 << 31 else np.int64
        n = len(ids)
        k = min(self.keep, n)
        for at in range(0, len(self.ids), BLOCK):
            part = slice(at, at + BLOCK)
            found = scores(self.table(at, kind), planes).T.astype(np.int64)
            if self.same:
                fits = (self.labels[part, None] == labels) & (self.ids[part, None] != ids)
            else:
                fits = self.labels[part, None] != labels
            for w in range(self.lows.shape[1]):
                low, high = self.lows[part, w, None], self.highs[part, w, None]
                floor = np.maximum(low, self.best[part, w, -1:])
                inside = fits & (found >= floor) & (found <= high)
                open_rows = np.flatnonzero(inside.any(1))
                if not len(open_rows):
                    continue
                # the place in the tile breaks ties, as it follows the id
                held = np.where(inside[open_rows], found[open_rows] - found.min(), -1)
                if held.max() >= (1 << 62) // n:
                    held = np.unique(held, return_inverse=True)[1].reshape(held.shape)
                top = np.argpartition(held * n + np.arange(n - 1, -1, -1), n - k, axis=1)[:, n - k :]
                real = np.take_along_axis(inside[open_rows], top, 1)
                rows = at + open_rows
                value = np.concatenate([self.best[rows, w], np.where(real, np.take_along_axis(found[open_rows], top, 1), NONE)], 1)
                name = np.concatenate([self.best_ids[rows, w], ids[top]], 1)
                order = np.lexsort((name, -np.maximum(value, NONE + 1)), axis=1)[:, : self.keep]
                self.best[rows, w] = np.take_along_axis(value, order, 1)
                self.best_ids[rows, w] = np.take_along_axis(name, order, 1)

    def found(self) -> pa.RecordBatch:
        """anchor_id, window, vec_id and score of the best rows."""
        anchor, window, place = np.nonzero(self.best != NONE)
        return pa.record_batch({
            "anchor_id": pa.array(self.ids[anchor], pa.int64()), "window": pa.array(window, pa.int32()),
            "vec_id": pa.array(self.best_ids[anchor, window, place], pa.int64()),
            "score": pa.array(self.best[anchor, window, place], pa.int64())})


FOUND = "anchor_id bigint, window int, vec_id bigint, score bigint"
PACKED = "vec_id bigint, label bigint, dim int, planes binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            codes = planes_of(part["v"].flatten().to_numpy().reshape(len(part), dim))
            yield pa.record_batch([
                part["vec_id"], part["label"], part["dim"], pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["vec_id", "label", "dim", "planes"])


def _codes(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows and their planes, for each number of planes among them."""
    sizes = np.array([len(x) for x in column.to_pylist()], np.int64)
    groups = -(-dim // 8)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        joined = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8)
        yield at, joined.reshape(len(at), int(size) // max(groups, 1) or 1, groups)


def _cells(same: bool, keep: int, windows: int):
    """Score sorted cells: rows of one cell follow each other, its anchors first."""

    def anchors(rows: list[pa.RecordBatch], dim: int) -> Anchors:
        table = pa.Table.from_batches(rows).combine_chunks()
        vectors = np.zeros((len(table), dim), np.int64)
        column = table["planes"].combine_chunks()
        for at, codes in _codes(column, dim):
            vectors[at] = numbers_of(codes, dim)
        lows, highs = (np.full((len(table), windows), fill) for fill in (1, 0))  # a window that does not exist holds no score
        for i, (low, high) in enumerate(zip(table["lows"].to_pylist(), table["highs"].to_pylist(), strict=True)):
            lows[i, : len(low)], highs[i, : len(high)] = low, high
        return Anchors(table["vec_id"].to_numpy(), table["label"].to_numpy(), vectors, lows, highs, same, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group = None, [], None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "s", "dim", "second")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                cell, candidates = tuple(keys[:3, a].tolist()), bool(keys[3, a])
                if cell != now:
                    if group is not None:
                        yield group.found()
                    now, held, group = cell, [], None
                part = batch.slice(a, b - a)
                if not candidates:
                    held.append(part)
                    continue
                if not held:  # no anchor is as long as these rows
                    continue
                group = group or anchors(held, cell[2])
                for at in range(0, len(part), TILE_ROWS):
                    tile = part.slice(at, TILE_ROWS)
                    ids, labels = tile["vec_id"].to_numpy(), tile["label"].to_numpy()
                    for rows, codes in _codes(tile["planes"], cell[2]):
                        group.see(ids[rows], labels[rows], codes)
        if group is not None:
            yield group.found()

    return run


def _best(rows: DataFrame, asked: DataFrame, size: tuple[int, int], same: bool, keep: int, windows: int) -> DataFrame:
    """anchor_id, window, rank, vec_id, score: the best rows of every window of every anchor. asked: with ``lows`` and ``highs``."""
    groups, stripes = size
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<bigint>")
    left = asked.select(deal(groups).alias("g"), every_of(stripes).alias("s"), "dim", F.lit(False).alias("second"), "vec_id", "label",
                        "planes", "lows", "highs")
    right = rows.select(every_of(groups).alias("g"), deal(stripes).alias("s"), "dim", F.lit(True).alias("second"), "vec_id", "label",
                        "planes", none.alias("lows"), none.alias("highs"))
    cells = left.unionByName(right).repartition(groups * stripes, "g", "s", "dim").sortWithinPartitions("g", "s", "dim", "second", "vec_id")
    found = cells.mapInArrow(_cells(same, keep, windows), FOUND)
    order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; a positive is one of an anchor's best rows of its label, and
    a negative one of the best rows of other labels with a score from ``low`` to ``high`` per cent of the positive's.
    """
    rows = staged(usable(vectors, vector).mapInArrow(_packed, PACKED), "planes")
    chosen = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, asked = rows.count(), chosen.count()
    size = max(1, -(-asked // GROUP_ROWS)), max(1, -(-n // min(STRIPE_ROWS, max(FEW_ROWS, n // STRIPES))))
    whole = [F.array(F.lit(x).cast("bigint")).alias(c) for c, x in (("lows", -(1 << 62)), ("highs", 1 << 62))]
    near = staged(_best(rows, chosen.select("*", *whole), size, True, positives, 1).select(
        "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the smallest and largest whole number in the window: -floor(-x / 100) and floor(x / 100)
    down = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    limits = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "place", (-down(f"(-{low} * positive_score)")).alias("low"), down(f"({high} * positive_score)").alias("high")))).alias("all"))
    limits = limits.select(F.col("anchor_id").alias("vec_id"), F.col("all.low").alias("lows"), F.col("all.high").alias("highs"))
    far = _best(rows, chosen.join(limits, "vec_id"), size, False, negatives, positives)
    return far.join(near.withColumn("window", F.col("place") - 1), ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of the contract's query: every seventh id has the label after its own."""
    rows = pick(vectors, "vec_id", "label", vector)
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = r"""
WITH usable AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
                      'v': list_transform(embedding, lambda x: floor(256 * x::DOUBLE))}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 8192)) = 0
  GROUP BY vec_id),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.r.label AS same, list_inner_product(a.r.v, c.r.v)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.r.v) = len(c.r.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
