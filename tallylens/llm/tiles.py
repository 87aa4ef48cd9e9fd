"""Nearest neighbours by a block matrix join.

Queries are dealt to groups and candidates to stripes; every cell of the grid of
groups and stripes is one group of a cogroup, of bounded size. The number of
groups and stripes follows from the row counts, so a cell stays the same size
whatever the input; candidates are sent once per query group, queries once per
stripe.

Inside a cell vectors are rounded to int8 with a scale of their own, and the
candidates are taken tile by tile. A product of codes differs from the product
of the vectors by at most ``|a'||eb| + |ea||b'| + |ea||eb|``, where ``a'`` is the
rounded vector and ``ea`` the rest (Cauchy-Schwarz). Pairs whose upper bound is
below the k-th lower bound of the query cannot be among its k nearest; the pairs
that survive are recomputed in double precision on the original vectors. The k
best of each query are kept in a heap over the tiles of a cell, and the cells'
results are merged by heaps, too. The result is exact.

Equal vectors of a cell share one row of the tile. Their products tie and ties
go to smaller ids, so only the k + 1 smallest ids can be near (one of them may
be the query's own); a vector that a third of all rows hold costs one product.

Defined results: ids or vectors that are null, zero vectors and those with a
null or non-finite component take no part; of rows with equal ids the smallest
vector takes part; vectors of another length than the query's are no candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylens.llm.tables import pick
from tallylens.sources.files import staged

GROUP_ROWS, STRIPE_ROWS, TILE_ROWS = 4096, 8192, 2048
PAIR = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id and ``v`` (doubles) of the rows that take part, one for each id."""
    v = F.col("v")
    rows = pick(vectors, "vec_id", vector).select("vec_id", F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def rounded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the rounded vectors and norms of the rests."""
    scale = np.abs(v).max(1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(v - near, axis=1)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: in floats as long as every sum is a whole number that they can hold."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """The k best pairs of each query in a cell."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, owner = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    by_owner = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_owner], np.arange(len(first) + 1))
    distinct = vectors[first]
    q_codes, q_scale, q_norm, q_rest = rounded(queries)
    heaps: list[list] = [[] for _ in query_ids]
    for at in range(0, len(distinct), TILE_ROWS):
        tile = distinct[at : at + TILE_ROWS]
        codes, scale, norm, rest = rounded(tile)
        about = multiplied(q_codes, codes) * q_scale[:, None] * scale
        # a little more than the bound, for the rounding of this computation itself
        slack = (q_norm[:, None] * rest + q_rest[:, None] * (norm + rest)) * (1 + 1e-9) + 1e-6 * q_norm[:, None] * norm
        # one more than k distinct vectors: one may be the query's own row
        most = min(k + 1, len(tile))
        floor = np.partition(about - slack, len(tile) - most, axis=1)[:, len(tile) - most] if len(tile) > k else np.full(len(about), -np.inf)
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        row, column = np.nonzero(about + slack >= np.maximum(floor, full)[:, None])
        for a in range(0, len(row), 1 << 16):
            r, c = row[a : a + (1 << 16)], column[a : a + (1 << 16)]
            exact = np.einsum("ij,ij->i", queries[r], tile[c])
            for q, d, value in zip(r.tolist(), c.tolist(), exact.tolist(), strict=True):
                heap = heaps[q]
                if len(heap) == k and value < heap[0][0]:
                    continue
                own = by_owner[starts[at + d] : min(starts[at + d + 1], starts[at + d] + k + 1)]
                for i in ids[own].tolist():
                    if i == query_ids[q]:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (value, -i))
                    elif (value, -i) > heap[0]:
                        heapq.heapreplace(heap, (value, -i))
    for q, heap in zip(query_ids.tolist(), heaps, strict=True):
        for value, i in heap:
            yield q, -i, value


def search(vectors: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query (ids divisible by ``every``)."""
    rows = staged(usable(vectors, vector).withColumn("dim", F.size("v")), "vectors")
    chosen = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    groups = max(1, -(-chosen.count() // GROUP_ROWS))
    stripes = max(1, -(-rows.count() // STRIPE_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = chosen.select("vec_id", "v", "dim", deal(groups).alias("g"), every_of(stripes).alias("s"))
    held = rows.select("vec_id", "v", "dim", every_of(groups).alias("g"), deal(stripes).alias("s"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = list(nearest(left["vec_id"].to_numpy(), matrix(left["v"]), right["vec_id"].to_numpy(), matrix(right["v"]), k))
        query, near, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({
            "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(near, pa.int64()), "score": pa.array(score, pa.float64())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, i, value in zip(*(batch[c].to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (value, -i))
                elif (value, -i) > heap[0]:
                    heapq.heapreplace(heap, (value, -i))
        for q, heap in heaps.items():
            best = sorted(heap, reverse=True)
            yield pa.record_batch({
                "query_id": pa.array([q] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([-i for _, i in best], pa.int64()), "score": pa.array([x for x, _ in best], pa.float64())})

    keys = ["g", "s", "dim"]
    pairs = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(cell, PAIR)
    return pairs.repartition("query_id").mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


SQL = r"""
WITH usable AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
