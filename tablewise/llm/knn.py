"""Operator 1: exact top-k search by inner product over KD-trees.

Method: the vectors are dealt to shards of bounded size; each shard builds a
KD-tree by median splits (at the middle row along the widest side, so ties
split evenly) with tight bounding boxes.  A query walks a tree best-first by
the largest inner product its box allows and stops at its kth best score.  The
queries first search the shard they lie in; the kth score found there goes with
them to all other shards, where it bounds the walk from the start.

Queries meet shards in blocks of bounded size, so no task holds all queries or
all vectors, and each shard returns at most k rows for a query.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import written

SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF_ROWS = 64
#: Sums of products below this are exact as doubles; larger ones are taken with whole numbers.
EXACT = 2.0**53


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``vector`` (array of long): floor(scale * x) of each component.

    Vectors that are null or hold a null or non-finite component, and rows
    without vec_id, are left out.  Rows that share a vec_id are one vector, the
    smallest of them.
    """
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("vector"), fine.alias("fine"))
        .where("fine and vec_id is not null")
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


class Tree:
    """KD-tree over the rows of ``points``: ``lo``/``hi`` boxes, children or a range of ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        lo, hi = [], []
        todo = [(0, len(points), None)]
        while todo:
            a, b, parent = todo.pop()
            number = len(self.span)
            if parent is not None:
                left = self.children[parent]
                self.children[parent] = (left[0], number) if left else (number, -1)
            own = points[self.order[a:b]]
            lo.append(own.min(axis=0))
            hi.append(own.max(axis=0))
            self.span.append((a, b))
            self.children.append(None)
            if b - a > leaf_rows and points.shape[1]:
                axis = int(np.argmax(hi[-1] - lo[-1]))
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argsort(own[:, axis], kind="stable")]
                todo += [(a + middle, b, number), (a, a + middle, number)]
        self.lo, self.hi = np.array(lo), np.array(hi)


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: list[int], floors: list[int | None], k: int, leaf_rows: int = LEAF_ROWS) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, vec_id) among ``points``, without its own id and below its floor."""
    largest = float(max(np.abs(points).max(initial=0), 1)) * float(max(np.abs(queries).max(initial=0), 1)) * max(points.shape[1], 1)
    kind = np.float64 if largest < EXACT else object
    tree = Tree(points, leaf_rows)
    points, queries = points[tree.order].astype(kind), queries.astype(kind)
    ids = ids[tree.order]
    lo, hi = tree.lo.astype(kind), tree.hi.astype(kind)
    limits = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
    out = []
    for row, own_id in enumerate(query_ids):
        query, limit, floor = queries[row], limits[row], floors[row]
        best: list[tuple] = []
        heap = [(-limit[0], 0)]
        while heap and (floor is None or -heap[0][0] >= floor):
            _, node = heapq.heappop(heap)
            if (pair := tree.children[node]) is not None:
                for child in pair:
                    heapq.heappush(heap, (-limit[child], child))
                continue
            a, b = tree.span[node]
            scores = points[a:b] @ query
            fit = np.flatnonzero(scores >= floor) if floor is not None else np.arange(b - a)
            for i in fit.tolist():
                if ids[a + i] != own_id:
                    entry = (int(scores[i]), -int(ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = best[0][0] if floor is None else max(floor, best[0][0])
        out.append([(score, -i) for score, i in sorted(best, reverse=True)])
    return out


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k rows with the highest inner product.

    ``vectors``: ``vec_id``, ``embedding``; queries are the rows whose vec_id
    is divisible by ``query_every``, candidates all rows but the query's own.
    Ties go to the smaller vec_id.  Vectors of different lengths have no
    product and do not meet; an empty vector scores 0.  See
    :func:`whole_vectors` for nulls and repeated rows.  An empty table, or one
    without queries, gives an empty result.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    table = written(whole_vectors(vectors, scale), "vectors")
    is_query = F.col("vec_id") % query_every == 0
    n, n_queries = table.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_shards, n_blocks = max(1, ceil(n / shard_rows)), max(1, ceil(n_queries / query_rows))
    rows = table.select("vec_id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int").alias("shard"))
    queries = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)).cast("int"))

    def searched(found: pa.Table, shard: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if found.num_rows and shard.num_rows:
            dim = found.column("dim")[0].as_py()
            matrix = [np.array(t.column("vector").combine_chunks().flatten(), np.int64).reshape(-1, dim) if dim else np.zeros((t.num_rows, 0), np.int64) for t in (shard, found)]
            asked = found.column("vec_id").to_pylist()
            for query, best in zip(asked, search(matrix[0], shard.column("vec_id").to_numpy(), matrix[1], asked, found.column("floor").to_pylist(), k)):
                out += [(query, i, score) for score, i in best]
        return pa.table({name: pa.array([r[c] for r in out], pa.int64()) for c, name in enumerate(("query_id", "vec_id", "score"))})

    def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        columns = [*keys, "vec_id", "vector"]
        asking = left.select(*[F.col(c).alias(c) for c in [*columns, "floor"]])  # columns of its own: both sides come from one table
        return asking.groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInArrow(searched, "query_id long, vec_id long, score long")

    home = written(meet(queries.withColumn("floor", F.lit(None).cast("long")), rows, ["dim", "shard"]), "home")
    floors = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asked = queries.join(floors, "vec_id", "left").withColumnRenamed("shard", "own")
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where("shard <> own")
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = home.union(meet(everywhere, copies, ["dim", "shard", "block"]))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
