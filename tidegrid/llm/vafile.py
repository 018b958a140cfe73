"""Exact top-k search by inner product over a vector-approximation file.

The file holds blocks of vectors. A block has, per dimension, 256 equally wide cells between its least and greatest
component, a cell number per component (the approximation), and the exact vectors. With q a query, c the middle of a
vector's cells and h half a cell's width per dimension, the inner product lies within q.c - sum(|q|h) and
q.c + sum(|q|h). A search scans the approximations of a block, drops every vector whose upper bound is below the k-th
best lower bound (or k-th best score so far), and reads the exact vectors of the others in order of their bounds until
no bound reaches the k-th score. (For a score to be maximised, the upper bound plays the part that the lower bound of a
distance plays.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CELLS = 256
BLOCK_VECTORS = 2048
BLOCK_QUERIES = 256
_READ_AT_ONCE = 32
#: products and sums of this size are exact in double precision
_EXACT = 2.0**50
_BIG = 1 << 62


def scaled_vectors(embeddings: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and its vector as doubles, floor(scale * x); rows that take no part are left out.

    Those are rows with a null id, a null vector, a null component or a component that is not finite.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(finite)
        .select("vec_id", F.transform("v", lambda x: F.lit(float(scale)) * x).alias("v"))
    )


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of equal length packed into blocks where they lie; no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[dim]])
            exact = np.concatenate([v for _, v in held[dim]])
            held[dim], count[dim] = [], 0
            low = exact.min(axis=0).astype(float)
            step = np.maximum((exact.max(axis=0).astype(float) - low) / CELLS, 1e-9)
            codes = np.clip((exact - low) / step, 0, CELLS - 1).astype(np.uint8)
            narrow = bool((np.abs(exact) < 2**31).all())
            row = [
                pa.array([dim], pa.int32()),
                pa.array([len(ids)], pa.int32()),
                pa.array([ids.astype("<i8").tobytes()]),
                pa.array([low.astype("<f8").tobytes()]),
                pa.array([step.astype("<f8").tobytes()]),
                pa.array([codes.tobytes()]),
                pa.array([narrow]),
                pa.array([exact.astype("<i4" if narrow else "<i8").tobytes()]),
            ]
            return pa.RecordBatch.from_arrays(row, names=["dim", "n", "ids", "low", "step", "cells", "narrow", "exact"])

        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            column = batch["v"]
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float))
            flat = np.clip(flat, -float(_BIG), float(_BIG)).astype(np.int64)
            dims = column.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                matrix = flat[starts[own][:, None] + np.arange(dim)]
                for at in range(0, len(own), size):
                    part = slice(at, at + size)
                    held.setdefault(dim, []).append((ids[own[part]], matrix[part]))
                    count[dim] = count.get(dim, 0) + len(own[part])
                    if count[dim] >= size:
                        yield block(dim)
        for dim in [d for d, n in count.items() if n]:
            yield block(dim)

    return vectors.mapInArrow(
        pack, "dim int, n int, ids binary, low binary, step binary, cells binary, narrow boolean, exact binary"
    )


class Approximated:
    """A block of the file in memory."""

    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.low, self.step = np.frombuffer(row["low"], "<f8"), np.frombuffer(row["step"], "<f8")
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(self.n, self.dim)
        self.exact = np.frombuffer(row["exact"], "<i4" if row["narrow"] else "<i8").reshape(self.n, self.dim)

    def search(self, queries: Approximated, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Bring each query's best (scores, ids) up to date with this block."""
        asked = queries.exact.astype(np.float64)
        middles = self.low + (self.cells + 0.5) * self.step
        reach = np.abs(asked) @ (self.step / 2)
        size = np.abs(asked).max(initial=0) * max(np.abs(middles).max(initial=0), 1) * max(self.dim, 1)
        if size < _EXACT:
            near = asked @ middles.T
            slack = reach[:, None] + 1.0 + size * 1e-12
        else:  # bounds in double precision would not hold; read every exact vector
            near, slack = np.zeros((queries.n, self.n)), np.inf
        upper, lower = near + slack, near - slack
        own = queries.ids[:, None] == self.ids[None, :]
        upper[own], lower[own] = -np.inf, -np.inf
        kth = np.partition(lower, self.n - k, axis=1)[:, self.n - k] if self.n >= k else np.full(queries.n, -np.inf)
        for i in range(queries.n):
            scores, ids = best[i]
            floor = max(kth[i], scores[-1]) if len(scores) >= k else kth[i]
            found = np.flatnonzero((upper[i] >= floor) & ~own[i])
            found = found[np.argsort(-upper[i, found], kind="stable")]
            vector = queries.exact[i].astype(np.int64)
            for at in range(0, len(found), _READ_AT_ONCE):
                if len(scores) >= k and scores[-1] > upper[i, found[at]]:
                    break
                part = found[at : at + _READ_AT_ONCE]
                scores = np.concatenate([scores, self.exact[part].astype(np.int64) @ vector])
                ids = np.concatenate([ids, self.ids[part]])
                order = np.lexsort([ids, -scores])[:k]
                scores, ids = scores[order], ids[order]
            best[i] = scores, ids


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """The k highest scores of every query against all vectors but its own: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding. A component counts as floor(scale * x), a score is the integer inner product,
    ties go to the smaller vec_id. Only vectors of the query's length are compared.

    Blocks of queries meet blocks of vectors in a grid of tasks: each task has one share of either, so with P tasks
    neither table is copied more than about sqrt(P) times, weighted by their sizes. They meet by merging: on disk the blocks
    of queries may look small enough to broadcast, but the driver would have to hold them once for every line of the grid.
    A task keeps the best k of the queries at hand from block to block; the best of all tasks are ranked at the end.

    Rows with null ids or null, missing or non-finite components take no part. Rows that share a vec_id are candidates
    each, and none of them for a query of that id; equal query ids are asked once each and ranked together. Scaled
    components beyond 2**62 are cut to it and sums wrap like 64-bit integers. Fewer than k other vectors: all of them.
    An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    file = stored(_blocks(scaled_vectors(embeddings, scale), BLOCK_VECTORS), "va-file")
    asked = stored(_blocks(scaled_vectors(queries, scale), BLOCK_QUERIES), "va-queries")
    sizes = [t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (file, asked)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, round((tasks * sizes[1] / max(1, sizes[0])) ** 0.5))
    lines = max(1, -(-tasks // columns))

    def share(of: int):
        return F.pmod(F.xxhash64("ids"), F.lit(of)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    grid = (
        asked.withColumn("column", share(columns))
        .withColumn("line", every(lines))
        .select("dim", "line", "column", F.struct(*asked.columns).alias("asked"), F.xxhash64("ids").alias("batch"))
        .join(
            file.withColumn("line", share(lines))
            .withColumn("column", every(columns))
            .select("dim", "line", "column", F.struct(*file.columns).alias("block"))
            .hint("merge"),
            ["dim", "line", "column"],
        )
        .select("batch", "asked", "block")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_no, queries_now, best = None, None, []

        def found() -> pa.RecordBatch:
            sizes = [len(s) for s, _ in best]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries_now.ids, sizes)),
                    pa.array(np.concatenate([i for _, i in best])),
                    pa.array(np.concatenate([s for s, _ in best])),
                ],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                if batch["batch"][i].as_py() != batch_no:
                    if queries_now is not None:
                        yield found()
                    batch_no = batch["batch"][i].as_py()
                    queries_now = Approximated(batch["asked"][i].as_py())
                    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * queries_now.n
                Approximated(batch["block"][i].as_py()).search(queries_now, best, k)
        if queries_now is not None:
            yield found()

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        grid.mapInArrow(search, "query_id long, vec_id long, score long")
        .withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
