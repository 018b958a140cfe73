"""Exact batch top-k retrieval by cosine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import COSINE_EPSILON
from ..sources.storage import written

# Rows of one block of vectors and of one block of queries; a task scores one
# block of each, so neither side has to fit a task.
VECTOR_BLOCK = 8192
QUERY_BLOCK = 8192

# Queries scored at a time inside a task.
_SCORED_ROWS = 256

# Scores are compared after rounding, so that ties do not hang on the order of
# additions.
SCORE_DIGITS = 6


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())


def _blocks(df: DataFrame, groups: list[str], rows: int, name: str) -> DataFrame:
    """Into how many blocks the rows of each group are cut."""
    return df.groupBy(*groups).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("long").alias(name))


def _matched(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """Rows of equal groups; a missing value is a group of its own, as in a cogroup."""
    if not groups:
        return a.crossJoin(b)
    b = b.withColumnsRenamed({n: f"{n}_r" for n in groups})
    return a.join(b, reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}_r")) for n in groups])).drop(*[f"{n}_r" for n in groups])


def _in_blocks(df: DataFrame, counts: DataFrame, groups: list[str], key: str, own, other) -> DataFrame:
    """Each row in one block of its side, once for every block of the other side of its group."""
    (n_own, block), (n_other, visited) = own, other
    numbers = F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1)
    return _matched(df, counts, groups).select(
        *df.columns, F.pmod(F.xxhash64(key), n_own).alias(block), F.explode(numbers).alias(visited)
    )


def _best(scores: np.ndarray, k: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best rounded scores of each row, ties by column, and of the kept columns.

    Only scores that can be among them after rounding are sorted.
    """
    # scores without a value come last
    order = np.where(np.isnan(scores), -np.inf, scores)
    most = min(max(int(k.max(initial=0)), 0), scores.shape[1])
    if not most:
        return np.nonzero(np.broadcast_to(kept, scores.shape))
    least = np.partition(order, -most, axis=1)[:, -most]
    rows, cols = np.nonzero((order >= (least - 10.0**-SCORE_DIGITS)[:, None]) | kept[None, :])
    value = np.round(order[rows, cols], SCORE_DIGITS)
    sorted_ = np.lexsort((cols, -value, rows))
    rows, cols = rows[sorted_], cols[sorted_]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = (rank < k[rows]) | kept[cols]
    return rows[keep], cols[keep]


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | str,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    item_id: str = "item_id",
    item_vector: str = "item_vector",
    within: Sequence[tuple[str, str]] = (),
    forced: str | None = None,
) -> DataFrame:
    """Best k items per query (and per ``within`` group) by cosine.

    k       number, or the name of an integer column of ``queries``
    within  (query column, item column) pairs that must be equal; ranks are
            taken inside each such group
    forced  name of a boolean item column; those items are kept whatever their rank

    Both sides of a group are cut into hash blocks of bounded size, as many as its
    rows ask for, and every pair of blocks of a group is scored as a matrix
    product, from which only its own best k leave, so the quadratic part is never
    materialised and a crowded group is spread over many tasks.  Returns query
    id, item id, score and rank, plus the item's ``within`` columns; the rank of
    a forced item outside the best k is NULL.  Rows whose vector is NULL or holds
    a NULL take no part on either side.
    """
    queries = queries.where(_usable(query_vector))
    vectors = vectors.where(_usable(item_vector))
    limit = F.lit(k) if isinstance(k, int) else F.col(k)
    groups = [f"__g{i}" for i in range(len(within))]
    q = queries.select(
        F.col(query_id).alias("__q"),
        F.col(query_vector).alias("__qv"),
        limit.cast("int").alias("__k"),
        *[F.col(a).alias(n) for (a, _), n in zip(within, groups)],
    )
    v = vectors.select(
        F.col(item_id).alias("__i"),
        F.col(item_vector).alias("__iv"),
        (F.col(forced) if forced else F.lit(False)).alias("__forced"),
        *[F.col(b).alias(n) for (_, b), n in zip(within, groups)],
    )
    n_query, n_vector = _blocks(q, groups, QUERY_BLOCK, "__nq"), _blocks(v, groups, VECTOR_BLOCK, "__nv")
    # stored, so that the planner knows how few they are
    counts = written(_matched(n_query, n_vector, groups), "blocks")
    q = _in_blocks(q, counts, groups, "__q", ("__nq", "__qb"), ("__nv", "__vb"))
    v = _in_blocks(v, counts, groups, "__i", ("__nv", "__vb"), ("__nq", "__qb"))
    keys = [*groups, "__qb", "__vb"]
    types = {f.name: f.dataType.simpleString() for f in (*q.schema, *v.schema)}
    schema = ", ".join(
        [f"{c} {types[c]}" for c in ("__q", "__i", "__k", "__forced", *groups)] + ["__score double"]
    )

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["__q", "__i", "__k", "__forced", *groups, "__score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        # columns in id order, so a stable sort settles ties by id
        right = right.iloc[np.argsort(right["__i"].to_numpy(), kind="stable")]
        b = np.stack(right["__iv"].to_numpy()).astype(float)
        lengths, kept = np.linalg.norm(b, axis=1), right["__forced"].to_numpy().astype(bool)
        parts = []
        for at in range(0, len(left), _SCORED_ROWS):
            some = left.iloc[at : at + _SCORED_ROWS]
            a, most = np.stack(some["__qv"].to_numpy()).astype(float), some["__k"].fillna(0).to_numpy()
            scores = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * lengths[None, :] + COSINE_EPSILON)
            rows, cols = _best(scores, most, kept)
            out = some.iloc[rows][["__q", "__k", *groups]].reset_index(drop=True)
            out["__i"] = right["__i"].to_numpy()[cols]
            out["__forced"] = kept[cols]
            out["__score"] = np.round(scores[rows, cols], SCORE_DIGITS)
            parts.append(out[columns])
        return pd.concat(parts, ignore_index=True)

    best = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(score, schema)
    order = Window.partitionBy("__q", *groups).orderBy(F.desc("__score"), "__i")
    return (
        best.withColumn("rank", F.row_number().over(order).cast("long"))
        .where((F.col("rank") <= F.col("__k")) | F.col("__forced"))
        .select(
            F.col("__q").alias(query_id), F.col("__i").alias(item_id),
            *[F.col(n).alias(b) for n, (_, b) in zip(groups, within)],
            F.col("__score").alias("score"),
            F.when(F.col("rank") <= F.col("__k"), F.col("rank")).alias("rank"),
        )
    )


# -- pruning by pivots ---------------------------------------------------------

# Vectors shorter than this have no safe direction; they form a block that every query visits.
_SHORT = 1e-3


def _directions(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which of them are too short to have one."""
    rows = np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, 1))
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.maximum(norms, _SHORT)[:, None], norms < _SHORT


def in_pivot_blocks(vectors: DataFrame, item_id: str, item_vector: str, pivots: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors with __block, the number of the nearest of ``pivots`` pivots, and __angle to it; and the pivots.

    Pivots are vectors drawn by the hash of their id, so their number bounds what the driver and the tasks hold.
    """
    usable = vectors.where(_usable(item_vector))
    drawn = usable.orderBy(F.xxhash64(item_id), item_id).limit(pivots).select(F.col(item_vector).cast("array<double>").alias("v")).collect()
    directions, short = _directions(pd.Series([r["v"] for r in drawn], dtype=object))
    directions = directions[~short]

    @F.pandas_udf(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def place(column: pd.Series) -> pd.DataFrame:
        units, none = _directions(column)
        if not len(directions) or not len(units):
            return pd.DataFrame({"block": np.zeros(len(units), np.int32), "angle": np.full(len(units), np.pi)})
        near = np.clip(units @ directions.T, -1, 1)
        block = np.where(none, len(directions), near.argmax(axis=1))
        return pd.DataFrame({"block": block.astype(np.int32), "angle": np.where(none, np.pi, np.arccos(near.max(axis=1)))})

    placed = usable.withColumn("__at", place(F.col(item_vector).cast("array<double>")))
    columns = [F.col(c) for c in vectors.columns]
    return written(placed.select(*columns, F.col("__at.block").alias("__block"), F.col("__at.angle").alias("__angle")), "pivot-blocks"), directions


def block_visits(
    queries: DataFrame, query_vector: str, blocks: dict[int, float], directions: np.ndarray, floor: str | None = None
) -> DataFrame:
    """A row per query and block that may hold one of its best, as __visit.

    ``blocks`` has the largest angle of each block.  On the sphere an item of a
    block is no nearer to the query than the angle to the pivot less that of the
    block, so its cosine is bounded; a block is left out if its bound is below
    the column ``floor``.  Without ``floor`` only the block with the best bound is
    visited.
    """
    numbers = np.array(sorted(blocks))
    reach = np.array([blocks[b] for b in numbers])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visits(column: pd.Series, least: pd.Series) -> pd.Series:
        units, none = _directions(column)
        bound = np.ones((len(units), len(numbers)))
        known = numbers < len(directions)
        if known.any() and len(units):
            angle = np.arccos(np.clip(units @ directions[numbers[known]].T, -1, 1))
            bound[:, known] = np.cos(np.maximum(0, angle - reach[known]))
        bound[none] = 1
        if floor is None:
            angle_first = bound - 1e-9 * np.arange(len(numbers))
            return pd.Series([[int(numbers[i])] for i in angle_first.argmax(axis=1)])
        keep = bound >= least.to_numpy()[:, None] - 4 * 10.0**-SCORE_DIGITS
        return pd.Series([numbers[k].tolist() for k in keep])

    least = F.col(floor) if floor else F.lit(-1.0)
    return queries.withColumn("__visit", F.explode(visits(F.col(query_vector).cast("array<double>"), least)))


def cosine_topk_pruned(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | str,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    item_id: str = "item_id",
    item_vector: str = "item_vector",
    pivots: int = 64,
) -> DataFrame:
    """The result of ``cosine_topk`` without scoring every pair: query id, item id, score, rank.

    Items are grouped around pivots.  Every query first scores the block that
    promises most; its k-th score there is a floor, and of the other blocks it
    visits those whose bound reaches it (see ``block_visits``).  Exact for any
    data; how many blocks are skipped depends on how the vectors cluster.
    Query ids must differ.
    """
    queries = queries.where(_usable(query_vector))
    names = {"query_id": query_id, "query_vector": query_vector, "item_id": item_id, "item_vector": item_vector}
    placed, directions = in_pivot_blocks(vectors.select(item_id, item_vector), item_id, item_vector, pivots)
    blocks = {r["__block"]: r["reach"] for r in placed.groupBy("__block").agg(F.max("__angle").alias("reach")).collect()}
    limit = queries.select(F.col(query_id).alias("__q"), (F.lit(k) if isinstance(k, int) else F.col(k)).cast("int").alias("__k"))
    if not blocks:
        return cosine_topk(queries, vectors, k, **names)

    def scored(asked: DataFrame) -> DataFrame:
        found = cosine_topk(asked, placed, k, within=[("__visit", "__block")], **names)
        return found.select(F.col(query_id).alias("__q"), F.col(item_id).alias("__i"), "score")

    home = block_visits(queries, query_vector, blocks, directions)
    first = written(scored(home), "first-block")
    floors = first.groupBy("__q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).join(limit, "__q")
    floors = floors.select("__q", F.when(F.col("n") >= F.col("__k"), F.col("least")).otherwise(F.lit(-2.0)).alias("__floor"))
    known = home.select(F.col(query_id).alias("__q"), F.col("__visit").alias("__home"))
    asked = queries.join(floors.join(known, "__q"), F.col(query_id) == F.col("__q")).drop("__q")
    rest = block_visits(asked, query_vector, blocks, directions, "__floor").where("__visit <> __home")
    order = Window.partitionBy("__q").orderBy(F.desc("score"), "__i")
    return (
        first.unionByName(scored(rest))
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .join(limit, "__q")
        .where(F.col("rank") <= F.col("__k"))
        .select(F.col("__q").alias(query_id), F.col("__i").alias(item_id), "score", "rank")
    )


def level_k(level: Column) -> Column:
    """Tables to retrieve for a question of a tier."""
    # 3 for L0, 4 for L1 and L2, else 5.
    return F.when(level == "L0", 3).when(level.isin("L1", "L2"), 4).otherwise(5)


def corpus_texts(columns: DataFrame) -> DataFrame:
    """One text per table: its name, then a "name: description" line per column.

    Input: table_name, position, column_name, description.
    """
    line = F.concat_ws(": ", "column_name", F.coalesce("description", F.lit("")))
    return (
        columns.groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
        .select(
            "table_name",
            F.concat_ws(
                "\n", "table_name", F.array_join(F.transform("lines", lambda s: s["line"]), "\n")
            ).alias("text"),
        )
    )
