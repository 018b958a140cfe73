"""Comparison of result tables and of item collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import checkpointed, written

_NUMERIC = (T.NumericType,)


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, _NUMERIC)


def _positional(df: DataFrame) -> DataFrame:
    """Columns renamed by position; numbers as double with NaN as NULL."""
    out = []
    for i, field in enumerate(df.schema):
        c = F.col(f"`{field.name}`")
        if _is_number(field):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        out.append(c.alias(f"c{i}"))
    return df.select(*out)


def _ranked(df: DataFrame, tag: str) -> DataFrame:
    """Rows with their place in the order over all columns.

    A range-partitioned sort; the place is the offset of the partition plus the
    position inside it, so no single task sees all rows.  The sorted rows are
    checkpointed because a repeated sort may cut its ranges elsewhere.
    """
    columns = df.columns
    ordered = checkpointed(
        df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("__mid", 33)
    position = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the sort
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    return (
        ordered.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .select(
            (F.col("__offset") + position).alias("__place"),
            F.lit(True).alias(f"__in_{tag}"),
            *[F.col(c).alias(f"{tag}_{c}") for c in columns],
        )
    )


def _cells_match(a: T.StructField, b: T.StructField, left: Column, right: Column, atol, rtol) -> Column:
    if _is_number(a) and _is_number(b):
        near = (left == right) | (F.abs(left - right) <= atol + rtol * F.abs(right))
        return (left.isNull() & right.isNull()) | F.coalesce(near, F.lit(False))
    if a.dataType == b.dataType:
        return left.eqNullSafe(right)
    return left.isNull() & right.isNull()


def frames_match(a: DataFrame, b: DataFrame, atol: float = 1e-3, rtol: float = 1e-5) -> DataFrame:
    """Compare two result tables: names, row order and numeric types are ignored.

    Returns one row: equal, rows_a, rows_b, rows_differing (rows_differing is
    NULL when the shapes differ in columns).
    """
    if len(a.columns) != len(b.columns):
        return a.agg(F.count(F.lit(1)).alias("rows_a")).select(
            F.lit(False).alias("equal"),
            "rows_a",
            b.agg(F.count(F.lit(1))).scalar().alias("rows_b"),
            F.lit(None).cast("long").alias("rows_differing"),
        )
    fa, fb = a.schema.fields, b.schema.fields
    both = _ranked(_positional(a), "a").join(_ranked(_positional(b), "b"), "__place", "full")
    same = F.lit(True)
    for i, (x, y) in enumerate(zip(fa, fb)):
        same = same & _cells_match(x, y, F.col(f"a_c{i}"), F.col(f"b_c{i}"), atol, rtol)
    present = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    return both.agg(
        F.count("__in_a").alias("rows_a"),
        F.count("__in_b").alias("rows_b"),
        F.coalesce(F.sum(F.when(present & same, 0).otherwise(1)), F.lit(0)).alias("rows_differing"),
    ).select(
        (F.col("rows_differing") == 0).alias("equal"), "rows_a", "rows_b", "rows_differing"
    )


def item_counts(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """How often each item occurs on either side: key, item, n_left, n_right.

    Items are counted before the shuffle; one long array spreads over tasks by
    item.
    """

    def side(column, n_left, n_right):
        return F.struct(F.col(column).alias("items"), F.lit(n_left).alias("l"), F.lit(n_right).alias("r"))

    sides = pairs.select(key, F.inline(F.array(side(left, 1, 0), side(right, 0, 1))))
    return (
        sides.select(key, F.explode("items").alias("item"), "l", "r")
        .groupBy(key, "item")
        .agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    )


def multiset_jaccard(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Multiset Jaccard m / (n1 + n2 - m) of two array columns per pair.

    Two empty arrays score 1, one empty array scores 0.
    """
    sizes = pairs.select(
        key,
        F.coalesce(F.size(left), F.lit(0)).cast("long").alias("size_left"),
        F.coalesce(F.size(right), F.lit(0)).cast("long").alias("size_right"),
    )
    shared = (
        item_counts(pairs, key, left, right)
        .groupBy(key)
        .agg(F.sum(F.least("n_left", "n_right")).alias("shared"))
    )
    m = F.coalesce("shared", F.lit(0)).cast("long")
    total = F.col("size_left") + F.col("size_right")
    return sizes.join(shared, key, "left").select(
        key, "size_left", "size_right", m.alias("matches"),
        F.when(total == 0, F.lit(1.0))
        .otherwise(m.cast("double") / F.greatest(total - m, F.lit(1)))
        .alias("score"),
    )


def _top_shared_in_row(pairs: DataFrame, key: str, left: str, right: str, n: int) -> DataFrame:
    """The n longest common items of each row on its own, with their multiset count."""
    longest = f"array_sort(transform(array_intersect(`{left}`, `{right}`), i_ -> struct(coalesce(-length(i_), 1) AS o, i_ AS item)))"
    best = pairs.select(key, left, right, F.posexplode(F.expr(f"slice({longest}, 1, {n})")).alias("__at", "__best"))
    n_left, n_right = (f"size(filter(`{c}`, i_ -> i_ <=> __best.item))" for c in (left, right))
    return best.selectExpr(
        f"`{key}`", "__best.item AS item", f"CAST(least({n_left}, {n_right}) AS BIGINT) AS matches", "CAST(__at + 1 AS BIGINT) AS rank"
    )


def top_shared_items(pairs: DataFrame, key: str, left: str, right: str, n: int = 5) -> DataFrame:
    """The n longest items common to both arrays, with their multiset count.

    The arrays of a key that has one row are compared inside the row.  Those of a
    repeated key are taken together, spread by item.
    """
    repeated = written(pairs.groupBy(F.col(key).alias("__key")).count().where("count > 1").select("__key"), "repeated-keys")
    if repeated.isEmpty():
        return _top_shared_in_row(pairs, key, left, right, n)
    same = F.col(key).eqNullSafe(F.col("__key"))
    single, several = pairs.join(repeated, same, "left_anti"), pairs.join(repeated, same, "left_semi")
    counts = item_counts(several, key, left, right).withColumn(
        "matches", F.least("n_left", "n_right")
    )
    longest = Window.partitionBy(key).orderBy(F.length("item").desc(), "item")
    ranked = (
        counts.where(F.col("matches") > 0)
        .withColumn("rank", F.row_number().over(longest).cast("long"))
        .where(F.col("rank") <= n)
        .select(key, "item", "matches", "rank")
    )
    return _top_shared_in_row(single, key, left, right, n).unionByName(ranked)
