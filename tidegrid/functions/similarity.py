"""Set and vector similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the eight query components.
COMPONENT_WEIGHTS = {
    "spatial_functions": 0.30,
    "select": 0.15,
    "where": 0.15,
    "from": 0.10,
    "join": 0.10,
    "predicate": 0.10,
    "group_by": 0.05,
    "order_by": 0.05,
}

# Fixed value: the characters a text is split at (all Unicode white space).
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Fixed value: keeps the cosine of a zero vector at zero.
COSINE_EPSILON = 1e-10


def tokens(text: Column) -> Column:
    """Lower-case white-space tokens of a text, without empty ones."""
    return F.array_remove(F.split(F.lower(text), WHITE_SPACE), "")


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays; two empty sets are equal, one empty set scores 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / F.greatest(union, F.lit(1))
    )


def text_jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard of two texts; a missing or empty text scores 0."""
    usable = (F.length(F.coalesce(a, F.lit(""))) > 0) & (F.length(F.coalesce(b, F.lit(""))) > 0)
    return F.when(usable, jaccard(tokens(a), tokens(b))).otherwise(F.lit(0.0))


def weighted_score(pairs: dict[str, tuple[Column, Column]], weights=None) -> Column:
    """Sum of weight x Jaccard over named (gold, predicted) array columns."""
    weights = weights or COMPONENT_WEIGHTS
    total = F.lit(0.0)
    for name, (gold, predicted) in pairs.items():
        total = total + jaccard(gold, predicted) * weights[name]
    return total


def set_difference(gold: Column, predicted: Column) -> Column:
    """struct<matches, missing, extra> of two arrays taken as sets."""
    return F.struct(
        F.array_sort(F.array_intersect(gold, predicted)).alias("matches"),
        F.array_sort(F.array_except(gold, predicted)).alias("missing"),
        F.array_sort(F.array_except(predicted, gold)).alias("extra"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays."""

    def dot(u, v):
        products = F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + COSINE_EPSILON)
