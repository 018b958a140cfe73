"""Hand-made polygons and a random set, as rings of (x, y)."""

from __future__ import annotations

import random


def square(x, y, side):
    return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]


UNIT = square(0.0, 0.0, 4.0)
HOLED = [UNIT[0], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]]
ELL = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
DIAMOND = [[(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0), (2.0, 0.0)]]
BOWTIE = [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]
SPIKE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 6.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
OPEN = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
HOLE_OUTSIDE = [UNIT[0], [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (6.0, 5.0), (5.0, 5.0)]]
HOLE_ACROSS = [UNIT[0], [(3.0, 1.0), (3.0, 3.0), (5.0, 3.0), (5.0, 1.0), (3.0, 1.0)]]
HOLE_TOUCHING = [UNIT[0], [(0.0, 2.0), (2.0, 3.0), (2.0, 1.0), (0.0, 2.0)]]


def moved(rings, dx, dy, scale=1.0):
    return [[(x * scale + dx, y * scale + dy) for x, y in ring] for ring in rings]


def mixed_polygons(n, seed):
    """Shapes from tiny to very large, many of them in one crowded corner."""
    rng = random.Random(seed)
    kinds = [UNIT, HOLED, ELL, DIAMOND]
    out = []
    for i in range(n):
        scale = 2.0 ** rng.randint(-6, 2)
        span = 4 if i % 3 == 0 else 64
        x, y = rng.randrange(span * 16) / 16, rng.randrange(span * 16) / 16
        out.append((i, moved(kinds[i % 4], x, y, scale)))
    return out


def as_frame(spark, rows, key="id", geom="geometry"):
    """DataFrame of key and checked geometry."""
    from tidegrid.functions.geometry import RINGS_TYPE, is_valid, make_polygon

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("rings", RINGS_TYPE)])
    raw = spark.createDataFrame(rows, schema)
    return raw.withColumn("ok", is_valid("rings")).select(
        F.col(key), make_polygon("rings", "ok").alias(geom)
    )
