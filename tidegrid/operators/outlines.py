"""Outlines compared as point sets, by an equi join on their normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def same_outlines(a: DataFrame, b: DataFrame, a_geom: str, b_geom: str) -> DataFrame:
    """Pairs of polygons that are the same point set (see ``canonical_rings_sql``).

    Two hashes of the normal form are the join key, so only polygons that are
    equal, or nearly never, meet; the normal forms decide.
    """
    clash = set(a.columns) & set(b.columns)
    if clash:
        raise ValueError(f"rename columns present on both sides: {sorted(clash)}")

    def keyed(df, geom, tag):
        normal = df.where(f"{geom} IS NOT NULL").withColumn(f"__n{tag}", F.expr(g.canonical_rings_sql(f"{geom}.rings")))
        return normal.withColumns({f"__h{tag}": F.xxhash64(f"__n{tag}"), f"__i{tag}": F.xxhash64(F.lit(3), f"__n{tag}")})

    same = "__ha = __hb AND __ia = __ib AND __na = __nb"
    return keyed(a, a_geom, "a").join(keyed(b, b_geom, "b"), F.expr(same)).select(*a.columns, *b.columns)
