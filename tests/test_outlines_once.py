"""Validity is worked out once for every different outline."""

from pyspark.sql import functions as F

from tidegrid.operators import validity

SOUND = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]
BOW = [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]
TWO = [[(0.0, 0.0), (4.0, 0.0)], [(4.0, 4.0), (0.0, 0.0)]]  # the points of SOUND in other rings


def test_copies_of_an_outline_are_checked_once(spark, monkeypatch):
    stored, written = {}, validity.written

    def counting(df, name):
        out = written(df, name)
        stored[name] = out.count()
        return out

    monkeypatch.setattr(validity, "written", counting)
    rows = [("a", SOUND), ("b", BOW), ("c", TWO), (None, None)]
    df = spark.createDataFrame(rows, "key string, outline array<array<struct<x:double,y:double>>>")
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30))))
    got = validity.flag_valid(copies, "key", "outline")
    assert got.columns == ["key", "outline", "copy", "valid"]
    counts = {(r["key"], r["valid"]): r["count"] for r in got.groupBy("key", "valid").count().collect()}
    assert counts == {("a", True): 30, ("b", False): 30, ("c", False): 30, (None, False): 30}
    assert stored == {"checked-outlines": 4, "unsound-outlines": 3}


def test_unsound_outlines_are_found_by_their_code(spark, monkeypatch):
    stored, written = {}, validity.written

    def noting(df, name):
        stored[name] = df.columns
        return written(df, name)

    monkeypatch.setattr(validity, "written", noting)
    minus = [[(-0.0, 0.0), (4.0, 4.0), (4.0, -0.0), (0.0, 4.0), (0.0, 0.0)]]  # BOW, zeros spelt otherwise
    holed = [[(0.0, 0.0), (None, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    shifted = [[(0.0, 0.0), (0.0, None), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]  # the same numbers at other places
    rows = [("a", SOUND), ("b", BOW), ("m", minus), ("h", holed), ("s", shifted), ("e", []), ("n", None)]
    df = spark.createDataFrame(rows, "key string, outline array<array<struct<x:double,y:double>>>")
    got = {r["key"]: r["valid"] for r in validity.flag_valid(df, "key", "outline").collect()}
    alone = {
        k: validity.flag_valid(df.where(F.col("key") == k), "key", "outline").first()["valid"] for k in "abmhsen"
    }
    assert got == alone and got["a"] and not (got["b"] or got["m"] or got["n"])
    assert stored["unsound-outlines"] == ["__outline_a", "__outline_b", "__found"]
    # outlines that differ in more than the sign of a zero have codes of their own
    code = validity._outline_code("outline", ["x", "y"])
    assert df.where("key <> 'm'").selectExpr(*code).distinct().count() == 6
