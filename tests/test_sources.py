import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from tests import shapes as sh
from tidegrid.functions import geometry as g
from tidegrid.sources import layers as ly
from tidegrid.sources import records as rc


def wkb_polygon(rings, order="<"):
    out = struct.pack("B", 1 if order == "<" else 0) + struct.pack(order + "II", 3, len(rings))
    for ring in rings:
        out += struct.pack(order + "I", len(ring))
        for x, y in ring:
            out += struct.pack(order + "dd", x, y)
    return out


def wkb_multi(parts):
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(wkb_polygon(p) for p in parts)


def test_wkb_decode_orients_rings(spark, tmp_path):
    backwards = [list(reversed(r)) for r in sh.HOLED]
    rows = [
        ("1", bytearray(wkb_polygon(sh.HOLED))),
        ("2", bytearray(wkb_polygon(backwards, ">"))),
        ("3", bytearray(wkb_multi([sh.UNIT, sh.moved(sh.HOLED, 10, 0)]))),
        ("4", None),
        ("5", bytearray(struct.pack("<BIdd", 1, 1, 2.0, 3.0))),
        ("6", bytearray(wkb_polygon(sh.BOWTIE))),
    ]
    path = str(tmp_path / "zones_tx_fl_la.parquet")
    spark.createDataFrame(rows, "GEOID string, geometry binary").write.parquet(path)
    layer = ly.load_layer(spark, path, "geometry")
    got = {
        r["GEOID"]: (r["area"], r["valid"])
        for r in layer.select("GEOID", g.polygon_area("geometry").alias("area"), "geometry.valid").collect()
    }
    assert got["1"] == (12.0, True) and got["2"] == (12.0, True) and got["3"] == (28.0, True)
    assert got["4"] == (None, None) and got["5"] == (None, None)
    assert got["6"][1] is False

    stored = str(tmp_path / "stored.parquet")
    ly.write_layer(layer.where("geometry IS NOT NULL"), stored, cell=1.0, files=2)
    again = ly.load_layer(spark, stored, "geometry")
    assert again.count() == 4 and dict(again.dtypes)["geometry"].startswith("struct")
    assert list(ly.open_layers(spark, str(tmp_path), ["zones"])) == ["zones"]
    with pytest.raises(FileNotFoundError, match="claims"):
        ly.open_layers(spark, str(tmp_path), ["zones", "claims"])


def test_wkb_with_more_ordinates():
    def polygon(kind, extra, order, srid=b""):
        out = struct.pack("B", 1 if order == "<" else 0) + struct.pack(order + "I", kind) + srid
        out += struct.pack(order + "I", len(sh.HOLED))
        for ring in sh.HOLED:
            out += struct.pack(order + "I", len(ring))
            for x, y in ring:
                out += struct.pack(order + "dd", x, y) + struct.pack(order + "d", 77.0) * extra
        return out

    want = ly._rings_from_wkb(wkb_polygon(sh.HOLED))
    for kind, extra in ((1003, 1), (2003, 1), (3003, 2), (0x80000003, 1), (0x40000003, 1), (0xC0000003, 2)):
        for order in "<>":
            assert ly._rings_from_wkb(polygon(kind, extra, order)) == want
    srid = struct.pack("<I", 4326)
    assert ly._rings_from_wkb(polygon(0xA0000003, 1, "<", srid)) == want
    for multi, part in ((1006, 1003), (0x80000006, 0x80000003)):
        whole = struct.pack("<BII", 1, multi, 2) + polygon(part, 1, "<") * 2
        assert ly._rings_from_wkb(whole) == want * 2
    assert ly._rings_from_wkb(struct.pack("<BIddd", 1, 1001, 2.0, 3.0, 4.0)) is None
    for kind in (7, 10, 17, 1010, 4003, 0):
        with pytest.raises(ValueError, match=f"WKB type {kind} "):
            ly._rings_from_wkb(struct.pack("<BII", 1, kind, 0))


def test_layer_names():
    assert ly.layer_name("/data/claims_tx_fl_la.parquet") == "claims"
    assert ly.layer_name("/data/NRI_TX_FL_LA.parquet") == "NRI"
    assert ly.layer_name("county.parquet/") == "county"


def test_views_schema_and_counts(spark):
    layers = {"a": spark.range(3), "b": spark.createDataFrame([("x", 1.5)], "k string, v double")}
    assert ly.register_views(layers) == ["a", "b"]
    assert spark.sql("SELECT count(*) AS n FROM a").first()["n"] == 3
    schema = [tuple(r) for r in ly.describe_schema(layers, spark).orderBy("layer", "position").collect()]
    assert schema == [("a", 0, "id", "bigint"), ("b", 0, "k", "string"), ("b", 1, "v", "double")]
    assert ly.list_columns(layers, ["b", "c"]) == {"b": ["k", "v"], "c": None}
    assert {tuple(r) for r in ly.row_counts(layers).collect()} == {("a", 3), ("b", 1)}
    sample = ly.sample_rows(layers["a"], 2, "id")
    assert sample.count() == 2 and sample.collect() == ly.sample_rows(layers["a"], 2, "id").collect()


def test_json_records(spark, tmp_path):
    questions = [{"id": "L0_0001", "question": "how many?", "sql": "SELECT 1", "level": "L0",
                  "category": "count", "output_type": "scalar", "expected_columns": ["n"]}]
    (tmp_path / "q.json").write_text(json.dumps(questions))
    assert rc.read_json_array(spark, str(tmp_path / "q.json")).first()["expected_columns"] == ["n"]
    good = {"id": "L0_0001", "gt_sql": "a", "generated_sql": "b", "chosen_tables": ["claims"],
            "chosen_columns": {"claims": ["id"]}}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({**good, "id": "L0_0002"}) + "\n")
    predictions = rc.read_json_lines(spark, str(tmp_path / "p.jsonl"))
    assert sorted(r["id"] for r in predictions.collect()) == ["L0_0001", "L0_0002"]
    out = str(tmp_path / "out")
    rc.append_json_lines(predictions.where("id = 'L0_0001'"), out)
    todo = rc.pending(predictions, rc.read_json_lines(spark, out))
    assert [r["id"] for r in todo.collect()] == ["L0_0002"]
    rc.append_json_lines(todo, out)
    assert rc.read_json_lines(spark, out).count() == 2
    rc.write_summary(predictions.groupBy().count(), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first()["count"] == 2


def test_value_helpers(spark):
    from tidegrid.functions import scalars as sc

    frame = spark.createDataFrame(
        [(math.nan, bytearray(b"abc"), "2020-01-02 03:04:05", " a\t b\n", "```sql\nSELECT 1\n```", 1001000001)],
        "v double, b binary, t string, s string, q string, fips long",
    ).withColumn("t", F.to_timestamp("t"))
    row = frame.select(
        sc.finite_or_null("v").alias("v"), sc.blob_text("b").alias("b"), sc.iso_text("t").alias("t"),
        sc.flatten_text(F.col("s")).alias("s"), sc.flatten_text(sc.strip_fences(F.col("q"))).alias("q"),
        sc.tract_text("fips").alias("g"), sc.describe_or_unknown(F.lit(None).cast("string")).alias("d"),
        sc.year_text("t").alias("y"),
    ).first()
    assert tuple(row) == (None, "BLOB(3 bytes)", "2020-01-02T03:04:05", "a b", "SELECT 1", "01001000001", "unknown", "2020")
    shares = frame.agg(sc.share_of(F.col("fips") > 0).alias("x"), F.count(F.when(sc.valid_pct("fips"), 1)).alias("n"))
    assert tuple(shares.first()) == (1.0, 0)


def test_wkb_round_trip(spark):
    shapes = [sh.UNIT, sh.HOLED, [*sh.HOLED, *sh.moved(sh.UNIT, 10, 0)], None]
    rows = spark.createDataFrame(list(enumerate(shapes)), "id int, rings array<array<struct<x: double, y: double>>>")
    back = rows.select("id", ly.wkb_from_rings("rings").alias("w")).select("id", ly.rings_from_wkb("w").alias("r")).collect()
    for r in back:
        got = None if r.r is None else [[(p.x, p.y) for p in ring] for ring in r.r]
        assert got == (None if shapes[r.id] is None else [[tuple(p) for p in ring] for ring in shapes[r.id]])


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert rc.read_runs(spark, path).count() == 0 and rc.runs(spark, path).count() == 0
    first = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, question string")
    assert rc.append_run(first, path, "r1") is True and rc.append_run(first, path, "r1") is False
    # a call that failed after writing its records has not entered its run
    first.write.json(f"{path}/runs/r2")
    assert {r.run_id for r in rc.read_runs(spark, path).collect()} == {"r1"}
    assert rc.append_run(first.limit(1), path, "r2") is True
    with open(f"{path}/runs/r2/part-x.json", "w") as f:
        f.write('{"id": "9", broken\n')
    got = sorted((r.run_id, r.id) for r in rc.read_runs(spark, path).collect())
    assert got == [("r1", "1"), ("r1", "2"), ("r2", got[-1][1])]
    with pytest.raises(ValueError):
        rc.append_run(first, path, "../r3")


def test_numbers_from_dirty_text(spark):
    from tidegrid.functions.scalars import number_or_null

    df = spark.createDataFrame([("1.5",), (" 2 ",), ("n/a",), ("",), (None,), ("1e3",)], "t string")
    assert [r[0] for r in df.select(number_or_null("t")).collect()] == [1.5, 2.0, None, None, None, 1000.0]
