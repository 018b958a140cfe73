import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import similarity as sim
from tidegrid.operators import comparison as cmp
from tidegrid.operators import key_join as kj
from tidegrid.operators import retrieval as rt
from tidegrid.operators import scoring as sco
from tidegrid.operators.profile import profile_layers


def vectors(spark, n, seed, id_name, vector_name):
    rng = np.random.default_rng(seed)
    data = rng.integers(-3, 4, (n, 6)).astype(float)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, f"{id_name} long, part int, {vector_name} array<double>")


def cosines(a, b):
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.round(a @ b.T / (norms + 1e-10), 6)


@pytest.mark.parametrize("blocks", [(8192, 1024), (16, 7)])
def test_cosine_topk_is_exact_for_any_block_size(spark, monkeypatch, blocks):
    monkeypatch.setattr(rt, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(rt, "QUERY_BLOCK", blocks[1])
    qv, queries = vectors(spark, 20, 1, "query_id", "query_vector")
    iv, items = vectors(spark, 60, 2, "item_id", "item_vector")
    scores = cosines(qv, iv)
    want = set()
    for q in range(20):
        for rank, i in enumerate(sorted(range(60), key=lambda i: (-scores[q, i], i))[:4], 1):
            want.add((q, i, rank))
    got = rt.cosine_topk(queries, items, 4).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == want


def test_cosine_topk_within_groups_and_forced(spark):
    qv, queries = vectors(spark, 9, 1, "query_id", "query_vector")
    iv, items = vectors(spark, 40, 2, "item_id", "item_vector")
    items = items.withColumnRenamed("part", "item_part").withColumn("key", F.col("item_id").isin(3, 7))
    got = rt.cosine_topk(queries, items, 2, within=[("part", "item_part")], forced="key").collect()
    scores = cosines(qv, iv)
    want = {}
    for q in range(9):
        group = sorted((i for i in range(40) if i % 3 == q % 3), key=lambda i: (-scores[q, i], i))
        for rank, i in enumerate(group, 1):
            if rank <= 2 or i in (3, 7):
                want[q, i] = rank if rank <= 2 else None
    assert {(r["query_id"], r["item_id"]): r["rank"] for r in got} == want


def test_level_k_and_corpus(spark):
    levels = spark.createDataFrame([("L0",), ("L2",), ("L5",)], "level string")
    assert [r[0] for r in levels.select(rt.level_k(F.col("level"))).collect()] == [3, 4, 5]
    columns = spark.createDataFrame(
        [("t", 1, "b", "second"), ("t", 0, "a", "first"), ("t", 2, "c", None)],
        "table_name string, position int, column_name string, description string",
    )
    assert rt.corpus_texts(columns).first()["text"] == "t\na: first\nb: second\nc: "


def test_set_similarity(spark):
    frame = spark.createDataFrame(
        [(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], [])], "l array<string>, r array<string>"
    )
    got = [r[0] for r in frame.select(sim.jaccard(F.col("l"), F.col("r"))).collect()]
    assert got == [1 / 3, 1.0, 0.0]
    score = sim.weighted_score({n: (F.col("l"), F.col("r")) for n in sim.COMPONENT_WEIGHTS})
    assert frame.select(score.alias("s")).first()["s"] == pytest.approx(1 / 3)
    text = spark.createDataFrame([("A b c", "a B d"), ("", "x"), (None, "x")], "l string, r string")
    got = [r[0] for r in text.select(sim.text_jaccard(F.col("l"), F.col("r"))).collect()]
    assert got == [0.5, 0.0, 0.0]
    parts = frame.select(sim.set_difference(F.col("l"), F.col("r")).alias("d")).first()["d"]
    assert tuple(parts) == (["b"], ["a"], ["c"])
    both = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in both.select(sim.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] == 0.0


def test_multiset_and_shared_items(spark):
    pairs = spark.createDataFrame(
        [(1, ["x", "x", "yy"], ["x", "yy", "yy"]), (2, [], []), (3, ["x"], []), (4, ["x"] * 50, ["x"] * 30)],
        "id long, l array<string>, r array<string>",
    )
    got = {r["id"]: (r["matches"], r["score"]) for r in cmp.multiset_jaccard(pairs, "id", "l", "r").collect()}
    assert got == {1: (2, 0.5), 2: (0, 1.0), 3: (0, 0.0), 4: (30, 0.6)}
    shared = [tuple(r) for r in cmp.top_shared_items(pairs, "id", "l", "r", 1).orderBy("id").collect()]
    assert shared == [(1, "yy", 1, 1), (4, "x", 30, 1)]


def test_frames_match(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(3.0, "c", 3.0005), (1.0, "a", 1.0), (2.0, "b", float("nan"))], "x double, y string, z double")

    def equal(x, y):
        return cmp.frames_match(x, y).first()["equal"]

    assert equal(a, b)
    assert not equal(a, b.withColumn("z", F.col("z") + 0.01))
    assert not equal(a, b.where("x > 1"))
    assert not equal(a, b.drop("z"))
    assert not equal(a, b.withColumn("y", F.lit("a")))
    assert not equal(a, b.withColumn("y", F.lit(1)))
    empty = a.where("k < 0")
    assert equal(empty, empty)
    many = spark.range(5000).select("id", (F.col("id") * 0.5).alias("v"))
    assert equal(many, many.orderBy(F.desc("id")))


def test_reports(spark):
    rows = [(i, f"L{i % 6}", i % 4 == 0, 1.0 * (i % 4 == 0), 0.5, i / 100) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, level string, exec_ok boolean, exec double, metric double, text double")
    means = {r["level"]: r for r in sco.level_rollup(frame).collect()}
    assert means["ALL"]["n"] == 40 and means["ALL"]["avg_exec"] == 0.25 and len(means) == 7
    picked = sco.first_examples(frame).collect()
    want = []
    for level in range(6):
        for ok in (True, False):
            ids = [r[0] for r in rows if r[1] == f"L{level}" and r[2] == ok]
            want += ids[:1]
    want += [r[0] for r in rows if r[0] not in want][: 12 - len(want)]
    assert [r["id"] for r in picked] == want
    status = sco.status_share(frame.withColumn("status", F.when(F.col("exec_ok"), "correct").otherwise("wrong")))
    assert {tuple(r) for r in status.collect()} == {("correct", 10, 25.0), ("wrong", 30, 75.0)}
    lacking = spark.createDataFrame([(["x"], []), ([], []), (["y", "z"], ["w"])], "a array<string>, b array<string>")
    assert tuple(sco.missing_counts(lacking, ["a", "b"]).first()) == (2, 1)


def test_rule_catalog(spark):
    assert kj.join_rules(spark).count() == 28
    assert kj.find_rules("county", "claims") == [("concat", "county.GEOID", "LEFT(claims.GEOID,5)")]
    assert [r[0] for r in kj.find_rules("hospitals", "county")] == ["direct", "point_polygon"]
    claims = spark.createDataFrame([("48201000001", 5), ("48201000002", 6)], "GEOID string, paid int")
    county = spark.createDataFrame([("48201", "HARRIS")], "GEOID string, NAME string")
    for a, an, b, bn in ((claims, "claims", county, "county"), (county, "county", claims, "claims")):
        assert kj.join_layers(a, an, b, bn).count() == 2
    with pytest.raises(ValueError, match="no join rule"):
        kj.join_layers(claims, "claims", claims, "schools")


def test_profile(spark):
    layer = spark.createDataFrame([("48", 1.0), ("12", float("nan"))], "GEOID string, v double")
    rows = profile_layers({"t": layer}, {"t": "GEOID"}, {"t": {"v": "a value"}}).orderBy("position").collect()
    assert [(r["column_name"], r["indexed"], r["description"], r["row_count"]) for r in rows] == [
        ("GEOID", True, "unknown", 2), ("v", False, "a value", 2),
    ]
    # the samples of all columns are the same rows in the same order
    assert dict(zip(rows[0]["sample"], rows[1]["sample"])) == {"48": "1.0", "12": None}


def test_retrieval_leaves_null_vectors_out(spark):
    from tidegrid.operators.retrieval import cosine_topk

    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<double>")
    v = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0, None])], "item_id long, item_vector array<double>")
    assert [(r.query_id, r.item_id) for r in cosine_topk(q, v, 3).collect()] == [(1, 7)]


def test_pruned_topk_is_exact_and_skips_blocks(spark):
    import numpy as np

    from tidegrid.operators.retrieval import block_visits, cosine_topk, cosine_topk_pruned, in_pivot_blocks

    g = np.random.default_rng(7)
    centers = g.normal(0, 1, (12, 16))
    rows = [(i, (centers[i % 12] + g.normal(0, 0.05, 16)).tolist()) for i in range(600)]
    rows += [(600, [0.0] * 16), (601, rows[3][1]), (602, rows[3][1]), (603, None), (604, [1e-6] + [0.0] * 15)]
    items = spark.createDataFrame(rows, "item_id long, item_vector array<double>")
    asked = spark.createDataFrame([(i, v, 1 + i % 5) for i, v in rows[::9] + [rows[600]]], "query_id long, query_vector array<double>, k int")
    want = sorted(map(tuple, cosine_topk(asked, items, "k").select("query_id", "item_id", "score", "rank").collect()))
    got = cosine_topk_pruned(asked, items, "k", pivots=24)
    assert got.columns == ["query_id", "item_id", "score", "rank"] and sorted(map(tuple, got.collect())) == want
    placed, directions = in_pivot_blocks(items, "item_id", "item_vector", 24)
    reach = {r["__block"]: r.a for r in placed.groupBy("__block").agg(F.max("__angle").alias("a")).collect()}
    near = asked.where("query_id < 600").withColumn("floor", F.lit(0.9))
    visits = block_visits(near, "query_vector", reach, directions, "floor").count()
    assert visits < 0.4 * near.count() * len(reach)
    assert cosine_topk_pruned(asked, items.limit(0), 3).count() == 0


def test_crowded_groups_are_cut_by_their_own_size(spark, monkeypatch):
    """A small group is one block however many rows the others have, so nothing of it is repeated."""
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(rt, "QUERY_BLOCK", 10)
    seen, spread = [], rt._in_blocks

    def counting(*args):
        out = spread(*args)
        seen.append({r["__g0"]: r["n"] for r in out.groupBy("__g0").agg(F.count(F.lit(1)).alias("n")).collect()})
        return out

    monkeypatch.setattr(rt, "_in_blocks", counting)
    rows = [(i, "many" if i < 35 else "few" if i < 40 else None, [float(i % 7), 1.0]) for i in range(43)]
    q = spark.createDataFrame(rows, "query_id long, part string, query_vector array<float>")
    v = spark.createDataFrame(rows, "item_id long, item_part string, item_vector array<float>")
    got = rt.cosine_topk(q, v, 2, within=[("part", "item_part")])
    assert got.groupBy("item_part").count().where("item_part = 'few'").first()["count"] == 10
    assert seen == [{"many": 140, "few": 5, None: 3}] * 2


@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_best_of_rounded_scores(k):
    """Scores that differ after the last digit are ties and go by column; those without a value come last."""
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 9, (20, 30)) / 10 + rng.uniform(-4e-7, 4e-7, (20, 30))
    scores[3, 4] = scores[5] = np.nan
    kept = np.zeros(30, bool)
    kept[[2, 11]] = True
    ranks = np.argsort(np.argsort(-np.round(scores, rt.SCORE_DIGITS), axis=1, kind="stable"), axis=1)
    rows, cols = rt._best(scores, np.full(20, k), kept)
    assert sorted(zip(rows, cols)) == sorted(zip(*np.nonzero((ranks < k) | kept[None, :])))


def test_shared_items_move_only_where_a_key_is_repeated(spark, monkeypatch):
    rows = [(1, ["x", "x", "yy"], ["x", "yy", "yy"]), (2, ["a", None], [None, "a"]), (3, ["x"], None), (None, ["b"], ["b"])]
    spread, counted = cmp.item_counts, []
    monkeypatch.setattr(cmp, "item_counts", lambda df, *rest: counted.append(df.count()) or spread(df, *rest))
    schema = "id long, l array<string>, r array<string>"

    def best(rows):
        found = cmp.top_shared_items(spark.createDataFrame(rows, schema), "id", "l", "r", 2)
        return sorted((tuple(r) for r in found.collect()), key=repr)

    want = [(1, "x", 1, 2), (1, "yy", 1, 1), (2, "a", 1, 1), (2, None, 1, 2), (None, "b", 1, 1)]
    assert best(rows) == sorted(want, key=repr) and counted == []
    # a key at two rows: the items of both are taken together, also where the key is missing
    more = [(1, ["zzz"], ["x"]), (None, ["c", "c"], ["b", "c"])]
    want = [(1, "x", 2, 2), (1, "yy", 1, 1), (2, "a", 1, 1), (2, None, 1, 2), (None, "b", 1, 1), (None, "c", 1, 2)]
    assert best(rows + more) == sorted(want, key=repr) and counted == [4]
