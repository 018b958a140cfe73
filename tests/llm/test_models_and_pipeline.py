"""The models against plain Python, held-out accuracy, hot ids, short benchmark items, recall, and the pipeline on odd tables."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import langid, quality
from tidegrid.llm.common import WordHashes, told_apart
from tidegrid.llm.decontaminate import contaminated, without_benchmark
from tidegrid.llm.neardup import near_duplicates, one_of_each
from tidegrid.llm.queries import QUERIES, fold, table
from tidegrid.llm.vafile import top_k

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
rng = random.Random(11)
VOCABULARY = [a + b + c for a in "th er in on ré".split() for b in "a be cu do".split() for c in ("", "n", "st")]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain_ftrl(rows, bits, passes, alpha=0.5, beta=1.0, l1=0.01, l2=0.1):
    """FTRL-proximal over dictionaries: {feature: weight}; the constant is feature 2**bits."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for features, label in rows:
            own = {**features, 1 << bits: 1.0}
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in own.items())))))
            for i, v in own.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_is_the_published_update():
    hashes = WordHashes()
    rows = [(quality.features(prose(30) if i % 2 else "junk " * 30 + prose(3), hashes, 10), i % 2) for i in range(40)]
    model = quality.Ftrl(10)
    for _ in range(3):
        for (at, values), label in rows:
            model.learn(at, values, label)
    want = plain_ftrl([(dict(zip(a.tolist(), v.tolist(), strict=True)), y) for (a, v), y in rows], 10, 3)
    got = model.weights(slice(None))
    assert all(got[i] == pytest.approx(w, abs=1e-6) for i, w in want.items())
    assert {int(i) for i in np.flatnonzero(got)} <= set(want)


def test_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(2).normal(0, 1, (1 << 12) + 1).astype("<f4")
    texts = [None, "", prose(50), "junk " * 40, prose(3000), "é!? é!?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, weights).collect()}
    for i, t in enumerate(texts):
        at, values = quality.features(t, WordHashes(), 12)
        raw = float(weights[-1]) + sum(float(weights[k]) * float(v) for k, v in zip(at.tolist(), values.tolist(), strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-4)


def test_a_hot_id_is_one_row_of_the_sample(spark):
    good, bad = [prose(60) for _ in range(60)], [(rng.choice(VOCABULARY) + " ") * 60 for _ in range(60)]
    texts = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 60)) for i in range(120)]
    once = [spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")]
    hot = [
        spark.createDataFrame(texts + [texts[7]] * 200, "doc_id long, text string"),
        spark.createDataFrame(labels + [labels[7]] * 300 + [(8, 5), (9, None)], "doc_id long, quality int"),
    ]
    a, b = (quality.fit(d, q, fold(5) != 0) for d, q in (once, hot))
    assert np.array_equal(a, b)


def test_languages_by_plain_loops(spark):
    langs = {"aa": "ka ko ki ku".split(), "bb": "zor zer zir zur".split()}
    rows = [(i, " ".join(rng.choice(langs[x]) for _ in range(20)), x) for i in range(30) for x in ("aa", "bb")]
    df = spark.createDataFrame(rows + [rows[0]] * 100, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    again = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert np.allclose(model.vectors, again.vectors)  # copies of a row teach once
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.where("doc_id < 5 AND lang = 'aa'"), model, reject=False).collect()}
    for i, text, x in rows:
        if i >= 5 or x != "aa":
            continue
        counts = collections.Counter()
        for word in text.split(" "):
            padded = f" {word} "
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    if (n, k) != (1, 0):
                        counts[zlib.crc32(padded[k : k + n].encode()) % langid.BUCKETS] += 1
        vector = {b: math.log1p(c) * float(model.idf[b]) for b, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(center[b]) for b, v in vector.items()) / norm for center in model.vectors]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i][0] == model.langs[best] and got[i][1] == pytest.approx(min(1.0, cosines[best]), abs=1e-4)
    few = langid.fit(df, F.lit(True), most_langs=1)
    assert few.langs and len(set(few.langs)) == 1


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op7_language_id"](spark, SF).where("held_out").collect()
    known = [r for r in got if truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(known) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in known) >= 0.97 * len(known)
    marks = {r.doc_id: r.quality for r in table(spark, LARGER, "labels").collect()}
    scored = [r for r in QUERIES["op8_quality_ftrl"](spark, LARGER).where("held_out").collect() if marks.get(r.doc_id) is not None]
    good = [r for r in scored if marks[r.doc_id] == 1]
    assert len(good) > 100 and sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(r.predicted == marks[r.doc_id] for r in scored) >= 0.97 * len(scored)


def test_short_items(spark):
    item = "the capital of france"
    texts = [f"so {item} is", item.upper() + "!", prose(40) + " " + item, "the capital of", "the capital of spain", "of france", None, "yes"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, "of France"), (2, None), (3, "..."), (4, "yes")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in contaminated(df, bench).collect()}
    want = {(0, 0, 1, 4, 1.0), (1, 0, 0, 4, 1.0), (2, 0, 40, 4, 1.0), (0, 1, 3, 2, 1.0), (1, 1, 2, 2, 1.0), (2, 1, 42, 2, 1.0)}
    assert got == want | {(5, 1, 0, 2, 1.0), (7, 4, 0, 1, 1.0)}
    assert {r.doc_id for r in without_benchmark(df, bench).collect()} == {3, 4, 6}


def test_rows_are_told_apart(spark):
    rows = spark.range(2000).withColumn("t", F.concat(F.lit("x"), "id"))
    members = spark.range(0, 2000, 7).withColumn("t", F.concat(F.lit("x"), "id"))
    maybe, sure = told_apart(rows, ["id", "t"], members)
    maybe, sure = {r.id for r in maybe.collect()}, {r.id for r in sure.collect()}
    assert not maybe & sure and maybe | sure == set(range(2000)) and set(range(0, 2000, 7)) <= maybe and len(maybe) < 300


def test_recall_of_planted_near_copies(spark):
    rows, pairs, n = [], [], 0
    for k in range(150):
        base = prose(rng.randint(60, 200)).split(" ")
        for _ in range(rng.randint(1, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"changed{n}"
            rows += [(n, " ".join(base)), (n + 1, " ".join(copy))]
            pairs.append((n, n + 1))
            n += 2
    rows += [(n + i, prose(100)) for i in range(100)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(got[n + i] == n + i for i in range(100))


def test_a_large_bucket_of_several_classes(spark):
    base = prose(300).split(" ")
    rows = []
    for i in range(150):  # each like the template in half of its words, and like its own near copy
        own = base[:150] + prose(150).split(" ")
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(150))
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == list(range(0, 300, 2))


def test_top_k_over_several_blocks(spark):
    g = np.random.default_rng(4)
    data = np.concatenate([g.normal(0, 0.3, (4500, 8)), np.repeat(g.normal(0, 0.3, (1, 8)), 500, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    whole = np.floor(data.astype(float) * 1024).astype(np.int64)
    want = []
    for q in range(0, 5000, 500):
        scores = whole @ whole[q]
        best = sorted((i for i in range(5000) if i != q), key=lambda i: (-scores[i], i))[:10]
        want += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(best)]
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 500 = 0")).collect())
    assert got == sorted(want)


def write(spark, folder, docs, labels, bench):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __key string, span string"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("rows", [0, 12])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    """Null ids, repeated rows, null and empty texts, further columns; or no rows at all."""
    texts = [None, "", prose(80), prose(90)]
    docs = [(None if i % 5 == 0 else i, texts[i % 4], None, "s", None, "k", "x") for i in range(rows)]
    write(spark, tmp_path, docs, [], [])
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == before.columns
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
    kept = out.collect()
    # copies of the two texts leave one row each; rows without words all stay, as one end token
    assert len(kept) == (8 if rows else 0)
    assert sum(r.length > 1 for r in kept) == (2 if rows else 0)
