"""The text operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import langid, quality, substring, warc
from tidegrid.llm.binary_ids import token_ids
from tidegrid.llm.components import components
from tidegrid.llm.decontaminate import contaminated, without_benchmark
from tidegrid.llm.neardup import near_duplicates, one_of_each
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.probminhash import jaccard, occurrences, shingles
from tidegrid.llm.queries import fold
from tidegrid.llm.tokens import token_counts, tokenizer_path
from tidegrid.llm.vafile import top_k
from tidegrid.llm.warc import archived_pages

rng = random.Random(4)
VOCABULARY = [a + b for a in "th er in on ré ü".split() for b in "a be cu do e fy".split()]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text: str, places: list[int]) -> str:
    words = text.split(" ")
    for p in places:
        words[p] = "changed" + str(p)
    return " ".join(words)


BASE, LONG = prose(120), prose(30_000)
PASSAGE = prose(50)
ROWS = [
    (1, BASE),
    (2, edited(BASE, [60])),
    (3, BASE),
    (4, edited(BASE, [10, 90])),
    (4, edited(BASE, [10, 90])),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (None, prose(40)),
    (None, None),
    (8, prose(60) + "\n" + PASSAGE + " " + prose(20)),
    (9, prose(3) + "\t" + PASSAGE),
    (10, "the " * 500),
    (11, "four words of text"),
    (12, "four words of text"),
    (13, LONG),
    (14, "x" * 5000 + " " + prose(5)),
    (15, " nbsp \x1c stays " + prose(50)),
]
EXTRA = "doc_id long, text string, key string, start int, lang string, words string, `group` int, n_words int, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "k", 1, None if i % 5 == 0 else "xy"[i % 2], "w", i, 9, "b") for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [(d, np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4")) for d, x in ROWS]


def test_token_counts(docs, none, ids):
    want = [(d, len((x or "").encode()), len(i), len(i) > 2048) for (d, x), (_, i) in zip(ROWS, ids, strict=True)]
    assert ordered(token_counts(docs).collect()) == ordered(want)
    assert token_counts(none).count() == 0


def test_token_counts_with_other_files(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = collections.Counter(r.n_tokens for r in token_counts(docs, "piece_bpe_32k.model").collect())
    assert got == collections.Counter(len(model.encode(t or "")) for _, t in ROWS)


def test_token_ids(docs, none, ids):
    got = token_ids(docs).orderBy("start").collect()
    want = collections.Counter((d, len(i) + 1, zlib.crc32(np.append(i, 1).astype("<u4").tobytes())) for d, i in ids)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((d for d, _ in ids), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == (np.cumsum([r.n_tokens for r in got]) - [r.n_tokens for r in got]).tolist()
    assert token_ids(none).count() == 0


def test_packing(docs, none, ids):
    got = pack_documents(docs, capacity=256).collect()
    want = collections.Counter()
    for d, i in ids:
        whole = np.append(i, 1).astype("<u4")
        for k, at in enumerate(range(0, len(whole), 256)):
            part = whole[at : at + 256]
            want[(d, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == (np.cumsum([n for _, n in parts]) - [n for _, n in parts]).tolist()
        assert sum(n for _, n in parts) <= 256
    assert len(by) <= -(-sum(n for *_, n, _ in (tuple(k) for k in want.elements())) // 256) + 1
    assert pack_documents(none).count() == 0


def test_repeated_passages(docs, none):
    window, seen = 35, collections.Counter()
    for _, t in ROWS:
        w = substring.words_of(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for d, t in ROWS:
        w = substring.words_of(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, kept if gone else t, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.without_repeats(docs)
    assert set(got.columns) == {*docs.columns, "n_removed", "kept_sha256"}
    assert ordered(got.select("doc_id", "text", "n_words", "n_removed", "kept_sha256").collect()) == ordered(want)
    assert substring.without_repeats(none).count() == 0


def test_frequent_minimisers_are_dealt_by_window(docs, monkeypatch):
    want = ordered(substring.without_repeats(docs, columns=["doc_id", "text"]).collect())
    monkeypatch.setattr(substring, "FREQUENT", 1)
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    assert ordered(substring.without_repeats(docs, columns=["doc_id", "text"]).collect()) == want


def classes_of(rows):
    sets = [occurrences(g) for g in shingles([t for _, t in rows])]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    smallest = {g: min((d for d in v if d is not None), default=None) for g, v in groups.items()}
    return [(rows[i][0], smallest[find(i)], len(groups[find(i)])) for i in range(len(rows))]


def test_near_duplicates(docs, none):
    assert ordered(near_duplicates(docs).collect()) == ordered(classes_of(ROWS))
    assert near_duplicates(none).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = collections.Counter(r.doc_id for r in kept.collect())
    assert got == collections.Counter([1, 5, 6, 7, None, None, 8, 9, 10, 11, 13, 14, 15])


def test_a_chain_of_near_copies_is_one_class(spark):
    # each text is near the next ones only; no text is near all
    texts = [BASE]
    for k in range(30):
        texts.append(edited(texts[-1], [(k * 7) % 120]))
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(classes_of(rows))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE.upper()), (2, edited(PASSAGE, [25])), (3, prose(40)), (4, "one two"), (5, None), (6, "the " * 20), (None, "")]
    bench = spark.createDataFrame([(i, t, 1, "g") for i, t in items], "item_id long, text string, doc_id int, gram string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in contaminated(docs, bench).collect()}
    near = (46 - 5) / (46 + 5)  # one of 50 words differs
    assert got == {(8, 1): 1.0, (9, 1): 1.0, (8, 2): round(near, 6), (9, 2): round(near, 6), (10, 6): 1.0}
    left = without_benchmark(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_with_a_heavy_shingle(spark):
    own = random.Random(11)
    texts = {i: [f"{own.choice(VOCABULARY)}{own.randrange(10**6)}" for _ in range(404)] for i in range(12)}
    texts[12] = texts[0][:364] + ["once"] * 40  # the item repeats a word, the document does not
    cut = {i: t[:364] + ["again"] * 40 for i, t in texts.items() if i < 12} | {12: texts[12][:364] + texts[1][:40]}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in cut.items()], "doc_id long, text string")
    want = {(i, i, round(360 / 440, 9)) for i in range(13)} | {(0, 12, round(360 / 440, 9)), (12, 0, round(360 / 440, 9))}
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in contaminated(df, bench).collect()}
    assert got == want


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(size=4).astype("f")]) for i in range(-100, 450)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (600, None), (601, [1.0, None]), (602, [float("nan")] * 4), (603, [float("inf")] * 4)]
    rows += [(None, [1.0] * 4), (700, [0.5, 0.5]), (800, [1e300, 1.0, 1.0, 1.0]), (900, [])]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, query_id string").where("vec_id IS NULL OR vec_id <> 800")
    ok = [(i, np.floor(np.array(v, "f4").astype(float) * 1024).astype(int)) for i, v in rows if i not in (None, 600, 601, 602, 603, 800)]
    want = []
    for q, x in ok:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert ordered(top_k(df, df.where("vec_id % 100 = 0")).collect()) == ordered(want)
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_sends_no_blocks_to_the_driver(spark):
    """Blocks of queries are copied for every line of the grid, so they are not broadcast however small they look."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    plan = top_k(df, df.where("vec_id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_language(spark, docs, none):
    langs = {"aa": "ka ko ki ku".split(), "bb": "zor zer zir zur".split()}
    rows = [(i, " ".join(rng.choice(langs[x]) for _ in range(30)), x) for i in range(80) for x in ("aa", "bb")]
    odd = [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, "ka ko", None), (903, "ka " * 200_000, None), (904, "qqqq wwww", None)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows + odd], "doc_id long, text string, lang string, score string, outlier int")
    model = langid.fit(df, fold(3) != 1)
    got = {(r.doc_id, r.lang_pred, r.outlier) for r in langid.predict(df, model).collect()}
    plain = {(r.doc_id, r.lang_pred) for r in langid.predict(df, model, reject=False).collect()}
    assert {(i, x) for i, _, x in rows} <= plain and (903, "aa") in plain and sum(o for *_, o in got) < 40
    assert {(900, "und", False), (901, "und", False), (902, "und", False), (904, "und", True)} <= got
    assert {r.lang_pred for r in langid.predict(df, model, reject=False).where("doc_id = 904").collect()} <= {"aa", "bb"}
    assert langid.predict(none, model).count() == 0
    nothing = langid.fit(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_quality(spark, docs, none):
    good, bad = [prose(60) for _ in range(60)], [(rng.choice(VOCABULARY) + " ") * 60 for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit(df, labels, fold(5) != 0)
    got = {r.doc_id: r.score for r in quality.score(df, weights).collect()}
    assert min(got[i] for i in range(60)) > max(got[i] for i in range(60, 120))
    odd = quality.score(docs, weights, keep=docs.columns)
    assert odd.count() == len(ROWS) and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(none, weights).count() == 0
    untaught = quality.fit(df, labels.limit(0), fold(5) != 0)
    assert {r.score for r in quality.score(df, untaught).collect()} == {0.5}


def test_archives(spark):
    page = "<p>" + "é" * 60 + "</p>"
    long = "".join(chr(97 + i % 26) + "\r\n\r\nWARC/1.1\r\n" for i in range(20_000))
    rows = [(3, "http://a/", page), (1, "http://b/ c", page), (2, None, page), (4, "u", long), (5, "u", long), (6, "u", None), (7, "u", ""), (8, "u", "short"), (9, "u", "short")]
    rows += [(None, "u", page), (-5, "u\r\nX: y", "z" * 100), (4, "u", long), (11, "u", "y" * 99), (12, "u", "y" * 99)]
    df = spark.createDataFrame([(*r, "d", "s") for r in rows], "page_id long, url string, html string, digest string, segment string")
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(i, first.get(body, i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = body in first and (i is None or i > first[body])
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None, True))
    assert ordered(archived_pages(df).collect()) == ordered(want)
    assert archived_pages(df.limit(0)).count() == 0


def test_repeated_pages_are_reassembled_on_their_own(spark, tmp_path):
    long = "".join(chr(97 + i % 26) + "\r\n" for i in range(60_000))
    df = spark.createDataFrame([(4, "u", long)] * 3, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "written"))
    records = [r for f in sorted((tmp_path / "written").glob("*.gz")) for r in warc.parse_records(gzip.open(f))]
    lost = next(i for i, (f, _) in enumerate(records) if f.get("warc-segment-number") == "2")
    (tmp_path / "cut").mkdir()
    with open(tmp_path / "cut" / "a.warc", "wb") as out:
        for i, (fields, block) in enumerate(records):
            if i != lost:
                head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
                out.write(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n")
    got = [(r.page_id, r.payload_bytes, r.complete) for r in warc.read_archives(spark, str(tmp_path / "cut")).collect()]
    assert sorted(got, key=repr) == sorted([(4, len(long), True)] * 2 + [(4, None, False)], key=repr)


def test_pipeline_stages_take_effect(spark, tmp_path):
    junk = [(rng.choice(VOCABULARY) + " ") * 80 for _ in range(40)]
    clean = [prose(80) for _ in range(40)]
    near = prose(100)
    shared, item = prose(60), prose(50)
    texts = junk + clean + [near, near, edited(near, [50]), prose(70) + " " + shared, prose(70) + " " + shared, prose(60) + " " + item, "", None]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r.doc_id for r in docs.collect()})
    everything = set(range(len(texts)))
    assert kept[0] == everything - set(range(40))
    assert kept[1] == kept[0] - {81, 82} == kept[2]
    assert kept[3] == kept[2] - {85} == kept[4]
    third = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert all(shared not in third[i].text and third[i].n_chars == len(third[i].text) for i in (83, 84))
    assert all(third[i].text == texts[i] for i in [*range(40, 81), 85])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == kept[4]
