"""Repetition rules, token alignment and vector codes against plain Python, with nulls, ties, repeats and odd texts."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import alignment, repetition
from tidegrid.llm.alignment import Aligner, aligned_groups, alignments
from tidegrid.llm.codes import codebooks_digest, vector_codes
from tidegrid.llm.common import hashed_words
from tidegrid.llm.repetition import MOST_REPEATED_RUNS, MOST_TOP_RUN, measures, repetition_rules
from tidegrid.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(8)


def words(n: int, of: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(of) for _ in range(rng.randint(1, 6))) for _ in range(n))


TEXTS = [
    None, "", " \n\t ", words(40), words(400), "spam ham eggs " * 40, words(60) + "\n" + "the same line stands here\n" * 30,
    "a b " * 300, "\n".join([words(30)] * 2 + [words(200)]), "é ü 中文 " * 20 + words(80), "# $ % & | < > *" + words(70),
    "one\x0bline\x1c stays\x85here " + words(60), words(30_000), "x" * 3000 + " y", "word", "a\r\nb\r\nb\r\n" + words(50),
]
EXTRA = "doc_id long, text string, n_words int, block string, pair long, kept int, label string"


def frame(spark, texts):
    rows = [(None if i == 3 else i // 2, t, 1, "b", 2, 3, "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


def plain_measures(text: str | None) -> dict[str, int]:
    text = text or ""
    own = WORD.findall(text)
    size = [len(w) for w in own]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {
        "n_words": len(own), "word_chars": sum(size), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(again), "dup_line_chars": sum(len(w) for x in again for w in WORD.findall(x)),
    }
    for n in {3, *MOST_TOP_RUN, *MOST_REPEATED_RUNS}:
        places = collections.defaultdict(list)
        for i in range(len(own) - n + 1):
            places[tuple(own[i : i + n])].append(i)
        covered = [{i + k for i in at for k in range(n)} for at in places.values() if len(at) > 1]
        every = set().union(*covered)
        if n == 3:
            out["n_repeat_words"] = len(every)
        if n in MOST_TOP_RUN:
            out[f"top_chars_{n}"] = max((sum(size[i] for i in c) for c in covered), default=0)
        if n in MOST_REPEATED_RUNS:
            out[f"repeat_chars_{n}"] = sum(size[i] for i in every)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab é#\n\t\x1c", max_size=120), max_size=5))
def test_repetition_is_measured_like_word_by_word(texts):
    got = measures(texts)
    want = [plain_measures(t) for t in texts]
    assert {c: v.tolist() for c, v in got.items()} == {c: [w[c] for w in want] for c in got}


def test_long_inputs_are_sorted_by_ranges(monkeypatch):
    texts = [words(500, "ab"), words(300, "ab"), None]
    want = {c: v.tolist() for c, v in measures(texts).items()}
    monkeypatch.setattr(repetition, "_SORTED_AT_ONCE", 50)
    assert {c: v.tolist() for c, v in measures(texts).items()} == want


def test_long_texts_are_hashed_by_pieces():
    unit = "ab é\n" * 50_000 + "z" * 2_100_000 + " end "
    long = unit * 2
    (found, chars) = hashed_words([long], chars=True)[0]
    own = WORD.findall(long)
    assert chars.tolist() == [len(w) for w in own]
    (short,) = hashed_words(["ab é end"])
    assert found[:2].tolist() == short[:2].tolist() and found[-1] == short[2]
    assert (found == np.concatenate(hashed_words([unit, unit]))).all()


def test_repetition_rules(spark):
    rows = repetition_rules(frame(spark, TEXTS)).collect()
    want = collections.Counter()
    for i, t in enumerate(TEXTS):
        m = plain_measures(t)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        want[(None if i == 3 else i // 2, tuple(sorted(m.items())), failed)] += 1
    counts = sorted(plain_measures(""))
    got = collections.Counter((r.doc_id, tuple((c, r[c]) for c in counts), r.base_failed) for r in rows)
    assert got == want
    assert not any(r.kept for r in rows if r.base_failed)
    kept = {r.n_words for r in rows if r.kept}
    assert 400 in kept and 30_000 in kept
    rejected = [r for r in rows if not r.kept and not r.base_failed]
    assert {r.n_words for r in rejected} >= {260}  # half its lines and characters stand in two equal lines
    assert repetition_rules(frame(spark, TEXTS).limit(0)).count() == 0


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    return a, b, Aligner("byte_bpe_50k.json", "piece_bpe_32k.model").a.entries


def plain_alignment(libraries, text):
    """(a ids, b ids, groups, links) of a whole text by its definition; None without tokens."""
    a, b, entries = libraries
    if not text:
        return None
    raw = (" " + text).encode()
    enc = a.encode(" " + text, add_special_tokens=False)
    a_ids, b_ids, b_bytes = enc.ids, b.encode(text), []
    for i in b_ids:
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(b_bytes) != raw:
        return None
    a_bytes = [entries[i] for i in a_ids]
    assert b"".join(a_bytes) == raw
    a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    both = sorted(set(a_end) & set(b_end))
    groups, start = [], 0
    for end in both:
        groups.append(
            ([i for i, e in zip(a_ids, a_end, strict=True) if start < e <= end], [i for i, e in zip(b_ids, b_end, strict=True) if start < e <= end])
        )
        start = end
    at_byte = np.repeat(np.arange(len(b_ids)), [len(x) for x in b_bytes])
    links = [(a_ids[i], b_ids[j]) for i, (s, e) in enumerate(zip([0, *a_end], a_end)) for j in sorted(set(at_byte[s:e].tolist()))]
    return a_ids, b_ids, groups, links


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


PARTS = [
    "a", "The", " the", "é", "é", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "don't", "123", "!?", "...", "<|endoftext|>", "<s>", "</s>",
    "<0x41>", "▁", "中文", "\U0001f600", "\x00", "\r\n", "World", "x" * 30, "ﬁ", "　", "naïve", "<unk>",
]


@pytest.fixture(scope="module")
def aligner():
    return Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", limit=20_000)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=4))
def test_chunks_align_like_whole_texts(libraries, aligner, texts):
    for text, (n, links, times, digest) in zip(texts, aligner([*texts]), strict=True):
        want = plain_alignment(libraries, text)
        if want is None:
            assert n.tolist() == [0, 0, 0] and not len(links) and digest == ""
            continue
        a, b, groups, pairs = want
        assert n.tolist() == [len(a), len(b), len(groups)]
        assert dict(zip(links.tolist(), times.tolist(), strict=True)) == collections.Counter((x << 32) + y for x, y in pairs)
        assert digest == hashlib.sha256(shown(groups).encode()).hexdigest()


def test_long_texts_align_by_segments(libraries, monkeypatch):
    text = " ".join(rng.choice(PARTS[:4] + PARTS[11:16] + ["word\nline", "a  b"]) for _ in range(3000))
    whole = Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")([text])[0]
    monkeypatch.setattr(alignment, "_SEGMENT", 500)
    parts = Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", limit=5_000)([text, "a b", text])
    for part in (parts[0], parts[2]):
        assert all(np.array_equal(x, y) for x, y in zip(whole, part, strict=True))
    assert len(libraries[1].encode(text)) == whole[0][1]


@pytest.mark.parametrize("block_links", [1, 500, 10_000_000])
def test_alignments(spark, libraries, block_links):
    texts = [t if t is None or len(t) < 5000 else t[:4000] for t in TEXTS] + ["has ▁ in it", "<|endoftext|> \x00"]
    found = [plain_alignment(libraries, t) for t in texts]
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    best = collections.defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    want = collections.Counter()
    for i, f in enumerate(found):
        doc_id = None if i == 3 else i // 2
        if f is None:
            want[(doc_id, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        a, b, groups, links = f
        digest = hashlib.sha256(shown(groups).encode()).hexdigest()
        n_best = sum(count[p] == best[p[0]] for p in links)
        want[(doc_id, len(a), len(b), len(groups), len(links), n_best, sum(count[p] for p in links), digest)] += 1
    got = alignments(frame(spark, texts), block_links=block_links).collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_alignments_without_rows_or_tokens(spark):
    assert alignments(frame(spark, TEXTS).limit(0)).count() == 0
    rows = alignments(frame(spark, [None, ""])).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_groups_have_spans(spark, libraries):
    texts = [None, "", "The naïve wörld", "▁"]
    got = sorted((r.doc_id, len(r.groups), r) for r in aligned_groups(frame(spark, texts)).collect() if r.groups)
    (_, _, row) = got[0]
    want = plain_alignment(libraries, texts[2])[2]
    assert len(got) == 1 and [(g.a, g.b) for g in row.groups] == want
    assert row.groups[0].start == 0 and row.groups[-1].end == len((" " + texts[2]).encode())
    assert all(x.end == y.start for x, y in zip(row.groups, row.groups[1:]))


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """By the definition, in whole numbers: ({(id, code, error, label error): count}, digest of the codebooks)."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max([1, *(len(v) for _, v, _ in kept)])
    dim = -(-dim // parts) * parts
    width = dim // parts
    top = 1 << 96
    whole = [[max(-top, min(top, math.floor(Fraction(float(np.float32(x))) * scale))) for x in v] + [0] * (dim - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [float(np.float32(x)) for x in kept[i][1]]))
    books = [[whole[i][p * width : (p + 1) * width] for i in order[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[p * width : (p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds if kept else 0):
        of = [[nearest(p, v)[1] for v in whole] for p in range(parts)]
        new = []
        for p in range(parts):
            book = []
            for k, e in enumerate(books[p]):
                own = [v[p * width : (p + 1) * width] for v, o in zip(whole, of[p], strict=True) if o == k]
                book.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else e)
            new.append(book)
        books = new
    last = [[nearest(p, v) for p in range(parts)] for v in whole]
    errors = [sum(d for d, _ in x) for x in last]
    by_label = collections.Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    out = collections.Counter()
    for (i, _, lab), x, e in zip(kept, last, errors, strict=True):
        narrow = [v if v < 1 << 63 else None for v in (e, by_label[lab])]
        out[(i, "".join(f"{k:02x}" for _, k in x), *narrow)] += 1
    return out, codebooks_digest(books)


def vectors(n, dim, spread=1.0):
    g = np.random.default_rng(n + dim)
    return [[float(np.float32(x)) for x in row] for row in g.normal(0, spread, (n, dim))]


EMBEDDINGS = "vec_id long, embedding array<float>, label int, code string, n int, sums string"


@pytest.mark.parametrize("dim, spread, block", [(16, 0.2, 8192), (8, 0.001, 7), (13, 0.3, 50), (16, 3e4, 8192), (0, 1, 9), (8, 1e30, 30)])
def test_vector_codes(spark, dim, spread, block):
    rows = [(i % 110, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors(130, dim, spread))]
    rows += [(500, None, 1), (501, [None] * dim if dim else None, 1), (502, [float("nan")] * (dim or 1), 2), (3, rows[3][1], 0)]
    rows += [(503, [float("inf")] + [0.0] * dim, 2), (None, rows[4][1], 1), (504, rows[5][1][: dim // 2], 2)]
    table = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], EMBEDDINGS).repartition(4)
    want, digest = plain_codes(rows)
    got = vector_codes(table, block_vectors=block).collect()
    assert {r.codebooks_sha256 for r in got} == {digest}
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want


@pytest.mark.parametrize("n", [0, 1, 5])
def test_vector_codes_of_few_rows(spark, n):
    rows = [(9 - i, v, None) for i, v in enumerate(vectors(n, 16))]
    table = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], EMBEDDINGS)
    got = vector_codes(table).collect()
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == plain_codes(rows)[0]
    assert all(r.error == 0 for r in got)
