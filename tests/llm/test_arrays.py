"""The array parts of the text operators against plain Python."""

from __future__ import annotations

import collections
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import binary_ids, fmindex, packing, probminhash, quality, substring, tokens, vafile, warc
from tidegrid.llm.common import WordHashes, gram_hashes, hashed_words, text_slices


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))


PARTS = [
    "a", "B", "é", "É", "é", "́", " ", "\n", "\t", " ", " ", "'s", "'RE", "1", "23", "!", "...",
    "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "ς", "ß", "ﬁ", "中", "\x01", "\x1c", "don't", "World", "x" * 70, "\U0001f600",
]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=4))
def test_pieces_give_the_librarys_ids(library, texts):
    encode = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"), limit=20)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want and encode([*texts, None]) == [*want, b""]


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.integers(1, 32), st.integers(0, 700)), max_size=6),
    st.sampled_from([1, 7, 64, 512]),
)
def test_segments_come_back(docs, block):
    rng = np.random.default_rng(len(docs))
    ids = [rng.integers(0, 2**bits, n).astype("<u4").tobytes() for _, bits, n in docs]
    found, sizes, flat = binary_ids.decode_segment(binary_ids.encode_segment([d for d, *_ in docs], ids, block))
    assert found == [d for d, *_ in docs] and flat.tobytes() == b"".join(ids) and sizes.tolist() == [n for *_, n in docs]


def test_small_ids_take_few_bits():
    ids = np.full(6000, 3, "<u4")
    ids[::100] = 49_000  # escapes
    assert len(binary_ids.encode_segment([1], [ids.tobytes()])) < 6000


def test_another_format_is_refused():
    with pytest.raises(ValueError):
        binary_ids.decode_segment(b"x" * 64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packing_is_whole_and_tight(lengths):
    sizes = np.array(lengths, np.int64)
    of, offset, free = packing.pack_lengths(sizes, 100)
    for b in set(of.tolist()):
        own = np.flatnonzero(of == b)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist()
        assert sizes[own].sum() <= 100 and set(free[own].tolist()) == {100 - int(sizes[own].sum())}
    bins = packing.Bins(sizes, 100)
    bins.best_fit()
    assert len(set(of.tolist())) <= len(bins.free)


def test_search_empties_bins_that_best_fit_leaves():
    lengths = [38, 25, 22, 15, 45, 8, 18, 29, 3, 22, 59, 16, 59, 3, 18, 20, 39, 11, 24, 26, 8, 66, 19, 7, 31, 3, 5, 61, 38, 25, 3, 34]
    bins = packing.Bins(np.array(lengths), 100)
    bins.best_fit()
    of, *_ = packing.pack_lengths(np.array(lengths), 100)
    assert len(bins.free) == 9 and len(set(of.tolist())) == 8 == sum(lengths) // 100


def test_search_ends_when_no_bin_can_give():
    lengths = np.random.default_rng(1).integers(900, 1701, 2000)
    of, _, free = packing.pack_lengths(lengths, 4096)
    room, bins = dict(zip(of.tolist(), free.tolist(), strict=True)), collections.defaultdict(list)
    for n, b in zip(lengths.tolist(), of.tolist(), strict=True):
        bins[b].append(n)
    assert len(bins) > -(-int(lengths.sum()) // 4096)
    beside = collections.defaultdict(set)  # most free places beside a piece of each length
    taken: list[int] = []
    for b in sorted(bins, key=room.get):
        if not room[b]:
            continue
        own = bins[b]
        totals = {*own, *(x + y for i, x in enumerate(own) for y in own[i + 1 :])}
        assert not any(0 < t - s <= r for t in totals for s in beside for r in beside[s])
        assert max(taken, default=0) < min(own)
        taken.append(room[b])
        for s in own:
            beside[s] = {max({*beside[s], room[b]})}
    assert len(bins) < 654  # where the twelve least full bins are stuck


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 2, 3, 4, 6, 7, 10, 35]), st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=90), st.integers(1, 2)), max_size=6))
def test_index_finds_repeated_runs(window, spans):
    texts, copies = [s for s, _ in spans], np.array([c for _, c in spans], np.int64)
    seen = collections.Counter()
    for s, c in spans:
        for i in range(len(s) - window + 1):
            seen[tuple(s[i : i + window])] += c
    want = [[i for i in range(len(s) - window + 1) if seen[tuple(s[i : i + window])] > 1] for s in texts]
    assert [f.tolist() for f in fmindex.repeated_starts(texts, copies, window)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=200), st.sampled_from([1, 4, 9, 35]))
def test_equal_windows_meet_in_one_shard(text, window):
    (hashes,) = hashed_words([" ".join(text)])
    mini, start, n, several = substring.window_runs(hashes, window)
    assert sum(n.tolist()) == max(0, len(text) - window + 1)
    of, many = {}, {}
    for m, s, k, v in zip(mini.tolist(), start.tolist(), n.tolist(), several.tolist(), strict=True):
        for a in range(s, s + k):
            key = tuple(text[a : a + window])
            assert of.setdefault(key, m) == m
            many.setdefault(key, []).append(((m, s), v))
    for found in many.values():  # two equal windows are in two spans, or their minimiser is known to have two places
        assert len(found) == 1 or len({s for s, _ in found}) > 1 or all(v for _, v in found)


def test_weighted_similarity_and_its_estimate():
    rng = np.random.default_rng(5)
    a = [str(w) for w in rng.integers(0, 50, 400)]
    b = a[:360] + [str(w) for w in rng.integers(0, 50, 40)]
    ga, gb = probminhash.shingles([" ".join(a), " ".join(b)])
    ca, cb = (collections.Counter(g.tolist()) for g in (ga, gb))
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert probminhash.jaccard(probminhash.occurrences(ga), probminhash.occurrences(gb)) == pytest.approx(want)
    s = probminhash.signatures([ga, gb, np.empty(0, np.uint64)], 1024)
    assert abs((s[0] == s[1]).mean() - want) < 0.08 and not s[2].any()


def test_equal_weights_do_not_depend_on_other_rows():
    g = probminhash.shingles(["a b c d e f g", "x", "a b c d e f g h i"])
    together, alone = probminhash.signatures(g), [probminhash.signatures([x])[0] for x in g]
    assert all((together[i] == alone[i]).all() for i in range(3))


def test_repetition_looks_alike():
    h = WordHashes()
    a, b = quality.features("junk " * 30, h), quality.features("other " * 30, h)
    assert len(set(a[0].tolist()) & set(b[0].tolist())) >= 2
    assert not len(quality.features(None, h)[0]) and not len(quality.features(" \n", h)[0])


def test_records_are_cut_and_put_together():
    payload = bytes(range(256)) * 50
    records = list(warc.page_records(7, "http://x/ y", payload, "d" * 64, None, False, segment_bytes=1000))
    read = list(warc.parse_records(io.BytesIO(b"".join(r + b"\r\n\r\n" for r in records))))
    assert len(read) == len(records) > 2
    parts = [
        {"number": int(f["warc-segment-number"]), "total": int(t) if (t := f.get("warc-segment-total-length")) else None, "block": b}
        for f, b in read
    ]
    (row,) = warc.reassembled("<urn:page:7:x>", "response", parts[::-1])
    assert row[0] == 7 and row[1] == len(payload) and row[5]
    (gap,) = warc.reassembled("<urn:page:7:x>", "response", parts[:1] + parts[2:])
    assert gap[1] is None and not gap[5]
    assert len(warc.reassembled("<urn:page:7:x>", "response", parts * 2)) == 2


def test_chunks():
    assert warc.dechunked(warc.chunked(b"")) == b""
    assert warc.dechunked(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_slices_are_balanced_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 5, 100, 1, 0)] + [None, "y"]})
    parts = list(text_slices([batch], limit=10))
    assert [t for _, texts in parts for t in texts] == batch["text"].to_pylist()
    assert [len(t) for _, t in parts] == [2, 1, 4]


def test_cells_bound_every_score():
    rng = np.random.default_rng(3)
    exact = rng.integers(-500, 500, (300, 8))
    low, step = exact.min(axis=0).astype(float), np.maximum(np.ptp(exact, axis=0) / 256, 1e-9)
    row = {
        "n": 300, "dim": 8, "ids": np.arange(300).astype("<i8").tobytes(), "low": low.tobytes(), "step": step.tobytes(), "narrow": True,
        "cells": np.clip((exact - low) / step, 0, 255).astype(np.uint8).tobytes(), "exact": exact.astype("<i4").tobytes(),
    }
    block = vafile.Approximated(row)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * 300
    block.search(block, best, 5)
    scores = exact @ exact.T
    for q in range(300):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[q, i], i))[:5]
        assert best[q][1].tolist() == order and best[q][0].tolist() == scores[q, order].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\x85\xa0é中", max_size=30), max_size=5), st.integers(1, 9))
def test_words_are_hashed_alike_wherever_they_stand(texts, n):
    got = hashed_words(texts)
    words = [substring.words_of(t) for t in texts]
    assert [len(h) for h in got] == [len(w) for w in words]
    seen, back = {}, {}
    for hashes, own in zip(got, words, strict=True):
        for i, run in enumerate(gram_hashes(hashes, n).tolist()):
            key = tuple(own[i : i + n])
            assert seen.setdefault(key, run) == run and back.setdefault(run, key) == key
        assert len(gram_hashes(hashes, n)) == max(0, len(own) - n + 1)
