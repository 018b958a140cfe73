"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

Both encode the text with a blank in front, so their tokens tile the same bytes. All tokens of both, sorted by their
start, are coalesced as intervals: with the running maximum of the ends, a new group begins where a start reaches it.
Inside a group each A token meets the run of B tokens that its bytes overlap; these are the links.

Texts are cut at single blanks between other characters, which no token of either vocabulary spans (this is read from
the vocabulary files; other files are encoded whole), and each distinct chunk is encoded and aligned once while it is
remembered. How often a pair of ids is linked is a question about the whole corpus: documents are held in blocks
of a bounded number of links, each with a dictionary of its distinct pairs, and only dictionaries are shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, text_slices
from .tokens import tokenizer_path

#: distinct links of a block of documents (its last document may exceed it)
BLOCK_LINKS = 4_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: white space but blanks and line feeds, and the character that stands for a blank in pieces
_RARE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
_SPACE = "\u2581"
_SEGMENT = 1 << 20
_CHUNKS_A_CALL = 2_000


#: numbers of A tokens, B tokens and groups; distinct links, ascending; how often each occurs; digest of the groups
Alignment = tuple[np.ndarray, np.ndarray, np.ndarray, str]
NOTHING: Alignment = np.zeros(3, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), ""


class ByteLevel:
    """A tokenizers file with byte-level entries."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # printable bytes stand for themselves, the others for the characters from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        size = self.tokenizer.get_vocab_size()
        self.entries = [b""] * size
        for entry, i in self.tokenizer.get_vocab().items():
            self.entries[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuttable = before.get("type") == "ByteLevel" and before.get("use_regex") is True and not spec.get("normalizer")

    def encode(self, text: str) -> list[int]:
        """Ids of the text with a blank in front."""
        return self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentencepiece model that puts a blank in front by itself and knows all bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.entries = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)
        ]
        self.cuttable = not any(_SPACE in p.lstrip(_SPACE) for p in names)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of A tokens and of B tokens that are over at the end of each group, for tokens that tile the same bytes."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([a_ends[:1] * 0, a_ends[:-1], b_ends[:1] * 0, b_ends[:-1]])
    of_a = np.arange(len(ends)) < len(a_ends)
    order = np.lexsort([~of_a, starts])
    reach = np.maximum.accumulate(ends[order])
    begins = np.flatnonzero(np.concatenate([[True], starts[order][1:] >= reach[:-1]]))
    a_so_far = np.cumsum(of_a[order])
    last = np.append(begins[1:], len(order)) - 1
    return a_so_far[last], last + 1 - a_so_far[last]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray, a_over: np.ndarray, b_over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all pairs of tokens that share a byte, in the order of A.

    A group with one token on either side is met by all tokens of the other side; in the other groups an A token meets the
    run of B tokens from the one that ends after its start to the one that starts before its end.
    """
    a_first, b_first = np.concatenate([[0], a_over[:-1]]), np.concatenate([[0], b_over[:-1]])
    group = np.repeat(np.arange(len(a_over)), a_over - a_first)
    low, high = b_first[group], b_over[group]
    inner = np.flatnonzero((a_over - a_first > 1)[group] & (b_over - b_first > 1)[group])
    if len(inner):
        begin = np.concatenate([[0], a_ends[:-1]])
        low[inner] = np.searchsorted(b_ends, begin[inner], side="right")
        high[inner] = np.searchsorted(b_ends, a_ends[inner], side="left") + 1
    n = high - low
    at_a = np.repeat(np.arange(len(a_ends)), n)
    return at_a, np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Aligner:
    """Aligns texts chunk by chunk; chunks are remembered up to a bound in bytes.

    Of a chunk are kept: numbers of A tokens, B tokens and groups (None if its bytes are not given back), its links (A id
    * 2**32 + B id, one after another) and its groups as text.
    """

    def __init__(self, a: str, b: str, limit: int = 128 << 20):
        self.a, self.b = ByteLevel(tokenizer_path(a)), Pieces(tokenizer_path(b))
        self.cuttable = self.a.cuttable and self.b.cuttable
        self.sizes = [np.array([len(e) for e in t.entries], np.int64) for t in (self.a, self.b)]
        self.shown = [list(map(str, range(len(t.entries)))) for t in (self.a, self.b)]
        self.digits = [np.array([len(x) for x in shown], np.int64) for shown in self.shown]
        self.limit, self.held = limit, 0
        self.counts: dict[str, bytes | None] = {}
        self.links: dict[str, bytes] = {}
        self.groups: dict[str, str] = {}

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, if the bytes of both are those of the text with a blank in front."""
        ids = self.a.encode(text), self.b.encode(text)
        want = (" " + text).encode()
        if any(b"".join(map(t.entries.__getitem__, x)) != want for t, x in zip((self.a, self.b), ids, strict=True)):
            return None
        return np.array(ids[0], np.int64), np.array(ids[1], np.int64)

    def _shown(self, ids: tuple[np.ndarray, np.ndarray], over: tuple[np.ndarray, np.ndarray]) -> tuple[str, np.ndarray]:
        """All groups as text, each with ``;`` behind it, and where each one ends."""
        texts, widths, place, marks = [], [], [], []
        for side in (0, 1):
            n = np.diff(over[side], prepend=0)
            last = np.zeros(len(ids[side]), bool)
            last[over[side] - 1] = True
            place.append(2 * np.repeat(np.arange(len(n)), n) + side)
            marks.append(np.where(last, "|;"[side], ","))
            widths.append(self.digits[side][ids[side]] + 1)
            texts += map(self.shown[side].__getitem__, ids[side].tolist())
        order = np.argsort(np.concatenate(place), kind="stable")
        in_order = map(texts.__getitem__, order.tolist())
        text = "".join(itertools.chain.from_iterable(zip(in_order, np.concatenate(marks)[order].tolist(), strict=True)))
        ends = np.cumsum(np.concatenate(widths)[order])
        return text, ends[over[0] + over[1] - 1]

    def _align(self, chunks: list[str], text: str) -> None:
        """Encode and align chunks that stand side by side in ``text`` with one blank between; they hold no other blank."""
        ids = self.tokens(text)
        if ids is None:
            if len(chunks) == 1:
                self.counts[text] = None  # not given back
                self.held += 4 * len(text) + 200
            for chunk in chunks if len(chunks) > 1 else ():
                self._align([chunk], chunk)
            return
        a_ends, b_ends = (np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True))
        over = coalesced(a_ends, b_ends)
        at_a, at_b = overlaps(a_ends, b_ends, *over)
        links = ((ids[0][at_a] << 32) + ids[1][at_b]).astype("<i8").tobytes()
        shown, shown_ends = self._shown(ids, over)
        raw = np.frombuffer(text.encode() + b" ", np.uint8)
        ends = np.flatnonzero(raw == 0x20) + 1 if len(chunks) > 1 else np.array([len(raw)])
        cut = np.stack([np.searchsorted(e, ends) + 1 for e in (a_ends, b_ends, a_ends[over[0] - 1])], axis=1)
        counts = np.diff(cut, axis=0, prepend=0).astype("<i4").tobytes()
        link_cut = [0, *(np.searchsorted(at_a, cut[:, 0]) * 8).tolist()]
        text_cut = [0, *shown_ends[cut[:, 2] - 1].tolist()]
        for i, chunk in enumerate(chunks):
            self.counts[chunk] = counts[12 * i : 12 * i + 12]
            self.links[chunk] = links[link_cut[i] : link_cut[i + 1]]
            self.groups[chunk] = shown[text_cut[i] : text_cut[i + 1] - 1]
        self.held += 400 * len(chunks) + 4 * len(text) + len(links) + len(shown)

    def _chunks(self, text: str) -> tuple[list[str], bool]:
        """Chunks of a text, and whether they may stand beside any others of that kind."""
        if not self.cuttable:
            return [text], False
        edges = text[0] in " \n" or text[-1] in " \n"
        if edges or "  " in text or " \n" in text or "\n " in text or _RARE.search(text):
            return _CUT.split(text), False
        return text.split(" "), True

    def _segments(self, text: str) -> Iterator[str]:
        """The text in parts of about a megabyte, cut like its chunks."""
        start = 0
        while self.cuttable and len(text) - start > _SEGMENT and (cut := _CUT.search(text, start + _SEGMENT)):
            yield text[start : cut.start()]
            start = cut.end()
        yield text[start:]

    def _known(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text, all of them known."""
        cut = [self._chunks(t) for t in texts]
        if self.held > self.limit:  # keep what these texts need, frequent chunks among it
            used = {c for chunks, _ in cut for c in chunks}.intersection(self.counts)
            self.counts = {c: self.counts[c] for c in used}
            self.links = {c: self.links[c] for c in used if c in self.links}
            self.groups = {c: self.groups[c] for c in used if c in self.groups}
            self.held = 400 * len(used) + sum(4 * len(c) + len(self.links.get(c, "")) + len(self.groups.get(c, "")) for c in used)
        plain = list({c for chunks, easy in cut if easy for c in chunks}.difference(self.counts))
        for at in range(0, len(plain), _CHUNKS_A_CALL):
            part = plain[at : at + _CHUNKS_A_CALL]
            self._align(part, " ".join(part))
        for chunk in {c for chunks, easy in cut if not easy for c in chunks}.difference(self.counts):
            self._align([chunk], chunk)
        return [chunks for chunks, _ in cut]

    def _one(self, parts: Iterator[list[str]]) -> Alignment:
        n, found, digest = np.zeros(3, np.int64), [], hashlib.sha256()
        for chunks in parts:
            counts = list(map(self.counts.__getitem__, chunks))
            if None in counts:
                return NOTHING
            n += np.frombuffer(b"".join(counts), "<i4").reshape(-1, 3).sum(axis=0)
            links = np.frombuffer(b"".join(map(self.links.__getitem__, chunks)), "<i8")
            digest.update((";" if found else "").encode() + ";".join(map(self.groups.__getitem__, chunks)).encode())
            found.append(np.unique(links, return_counts=True))
        links, times = found[0]
        if len(found) > 1:
            links, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            times = np.bincount(at, np.concatenate([t for _, t in found])).astype(np.int64)
        return n, links, times, digest.hexdigest()

    def __call__(self, texts: list[str | None]) -> list[Alignment]:
        """The alignment of each whole text; long ones are taken a segment at a time."""
        out = [NOTHING] * len(texts)
        short = [i for i, t in enumerate(texts) if t and len(t) <= _SEGMENT]
        for i, chunks in zip(short, self._known([texts[i] for i in short]), strict=True):
            out[i] = self._one(iter([chunks]))
        for i, text in enumerate(texts):
            if text and len(text) > _SEGMENT:
                out[i] = self._one(self._known([part])[0] for part in self._segments(text))
        return out


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of bytes, which are mostly zeros above the lowest."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_BLOCK = (
    "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, distinct_links array<long>, places binary, counts binary, pairs binary, documents binary"
)


@dataclass
class _Block:
    """Documents and their distinct links until they are written as one row."""

    rows: list[tuple] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, doc_id: int | None, n: np.ndarray, links: np.ndarray, counts: np.ndarray, digest: str) -> None:
        self.rows.append((doc_id, *n.tolist(), int(counts.sum()), digest))
        self.links.append(links)
        self.counts.append(counts)
        self.held += len(links)

    def written(self) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in self.links])
        pairs, at, documents = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        steps = np.diff(at, prepend=0)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[first] = at[first]  # ascending within a document
        kinds = [pa.int64()] * 5 + [pa.string()]
        columns = [pa.array([list(c)], pa.list_(k)) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)]
        blobs = [packed(steps), packed(np.concatenate(self.counts)), pairs.astype("<i8").tobytes(), documents.astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().hex]),
                *columns,
                pa.array([sizes.tolist()], pa.list_(pa.int64())),
                *(pa.array([b], pa.binary()) for b in blobs),
            ],
            names=["block", *_DOCUMENT, "distinct_links", "places", "counts", "pairs", "documents"],
        )


def _blocks(documents: DataFrame, a: str, b: str, block_links: int) -> DataFrame:
    """Aligned documents in blocks, made where the texts lie."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(a, b), _Block()
        for part, texts in text_slices(batches, limit=_SEGMENT):
            for doc_id, found in zip(part["doc_id"].to_pylist(), aligner(texts), strict=True):
                block.add(doc_id, *found)
                if block.held >= block_links:
                    yield block.written()
                    block = _Block()
        if block.rows:
            yield block.written()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, _BLOCK)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """block, pair, documents: how many documents of the block hold the pair linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, pairs, documents in zip(*(batch[c].to_pylist() for c in ("block", "pairs", "documents")), strict=True):
                n = len(pairs) // 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.frombuffer(pairs, "<i8")), pa.array(np.frombuffer(documents, "<i8"))],
                    names=["block", "pair", "documents"],
                )

    return blocks.select("block", "pairs", "documents").mapInArrow(rows, "block string, pair long, documents long")


def _scored(block: dict, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_best and count_sum of every document of a block, from what is known of its pairs."""
    pairs = np.frombuffer(block["pairs"], "<i8")
    at = np.searchsorted(pairs, pair)
    of_pair, is_best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    of_pair[at], is_best[at] = count, best
    sizes = np.array(block["distinct_links"], np.int64)
    total = int(sizes.sum())
    times, steps = unpacked(block["counts"], total), unpacked(block["places"], total)
    ends = np.cumsum(sizes)
    first = ends - sizes
    sums = np.concatenate([[0], np.cumsum(steps)])
    places = sums[1:] - np.repeat(sums[first], sizes)

    def per_document(values: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(values)])
        return so_far[ends] - so_far[first]

    return per_document(times * is_best[places]), per_document(times * of_pair[places])


def alignments(
    documents: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_links: int = BLOCK_LINKS
) -> DataFrame:
    """Alignment of every whole text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Byte offsets where tokens of A and of B both end cut them into groups; a link is a pair of tokens, one of each, whose
    bytes overlap. The count of a pair of ids is the number of documents that hold it linked, in the whole table. n_best
    counts the links whose count is the highest of their A id (ties included), count_sum adds the counts of all links.
    groups_sha256 is the digest of the groups as ``a1,a2|b1;a3|b2,b3``.

    One pass encodes and aligns; what it stores are blocks of documents with a dictionary of their distinct pairs. The
    dictionaries alone are added up by pair, ranked by A id, and sent back to their blocks; a pair has one row per
    block, however many documents hold it.

    Texts that are null, empty or not given back byte by byte by both (such as those with U+2581) have no tokens: zeros
    and ''. Special strings inside texts are plain text. Every row is a document, so repeated rows count each; a null
    doc_id stays null. An empty table gives an empty result; other columns are ignored.
    """
    blocks = stored(_blocks(documents, a, b, block_links), "alignment-blocks")
    rows = _pair_rows(blocks)
    counts = stored(rows.groupBy("pair").agg(F.sum("documents").alias("count")), "pair-counts")
    a_id = F.shiftright("pair", 32)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest"))
    known = (
        counts.withColumn("a", a_id)
        .join(highest, "a")
        .select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    )
    wanted = rows.select("block", "pair").join(known, "pair").select("block", "pair", "count", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        known_pairs = [right[c].to_numpy() for c in ("pair", "count", "best")]
        for block in left.to_pylist():
            n_best, count_sum = _scored(block, *known_pairs)
            arrays = [pa.array(block[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in _DOCUMENT]
            out.append(pa.Table.from_arrays([*arrays, pa.array(n_best), pa.array(count_sum)], names=[*_DOCUMENT, "n_best", "count_sum"]))
        return pa.concat_tables(out)

    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    columns = ["block", *_DOCUMENT, "distinct_links", "places", "counts", "pairs"]
    scored = blocks.select(*columns).groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(score, schema)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_groups(documents: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and groups of every text: an array of (start, end, a, b), with byte offsets in the text behind a blank.

    Texts without tokens (see ``alignments``) have an empty array. A text is held as a whole.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for part, texts in text_slices(batches, limit=_SEGMENT):
            rows = []
            for ids in (aligner.tokens(t) if t else None for t in texts):
                if ids is None:
                    rows.append([])
                    continue
                a_ends, b_ends = (np.cumsum(size[x]) for size, x in zip(aligner.sizes, ids, strict=True))
                a_over, b_over = coalesced(a_ends, b_ends)
                of_a, of_b = (np.split(x, over[:-1]) for x, over in zip(ids, (a_over, b_over), strict=True))
                ends = a_ends[a_over - 1].tolist()
                rows.append(
                    [
                        {"start": s, "end": e, "a": x.tolist(), "b": y.tolist()}
                        for s, e, x, y in zip([0, *ends[:-1]], ends, of_a, of_b, strict=True)
                    ]
                )
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(rows, pa.list_(kind))], names=["doc_id", "groups"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        align, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>"
    )
