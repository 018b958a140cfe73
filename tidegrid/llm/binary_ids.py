"""Token ids as Simple-8b words.

A segment holds the ids of consecutive documents. Its bytes, all little-endian:

    magic "TS8B", block size u32, documents u32, blocks u32, ids u64
    documents: doc_id i64 each, then 1 byte each (1: doc_id is null), then ids of each u64
    blocks: end in words u32 each, end in escapes u32 each, width of the escape 1 byte each
    words u64 each, escapes u32 each

A word has a selector in its upper 4 bits and as many equally wide slots below as the selector says. A block of ids has
a width W: an id of 2**W - 1 or more is stored as 2**W - 1 in its slot, and itself in the list of escapes. Blocks start
at a word of their own, so any block is decoded without the others, and all blocks of a segment at once with array
operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, text_slices
from .tokens import encoder

#: slots of a word and bits of a slot, by selector (0 and 1 are not used)
SLOTS = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: selectors whose width may be the escape of a block (8 to 60 bits)
ESCAPE_SELECTORS = (9, 10, 11, 12, 13, 14, 15)
BLOCK = 512
SEGMENT_IDS = 1 << 20
_MAGIC = b"TS8B"
_HEAD = struct.Struct("<4sIIIQ")


#: number of the narrowest selector whose slot takes an id, the escape of that width set apart
_NARROWEST = np.searchsorted((1 << BITS[2:-1].astype(np.int64)) - 1, np.arange(1 << 16), side="right").astype(np.uint8) + np.uint8(2)


def _fits(ids: np.ndarray) -> np.ndarray:
    if ids.max(initial=0) < len(_NARROWEST):
        return _NARROWEST[ids]
    return (np.searchsorted((1 << BITS[2:-1].astype(np.int64)) - 1, ids.astype(np.int64), side="right") + 2).astype(np.uint8)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, escapes, escapes of each block, width of each block; the last block may be short."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, np.int64), np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.uint8)
    starts = np.arange(0, n, block)
    sizes = np.diff(np.append(starts, n))
    # the escape width that costs least, block by block
    fit = _fits(ids)
    of = np.repeat(np.arange(blocks, dtype=np.int32), sizes)
    by_width = np.bincount(of * np.int32(len(SLOTS)) + fit, minlength=blocks * len(SLOTS)).reshape(blocks, len(SLOTS))
    above = [by_width[:, s + 1 :].sum(axis=1) for s in ESCAPE_SELECTORS]
    cost = [8 * sizes / SLOTS[s] + 4 * a for s, a in zip(ESCAPE_SELECTORS, above, strict=True)]
    widest = np.array(ESCAPE_SELECTORS, np.uint8)[np.argmin(cost, axis=0)]
    width = BITS[widest]
    widest = widest[of]
    escaped = fit > widest
    escapes = ids[escaped].astype("<u4")
    n_escapes = np.bincount(of[escaped], minlength=blocks)
    values = ids.astype(np.uint64)
    values[escaped] = (np.uint64(1) << BITS[widest[escaped]].astype(np.uint64)) - np.uint64(1)
    fit = np.minimum(fit, widest)

    # for every place the selector with the most slots whose next ids all fit; the end of a block may leave slots empty.
    # Blocks stand side by side with narrow ids behind them; the widest id of a window comes from two shorter windows.
    end = np.minimum((of + 1) * block, n).astype(np.int32)
    padded = np.zeros((blocks, block + int(SLOTS.max())), np.uint8)
    padded[:, :block].flat[:n] = fit
    widest, window = padded, 1
    chosen_for = np.full((blocks, block), len(SLOTS) - 1, np.int8)
    for s in range(len(SLOTS) - 2, 1, -1):
        step = int(SLOTS[s]) - window
        widest, window = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:]), int(SLOTS[s])
        fits = widest[:, :block] <= s
        if not fits.any():
            break  # nor does any window of more slots
        chosen_for -= fits.view(np.int8)  # where this one fits, so did all before it
    selector = chosen_for.reshape(-1)[:n]
    # walk all blocks side by side
    at, bound, heads = starts.copy(), starts + sizes, []
    while len(at):
        heads.append(at)
        at = at + SLOTS[selector[at]]
        going = at < bound
        at, bound = at[going], bound[going]
    head = np.sort(np.concatenate(heads)) if heads else np.empty(0, np.int64)
    words = np.zeros(len(head), "<u8")
    chosen = selector[head]
    for s in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == s)
        slot = head[own][:, None] + np.arange(SLOTS[s])
        value = np.where(slot < end[head[own]][:, None], values[np.minimum(slot, n - 1)], np.uint64(0))
        shift = (np.arange(SLOTS[s]) * BITS[s]).astype(np.uint64)
        words[own] = (np.uint64(s) << np.uint64(60)) | np.bitwise_or.reduce(value << shift, axis=1)
    n_words = np.bincount(head // block, minlength=blocks)
    return words, n_words, escapes, n_escapes, width.astype(np.uint8)


def decode_blocks(
    words: np.ndarray, word_ends: np.ndarray, escapes: np.ndarray, width: np.ndarray, n: int, block: int = BLOCK
) -> np.ndarray:
    """Ids of consecutive blocks, all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = SLOTS[selector]
    n_words = np.diff(word_ends, prepend=0)
    of = np.repeat(np.arange(len(n_words)), n_words)
    before = np.cumsum(count) - count
    first = before[word_ends - n_words] if len(n_words) else before
    at = before - first[of] + of * block  # place of a word's first id
    end = np.minimum((of + 1) * block, n)
    values = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        own = np.flatnonzero(selector == s)
        slot = at[own][:, None] + np.arange(SLOTS[s])
        shift = (np.arange(SLOTS[s]) * BITS[s]).astype(np.uint64)
        value = (words[own][:, None] >> shift) & np.uint64((1 << int(BITS[s])) - 1)
        real = slot < end[own][:, None]
        values[slot[real]] = value[real]
    marker = np.repeat((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1), block)[:n]
    ids = values.astype("<u4")
    ids[values == marker] = escapes
    return ids


def encode_segment(doc_ids: list[int | None], ids: list[bytes], block: int = BLOCK) -> bytes:
    """One segment from the packed 32-bit ids of consecutive documents."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    step = block * max(1, SEGMENT_IDS // block)
    parts = [encode_blocks(flat[i : i + step], block) for i in range(0, len(flat), step)]
    words, n_words, escapes, n_escapes, width = (
        (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint8),) * 5
    )
    return b"".join(
        [
            _HEAD.pack(_MAGIC, block, len(doc_ids), len(n_words), len(flat)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(b) // 4 for b in ids], "<u8").tobytes(),
            np.cumsum(n_words).astype("<u4").tobytes(),
            np.cumsum(n_escapes).astype("<u4").tobytes(),
            width.astype("u1").tobytes(),
            words.astype("<u8").tobytes(),
            escapes.astype("<u4").tobytes(),
        ]
    )


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document (count), all ids."""
    magic, block, docs, blocks, n = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, sizes = take("<i8", docs), take("u1", docs), take("<u8", docs)
    word_ends, escape_ends, width = take("<u4", blocks), take("<u4", blocks), take("u1", blocks)
    words = take("<u8", int(word_ends[-1]) if blocks else 0)
    escapes = take("<u4", int(escape_ends[-1]) if blocks else 0)
    ends = word_ends.astype(np.int64)
    out, step = [], max(1, SEGMENT_IDS // block)  # some blocks at a time: bounded memory
    for b in range(0, blocks, step):
        last = min(b + step, blocks)
        w0, e0 = (ends[b - 1], escape_ends[b - 1]) if b else (0, 0)
        out.append(
            decode_blocks(
                words[w0 : ends[last - 1]], ends[b:last] - w0, escapes[e0 : escape_ends[last - 1]], width[b:last],
                min(n, last * block) - b * block, block,
            )
        )
    ids = np.concatenate(out) if out else np.empty(0, "<u4")
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], sizes.astype(np.int64), ids


def write_token_ids(
    documents: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode every text and write the segments, in ascending order of doc_id.

    Texts are range-partitioned by doc_id (equal ones also by content), so each task writes a shard that follows the
    shard before it; ``shard`` and ``segment`` number them. Segments are rows of a Parquet dataset, which gives them
    Spark's commit protocol on any file system. A document is never split; a segment is closed when it has
    ``segment_ids`` ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids_of, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        ids: list[bytes] = []
        held, segment = 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([held], pa.int64()),
                    pa.array([encode_segment(docs, ids)], pa.binary()),
                ],
                names=["shard", "segment", "n_ids", "data"],
            )

        for part, texts in text_slices(batches):
            for doc, own in zip(part["doc_id"].to_pylist(), ids_of(texts), strict=True):
                docs.append(doc)
                ids.append(own + end)
                held += len(own) // 4 + 1
                if held >= segment_ids:
                    yield close()
                    docs, ids, held, segment = [], [], 0, segment + 1
        if docs:
            yield close()

    content = F.xxhash64("text")
    (
        documents.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id", content)
        .sortWithinPartitions("doc_id", content)
        .mapInArrow(encode, "shard int, segment int, n_ids long, data binary")
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_ids(spark, path: str) -> DataFrame:
    """Documents of a written dataset: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, data in zip(*(batch[c].to_pylist() for c in ("shard", "segment", "data")), strict=True):
                docs, sizes, ids = decode_segment(data)
                ends, raw = np.cumsum(sizes), ids.tobytes()
                first = ends - sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(k, shard, np.int32)),
                        pa.array(np.full(k, segment, np.int32)),
                        pa.array(docs, pa.int64()),
                        pa.array(first),
                        pa.array(sizes),
                        pa.array(np.array(crc, np.int64)),
                    ],
                    names=["shard", "segment", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema("shard int, segment int, n_ids long, data binary").parquet(path)
    sizes = segments.select("shard", "segment", "n_ids")
    in_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (  # one row per shard
        sizes.groupBy("shard")
        .agg(F.sum("n_ids").alias("n_ids"))
        .select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    )
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(in_shard), F.lit(0)).alias("in_shard")).join(
        shards, "shard"
    )
    rows = segments.select("shard", "segment", "data").mapInArrow(
        decode, "shard int, segment int, doc_id long, first long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("shard_start") + F.col("in_shard") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_ids(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write the ids of all documents to the shared folder and read the digest of every document back.

    A null or empty text has one id, the end. Null doc_ids come first. Rows with equal doc_id follow each other in
    some order. An empty table gives an empty result. Other columns are ignored.
    """
    path = new_folder(documents.sparkSession, "token-ids")
    write_token_ids(documents, path, tokenizer, end_id)
    return read_token_ids(documents.sparkSession, path)
