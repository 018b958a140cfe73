"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources.storage import working_folder

SLICE_BYTES = 1 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's tables, in the folder that all executors share."""
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and tells the planner the real size.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Give the space of tables made by ``stored`` back; nothing may be read from them any more.

    Overwriting with no rows needs nothing but Spark's own writers, so it works wherever the shared folder is.
    """
    for table in tables:
        files = table.inputFiles()
        if files:
            nothing = table.sparkSession.createDataFrame([], table.schema)
            nothing.write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


#: bits of the set by which rows are told apart
_SET_BITS = 24


def told_apart(rows: DataFrame, keys: list[str], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys may be among those of ``members``, and the rows whose keys are certainly not.

    For joins that need few of the rows: only the first part has to be shuffled. The keys of the members set bits in an
    array of 2**24 bits, which is sent to all tasks; it is at most 2**18 rows, whatever the number of members, and with
    more members than bits the first part simply holds nearly all rows. No key may be null.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << _SET_BITS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    one = F.expr("shiftleft(1L, __bit)")
    held = members.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(one).alias("__bits"))
    columns = rows.columns
    looked_up = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(held), "__word", "left")
    maybe = F.expr("coalesce(shiftrightunsigned(__bits, __bit) & 1L, 0L) = 1L")
    return looked_up.where(maybe).select(*columns), looked_up.where(~maybe).select(*columns)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Arrow batches cut where the texts reach ``limit`` bytes, each with its texts as Python strings.

    When the last one is done, Arrow gives the memory of the task back; the worker lives on for other tasks.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = batch.slice(start, end - start)
            yield part, part[column].to_pylist()
            start = end
    pa.default_memory_pool().release_unused()


class WordHashes:
    """64-bit hashes of words, remembered between batches.

    The table of known words is emptied when it reaches about ``limit`` bytes, so memory stays bounded.
    """

    def __init__(self, limit: int = 32 << 20, seed: int = 0):
        self.limit, self.seed, self.known, self.held = limit, seed, {}, 0

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        if self.held > self.limit:
            self.known, self.held = {}, 0
        known = self.known
        new = set(words).difference(known)
        for w in new:
            known[w] = xxhash.xxh3_64_digest(w.encode(), self.seed)
        self.held += 200 * len(new) + sum(map(len, new))
        return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=">u8").astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


#: bytes of text that are hashed at once
_PIECE = 1 << 18
_WHITE = b" \t\n\v\f\r"


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int = _PIECE + 1) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every word of at most ``_PIECE`` bytes of text.

    A word's polynomial is the difference of two running sums, brought to the word's own start.
    """
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_MULTIPLIER)[: len(data)], dtype=np.uint64, out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * _powers(_INVERSE)[starts]


def _pieces(raw: bytes) -> Iterator[tuple[int, int]]:
    """Where a text is cut: at white space, or inside a word that is longer than a piece."""
    start = 0
    while len(raw) - start > _PIECE:
        end = max(raw.rfind(bytes([w]), start, start + _PIECE) for w in _WHITE) + 1
        end = end if end > start else start + _PIECE
        yield start, end
        start = end
    yield start, len(raw)


def _long_text(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and characters of the words of one long text, piece by piece; a word cut in two is put together."""
    hashes, sizes, chars = [], [], []
    open_word = False
    for start, end in _pieces(raw):
        data = np.frombuffer(raw, np.uint8)[start:end]
        starts, ends, sums = _hashed(data)
        size, own = ends - starts, _chars(data, starts, ends)
        if open_word and len(starts) and not starts[0]:
            power = np.uint64(pow(_MULTIPLIER, int(sizes[-1][-1]), 1 << 64))
            hashes[-1][-1:] += sums[:1] * power
            sizes[-1][-1] += size[0]
            chars[-1][-1] += own[0]
            sums, size, own = sums[1:], size[1:], own[1:]
        if len(sums):
            hashes.append(sums)
            sizes.append(size)
            chars.append(own)
        open_word = raw[end - 1 : end] not in _SINGLE
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return mix64(np.concatenate(hashes) + np.concatenate(sizes).astype(np.uint64)), np.concatenate(chars)


_SINGLE = {bytes([w]) for w in _WHITE}


def _chars(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each word: its bytes without those that continue one."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return before[ends] - before[starts]


def hashed_words(texts: list[str | None], chars: bool = False) -> list:
    """64-bit hashes of the words of each text; a word is what stands between ASCII white space.

    With ``chars`` the number of code points of each word goes with them: (hashes, chars) for each text. Texts are hashed
    from their bytes, a quarter of a megabyte at a time, so a long text needs little more than its hashes.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(group), np.uint8)
        starts, ends, sums = _hashed(data)
        hashes = mix64(sums + (ends - starts).astype(np.uint64))
        limits = np.searchsorted(starts, np.cumsum([len(r) for r in group]))[:-1]
        counts = np.split(_chars(data, starts, ends), limits) if chars else itertools.repeat(None)
        out.extend(zip(np.split(hashes, limits), counts))

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass") + b" "
        if group and held + len(raw) > _PIECE:
            flush()
            group, held = [], 0
        if len(raw) > _PIECE:
            out.append(_long_text(raw))
        else:
            group.append(raw)
            held += len(raw)
    if group:
        flush()
    return out if chars else [h for h, _ in out]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes, from runs of half the length."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size, runs = 1, words
    for bit in bin(n)[3:]:
        power = np.uint64(pow(_MULTIPLIER, size, 1 << 64))
        runs = runs[: len(runs) - size] * power + runs[size:]
        size *= 2
        if bit == "1":
            runs = runs[:-1] * np.uint64(_MULTIPLIER) + words[size:]
            size += 1
    return mix64(runs)
