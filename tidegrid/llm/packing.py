"""Packing of tokenised documents into sequences of bounded length.

Best fit, then a swap-based local search: between bins that are not full, documents move, change places one for one or
two for one, whenever that raises the sum of squared fills, until a bin is empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .tokens import encoder, forget

GROUP_PIECES = 50_000
#: bins that give documents away in a round of the search, the least full first
GIVING_BINS = 12


def token_pieces(
    documents: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, give_back: bool = False
) -> DataFrame:
    """Documents as pieces: doc_id, piece, start, length, ids_crc32.

    The ids of a text (null: empty) are followed by ``end_id``. Only longer documents are cut, every ``capacity`` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part, texts in text_slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((i, k, at // 4, len(own) // 4, zlib.crc32(own)))
            row, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        if give_back:
            forget(tokenizer)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Bins of one group of pieces; ``of[i]`` is the bin of piece i."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.of = np.full(len(lengths), -1, np.int64)
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest piece first, each into the fullest bin that still takes it."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r: some bin has exactly r free places
        lengths = self.lengths.tolist()
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            length = lengths[i]
            fitting = open_rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                b = by_free[room].pop()
                if not by_free[room]:
                    open_rooms ^= 1 << room
            else:
                room, b = self.capacity, len(self.free)
                self.free.append(room)
            left = room - length
            self.of[i], self.free[b] = b, left
            if left:
                by_free[left].append(b)
                open_rooms |= 1 << left

    def _improve(self, a: int, free: np.ndarray) -> bool:
        """One exchange that takes places out of bin ``a``; False when there is none.

        The other bins are at least as full as ``a``, so each exchange raises the sum of squared fills.
        """
        mine = np.flatnonzero(self.of == a)
        room = np.where((free > 0) & (free <= free[a]), free, -1)
        room[a] = -1
        for x in mine[np.argsort(-self.lengths[mine])].tolist():
            fits = np.flatnonzero(room >= self.lengths[x])
            if len(fits):  # move
                self._put(free, [x], a, [], int(fits[np.argmin(free[fits])]))
                return True
        # a piece of size s beside r free places can be changed for what is longer by 1 to r
        most = np.maximum.reduceat(room[self.of[self.by_length]], self.starts)
        some = most > 0
        edges = np.zeros(self.capacity + 2, np.int64)
        edges[self.sizes[some] + 1] += 1
        np.subtract.at(edges, np.minimum(self.sizes[some] + most[some], self.capacity) + 1, 1)
        possible = np.cumsum(edges) > 0

        def change(out: list[int]) -> bool:
            total = int(self.lengths[out].sum())
            k = int(np.flatnonzero((self.sizes < total) & (self.sizes + most >= total))[0])
            same = self.by_length[self.starts[k] :][: self.counts[k]]
            back = int(same[np.argmax(room[self.of[same]] >= total - self.sizes[k])])
            self._put(free, out, a, [back], int(self.of[back]))
            return True

        for x in mine[np.argsort(-self.lengths[mine])].tolist():
            if possible[self.lengths[x]]:  # one for one
                return change([x])
        for i, x in enumerate(mine.tolist()):
            fitting = possible[self.lengths[x] + self.lengths[mine[i + 1 :]]]
            if fitting.any():  # two for one
                return change([x, int(mine[i + 1 + int(np.argmax(fitting))])])
        return False

    def _put(self, free: np.ndarray, out: list[int], a: int, back: list[int], b: int) -> None:
        moved = int(self.lengths[out].sum() - self.lengths[back].sum())
        self.of[out], self.of[back] = b, a
        free[a] += moved
        free[b] -= moved

    def search(self) -> None:
        """Exchanges that raise the sum of squared fills, until no bin can be emptied any more.

        The least full bins give and fuller ones take: the least full of all so that it gets empty, the next ones so
        that their free places come together in one bin. When these are stuck the next ones give, until a whole pass
        over all bins that are not full changes nothing. Each exchange raises an integer, so the search ends; it stops
        early at the number of bins that the total length needs at least.
        """
        free = np.array(self.free, np.int64)
        least = -(-int(self.lengths.sum()) // self.capacity)
        self.by_length = np.argsort(self.lengths, kind="stable")
        self.sizes, self.starts, self.counts = np.unique(
            self.lengths[self.by_length], return_index=True, return_counts=True
        )
        at, changed = 0, False
        while int((free < self.capacity).sum()) > least:
            used = np.flatnonzero((free < self.capacity) & (free > 0))
            givers = used[np.argsort(-free[used], kind="stable")][at : at + GIVING_BINS].tolist()
            if not givers:
                if not changed:
                    break
                at, changed = 0, False
                continue
            gave = False
            for a in givers:
                while 0 < free[a] < self.capacity and self._improve(a, free):
                    gave = True
            changed |= gave
            at += 0 if gave else GIVING_BINS
        self.free = free.tolist()


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and free places of it for every length (1 to capacity)."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    _, of = np.unique(bins.of, return_inverse=True)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(bins.lengths[order])
    before = ends - bins.lengths[order]
    first = np.concatenate([[True], np.diff(of[order]) > 0]) if len(order) else np.empty(0, bool)
    offset = np.empty(len(order), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    free = capacity - np.bincount(of, weights=bins.lengths).astype(np.int64)[of]
    return of, offset, free


def _pack_groups(pieces: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        of, offset, free = pack_lengths(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (round_no << 56) + (int(rows["group"].iloc[0]) << 24) + of
        rows["offset"], rows["sequence_free"] = offset, free
        return rows.drop(columns="group")

    # the row number keeps equal rows (null or repeated doc_id) from meeting in one group
    key = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    return (
        pieces.withColumn("group", key)
        .groupBy("group")
        .applyInPandas(
            pack,
            "doc_id long, piece int, start long, length long, ids_crc32 long, "
            "sequence_id long, offset long, sequence_free long",
        )
    )


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Put pieces (see ``token_pieces``) into sequences; adds sequence_id, offset and sequence_free.

    Pieces are dealt by hash into groups of about ``group_pieces``, each packed by one task: best fit, then the local
    search. Sequences that are still less than 63/64 full are opened again and their pieces packed with those of other
    groups, round by round, until one group is left; each round keeps a small part of the one before. Only lengths and
    digests move, never texts or ids.

    Equal lengths are taken in order of doc_id and piece. An empty table gives an empty result. Columns other than
    those of ``token_pieces`` are left out.
    """
    rest = stored(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    done: list[DataFrame] = []
    round_no, n = 0, rest.count()
    while True:
        groups = max(1, -(-n // group_pieces))
        packed = stored(_pack_groups(rest, groups, round_no, capacity), "packed")
        if groups == 1:
            done.append(packed)
            break
        loose = F.col("sequence_free") * 64 > capacity
        done.append(packed.where(~loose))
        rest = packed.where(loose).select(*rest.columns)
        before, n, round_no = n, rest.count(), round_no + 1
        if n == before:  # nothing was closed: one more round would change nothing
            done.append(packed.where(loose))
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(
    documents: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, give_back: bool = False
) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` tokens as the search finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequence_free. A null or empty text
    is a piece of one token (the end). Repeated rows are packed each; a null doc_id stays null. An empty table gives
    an empty result. With ``give_back`` a task drops the pieces it remembers, for workers that go on with other work.
    """
    return pack_pieces(token_pieces(documents, tokenizer, capacity, end_id, give_back), capacity)
