"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

All distances come from per-dimension dictionaries. A block of vectors is stored once as the distinct integers of each
dimension and, for every vector, the place of its value among them. A round then tabulates the squared difference of
every distinct integer to all entries of its part, and the distance of a part is the sum of the table rows that the
places of its dimensions point at: gathers and adds, no arithmetic on vectors.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import release, stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: vectors of one dictionary; a place takes two bytes
BLOCK_VECTORS = 8_192
#: integers up to this size have squares and sums of squares that 64 bits hold
_NARROW = 1 << 26
#: larger integers are cut to this size, so that their sums stay exact in 38 digits
_LARGEST = 1 << 96
_LONG = 1 << 63

Codebooks = list[list[list[int]]]  # by part, entry, place within the part


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(vectors: list[np.ndarray], dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers, a row per vector; shorter vectors end in zeros.

    Numbers whose squares might not fit 64 bits make an array of Python integers.
    """
    rows = np.zeros((len(vectors), dim))
    for i, x in enumerate(vectors):
        rows[i, : len(x)] = x
    if np.abs(rows).max(initial=0) <= _NARROW / scale:
        return np.floor(rows * scale).astype(np.int64)
    cut = [[max(-_LARGEST, min(_LARGEST, math.floor(Fraction(x) * scale))) for x in row] for row in rows.tolist()]
    return np.array(cut, dtype=object).reshape(rows.shape)


@dataclass(frozen=True)
class Coded:
    """A block of vectors: the ascending distinct integers of each dimension, and each vector's places among them."""

    values: list[np.ndarray]
    places: np.ndarray  # a row per dimension

    @staticmethod
    def of(rows: np.ndarray) -> Coded:
        found = [np.unique(rows[:, d], return_inverse=True) for d in range(rows.shape[1])]
        places = np.array([p.reshape(-1) for _, p in found], "<u2").reshape(rows.shape[::-1])
        return Coded([v for v, _ in found], places)

    def stored(self) -> tuple[bytes, bytes | None, str | None, bytes]:
        """Number of integers of each dimension; the integers as bytes, or as text if one is too large; the places."""
        sizes = np.array([len(v) for v in self.values], "<i4").tobytes()
        every = list(itertools.chain.from_iterable(v.tolist() for v in self.values))
        if any(v.dtype == object for v in self.values):
            return sizes, None, ",".join(map(str, every)), self.places.tobytes()
        return sizes, np.array(every, "<i8").tobytes(), None, self.places.tobytes()

    @staticmethod
    def read(n: int, sizes: bytes, narrow: bytes | None, wide: str | None, places: bytes) -> Coded:
        ends = np.cumsum(np.frombuffer(sizes, "<i4"))
        every = np.array([int(x) for x in wide.split(",")], object) if narrow is None else np.frombuffer(narrow, "<i8")
        return Coded(np.split(every, ends[:-1]) if len(ends) else [], np.frombuffer(places, "<u2").reshape(len(ends), n))

    def nearest(self, n: int, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """Of every part: the number of its nearest entry (the lowest of equally near ones) and the squared distance."""
        width = len(self.values) // len(codebooks)
        large = any(v.dtype == object for v in self.values) or any(abs(x) > _NARROW for b in codebooks for e in b for x in e)
        kind = object if large else np.int64
        codes, errors = np.zeros((len(codebooks), n), np.int64), np.zeros((len(codebooks), n), kind)
        for p, book in enumerate(codebooks):
            entries = np.array(book, kind).reshape(len(book), width)
            distance = np.zeros((n, len(book)), kind)
            for i, d in enumerate(range(p * width, (p + 1) * width)):
                table = (self.values[d].astype(kind)[:, None] - entries[None, :, i]) ** 2
                distance += table[self.places[d]]
            codes[p] = distance.argmin(axis=1)
            errors[p] = distance[np.arange(n), codes[p]]
        return codes, errors

    def sums(self, codes: np.ndarray, entries: int) -> np.ndarray:
        """Sum of the components that each entry got: by dimension and entry.

        Found through the dictionary as well: how often each integer meets each entry, times the integer.
        """
        width = len(self.values) // len(codes)
        out = np.zeros((len(self.values), entries), object)
        for d, values in enumerate(self.values):
            key = self.places[d].astype(np.int64) * entries + codes[d // width]
            met = np.bincount(key, minlength=len(values) * entries).reshape(len(values), entries)
            out[d] = (met.astype(values.dtype) * values[:, None]).sum(axis=0)
        return out


_CODED = ["n", "sizes", "narrow", "wide", "places"]


def _blocks(vectors: DataFrame, dim: int, scale: int, size: int) -> DataFrame:
    """Coded blocks of at most ``size`` vectors, made where the rows lie."""
    row = ArrayType(StructType([StructField("vec_id", LongType()), vectors.schema["label"]]))
    schema = StructType(
        [
            StructField("rows", row),
            StructField("n", LongType()),
            StructField("sizes", BinaryType()),
            StructField("narrow", BinaryType()),
            StructField("wide", StringType()),
            StructField("places", BinaryType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                flat = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(float)
                ends = np.cumsum(part["vector"].value_lengths().to_numpy(zero_copy_only=False))
                coded = Coded.of(integers(np.split(flat, ends[:-1]), dim, scale)).stored()
                pairs = pa.StructArray.from_arrays([part["vec_id"], part["label"]], names=["vec_id", "label"])
                rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pairs)
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
                columns = [pa.array([x], kind) for x, kind in zip([part.num_rows, *coded], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows, *columns], names=["rows", *_CODED])

    return vectors.mapInArrow(encode, schema)


def _first_entries(vectors: DataFrame, dim: int, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the vectors with the smallest ids; a fixed number of rows reaches the driver."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    rows = integers([np.array(r["vector"], float) for r in first], dim, scale).tolist()
    width = dim // parts
    return [[[int(x) for x in row[p * width : (p + 1) * width]] for row in rows] for p in range(parts)]


def _next_entries(blocks: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every entry replaced by the mean, rounded down, of the parts nearest to it; an entry without parts stays.

    A task adds up its blocks; what it hands on, and what reaches the driver, has the size of the codebooks.
    """
    parts, entries = len(codebooks), len(codebooks[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                block = Coded.read(*(row[c] for c in _CODED))
                codes, _ = block.nearest(row["n"], codebooks)
                counts += np.array([np.bincount(c, minlength=entries) for c in codes])
                sums = block.sums(codes, entries)
                totals = sums if totals is None else totals + sums
        if totals is None:
            return
        width = len(totals) // parts
        d, e = (x.ravel() for x in np.indices(totals.shape))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(d.astype(np.int32)),
                pa.array(e.astype(np.int32)),
                pa.array(counts[d // width, e]),
                pa.array([Decimal(int(x)) for x in totals.ravel()], pa.decimal128(38, 0)),
            ],
            names=["d", "e", "n", "total"],
        )

    sums = (
        blocks.select(*_CODED)
        .mapInArrow(add, "d int, e int, n long, total decimal(38,0)")
        .groupBy("d", "e")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .collect()
    )
    out = [[list(entry) for entry in book] for book in codebooks]
    for r in sums:
        if r["n"]:
            p, i = divmod(r["d"], len(codebooks[0][0]))
            out[p][r["e"]][i] = int(r["total"]) // r["n"]
    return out


def _assigned(blocks: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    label = blocks.schema["rows"].dataType.elementType["label"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = [batch[c][i].as_py() for c in _CODED]
                codes, errors = Coded.read(*held).nearest(held[0], codebooks)
                total = errors.sum(axis=0)
                if total.dtype == object:
                    total = [int(x) if x < _LONG else None for x in total]
                own = batch["rows"].slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        own.field("vec_id"),
                        own.field("label"),
                        pa.array([row.tobytes().hex() for row in codes.T.astype(np.uint8, order="C")], pa.string()),
                        pa.array(total, pa.int64()),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    schema = [StructField("vec_id", LongType()), label, StructField("code", StringType()), StructField("error", LongType())]
    return blocks.mapInArrow(assign, StructType(schema))


def codebooks_digest(codebooks: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and place within the part, joined by commas."""
    every = (x for book in codebooks for entry in book for x in entry)
    return hashlib.sha256(",".join(map(str, every)).encode()).hexdigest()


def vector_codes(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """Codes of all vectors, one row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    ``embeddings`` has vec_id, embedding and label. A component counts as floor(scale * x). Vectors are cut into
    ``parts`` equal parts, each with a codebook of at most ``entries`` (256 at most) entries, which starts as that part
    of the vectors with the smallest ids and is refined ``rounds`` times: every part goes to its nearest entry (squared
    distance, ties to the lower number), every entry becomes the rounded-down mean of its parts. ``code`` has two hex
    digits a part, ``error`` is the squared distance of the whole vector, ``label_error`` its sum over equal labels.

    Each round is one pass over the stored blocks; tasks hand on sums of the size of the codebooks. Labels are added up
    before they move, and only the sums are joined back.

    Rows whose vector is null or holds a null or non-finite component are left out. A null vec_id comes after all
    others; equal ids are told apart by their vectors, equal rows count each. Null labels form one group. Vectors of
    different lengths are taken as long as the longest one, and lengths that ``parts`` does not divide are filled up,
    with zeros. Fewer vectors than entries: that many entries. Integers beyond 2**96 are cut to it; an error beyond 64
    bits, and the sum of a label that holds one, is null. An empty table gives an empty result. Other columns are
    ignored.
    """
    if not (1 <= entries <= 256 and 1 <= block_vectors <= 1 << 16):
        raise ValueError("a code has two hex digits, a place two bytes")
    vector = F.col("embedding").cast("array<double>")
    vectors = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").alias("label")
    ).where(usable(F.col("vector")))
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    dim = -(-max(1, longest or 0) // parts) * parts
    blocks = stored(_blocks(vectors, dim, scale, block_vectors), "vector-blocks")
    books = _first_entries(vectors, dim, parts, entries, scale)
    for _ in range(rounds if books[0] else 0):
        books = _next_entries(blocks, books)
    coded = stored(_assigned(blocks, books), "vector-codes")
    release(blocks)
    whole = F.count("error") == F.count(F.lit(1))
    sums = stored(coded.groupBy("label").agg(F.when(whole, F.try_sum("error")).alias("label_error")), "label-errors")
    of, to = coded.alias("c"), sums.alias("s")
    return of.join(to, F.col("c.label").eqNullSafe(F.col("s.label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )
