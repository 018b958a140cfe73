"""Near-duplicate documents: ProbMinHash signatures, banding, verification, classes.

The classes are the connected components of all verified pairs. Not all pairs of a bucket are written down to find
them: exact copies are one text from the start; each bucket's most central text is compared with the others first;
and only where a bucket still holds several classes, its other texts are compared with all of it, block by block, each
task handing on no more than a spanning set of links.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, text_slices, told_apart
from .components import components
from .probminhash import band_hashes, jaccard, occurrences, shingles, signatures

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: a block of a bucket has about this many texts and bytes of shingles
BLOCK_TEXTS, BLOCK_BYTES = 64, 32 << 20
COLUMNS_AT_ONCE = 1 << 16


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of the text; texts without words have no key."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")
    ).where(F.col("text").rlike(r"\S"))


def _band_rows(keyed: DataFrame, size: int) -> DataFrame:
    """key and bands of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            bands = band_hashes(signatures(shingles(texts, size)))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.ravel())
            )
            yield pa.RecordBatch.from_arrays([part["key"], lists], names=["key", "bands"])

    return keyed.select("key", "text").mapInArrow(sign, "key binary, bands array<bigint>")


def _shingle_rows(keyed: DataFrame, size: int) -> DataFrame:
    """key, its shingles as ascending 64-bit hashes, occurrences told apart, and the bytes of these."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = [occurrences(g).tobytes() for g in shingles(texts, size)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part["key"], pa.array(sets, pa.binary()), sizes], names=["key", "grams", "size"])

    return keyed.select("key", "text").mapInArrow(shingle, "key binary, grams binary, size long")


def _verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard similarity reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch[c]] for c in ("grams_a", "grams_b")]
            keep = [i for i, (x, y) in enumerate(zip(*sets, strict=True)) if jaccard(x, y) >= similarity]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return (
        pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("grams_a")), "a")
        .join(grams.select(F.col("key").alias("b"), F.col("grams").alias("grams_b")), "b")
        .select("a", "b", "grams_a", "grams_b")
        .mapInArrow(check, "a binary, b binary")
    )


def block_links(
    a: list[tuple[bytes, bytes, np.ndarray]], b: list[tuple[bytes, bytes, np.ndarray]], similarity: float
) -> list[tuple[bytes, bytes]]:
    """Links between two lists of (key, class, shingles): of each text of ``a`` one to every other class it is near to.

    All similarities are found at once: the shingles that occur in both lists become columns of two 0/1 matrices, whose
    product counts what each pair shares; ``COLUMNS_AT_ONCE`` columns at a time, so that long texts need no wide matrix.
    """
    both = np.intersect1d(np.concatenate([g for *_, g in a]), np.concatenate([g for *_, g in b]))

    def matrix(rows: list[tuple[bytes, bytes, np.ndarray]], columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        for i, (*_, grams) in enumerate(rows):
            near = grams[np.searchsorted(grams, columns[0]) : np.searchsorted(grams, columns[-1], side="right")]
            out[i, np.searchsorted(columns, np.intersect1d(near, columns, assume_unique=True))] = 1
        return out

    shared = np.zeros((len(a), len(b)))
    for at in range(0, len(both), COLUMNS_AT_ONCE):
        part = both[at : at + COLUMNS_AT_ONCE]
        shared += matrix(a, part) @ matrix(b, part).T
    sizes = np.array([len(g) for *_, g in a])[:, None] + np.array([len(g) for *_, g in b])[None, :]
    near = shared >= similarity * (sizes - shared) - 1e-9
    links: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}
    for i, j in zip(*np.nonzero(near), strict=True):
        if a[i][1] != b[j][1]:
            links.setdefault((a[i][0], b[j][1]), (a[i][0], b[j][0]))
    return list(links.values())


def _rest_links(members: DataFrame, grams: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links that the first comparison left open, and the stored blocks they are found in.

    ``members``: bucket, key, comp. In each bucket the texts outside its largest class are compared with all texts of
    the bucket. A bucket is cut into blocks of about ``BLOCK_TEXTS`` texts, or of ``BLOCK_BYTES`` bytes of shingles where
    texts are long; each pair of blocks is a row of its own, so a large bucket is spread over many tasks, and a task
    returns links, not pairs.
    """
    by_class = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = (
        by_class.groupBy("bucket")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("classes"))
        .where("classes > 1")
    )
    mixed = members.join(largest, "bucket")
    held = mixed.select("bucket", "key").join(grams.select("key", "size"), "key").groupBy("bucket").agg(F.sum("size").alias("held"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("held") / BLOCK_BYTES)).cast("int").alias("blocks")
    cut = stored(largest.join(held, "bucket").select("bucket", "main", blocks), "bucket-cuts")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = members.join(cut, "bucket").withColumn("block", block).join(grams.select("key", "grams"), "key")
    text = F.struct("key", "comp", "grams")
    blocks = stored(
        rows.groupBy("bucket", "block").agg(
            F.first("blocks").alias("blocks"),
            F.collect_list(text).alias("all"),
            F.collect_list(F.when(F.col("comp") != F.col("main"), F.col("key"))).alias("rest"),
        ),
        "bucket-blocks",
    )
    one = blocks.where(F.size("rest") > 0).select(
        "bucket",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.filter("all", lambda x: F.array_contains("rest", x["key"])).alias("one"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts(cell: pa.Scalar) -> list[tuple[bytes, bytes, np.ndarray]]:
            return [(t["key"], t["comp"], np.frombuffer(t["grams"], np.uint64)) for t in cell.as_py()]

        for batch in batches:
            found = [block_links(texts(batch["one"][i]), texts(batch["all"][i]), similarity) for i in range(batch.num_rows)]
            links = list(itertools.chain.from_iterable(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"]
            )

    pairs = one.join(blocks.select("bucket", "block", "all"), ["bucket", "block"]).select("one", "all")
    return pairs.mapInArrow(compare, "a binary, b binary"), blocks


def text_classes(documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """key (of a text) and comp (key of its class), for the texts whose class is not their own key alone."""
    keyed = _keyed(documents)
    rows = stored(_band_rows(keyed, size), "bands")
    bands = rows.groupBy("key").agg(F.first("bands").alias("bands"))
    entries = stored(bands.select("key", F.explode("bands").alias("bucket")), "band-entries")
    release(rows)
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(entries.join(sizes, "bucket"), "buckets")
    release(entries)
    # the texts that share most of their bands with most others are the most central ones
    central = stored(members.groupBy("key").agg(F.sum("n").alias("score")), "central")
    scored = members.join(central, "key")
    leaders = scored.groupBy("bucket").agg(F.max_by("key", F.struct("score", "key")).alias("leader"))
    stars = (
        members.join(leaders, "bucket")
        .where("key <> leader")
        .select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
        .distinct()
    )
    # texts without a partner stay where they are, and copies are brought down to one a task before they move
    wanted, _ = told_apart(keyed, ["key"], central)
    different = wanted.dropDuplicates(["key"]).join(central.select("key"), "key", "left_semi")
    grams = stored(_shingle_rows(different, size), "shingles")
    first = stored(_verified(stars, grams, similarity), "links")
    comps = components(first)
    placed = members.select("bucket", "key").join(comps.withColumnRenamed("node", "key"), "key", "left")
    more, blocks = _rest_links(placed.withColumn("comp", F.coalesce("comp", "key")), grams, similarity)
    classes = components(first.union(more))
    release(members, grams, first, blocks)
    return classes.withColumnRenamed("node", "key")


def _placed(documents: DataFrame, similarity: float, size: int) -> DataFrame:
    """doc_id, key and comp of every row; texts without words have neither key nor comp."""
    key = F.when(F.col("text").rlike(r"\S"), F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    classes = text_classes(documents, similarity, size)
    return rows.join(classes, "key", "left").select("doc_id", "key", F.coalesce("comp", "key").alias("comp"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, class_id, class_size.

    Two texts are linked if the weighted Jaccard similarity of their runs of ``size`` words (white-space words in lower
    case, each run weighted by its occurrences; a shorter text is one run) is at least ``similarity``; a class is what
    links connect; class_id is its smallest doc_id. Candidates come from 16 bands of 4 registers, which miss a link at
    the threshold itself about twice in 10,000 times; nothing is capped.

    Rows whose text is null or has no word are classes of their own: class_id is their doc_id. A null doc_id takes part
    and is the class_id only where there is no other. Repeated rows count each. An empty table gives an empty result;
    other columns are ignored.
    """
    placed = stored(_placed(documents, similarity, size), "placed")
    sums = placed.where("comp IS NOT NULL").groupBy("comp")
    sums = sums.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    # stored, so that the planner may send them to the rows, or split the rows of a large class
    sums = stored(sums, "classes")
    alone = F.col("class_size").isNull()
    return placed.join(sums, "comp", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """The documents with one row of each class left, all columns kept; texts without words all stay.

    The row with the smallest doc_id stays (null ids come last; equal ids: the smallest key of a text; equal rows: one
    of them). Only ids and keys are moved to find the rows to drop. Documents that are certainly not among those pass
    where they lie; the others alone are matched with them.
    """
    placed = stored(_placed(documents, similarity, size), "placed").where("comp IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    pairs = placed.groupBy("comp", "doc_id", "key").agg(F.count("*").alias("n"))
    pairs = stored(pairs, "class-members")
    first = pairs.groupBy("comp").agg(F.min(order).alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    first = stored(first, "first-of-class")
    fate = (
        pairs.join(first, "comp")
        .select(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"),
            F.col("key").alias("__key"),
            (order != F.col("first")).alias("__drop"),
            (F.col("n") > 1).alias("__repeated"),
        )
        .where("__drop OR __repeated")
    )
    key = F.when(F.col("text").rlike(r"\S"), F.unhex(F.md5(F.col("text").cast("binary"))))
    fate = stored(fate, "fate")
    rows = documents.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn(
        "__key", F.coalesce(key, F.lit(b""))
    )
    looked_at, sure = told_apart(rows, ["__id", "__key"], fate)
    marked = looked_at.join(fate, ["__id", "__key"], "left").where("NOT coalesce(__drop, false)")
    repeated = F.coalesce("__repeated", F.lit(False))
    once = marked.where(repeated).dropDuplicates(["__id", "__key"])
    kept = [sure, marked.where(~repeated), once]
    return functools.reduce(DataFrame.union, [k.select(*documents.columns) for k in kept])
