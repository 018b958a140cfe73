"""Benchmark decontamination with DataFrame and SQL functions only.

A benchmark item is compared with windows of a document that have as many words as the item. A window and an item are
near if the weighted Jaccard similarity of their five-word shingles (weight: number of occurrences) is 0.8 or more. An
item of fewer words is one shingle of all of them, so it is near a window with the same words.

1. Shingles of all documents are looked up among those of the items. A window that is near an item must hold a certain
   number of its shingles, which gives the windows to look at without loss: sliding a window on to its first such
   shingle never loses one.
2. Those windows get a 64-bit SimHash of their shingles, the occurrences of a repeated one told apart, so that the angle
   follows the weighted similarity whatever the weights. Items with as many words are found through a multi-index: the fingerprint is cut
   into 8 blocks of 8 bits, and two fingerprints within 23 bits of each other are within 2 bits in some block, so the
   index holds each block of an item with all its changes of up to 2 bits, and no fingerprint within the radius is
   missed. At similarity 0.8 about 10 bits differ, with a deviation of 3; 23 is over four deviations away.
3. Candidates are verified by their exact similarity.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
_BLOCK_BITS = 64 // BLOCKS


def words(text: str = "text") -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0)


def shingle_hashes(word_array: str = "words", size: int = SHINGLE_WORDS) -> Column:
    """Hash of every run of ``size`` words; no element for a shorter text."""
    run = ", ".join(f"{word_array}[i + {k}]" for k in range(size))
    return F.expr(
        f"CASE WHEN size({word_array}) >= {size} "
        f"THEN transform(sequence(0, size({word_array}) - {size}), i -> xxhash64({run})) "
        "ELSE array() END"
    )


def _told_apart(grams: str) -> str:
    """The hashes with repeats told apart, in any order: the k-th repeat of a hash is hashed with k, the first stays.

    As sets these have the weighted Jaccard similarity of the hashes with their numbers of occurrences.
    """
    return (
        f"CASE WHEN size(array_distinct({grams})) = size({grams}) THEN {grams} ELSE transform(array(sort_array({grams})), "
        "s -> transform(s, (x, i) -> CASE WHEN get(s, i - 1) = x THEN xxhash64(x, i + 1 - array_position(s, x)) "
        "ELSE x END))[0] END"
    )


def simhash(grams: str = "grams") -> Column:
    """64-bit SimHash of an array of 64-bit hashes, repeats told apart: a bit is set if more than half of them set it.

    A repeated hash must not vote with its whole weight for the same bits: one heavy shingle would turn many of them
    between arrays of high weighted similarity. Two bits are counted in one long, 32 places apart.
    """
    lanes = "transform(sequence(0, 31), i -> aggregate(g, 0L, (a, x) -> a + (shiftrightunsigned(x, i) & 4294967297L)))"
    return F.expr(
        f"transform(array({_told_apart(grams)}), g -> aggregate({lanes}, named_struct('f', 0L, 'i', 0), "
        "(s, c) -> named_struct("
        "'f', s.f | CASE WHEN (c & 4294967295L) * 2 > size(g) THEN shiftleft(1L, s.i) ELSE 0L END"
        " | CASE WHEN shiftrightunsigned(c, 32) * 2 > size(g) THEN shiftleft(1L, s.i + 32) ELSE 0L END,"
        " 'i', s.i + 1), s -> s.f))[0]"
    )


def _shared(a: str, b: str) -> Column:
    """Size of the multiset intersection; ``b`` is the item, mostly without repeats."""
    return F.expr(
        f"CASE WHEN size(array_distinct({b})) = size({b}) THEN size(array_intersect({a}, {b})) "
        f"ELSE aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + "
        f"least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))) END"
    )


def _block_changes(radius: int) -> list[int]:
    """All bit patterns of a block with at most radius / BLOCKS bits."""
    return [m for m in range(1 << _BLOCK_BITS) if m.bit_count() <= radius // BLOCKS]


def _by_blocks(df: DataFrame, changes: list[int]) -> DataFrame:
    block = F.explode(F.array(*(F.lit(b) for b in range(BLOCKS)))).alias("block")
    change = F.explode(F.array(*(F.lit(m).cast("long") for m in changes))).alias("change")
    value = F.expr(f"(shiftrightunsigned(fingerprint, block * {_BLOCK_BITS}) & {(1 << _BLOCK_BITS) - 1}L) ^ change")
    return df.select("*", block).select("*", change).withColumn("value", value).drop("change")


def _text_key() -> Column:
    return F.xxhash64(F.col("text"), F.lit(11))


def matches(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """doc_id, text_key, item_id, similarity, start_word, n_words: the best window of every document and item near it."""
    grams = F.expr(
        f"CASE WHEN size(words) >= {size} THEN item_grams "
        + " ".join(f"WHEN size(words) = {k} THEN array(xxhash64({', '.join(f'words[{i}]' for i in range(k))}))" for k in range(1, size))
        + " ELSE array() END"
    )
    items = stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), words().alias("words"))
        .select("item_id", "words", shingle_hashes(size=size).alias("item_grams"))
        .select("item_id", F.size("words").alias("item_words"), grams.alias("item_grams"))
        .where(F.size("item_grams") > 0),
        "items",
    )
    # the lengths of the items' shingles, which are those of short items and ``size``
    run = F.least("item_words", F.lit(size))
    runs = sorted(r["run"] for r in items.select(run.alias("run")).distinct().collect())
    # shingles of the benchmark, by length of item; stored, so that the planner knows how small it is
    known = stored(items.select("item_words", F.explode("item_grams").alias("gram")).distinct(), "item-shingles")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), words().alias("words"))
    places = [
        rows.select("doc_id", "text_key", F.size("words").alias("doc_words"), F.posexplode(shingle_hashes(size=r)).alias("pos", "gram"))
        .join(known.where(run == r), "gram")
        for r in runs or [size]
    ]
    hits = (
        functools.reduce(DataFrame.unionByName, places)
        .groupBy("doc_id", "text_key", "doc_words", "item_words")
        .agg(F.array_sort(F.collect_set("pos")).alias("places"))
    )
    needed = F.ceil(
        F.lit(similarity / (1 + similarity)) * (F.least("doc_words", "item_words") + F.col("item_words") - 2 * (run - 1)) - 1e-9
    ).cast("int")
    last = F.greatest(F.lit(0), F.col("doc_words") - F.col("item_words"))
    starts = F.expr(
        "array_union("
        "filter(places, (p, k) -> p <= last AND k + needed <= size(places)"
        f" AND get(places, k + needed - 1) <= p + item_words - least(item_words, {size})),"
        "CASE WHEN size(filter(places, p -> p >= last)) >= needed THEN array(last) ELSE array() END)"
    )
    windows = stored(
        hits.withColumn("needed", needed)
        .withColumn("last", last)
        .select("doc_id", "text_key", "item_words", F.explode(starts).alias("start_word"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("item_words", "start_word")).alias("windows")),
        "windows",
    )
    d, w = rows.alias("d"), windows.alias("w")
    cut = (
        d.join(w, F.col("d.text_key").eqNullSafe(F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
        .select("d.doc_id", "d.text_key", "windows", *(shingle_hashes(size=r).alias(f"grams_{r}") for r in runs or [size]))
        .select(
            "doc_id",
            "text_key",
            F.expr(
                "inline(transform(windows, w -> named_struct('item_words', w.item_words, 'start_word', w.start_word, "
                f"'grams', CASE least(w.item_words, {size}) "
                + " ".join(f"WHEN {r} THEN slice(grams_{r}, w.start_word + 1, w.item_words - {r - 1})" for r in runs or [size])
                + " END)))"
            ),
        )
        .withColumn("fingerprint", simhash())
    )
    cut = stored(cut.dropDuplicates(["doc_id", "text_key", "item_words", "start_word"]), "window-fingerprints")
    marked = items.select("item_id", "item_words", "item_grams", simhash("item_grams").alias("fingerprint"))
    index = _by_blocks(marked.select("item_id", "item_words", "fingerprint"), _block_changes(radius))
    index = index.withColumnRenamed("fingerprint", "item_fingerprint")
    window = ["doc_id", "text_key", "item_words", "start_word"]
    candidates = (
        _by_blocks(cut.select(*window, "fingerprint"), [0])
        .join(index, ["item_words", "block", "value"])
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
        .groupBy("item_id", *window)
        .agg(F.count("*").alias("blocks"))
    )
    both = F.col("shared").cast("double") / (F.size("grams") + F.size("item_grams") - F.col("shared"))
    c, k = candidates.alias("c"), cut.alias("k")
    same = F.col("c.doc_id").eqNullSafe(F.col("k.doc_id"))
    for name in window[1:]:
        same = same & (F.col(f"c.{name}") == F.col(f"k.{name}"))
    return (
        c.join(k, same)
        .select("c.*", "k.grams")
        .join(items.select("item_id", "item_grams"), "item_id")
        .withColumn("shared", _shared("grams", "item_grams"))
        .withColumn("similarity", both)
        .where(F.col("similarity") >= similarity - 1e-9)
        .groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("at"), "item_words")).alias("best"))
        .select(
            "doc_id",
            "text_key",
            "item_id",
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.at")).cast("int").alias("start_word"),
            F.col("best.item_words").alias("n_words"),
        )
    )


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start_word (of the first best window), n_words (of the item).

    Every document that holds a window near an item, once per item. A document shorter than an item is its own window.
    An item of fewer than five words is near every document that holds just these words in a row; a document of fewer
    words than both five and the item is near nothing, nor are null texts and texts without words. Rows with equal doc_id and text are one; a null doc_id stays null; equal item_ids are reported apart only by their
    texts' lengths. Empty tables give an empty result; other columns are ignored.
    """
    return matches(documents, benchmark, similarity).drop("text_key")


def without_benchmark(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no window near an item, all columns kept; see ``contaminated``."""
    found = stored(matches(documents, benchmark, similarity).select("doc_id", "text_key").distinct(), "contaminated")
    d, f = documents.withColumn("__key", _text_key()).alias("d"), found.alias("f")
    same = (F.col("d.__key") == F.col("f.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    return d.join(f, same, "left_anti").select(*documents.columns)
