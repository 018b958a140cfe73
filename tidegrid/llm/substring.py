"""Removal of passages that occur more than once.

A window is a run of consecutive words of one document. Every word that a window covers whose words also start anywhere
else is removed; windows are judged on the input.

Shards. Each window belongs to the least hash of its nine-word runs (for 35-word windows), its minimiser; equal windows
have equal minimisers. Consecutive windows with the same minimiser form one span of text, about 14 windows long, and a
span's minimiser decides its shard, so windows that could be equal always meet in one shard and none is compared across
shards. Minimisers that occur once are dropped beforehand: their windows cannot be repeated. Equal spans are counted
before they move. Spans of a very frequent minimiser are cut into single windows and dealt by all their words, so such
a passage does not fill one shard.

Each shard builds an FM-index of its spans and streams its spans through it (see ``fmindex``); the intervals found are
brought back to the documents.

What decides about a window, exactly: its minimiser has one place in the corpus: not repeated, without the index. Its
document has an exact copy (equal MD5 of the text): repeated, without the index. Its span has an exact copy: repeated, by
the count of copies. All others: by the width of the interval that backward search finds for its words. The search stops
at the window's length, since a longer match would remove no further word; the index holds packed bits, not compressed
ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import gram_hashes, hashed_words, stored, text_slices
from .fmindex import repeated_starts

WINDOW = 35
SHARD_WORDS = 250_000
FREQUENT = 4_096
_SPAN_WINDOWS = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n, reach, least = len(x) - width + 1, 1, x
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    return np.minimum(least[:n], least[width - reach : width - reach + n])


def window_runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a document: minimiser, first window, number of windows, whether the minimiser has several places."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    size = window // 4 + 1
    grams, width = gram_hashes(hashes, size), window - size + 1
    least = _sliding_least(grams, width)
    # a place is chosen if the greatest minimum of the windows over it is its own hash
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen, places = np.unique(grams[~_sliding_least(~padded, width) == grams], return_counts=True)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    run = np.flatnonzero(new)
    at = np.arange(len(least)) - np.repeat(run, np.diff(np.append(run, len(least))))
    start = np.flatnonzero(at % _SPAN_WINDOWS == 0)  # long runs of one minimiser are cut
    several = places[np.searchsorted(chosen, least[start])] > 1
    return least[start], start, np.diff(np.append(start, len(least))), several


def _key() -> Column:
    """128 bits of the text: equal texts have equal spans."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _minimisers(documents: DataFrame, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            found = [window_runs(h, window) for h in hashed_words(texts)]
            row = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
            mini, start, n, several = (np.concatenate([f[k] for f in found]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mini.view(np.int64)),
                    part["key"].take(pa.array(row)),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(several),
                ],
                names=["minimiser", "key", "start", "n", "several"],
            )

    return documents.select(_key().alias("key"), "text").mapInArrow(
        find, "minimiser long, key binary, start int, n int, several boolean"
    )


_SPAN = [
    StructField("start", IntegerType()), StructField("n", IntegerType()), StructField("deal", LongType()),
    StructField("span", BinaryType()), StructField("words", StringType()),
]
_DOC = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]


def _deal(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _spread(documents: DataFrame, spans: DataFrame, window: int, columns: list[str], keep_text: bool, row_id: str) -> DataFrame:
    """One table of two kinds of rows: documents, and the spans that need a look.

    A document without such spans is done: its digest is made here. So is an exact copy, which loses all its windows;
    one row of the copies still gives its spans, since others may repeat them. The text of the rest is kept for the end.
    """
    keep = [c for c in columns if c != "text"]
    source = documents.select(*keep, "text", _key().alias("key"), F.col(row_id).cast("long").alias("row_id")).join(spans, "key", "left")
    schema = StructType([*(source.schema[c] for c in [*keep, "text", "key"]), *_DOC, *_SPAN])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}
        for part, texts in text_slices(batches):
            kinds = kinds or {f.name: f.type for f in part.schema}
            n_words, removed, digest, held, out = [], [], [], [], {k: [] for k in ("key", "start", "n", "deal", "span", "words")}
            given = (part[c].to_pylist() for c in ("key", "spans", "copies", "first_id", "row_id"))
            for text, key, own, copies, first_id, row in zip(texts, *given, strict=True):
                words, own = words_of(text), own or []
                copied = copies is not None and len(words) >= window
                n_words.append(len(words))
                if copied:
                    removed.append(len(words))
                    digest.append(hashlib.sha256(b"").hexdigest())
                    held.append("")
                    own = own if row == first_id else []
                elif own:
                    removed.append(None)
                    digest.append(None)
                    held.append(text)
                else:
                    removed.append(0)
                    digest.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
                    held.append(text if keep_text else None)
                for s in own:
                    cuts = [(s["start"], s["n"])] if not s["frequent"] else [(s["start"] + i, 1) for i in range(s["n"])]
                    for start, n in cuts:
                        joined = " ".join(words[start : start + n + window - 1])
                        out["key"].append(key)
                        out["start"].append(start)
                        out["n"].append(n)
                        out["deal"].append(_deal(joined) if s["frequent"] else s["minimiser"])
                        out["span"].append(hashlib.md5(joined.encode()).digest())
                        out["words"].append(joined)
            rows = part.num_rows
            doc = [part[c] for c in keep] + [pa.array(held, pa.string()), part["key"], pa.array(n_words, pa.int64())]
            doc += [pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            span_types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(doc + [pa.nulls(rows, t) for t in span_types], names=schema.names)
            k = len(out["key"])
            empty = [pa.nulls(k, kinds[c]) for c in keep] + [pa.nulls(k, pa.string()), pa.array(out["key"], pa.binary())]
            empty += [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())]
            found = [pa.array(out[f.name], t) for f, t in zip(_SPAN, span_types, strict=True)]
            yield pa.RecordBatch.from_arrays(empty + found, names=schema.names)

    return source.mapInArrow(emit, schema)


def _covered(n_words: int, window: int, spans: list[dict]) -> np.ndarray:
    """Which words repeated windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans:
        starts = s["start"] + np.frombuffer(s["repeated"], "<i4")
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(documents: DataFrame, window: int = WINDOW, columns: list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """The documents with every word of a repeated window removed.

    All of ``columns`` (default: all) are kept, with n_words, n_removed and kept_sha256 added: the words of the input,
    how many of them go, and the SHA-256 (lower-case hex, UTF-8) of the kept ones joined by one space. A word is
    whatever stands between ASCII white space, unchanged. ``text`` stays as it is where nothing goes, else it becomes the
    kept words joined by one space; with ``keep_text`` False it is null for documents that keep all (only digests are
    wanted then).

    Repetitions within one document and between equal rows count. Null and empty texts have no words; shorter texts
    than a window lose nothing. A null doc_id is as good as another. An empty table gives an empty result. Columns
    named n_words, n_removed or kept_sha256 are replaced.
    """
    columns = columns or documents.columns
    columns = [c for c in columns if c not in {f.name for f in _DOC}]
    spans = _minimisers(documents, window)
    place = F.xxhash64("key", "start")  # the same for exact copies
    often = spans.groupBy("minimiser").agg(
        F.count("*").alias("rows"), F.max("several").alias("several"), F.min(place).alias("low"), F.max(place).alias("high")
    )
    often = often.where("low <> high OR several").select("minimiser", "rows")
    wanted = (
        spans.join(often, "minimiser")
        .groupBy("key")
        .agg(F.collect_set(F.struct("start", "n", "minimiser", (F.col("rows") > FREQUENT).alias("frequent"))).alias("spans"))
    )
    copies = documents.select(_key().alias("key"), F.col("doc_id").cast("long").alias("row_id")).groupBy("key")
    copies = copies.agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    wanted = wanted.join(copies, "key", "full_outer")
    inner = {c: f"__{i}" for i, c in enumerate(columns) if c != "text"}  # the users' names cannot clash with ours
    named = documents.select(*(F.col(f"`{c}`").alias(inner.get(c, c)) for c in columns))
    names = [inner.get(c, c) for c in columns]
    both = stored(_spread(named, wanted, window, names, keep_text, inner["doc_id"]), "documents-and-spans")
    occurrences = both.where("span IS NOT NULL")
    docs = both.where("span IS NULL").drop(*(f.name for f in _SPAN))

    different = stored(
        occurrences.groupBy("span").agg(
            F.first("deal").alias("deal"), F.first("words").alias("words"), F.first("n").alias("n"), F.count("*").alias("copies")
        ),
        "spans",
    )
    total = different.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [w.split(" ") for w in frame["words"]]
        found = repeated_starts(texts, frame["copies"].to_numpy(), window)
        keep = [i for i, f in enumerate(found) if len(f)]
        return pd.DataFrame(
            {"span": frame["span"].iloc[keep], "repeated": [found[i].astype("<i4").tobytes() for i in keep]}
        )

    repeated = (
        different.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(search, "span binary, repeated binary")
    )
    cover = (
        occurrences.select("key", "start", "span")
        .join(repeated, "span")
        .groupBy("key")
        .agg(F.collect_set(F.struct("start", "repeated")).alias("cover"))
    )
    open_docs = docs.where("n_removed IS NULL").join(cover, "key", "left").drop("key")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            kept_text, removed, digest = [], [], []
            for text, cover in zip(texts, part["cover"].to_pylist(), strict=True):
                words = words_of(text)
                gone = _covered(len(words), window, cover or [])
                left = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                kept_text.append(left if removed[-1] else text)
                digest.append(hashlib.sha256(left.encode()).hexdigest())
            new = {"text": pa.array(kept_text, pa.string()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest)}
            names = [n for n in part.schema.names if n != "cover"]
            yield pa.RecordBatch.from_arrays([new.get(n, part[n]) for n in names], names=names)

    done = docs.drop("key")
    changed = open_docs.mapInArrow(remove, done.schema)
    out = done.where("n_removed IS NOT NULL").unionByName(changed)
    return out.select(*(F.col(inner.get(c, c)).alias(c) for c in columns), *(f.name for f in _DOC))
