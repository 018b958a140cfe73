"""Language of texts by nearest centroid.

A text is a vector of hashed character n-grams (one to three, of its words with a blank on either side), weighted by
TF-IDF and brought to length 1. Each language has several centroids, found by spherical k-means; the text takes the
language of the nearest one by cosine. A text whose nearest centroid is farther than the language allows is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices

UNKNOWN = "und"
BUCKETS = 4096
_WORD = re.compile(r"[^\W\d_]+")


class NGrams:
    """Counts of hashed character n-grams; words are remembered up to a bound in bytes."""

    def __init__(self, limit: int = 64 << 20):
        self.limit, self.known, self.held = limit, {}, 0

    @staticmethod
    def of_word(word: str) -> bytes:
        w = f" {word} "
        grams = [w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)][1:]
        return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams], "<u2").tobytes()

    def counts(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if self.held > self.limit:
            self.known, self.held = {}, 0
        known = self.known
        for w in set(words).difference(known):
            known[w] = grams = self.of_word(w)
            self.held += 200 + len(w) + len(grams)
        out = np.zeros(BUCKETS, np.float32)
        for at in range(0, len(words), 100_000):  # long texts a part at a time
            grams = np.frombuffer(b"".join(map(known.__getitem__, words[at : at + 100_000])), "<u2")
            out += np.bincount(grams, minlength=BUCKETS)
        return out

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.stack([self.counts(t) for t in texts]) if texts else np.zeros((0, BUCKETS), np.float32)


@dataclass(frozen=True)
class Centroids:
    """A fitted model: its size depends on languages and buckets only."""

    idf: np.ndarray
    langs: list[str]
    vectors: np.ndarray  # one row per centroid
    least: np.ndarray  # least cosine at which a centroid accepts a text

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, its cosine, and whether its distance is too large; counts of no letter give cosine 0."""
        near = weighted(counts, self.idf) @ self.vectors.T
        best = near.argmax(axis=1)
        cosine = near[np.arange(len(near)), best]
        return best, np.clip(cosine, 0.0, 1.0), cosine < self.least[best]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _k_means(rows: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out rows; centroids and the nearest one of each row."""
    chosen = [0]
    for _ in range(min(k, len(rows)) - 1):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(axis=1))))
    centers = rows[chosen]
    for _ in range(rounds):
        of = (rows @ centers.T).argmax(axis=1)
        sums = np.stack([rows[of == c].sum(axis=0) if (of == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers, (rows @ centers.T).argmax(axis=1)


def fit(
    documents: DataFrame, learn_from: Column, per_lang: int = 1_500, clusters: int = 3, tail: float = 0.002, most_langs: int = 500
) -> Centroids:
    """Fit on rows of text and lang that ``learn_from`` accepts; null languages and texts teach nothing.

    Of each language about ``per_lang`` different texts are taken, by a hash of the text, so the model costs the same for
    any corpus, and copies of one text teach once; where a dirty column holds more, the ``most_langs`` languages with most
    texts are learned. Vectors are made where the rows lie; each language is clustered by a task of its own from its
    bounded sample. A centroid accepts what is at least as near as all but the share ``tail`` of its own rows.
    """
    rows = documents.select("doc_id", "text", "lang").where(learn_from).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("key"))
    sizes = rows.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    totals = {r["lang"]: r["n"] for r in sizes.orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not totals:
        return Centroids(np.ones(BUCKETS, np.float32), [], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, per_lang / n))))
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for part, texts in text_slices(batches):
            counts = grams.matrix(texts)
            keep = np.flatnonzero(counts.sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays(
                [part["lang"].take(pa.array(keep)), pa.array([counts[i].tobytes() for i in keep], pa.binary())],
                names=["lang", "counts"],
            )

    different = rows.where(drawn).groupBy("lang", "key").agg(F.min("text").alias("text"))
    sample = stored(different.select("lang", "text").mapInArrow(count, "lang string, counts binary"), "langid-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for counts in batch["counts"].to_pylist():
                n, seen = n + 1, seen + (np.frombuffer(counts, np.float32) > 0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([seen.tobytes()])], names=["n", "seen"])

    parts = sample.mapInArrow(frequencies, "n long, seen binary").collect()  # one row per task of a bounded sample
    n = sum(r["n"] for r in parts)
    seen = sum((np.frombuffer(bytes(r["seen"]), np.int64) for r in parts), np.zeros(BUCKETS, np.int64))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = weighted(np.stack([np.frombuffer(c, np.float32) for c in frame["counts"].sort_values()]), idf)
        centers, of = _k_means(vectors, clusters)
        near = np.einsum("ij,ij->i", vectors, centers[of])
        least = [float(np.quantile(near[of == c], tail)) if (of == c).any() else 0.0 for c in range(len(centers))]
        return pd.DataFrame(
            {"lang": frame["lang"].iloc[0], "center": [c.astype(np.float32).tobytes() for c in centers], "least": least}
        )

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, center binary, least double").collect()
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["center"])))
    vectors = [np.frombuffer(bytes(r["center"]), np.float32) for r in found]
    return Centroids(
        idf,
        [r["lang"] for r in found],
        np.stack(vectors) if vectors else np.zeros((0, BUCKETS), np.float32),
        np.array([r["least"] for r in found]),
    )


def predict(documents: DataFrame, model: Centroids, reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (cosine), outlier (the nearest centroid is too far).

    With ``reject`` an outlier's language is ``und``. A null text, one without a letter, and any text when nothing was
    learned are ``und`` with score 0 and no outlier. Whole texts are read. Repeated rows give repeated results; a null
    doc_id stays null; an empty table gives an empty result; other columns are ignored.
    """
    langs = np.array([*model.langs, UNKNOWN], dtype=object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for part, texts in text_slices(batches):
            counts = grams.matrix(texts)
            letters = (counts.sum(axis=1) > 0) & bool(model.langs)
            if model.langs:
                best, cosine, far = model.predict(counts)
            else:
                best, cosine, far = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = letters & ~far if reject else letters
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pa.array(langs[np.where(known, best, len(model.langs))], pa.string()),
                    pa.array(np.where(letters, cosine, 0.0).astype(float)),
                    pa.array(far & letters),
                ],
                names=["doc_id", "lang_pred", "score", "outlier"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, lang_pred string, score double, outlier boolean"
    )
