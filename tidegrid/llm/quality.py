"""Quality of texts: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words and runs of marks are the units; features are hashed single units and pairs. A unit that repeats the one before
it is read as a repetition mark, so that repeated junk looks alike whatever it repeats. A text is a sparse vector of
feature shares, brought to length 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WordHashes, mix64, stored, text_slices

BITS = 18
SAMPLE_ROWS = 8_000
_UNIT = re.compile(r"\w+|[^\w\s]+")
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (ascending) and values of a whole text; none for a text without words or marks."""
    units = hashes(_UNIT.findall((text or "").lower()))
    if not len(units):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    units = units.copy()
    units[1:][units[1:] == units[:-1]] = _AGAIN
    pairs = mix64(units[:-1] * np.uint64(0x9E3779B97F4A7C15) + units[1:])
    at = (np.concatenate([mix64(units), pairs]) >> np.uint64(64 - bits)).astype(np.int32)
    at.sort()
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    values = np.log1p(np.diff(np.append(first, len(at)))).astype(np.float32)
    return at[first], values / np.linalg.norm(values)


class Ftrl:
    """FTRL-proximal for logistic loss: per-feature rates, L1 and L2."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the constant

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (logistic(float(w @ values)) - label) * values
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def logistic(x: float | np.ndarray):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(
    documents: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = SAMPLE_ROWS, passes: int = 6,
    bits: int = BITS,
) -> np.ndarray:
    """Weights learned from labelled rows that ``learn_from`` (a condition on doc_id) accepts.

    At most about ``sample_rows`` labelled documents are taken, by a hash of doc_id, so that the fit costs the same for
    any corpus; one task goes over them. Labels are counted before the draw: equal rows teach once, and a document with
    both labels teaches both. Of documents with one id the least text (by its MD5, then by itself) stands for all, so an id
    that holds a third of all rows is one row of the sample. Qualities other than 0 and 1 and rows without a document teach
    nothing. Nothing to learn from: all weights are 0 (every score is 0.5).
    """
    quality = F.col("quality").cast("int").alias("quality")
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), quality).where(learn_from)
    usable = usable.where("quality IN (0, 1) AND doc_id IS NOT NULL").distinct()
    share = min(1.0, sample_rows / max(1, usable.count()))
    sample = stored(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)), "labelled-sample")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample.select("doc_id").distinct(), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")), "text")).alias("least"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in text_slices(batches):
            rows = [features(t, hashes, bits) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    part["quality"],
                    pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()),
                ],
                names=["doc_id", "quality", "at", "values"],
            )

    rows = stored(
        texts.select("doc_id", "least.text")
        .join(sample, "doc_id")
        .select("doc_id", "quality", "text")
        .mapInArrow(featurise, "doc_id long, quality int, at binary, values binary"),
        "quality-sample",
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [
            (np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4"), q)
            for batch in batches
            for a, v, q in zip(*(batch[c].to_pylist() for c in ("at", "values", "quality")), strict=True)
        ]
        model = Ftrl(bits)
        for _ in range(passes):
            for at, values, label in held:
                model.learn(at, values, label)
        weights = model.weights(slice(None)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], names=["weights"])

    # one task over a sample of bounded size, in an order that does not depend on how it was read
    learned = (
        rows.repartition(1)
        .sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id", "at", "quality")
        .mapInArrow(train, "weights binary")
        .collect()
    )
    if not learned:
        return np.zeros((1 << bits) + 1, "<f4")
    return np.frombuffer(bytes(learned[0]["weights"]), "<f4")


def score(documents: DataFrame, weights: np.ndarray, keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """Score of every whole text (0 to 1, higher is better): the columns in ``keep`` (doc_id) and ``into``.

    A null or empty text has the score of the constant alone. Repeated rows give repeated results; a null doc_id stays
    null; an empty table gives an empty result; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    bits = (len(weights) - 1).bit_length() - 1
    held = weights.tobytes()  # 4 bytes a feature, whatever the corpus
    chosen = documents.select(*keep, *(["text"] if "text" not in keep else []))
    schema = [chosen.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = WordHashes(), np.frombuffer(held, "<f4")
        for part, texts in text_slices(batches):
            raw = np.empty(len(texts))
            for i, text in enumerate(texts):
                at, values = features(text, hashes, bits)
                raw[i] = w[at] @ values + w[-1]
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in keep), pa.array(logistic(raw))], names=[*keep, into]
            )

    return chosen.mapInArrow(run, StructType([*schema, StructField(into, DoubleType())]))
