"""Quality rules about repetition: how much of a text lies inside repeated word runs and repeated lines.

Words become 64-bit hashes and runs of 2 to 10 words rolling hashes over them, as arrays of a whole slice of texts. A run
counts as repeated if its hash occurs twice or more in the same text; what repeated runs cover is a union of word ranges
(a word inside two of them counts once), measured in characters of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, mix64, text_slices

LEAST_WORDS = 50
#: most percent of the words inside repeated runs of three words
MOST_REPEAT_WORDS = 50
#: run length: most percent of the characters inside the run that covers most of them
MOST_TOP_RUN = {2: 20, 3: 18, 4: 16}
#: run length: most percent of the characters inside repeated runs
MOST_REPEATED_RUNS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: most percent of the lines with a word that equal an earlier one, and of the characters inside them
MOST_LINES, MOST_LINE_CHARS = 30, 20
#: characters that mark junk when frequent
SYMBOLS = "#*$%&|<>"

_LONGEST = max(*MOST_TOP_RUN, *MOST_REPEATED_RUNS)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = " \t\n\v\f\r"
#: keys that are sorted at once
_SORTED_AT_ONCE = 1 << 21


def repeated_keys(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the keys that occur more than once: equal ones side by side, ascending, in arrays of bounded size.

    Long inputs are taken a range of keys at a time.
    """
    bits = max(0, len(keys) // _SORTED_AT_ONCE).bit_length()
    for part in range(1 << bits):
        own = np.flatnonzero(keys >> np.uint64(64 - bits) == part) if bits else np.arange(len(keys))
        order = own[np.argsort(keys[own], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        yield order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order


@dataclass
class Runs:
    """Repeated runs of a slice of texts. ``ends``: where the words of each text end; ``chars``: characters of each word."""

    words: np.ndarray
    chars: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.text = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))
        self.before = np.concatenate([[0], np.cumsum(self.chars, dtype=np.int64)])

    def of_length(self) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
        """For each length from 2 on: the places at which repeated runs of this length start, and the keys of the runs.

        The hash rolls on by a word from length to length, and only over places that are still repeated, since a run
        can only be repeated if it is so without its last word. A text's number is mixed in, so texts do not meet.
        """
        places, rolled = np.arange(len(self.words)), mix64(self.words)
        for n in range(2, _LONGEST + 1):
            inside = places + n - 1 < len(self.words)
            places, rolled = places[inside], rolled[inside]
            inside = self.text[places + n - 1] == self.text[places]
            places, rolled = places[inside], rolled[inside]
            rolled = rolled * _STEP + self.words[places + n - 1]
            keys = mix64(rolled ^ mix64(self.text[places].astype(np.uint64) + _STEP))
            found = [f for f in repeated_keys(keys) if len(f)]
            yield n, [places[f] for f in found], [keys[f] for f in found]
            again = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
            places, rolled = places[again], rolled[again]

    def covered(self, n: int, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Words and characters of each text that runs of ``n`` words at these places cover, each counted once."""
        edge = np.zeros(len(self.words) + 1, np.int32)
        for p in places:
            np.add.at(edge, p, 1)
            np.add.at(edge, p + n, -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        texts = self.text[inside]
        size = len(self.ends)
        return np.bincount(texts, minlength=size), self._chars(texts, self.chars[inside])

    def _chars(self, texts: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return np.bincount(texts, chars, len(self.ends)).astype(np.int64)

    def top(self, n: int, places: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
        """Of each text the characters covered by its run of ``n`` words that covers most; overlaps count once."""
        most = np.zeros(len(self.ends), np.int64)
        for p, k in zip(places, keys, strict=True):
            first = np.concatenate([[True], k[1:] != k[:-1]])
            start = np.where(first, p, np.maximum(p, np.concatenate([[0], p[:-1] + n])))
            at = np.flatnonzero(first)
            np.maximum.at(most, self.text[p[at]], np.add.reduceat(self.before[p + n] - self.before[start], at))
        return most


def lines_repeated(text: str) -> tuple[int, int, int]:
    """Lines with a word; those of them equal to an earlier one; characters of words inside these."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return sum(1 for line in lines if line.strip(_BLANKS)), 0, 0
    seen: set[str] = set()
    n = again = chars = 0
    for line in lines:
        if line.strip(_BLANKS):
            n += 1
            if line in seen:
                again += 1
                chars += len(line) - sum(map(line.count, _BLANKS))
            seen.add(line)
    return n, again, chars


def _columns() -> list[str]:
    tops, runs = [f"top_chars_{n}" for n in MOST_TOP_RUN], [f"repeat_chars_{n}" for n in MOST_REPEATED_RUNS]
    base = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
    return [*base, *tops, *runs]


def measures(texts: list[str | None]) -> dict[str, np.ndarray]:
    """All counts of ``repetition_rules`` for each text."""
    held = [t or "" for t in texts]
    hashed = hashed_words(held, chars=True)
    words = [h for h, _ in hashed]
    out = {c: np.zeros(len(held), np.int64) for c in _columns()}
    if not held:
        return out
    runs = Runs(np.concatenate(words), np.concatenate([c for _, c in hashed]), np.cumsum([len(w) for w in words]))
    out["n_words"] += np.array([len(w) for w in words], np.int64)
    out["word_chars"] += np.array([len(t) - sum(map(t.count, _BLANKS)) for t in held], np.int64)
    out["n_symbols"] += np.array([sum(map(t.count, SYMBOLS)) for t in held], np.int64)
    for i, t in enumerate(held):
        out["n_lines"][i], out["n_dup_lines"][i], out["dup_line_chars"][i] = lines_repeated(t)
    for n, places, keys in runs.of_length():
        if n in MOST_TOP_RUN:
            out[f"top_chars_{n}"] += runs.top(n, places, keys)
        if n == 3:
            out["n_repeat_words"] += runs.covered(n, places)[0]
        if n in MOST_REPEATED_RUNS:
            out[f"repeat_chars_{n}"] += runs.covered(n, places)[1]
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept, by whole numbers."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_WORDS * m["n_words"])
    repetitive = 100 * m["n_dup_lines"] > MOST_LINES * m["n_lines"]
    limits = {"dup_line_chars": MOST_LINE_CHARS}
    limits |= {f"top_chars_{n}": most for n, most in MOST_TOP_RUN.items()}
    limits |= {f"repeat_chars_{n}": most for n, most in MOST_REPEATED_RUNS.items()}
    for column, most in limits.items():
        repetitive |= 100 * m[column] > most * m["word_chars"]
    return failed, ~failed & ~repetitive


def repetition_rules(documents: DataFrame) -> DataFrame:
    """Repetition of every whole text and the verdict: doc_id, the counts, base_failed, kept.

    A word is what stands between ASCII white space, as it is; a line is what stands between line feeds and counts if it
    holds a word. word_chars, dup_line_chars, top_chars_n and repeat_chars_n are characters of words; n_repeat_words are
    the words inside runs of three words that occur twice or more in the text, the first time included.
    ``top_chars_n`` belongs to the run of n words that covers most, ``repeat_chars_n`` to all repeated runs together.
    base_failed: fewer than 50 words, or more than half of them in repeated runs of three. kept: not base_failed, and no
    share over its limit (see the constants of this module). No row moves between tasks.

    A null text counts as empty: all counts are 0, base_failed is true, kept false. Repeated rows give repeated results;
    a null doc_id stays null; an empty table gives an empty result; other columns are ignored. Long texts are hashed
    piece by piece and their runs sorted a range of hashes at a time.
    """
    columns = _columns()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            found = measures(texts)
            arrays = [pa.array(found[c]) for c in columns] + [pa.array(v) for v in verdicts(found)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *arrays], names=["doc_id", *columns, "base_failed", "kept"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in columns), "base_failed boolean, kept boolean"])
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)
