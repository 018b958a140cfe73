"""FM-index over sequences of words, for counting repeated runs of a fixed number of words.

Words are read ``g`` at a time (g divides the run length), at every offset, so a run of 35 words is a pattern of 5
symbols of 7 words. Symbols are named exactly, not hashed. Suffixes are sorted as far as a pattern reaches, which is all
that backward search for patterns up to that length needs. The Burrows-Wheeler transform is kept as a wavelet matrix of
packed bits with a count before every 64.
"""

from __future__ import annotations

import numpy as np


def _named(*parts: np.ndarray) -> np.ndarray:
    """Order-preserving numbers, from 1, of the tuples that the arrays form."""
    names = parts[0].astype(np.int64)
    for part in parts[1:]:
        _, names = np.unique(names * (int(part.max(initial=0)) + 1) + part, return_inverse=True)
    return names + 1


def _named_runs(symbols: np.ndarray, length: int) -> np.ndarray:
    """Order-preserving numbers of the ``length`` symbols from each place on; beyond the end there are zeros."""

    def shifted(names: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        if by < len(names):
            out[: len(names) - by] = names[by:]
        return out

    names, reach = symbols.astype(np.int64), 1
    while reach * 2 <= length:
        names = _named(names, shifted(names, reach))
        reach *= 2
    if reach < length:  # the last step may overlap
        names = _named(names, shifted(names, length - reach))
    return names


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit per level, highest bit first."""

    def __init__(self, sequence: np.ndarray):
        self.levels: list[Bits] = []
        self.height = max(1, int(sequence.max(initial=0)).bit_length())
        for level in range(self.height - 1, -1, -1):
            bits = (sequence >> level) & 1 == 1
            self.levels.append(Bits(bits))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.first: np.ndarray | None = None

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``at`` ends within the symbol's part of the lowest level."""
        for level, bits in zip(range(self.height - 1, -1, -1), self.levels, strict=True):
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, at - ones)
        return at


class FmIndex:
    """Counts runs of ``window`` words in sequences of word numbers."""

    def __init__(self, sequences: list[np.ndarray], window: int):
        self.window = window
        self.group = max(d for d in range(1, 9) if window % d == 0)
        steps = window // self.group
        sizes = np.array([len(s) for s in sequences], np.int64)
        words = np.concatenate([np.append(s.astype(np.int64) + 1, 0) for s in sequences])  # 0 ends a sequence
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        within = np.arange(len(words)) - starts[of]
        whole = within + self.group <= sizes[of]  # places where a symbol of ``group`` words begins
        place = np.flatnonzero(whole)
        names = np.zeros(len(words), np.int64)
        _, names[place] = np.unique(_named_runs(words, self.group)[place], return_inverse=True)
        names[place] += 1
        # sequences of symbols at every offset, each ended by a 0
        offset = within[place] % self.group
        order = np.lexsort([within[place], offset, of[place]])
        place, offset = place[order], offset[order]
        new = np.concatenate([[True], (of[place][1:] != of[place][:-1]) | (offset[1:] != offset[:-1])]) if len(place) else np.empty(0, bool)
        at = np.arange(len(place)) + np.cumsum(new)
        self.text = np.zeros(len(place) + int(new.sum()) + 1, np.int64)
        self.text[at] = names[place]
        self.at = np.full(len(words), -1, np.int64)  # place in ``text`` of the symbol that begins at a word
        self.at[place] = at
        self.starts, self.sizes, self.steps = starts, sizes, steps
        suffixes = np.argsort(_named_runs(self.text, steps), kind="stable")
        self.bwt = WaveletMatrix(self.text[suffixes - 1])
        counts = np.bincount(self.text, minlength=int(self.text.max(initial=0)) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        symbols = np.arange(len(counts))
        self.first = self.bwt.down(symbols, np.zeros(len(symbols), np.int64))

    def repeated(self, sequence_numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams sequences through the index: (number of sequence, start) of every run that occurs more than once.

        Backward search goes from the last symbol of each run to the first; a run is given up as soon as what was
        matched occurs only once, so the matched lengths are matching statistics cut off at the window.
        """
        runs = np.maximum(self.sizes[sequence_numbers] - self.window + 1, 0)
        number = np.repeat(sequence_numbers, runs)
        start = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
        head = self.at[self.starts[number] + start]
        symbol = self.text[head + self.steps - 1] if len(head) else head
        low, high = self.before[symbol], self.before[symbol + 1]
        for step in range(self.steps - 2, -1, -1):
            going = high - low > 1
            number, start, head, low, high = number[going], start[going], head[going], low[going], high[going]
            symbol = self.text[head + step]
            shift = self.before[symbol] - self.first[symbol]
            low, high = shift + self.bwt.down(symbol, low), shift + self.bwt.down(symbol, high)
        going = high - low > 1
        return number[going], start[going]


def repeated_starts(spans: list[list[str]], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each span of words the starts of its runs of ``window`` words that occur more than once in all.

    A span stands for as many equal ones as ``copies`` says.
    """
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in span], np.int64) for span in spans]
    out = [np.arange(max(0, len(s) - window + 1)) if c > 1 else np.empty(0, np.int64) for s, c in zip(coded, copies, strict=True)]
    single = np.flatnonzero(copies == 1)
    if not coded or not len(single):
        return out
    number, start = FmIndex(coded, window).repeated(single)
    cuts = np.searchsorted(number, single)
    for i, lo, hi in zip(single.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(number)], strict=True):
        out[i] = start[lo:hi]
    return out
