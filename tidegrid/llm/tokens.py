"""Token ids and token counts of whole texts with a public tokenizer.

Only the tokenizers (or sentencepiece) library makes ids. Two things are put in front of it: texts are cut at safe
boundaries, and each distinct piece is encoded once per batch instead of once per occurrence.

A cut is safe where it cannot change an id. For the tokenizers file used here, a blank or a line feed is: the file
drops white space before it merges anything, no token spans it, and Unicode composition does not reach across it.
Inside a piece, the step from Latin letters to closing marks is safe as well, since the file always parts the two.
Other files are encoded as whole texts.
"""

from __future__ import annotations

import array
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: letters and closing marks whose lower case and composition are the same in every Unicode version
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: how the byte-level step spells letters beyond ASCII: the bytes of 0xA1 to 0xFF but 0xAD stand for themselves, 0x80 to
#: 0xA0 and 0xAD for the characters from U+0122 on
_SPELT = {
    c: "".join(chr(0x122 + b - 0x80) if b <= 0xA0 else "\u0143" if b == 0xAD else chr(b) for b in chr(c).encode())
    for c in range(0xC0, 0x100)
}
#: a control character that stands between pieces handed over in one string
_BETWEEN = "\x01"
#: fixed value: the pattern by which such a file parts its texts
_PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LONG = 64
_PIECES_A_CALL = 2_000


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_at_blanks(path: str) -> bool:
    """Whether a file is one that drops white space before it merges and lower-cases: read from its own description.

    It must turn white space into blanks and lower-case after composing, and split off runs of letters, single digits and
    runs of other marks while dropping what lies between.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": r"\s+"}
        and steps[1].get("content") == " "
        and [s.get("type") for s in before] == ["Split", "ByteLevel"]
        and before[0].get("pattern") == {"Regex": _PARTED}
        and (before[0].get("behavior"), before[0].get("invert")) == ("Removed", True)
        and not before[1].get("add_prefix_space")
    )


class PieceEncoder:
    """Ids of texts for a ``.json`` file whose tokens never span white space, as packed 32-bit integers."""

    def __init__(self, path: str, limit: int = 200 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.forget()
        (self.between,) = self._plain(_BETWEEN)
        self.word_ids = self.tokenizer.model.tokenize

    def forget(self) -> None:
        self.known, self.held = {"": b""}, 0

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, pieces: list[str]) -> None:
        calls = [
            "".join(f"{p} {_BETWEEN} " for p in pieces[i : i + _PIECES_A_CALL])
            for i in range(0, len(pieces), _PIECES_A_CALL)
        ]
        done = iter(pieces)
        for encoding in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            packed, start = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == self.between) * 4).tolist():
                self.known[next(done)] = packed[start:end]
                start = end + 4
        self.held += 200 * len(pieces) + sum(map(len, pieces))

    def _encode_words(self, words: list[str]) -> None:
        """Lower-case Latin words: nothing is left to normalise or to part, so they go to the file's model as they are."""
        known, word_ids = self.known, self.word_ids
        for word in words:
            spelt = word if word.isascii() else word.translate(_SPELT)
            known[word] = array.array("I", [t.id for t in word_ids(spelt)]).tobytes()
        self.held += 200 * len(words) + sum(map(len, words))

    def learn(self, pieces: set[str]) -> list[str]:
        """Make every piece known; the table is emptied first when it has grown past its bound in bytes.

        Returns the pieces that are too long to be kept after this call.
        """
        if self.held > self.limit:
            self.forget()
        known = self.known
        new, words, parts, odd = [], [], {}, []
        for piece in pieces.difference(known):
            if len(piece) <= _LONG and piece.isascii() and piece.isalpha() and piece.islower():
                words.append(piece)
            elif _BETWEEN in piece or len(piece) > _LONG:
                odd.append(piece)
            elif (m := _LATIN.fullmatch(piece)) is None:
                new.append(piece)
            elif (letters := m[1].lower()) == piece:
                words.append(piece)
            else:
                parts[piece] = letters, m[2]
        new += {marks for _, marks in parts.values()}.difference(known)
        self._encode(new)
        self._encode_words(words)
        self._encode_words(list({letters for letters, _ in parts.values()}.difference(known)))
        for piece in odd:
            known[piece] = np.array(self._plain(piece), "<u4").tobytes()
        for piece, (letters, marks) in parts.items():
            known[piece] = known[letters] + known[marks]
        self.held += 200 * len(parts)
        return odd

    @staticmethod
    def _plain_case(text: str) -> str:
        """Lower case where that changes no id: Latin letters only, and nothing that could be a special string."""
        if "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._plain_case(t or "").replace("\n", " ").split(" ") for t in texts]
        odd = self.learn(set(itertools.chain.from_iterable(cut)))
        get = self.known.__getitem__
        ids = [b"".join(map(get, pieces)) for pieces in cut]
        for piece in odd:
            del self.known[piece]
        return ids


def _whole_texts(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """Encoder for files without known safe boundaries."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [np.array(x, "<u4").tobytes() for x in model.encode([t or "" for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [
        np.array(x.ids, "<u4").tobytes()
        for x in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    ]


_encoders: dict[str, Callable[[list[str | None]], list[bytes]]] = {}


def encoder(name: str) -> Callable[[list[str | None]], list[bytes]]:
    """The encoder of a vocabulary file, kept for the life of the Python worker."""
    if name not in _encoders:
        path = tokenizer_path(name)
        _encoders[name] = PieceEncoder(path) if parts_at_blanks(path) else _whole_texts(path)
    return _encoders[name]


def forget(name: str) -> None:
    """Give the pieces that the encoder remembers back, for tasks after which the worker does other work."""
    if isinstance(_encoders.get(name), PieceEncoder):
        _encoders[name].forget()


def token_counts(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens, over_limit.

    Arrow batches are cut into slices of about equal bytes; each slice is one batch for the library, with texts split
    at safe boundaries; only lengths leave the function. No row is moved between tasks.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results. A null doc_id stays null. An
    empty table gives an empty result. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part, texts in text_slices(batches):
            n = np.fromiter((len(b) // 4 for b in encode(texts)), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"],
                    pc.fill_null(pc.binary_length(part["text"]), 0).cast(pa.int64()),
                    pa.array(n),
                    pa.array(n > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
