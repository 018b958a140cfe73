"""Latin words go to the file's model without the steps that do nothing to them."""

import numpy as np
import pytest

from tidegrid.llm import binary_ids, tokens


def test_latin_words_skip_the_steps_before_the_model(monkeypatch):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    encode, seen = tokens.PieceEncoder(path), []
    plain = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda pieces: (seen.extend(pieces), plain(pieces)))
    texts = ["Harbour, cióníjañ laéanleç; ÀÿÖ straße", "ab1c harbour", None]
    texts += [chr(c) + chr(d) for c in range(0xC0, 0x100) for d in (0xC0, 0xE0, 0xED, 0xFF) if c not in (0xD7, 0xF7)]
    want = [np.array(encode.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want
    assert set(seen) == {",", ";", "ab1c"}


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 1500])
def test_words_take_as_many_ids_as_fit(n):
    ids = np.random.default_rng(n).integers(0, 3, n).astype("<u4")
    ids[:: 97] = 40_000
    words, n_words, escapes, n_escapes, width = binary_ids.encode_blocks(ids)
    ends = np.cumsum(n_words)
    assert np.array_equal(binary_ids.decode_blocks(words, ends, escapes, width, n), ids)
    at, greedy = 0, []
    slots, bits = binary_ids.SLOTS.tolist(), binary_ids.BITS.tolist()
    for b, end in enumerate(range(512, n + 512, 512)):
        limit = (1 << int(width[b])) - 1
        kept, at, used = np.minimum(ids[at : min(end, n)], limit).tolist(), min(end, n), 0
        while kept:
            s = next(s for s in range(2, 16) if all(v < (1 << bits[s]) - (bits[s] < width[b]) for v in kept[: slots[s]]))
            kept, used = kept[slots[s] :], used + 1
        greedy.append(used)
    assert n_words.tolist() == greedy


def test_a_plain_word_is_held_once():
    encode = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    (ids,) = encode(["harbour Zürich harbour"])
    assert ids == np.array(encode._plain("harbour Zürich harbour"), "<u4").tobytes()
    assert encode.held == 2 * 200 + len("harbourzürich")
