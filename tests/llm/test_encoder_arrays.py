from __future__ import annotations

import random
import re

import numpy as np
import pytest
from perigee.llm import piece_lattice
from perigee.llm.queries import MODEL

MARK = piece_lattice.SPACE
PLAIN = [("<unk>", 0, 2), (MARK, -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1)]
WITH_BYTES = [*PLAIN, *[(f"<0x{b:02X}>", -6, 6) for b in range(256)]]


def test_new_chunks_are_worked_on_together(monkeypatch):
    """No call a chunk: these took most of the CPU seconds."""
    calls = []
    one = piece_lattice.Encoder._packed
    monkeypatch.setattr(piece_lattice.Encoder, "_packed", lambda self, chunk, *found: calls.append(chunk) or one(self, chunk, *found))
    pieces = piece_lattice.Pieces.load(MODEL)
    text = " ".join(f"word{k}" for k in range(3000)) + " " + "x" * 60
    scores, sizes, ids, _, back = piece_lattice.Encoder(pieces).encode_all([text])
    assert calls == [" " + "x" * 60]
    assert pieces.decode(ids.tolist()) == text and back == [True] and sizes.tolist() == [len(ids)]
    assert scores == [sum(pieces.best(MARK + word)[0] for word in text.split(" "))]


def test_cuts_are_those_of_the_pattern():
    draw = random.Random(3)
    texts = ["", " ", "\n", MARK, "a \n\n  b", *("".join(draw.choice(f"ab  \n\t{MARK}é🙂") for _ in range(draw.randrange(30))) for _ in range(500))]
    chunks, many = piece_lattice._chunks(texts)
    want = [re.findall(" +[^ \n]*|\n|[^ \n]+", " " + t.replace(MARK, " ")) if t else [] for t in texts]
    assert chunks.to_pylist() == [c for several in want for c in several] and many.tolist() == list(map(len, want))
    assert [len(x) for x in piece_lattice._chunks([])] == [0, 0]


@pytest.mark.parametrize("model", [PLAIN, WITH_BYTES, PLAIN[:1]])
@pytest.mark.parametrize("remembered", [piece_lattice.REMEMBERED, 3])
def test_characters_that_are_no_piece(monkeypatch, model, remembered):
    monkeypatch.setattr(piece_lattice, "REMEMBERED", remembered)
    pieces = piece_lattice.Pieces(model)
    encoder = piece_lattice.Encoder(pieces)
    texts = ["ab ba", "aé 🙂b", "", "é\nab", " ab" * 30, "\x00", "é" * 50, "ab"] * 2
    scores, sizes, ids, _, back = encoder.encode_all(texts)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for text, score, part, right in zip(texts, scores, parts, back, strict=True):
        chunks = re.findall(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+", MARK + text.replace(" ", MARK)) if text else []
        want = [pieces.best(c) for c in chunks]
        assert part.tolist() == [i for _, _, several in want for i in several]
        assert score == pytest.approx(sum(s for s, _, _ in want))
        assert right == all(pieces.content_of(w[2]) == c.replace(MARK, " ") for c, w in zip(chunks, want, strict=True))


def test_other_ids_do_not_decode_to_the_chunks():
    pieces = piece_lattice.Pieces(WITH_BYTES)
    text, lengths = " ab" + "é" + "a" + "b", np.array([3, 1, 1, 1])
    ids = [1, 4, pieces.bytes_[0xC3], pieces.bytes_[0xA9], 3, 4]
    alike = pieces.decoded_alike(text, lengths, np.array([2, 2, 1, 1]), np.array(ids))
    assert alike.tolist() == [True, True, False, False]
