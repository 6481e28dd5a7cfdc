from __future__ import annotations

import itertools
import random

import pytest

from perigee.llm import piece_lattice
from perigee.llm.queries import MODEL

SMALL = [("<unk>", 0, 2), ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("▁a", -2.5, 1), ("ba", -4.25, 1), ("aba", -7, 1), ("▁▁", -3.25, 1)]


def every_path(pieces, text):
    """All segmentations of the marked text with their scores."""
    if not text:
        return [(0.0, ())]
    out = []
    for size in range(1, len(text) + 1):
        arc = pieces.arcs.get(text[:size]) or (pieces.fallback(text[0]) if size == 1 else None)
        if arc:
            out += [(arc[0] + s, arc[1] + ids) for s, ids in every_path(pieces, text[size:])]
    return out


def applied(ids, edits):
    out, at = [], 0
    for e in edits:
        out += ids[at : e["at"]] + e["ids"]
        at = e["at"] + e["n"]
    return out + ids[at:]


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_n_best_against_all_paths(n):
    pieces = piece_lattice.Pieces(SMALL)
    for words in itertools.product(["a", "ab", "abab", "", "xa\nb"], repeat=3):
        text = " ".join(words)
        if not text:
            continue
        marked = ("▁" + text).replace(" ", "▁")
        paths = sorted(every_path(pieces, marked), key=lambda x: -x[0])
        score, ids, more = piece_lattice.Encoder(pieces, n).encode(text)
        scores = [score] + [m["score"] for m in more]
        assert scores == pytest.approx([s for s, _ in paths[:n]])
        found = [tuple(ids)] + [tuple(applied(ids, m["edits"])) for m in more]
        assert len(set(found)) == len(found)
        by = {}
        for s, p in paths:
            by.setdefault(p, []).append(s)
        for s, p in zip(scores, found, strict=True):
            assert any(abs(s - x) < 1e-9 for x in by[p])


def test_real_pieces_round_trip():
    pieces = piece_lattice.Pieces.load(MODEL)
    encoder = piece_lattice.Encoder(pieces)
    for text in ("Hello  wörld\n🙂x  ", " lead", "\n\n", "a\tb　c ﬁ", "x" * 5000, "日本語のテキスト", " "):
        score, ids, more = encoder.encode(text)
        assert pieces.decode(ids) == text
        for other in more:
            assert pieces.decode(applied(ids, other["edits"])) == text
            assert other["score"] <= score


def test_pieces_that_cross_chunks_are_refused():
    with pytest.raises(ValueError):
        piece_lattice.Pieces([("a▁b", -1, 1)])


def test_awkward(awkward, nothing):
    rows = piece_lattice.encode(awkward, MODEL).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        if r["text"] is None:
            assert (r["ids"], r["score"], r["n_pieces"], r["round_trip"]) == (None, None, 0, None)
        else:
            assert r["round_trip"] and r["n_pieces"] == len(r["ids"])
    assert piece_lattice.encode(nothing, MODEL).count() == 0


def test_many_chunks_at_once_equal_one_at_a_time():
    draw = random.Random(2)
    pieces = piece_lattice.Pieces(SMALL)
    chunks = ["".join(draw.choice("ab▁x") for _ in range(draw.randrange(1, 9))) for _ in range(300)] + ["a" * 40]
    real = piece_lattice.Pieces.load(MODEL)
    words = ["▁" + "".join(draw.choice("etaoinshé🙂ツ") for _ in range(draw.randrange(12))) for _ in range(400)] + ["\n", "▁▁▁▁"]
    for model, several in ((pieces, chunks), (real, words)):
        for chunk, (score, loss, ids) in zip(several, model.best_of(several), strict=True):
            want = model.best(chunk)
            assert (score, loss) == pytest.approx(want[:2]) and ids == want[2]
    assert pieces.best_of([]) == []


def test_texts_together_equal_texts_alone(monkeypatch):
    pieces = piece_lattice.Pieces.load(MODEL)
    texts = ["one two two", "", "x" * 300, "a ▁ b\n\n", "one  two"]
    scores, sizes, ids, more, back = piece_lattice.Encoder(pieces).encode_all(texts)
    ends = [0, *itertools.accumulate(sizes.tolist())]
    alone = [piece_lattice.Encoder(pieces).encode(t) for t in texts]
    assert [(s, ids[a:b].tolist(), m) for s, a, b, m in zip(scores, ends[:-1], ends[1:], more, strict=True)] == alone
    assert back == [True] * 5
    monkeypatch.setattr(piece_lattice, "TOGETHER", 4)
    held = list(piece_lattice._together(iter([b"ab", None, b"cdef", b"g"])))
    assert held == [["ab", None, "cdef"], ["g"]]
