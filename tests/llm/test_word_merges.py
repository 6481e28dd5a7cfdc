from __future__ import annotations

import json
import random

import numpy as np
import pytest
from perigee.llm import word_merges
from perigee.llm.word_merges import BYTES, Encoder, Vocabulary, decode, encode
from tests_llm_rows import long_text  # noqa: I001
from tokenizers import Tokenizer

PATH = "/opt/tokenizers/word_bpe_49k.json"
TEXTS = [
    "",
    " \t\n",
    "Hello <|endoftext|>World<|startoftext|>\n\n it's IT'S we'll",
    "<|endoftext|>",
    "aaaa aaaaaaa" * 50 + "a" * 4000,
    "ΣΑΣ ΟΔΟΣ İstanbul élève ﬁ 🙂🙂 12345 日本語日本語",
    "new letters Ᲊ \U000105c0 ՘ Σ",
    "\x00\x1f\x85  odd spaces　here",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(PATH)


def encoded(vocabulary, texts):
    ids, sizes = Encoder(vocabulary).encode(iter([t if t is None else t.encode() for t in texts]))
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]


def test_ids_and_decoding_equal_the_library(library, vocabulary):
    got = encoded(vocabulary, TEXTS)
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert vocabulary.decode(np.array(ids, int)).decode() == library.decode(ids, skip_special_tokens=False)


def test_every_tenth_code_point_is_cut_as_the_library_does(library, vocabulary):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(3, 0x110000, 10) if not 0xD800 <= c < 0xE000]
    assert encoded(vocabulary, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_rounds_equal_joining_one_pair_at_a_time(vocabulary):
    """A loop that joins the lowest pair of one word, leftmost first, again and again."""
    ranks = {(int(k) // vocabulary.size, int(k) % vocabulary.size): int(r) for k, r in zip(vocabulary.keys, vocabulary.ranks, strict=True)}

    def slow(word):
        symbols = [*vocabulary.inner[list(word[:-1])], vocabulary.last[word[-1]]] if word else []
        while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]:
            rank, i = min(found)
            symbols[i : i + 2] = [vocabulary.made[rank]]
        return symbols

    draw = random.Random(3)
    words = [bytes(draw.choice(b"aabbehinrst\xc3\xa9") for _ in range(draw.randint(1, 40))) for _ in range(300)] + [b"a" * n for n in range(1, 20)]
    ids, sizes = vocabulary.merged(words)
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == [slow(w) for w in words]


def test_chunks_do_not_change_the_ids(monkeypatch, library, vocabulary):
    monkeypatch.setattr(word_merges, "CHUNK_WORDS", 7)
    monkeypatch.setattr(word_merges, "CHUNK_CHARS", 16)
    texts = [*TEXTS, long_text(3000)]
    assert encoded(vocabulary, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_vocabularies_that_rounds_do_not_fit_are_refused():
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    merges = spec["model"]["merges"]
    late = next(k for k, (a, b) in enumerate(merges) if len(a) > 1)
    spec["model"]["merges"] = [merges[late], *merges[:late], *merges[late + 1 :]]
    with pytest.raises(ValueError, match="later merge"):
        Vocabulary(spec)


def test_awkward_rows(awkward, nothing, library):
    made = decode(encode(awkward.selectExpr("*", "'clash' AS ids", "'clash' AS decoded"), PATH), PATH)
    assert made.columns[-3:] == ["n_tokens", "ids", "decoded"] and "rank" in made.columns
    rows = made.collect()
    assert len(rows) == awkward.count()
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert (row["n_tokens"], row["ids"]) == (len(ids), ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    packed = encode(awkward, PATH, ids_as=BYTES).select("text", "ids").collect()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids for r in packed)
    assert decode(encode(nothing, PATH), PATH).count() == 0


def test_the_text_column_may_have_the_name_of_a_result(spark, library):
    frame = spark.createDataFrame([("two words",)], "ids string")
    assert encode(frame, PATH, text_col="ids").first()["ids"] == library.encode("two words", add_special_tokens=False).ids
