from __future__ import annotations

import numpy as np
import pytest

from perigee.llm import fmindex


def plain(text, items, width=10):
    words = fmindex.words_of(None if text is None else text.encode())
    hit, found = set(), set()
    for item, phrase in items:
        for window in fmindex.windows(fmindex.words_of((phrase or "").encode()), width):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.update({item} - {None})
    return len(words), len(hit), sorted(found)


def test_suffix_order_and_index():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 1), (50, 2), (400, 3), (300, 60)):
        sequence = np.concatenate((rng.integers(1, symbols + 1, n), [0]))
        order = fmindex.suffix_order(sequence)
        assert order.tolist() == sorted(range(len(sequence)), key=lambda i: sequence[i:].tolist())
        index = fmindex.FMIndex(sequence, symbols)
        rows = rng.integers(1, symbols + 1, (30, 3))
        lengths = rng.integers(1, 4, 30)
        low, high = index.ranges(rows, lengths)
        for k in range(30):
            phrase = rows[k, : lengths[k]].tolist()
            places = [i for i in range(len(sequence)) if sequence[i : i + len(phrase)].tolist() == phrase]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == places


@pytest.mark.parametrize("block_words", [3, 1 << 20])
def test_spans_against_a_loop(spark, awkward, monkeypatch, block_words):
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 50)
    rng = np.random.default_rng(2)
    words = ["red", "blue", "Ünder", "9", "sea"]
    draw = lambda n: " ".join(rng.choice(words, n))
    items = [(1, draw(12)), (2, draw(14)), (3, "red, BLUE"), (4, ""), (5, None), (6, "one two three four five six seven one two three four"), (1, draw(11)), (None, draw(10)), (8, draw(25))]
    texts = [(100 + k, draw(30) + "\n" + (items[k % 3][1] or "") + ". " + draw(5)) for k in range(20)]
    texts += [(200, draw(20) + " " + items[7][1]), (201, draw(400) + " " + items[8][1])]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").unionAll(awkward.select("doc_id", "text")).selectExpr("*", "'x' AS hit_spans", "'y' AS n_words")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = fmindex.contaminated_spans(docs, bench, block_words=block_words).select("doc_id", "text", "n_words", fmindex.n_hit().alias("n"), "hit_items").collect()
    for r in got:
        assert (r["n_words"], r["n"], r["hit_items"]) == plain(r["text"], items)
    assert len(got) == docs.count() and sum(r["n"] > 0 for r in got) > 10


def test_a_long_run_is_cut(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 7)
    items = [(k, " ".join(f"w{i % 13}" for i in range(k, k + 11))) for k in range(13)] + [(99, "w3 w4")]
    texts = [(n, " ".join(f"w{i % 13}" for i in range(n))) for n in (5, 9, 10, 16, 17, 18, 40, 41)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for r in fmindex.contaminated_spans(docs, spark.createDataFrame(items, "item_id bigint, text string")).select("text", "n_words", fmindex.n_hit().alias("n"), "hit_items").collect():
        assert (r["n_words"], r["n"], r["hit_items"]) == plain(r["text"], items)


@pytest.mark.parametrize("kind", ["smallint", "string", "date", "decimal(10,2)"])
def test_item_ids_of_any_type(spark, kind):
    value = "2020-01-0" if kind == "date" else ""
    bench = spark.sql(f"SELECT CAST('{value}1' AS {kind}) AS item_id, 'a b' AS text UNION ALL SELECT CAST('{value}2' AS {kind}), 'b c'")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert fmindex.contaminated_spans(docs, bench).selectExpr("size(hit_items)", "hit_items[0] < hit_items[1]").first() == (2, True)


def test_empty_tables(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert fmindex.contaminated_spans(nothing, bench).count() == 0
    assert {r["hit_items"] == [] for r in fmindex.contaminated_spans(awkward, bench.where("false")).collect()} == {True}


def test_removal():
    assert fmindex.without_spans("Keep this, drop that one. Keep!", [(2, 5)]) == "Keep this, . Keep!"
    assert fmindex.merged([5, 0, 3], [7, 3, 4]) == [(0, 4), (5, 7)]
