from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from perigee.llm.hybrid_search import Shard, search, walk
from tests_llm_rows import long_text

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(documents, items, top=20):
    """Every document's score for every item."""
    held = [(i, Counter(t), len(t)) for i, text in documents if (t := terms(text))]
    n, every = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        scores = []
        for doc, counts, size in held:
            m = 100 - 25 + ((25 * size * n) // every)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, documents, items, **options):
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").selectExpr("*", "1 AS id", "'x' AS terms")
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS item", "'x' AS number")
    return sorted(map(tuple, search(docs, asked, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_postings": 300, "block_chars": 90}, {"top": 3, "shard_postings": 1}])
def test_ranking_equals_scoring_every_document(spark, options):
    draw = random.Random(4)
    documents = [(draw.randrange(200), long_text(draw.randrange(60), seed=k % 90, vocabulary=60)) for k in range(300)]
    items = [(k, long_text(draw.randrange(1, 25), seed=1000 + k, vocabulary=60)) for k in range(8)]
    assert found(spark, documents, items, **options) == slow(documents, items, options.get("top", 20))


def test_awkward_documents_and_items(spark, awkward):
    documents = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    items = [(1, "The CAT, the mat."), (1, "The CAT, the mat."), (1, "wörd hund"), (2, None), (3, " ?! "), (None, "one two"), (4, "nowhere"), (5, "x" * 30_000)]
    assert found(spark, documents, items) == slow(documents, items)


def test_empty_tables_give_no_rows(spark):
    assert found(spark, [], [(1, "cat")]) == [] and found(spark, [(1, "cat")], []) == []
    assert found(spark, [(1, None), (2, "?")], [(1, "cat")]) == []
    assert found(spark, [(1, "dog")], [(1, "cat")]) == []


def test_equal_scores_rank_by_id_and_copies_count_each(spark):
    documents = [(k % 40, "the same words") for k in range(80)] + [(100, "other text")] * 30
    rows = found(spark, documents, [(1, "same words")], shard_postings=7)
    assert [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[1])] == [(k + 1, k // 2) for k in range(20)]


def test_short_lists_walked_as_one_list_lose_nothing():
    draw = np.random.default_rng(8)
    size, n_terms = 20_000, 30
    counts = [int(size * 0.6 / (k + 1) ** 1.5) + 1 for k in range(n_terms)]
    documents = [np.sort(draw.choice(size, c, replace=False)) for c in counts]
    flat = np.repeat(np.arange(n_terms), counts)
    scores = draw.integers(1, 50, sum(counts))
    shard = Shard(flat, np.concatenate(documents), scores, size, n_terms)
    for _ in range(20):
        query = [(int(t), int(draw.integers(0, 9))) for t in draw.choice(n_terms, 12, replace=False)]
        sums = np.zeros(size, np.int64)
        for term, weight in query:
            ids, values = shard.list_of(term, weight)
            sums[ids] += values
        order = np.lexsort((np.arange(size), -sums))[:20]
        order = order[sums[order] > 0]
        got, values = shard.best(query, 20)
        assert got.tolist() == order.tolist() and values.tolist() == sums[order].tolist()


def test_walk_asks_lists_that_cannot_bring_in_a_document():
    many = (np.arange(100_000), np.ones(100_000, np.int64))
    few = (np.array([5, 70_000, 99_999]), np.array([10, 30, 20]))
    got, scores = walk([many, few], 100_000, 2)
    assert (got.tolist(), scores.tolist()) == ([70_000, 99_999], [31, 21])
