from __future__ import annotations

import math
import random

import numpy as np
import pytest
from perigee.llm.vector_codes import Codebooks, compress, label_errors, reconstructed

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def slow(rows, parts, entries, rounds):
    """Codes by comparing every part with every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda v: [min((gap(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))]
    for _ in range(rounds):
        codes = [code(v) for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(kept, codes, strict=True) if c[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    return sorted((i is None, i or 0, [k for _, k in code(v)], [d for d, _ in code(v)]) for i, v, _ in kept), books


def random_rows(count, size, seed=5):
    draw = random.Random(seed)
    return [(draw.randrange(count), [round(draw.gauss(0, 1), 2) for _ in range(size)], draw.randrange(4)) for _ in range(count)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (2, 64, 2), (8, 3, 0)])
def test_codes_equal_comparing_all_entries(spark, parts, entries, rounds):
    rows = random_rows(150, 16)
    coded, books = compress(spark.createDataFrame(rows, SCHEMA), parts=parts, entries=entries, rounds=rounds)
    want, want_books = slow([(i, np.float32(v).tolist(), x) for i, v, x in rows], parts, entries, rounds)
    assert [[tuple(e) for e in book] for book in books.entries.tolist()] == want_books
    assert sorted((r["id"] is None, r["id"] or 0, r["codes"], r["errors"]) for r in coded.collect()) == want


def test_search_is_exact_with_ties_and_equal_sums():
    draw = np.random.default_rng(2)
    entries = draw.integers(-2, 3, (3, 40, 4))
    entries[:, 20:] = entries[:, :20]  # ties go to the lower number
    values = draw.integers(-3, 4, (500, 12))
    entry, away = Codebooks(entries).nearest(values)
    gaps = ((values.reshape(500, 3, 1, 4) - entries) ** 2).sum(3)
    assert (entry == gaps.argmin(2)).all() and (away == gaps.min(2)).all()
    large = Codebooks(entries * (1 << 22)).nearest(values * (1 << 22))
    assert (large[0] == entry).all() and (large[1] == away << 44).all()


def test_rows_that_are_no_vectors_and_empty_tables(spark):
    rows = [(1, [0.5] * 4, None), (1, [0.5] * 4, None), (None, [1.0] * 4, 3), (3, None, 1), (4, [], 1), (5, [1.0, None, 1.0, 1.0], 1)]
    rows += [(6, [float("nan")] * 4, 1), (7, [float("inf"), 0.0, 0.0, 0.0], 1), (8, [1.0] * 8, 1), (9, [3e38, 0.0, 0.0, -3e38], None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS id", "'clash' AS codes", "1 AS whole")
    coded, books = compress(frame, parts=2)
    got = {(r["id"], r["label"]): r for r in label_errors(coded).collect()}
    assert set(got) == {(1, None), (None, 3), (9, None)} and coded.count() == 4
    assert books.entries.max() == 1 << 24
    # two rounds with one entry a kept row: each stands on its own mean
    assert all(r["error"] == 0 and r["label_error"] == 0 for r in got.values())
    empty, none = compress(frame.where("vec_id > 100"), parts=2)
    assert none is None and empty.count() == 0 and label_errors(empty).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        compress(frame, parts=3)


def test_label_errors_sum_equal_labels_nulls_together(spark):
    coded, _ = compress(spark.createDataFrame([(i, [float(i % 7), 1.0], None if i % 3 else i % 2) for i in range(60)], SCHEMA), parts=1, entries=2)
    rows = label_errors(coded).collect()
    for row in rows:
        assert row["label_error"] == sum(r["error"] for r in rows if r["label"] == row["label"])


def test_codes_give_the_vectors_back_within_their_errors(spark):
    coded, books = compress(spark.createDataFrame(random_rows(80, 8), SCHEMA), parts=4, entries=80)
    for row in reconstructed(coded, books).collect():
        assert len(row["vector"]) == 8
