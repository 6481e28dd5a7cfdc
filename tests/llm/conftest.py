"""Rows with every awkward case, and the session's shared folder."""

from __future__ import annotations

import pytest

ROWS = [
    (1, "The cat sat on the mat and the dog lay by the door all day long", "en"),
    (2, "The cat sat on the mat and the dog lay by the door all day long", "en"),
    (2, "The cat sat on the mat and the dog lay by the door all day long", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n ", "de"),
    (None, "kein Hund und keine Katze ist heute im Garten zu sehen", "de"),
    (7, "12 345 ###", None),
    (8, "wörd ﬁ 🙂\n\nline two\n" * 40, "de"),
    (9, "x" * 30_000, None),
    (10, "one two three four five six seven\n" * 900, "en"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, copies, and columns that clash."""
    schema = "doc_id bigint, text string, lang string"
    extra = ["id", "fp", "fingerprint", "key", "digest", "found", "blob", "page", "score", "n_words", "hit_items", "line", "rank", "order", "start"]
    frame = spark.createDataFrame(ROWS, schema)
    return frame.selectExpr("*", *[f"'clash' AS `{name}`" for name in extra])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
