from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import byte_cnn
from perigee.llm.shared import smallest

DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.read.parquet(DATA)
    return byte_cnn.train(byte_cnn.sample(docs, ~byte_cnn.held_out("doc_id"), "text", "lang", "doc_id", 60))


def test_tables_equal_the_convolution(network):
    text = "Ein kurzer Text für die Probe. ".encode() * 9
    windows = byte_cnn.cut(text)
    best = np.full((len(windows), 48), -np.inf)
    for w, width in enumerate(byte_cnn.WIDTHS):
        for row, window in enumerate(windows):
            for i in range(byte_cnn.LENGTH - width + 1):
                value = sum(network.filters[width][k][window[i + k]] for k in range(width))
                best[row, 16 * w : 16 * w + 16] = np.maximum(best[row, 16 * w : 16 * w + 16], value)
    scores = np.maximum(best + network.bias, 0) @ network.weights + network.offset
    expected = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert np.allclose(network.scores(windows), expected, atol=1e-4)


def test_sample_takes_the_smallest_hashes_and_windows_of_the_whole_text(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 'x', 'y') AS label", "xxhash64(id) AS order")
    rows = rows.unionAll(rows.where("id = 7")).unionAll(spark.createDataFrame([(1, "z", 5)], rows.schema))
    got = {(r["label"], r["id"], r["order"]) for r in smallest(rows, "label", "order", 50).collect()}
    every = sorted((r["label"], r["order"], r["id"]) for r in rows.collect())
    for label in "xyz":
        mine = [(label, i, o) for x, o, i in every if x == label]
        kept = [r for r in mine if r in got]
        assert len(kept) >= min(50, len(mine)) and set(mine[:50]) <= got and len(kept) <= 60
    with pytest.raises(ValueError):
        smallest(rows, "label", "order", 50, most_groups=1)
    text = "a" * 500 + "m" * 500 + "z" * 500
    docs = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, "short", "de"), (None, "é" * 300, "de")], "doc_id bigint, text string, lang string")
    found = byte_cnn.sample(docs, F.lit(True), "text", "lang", "doc_id", 5)
    assert sorted(w[:1] for w, label in found if label == "en") == [b"a", b"a", b"m", b"m", b"z", b"z"]
    assert all(0 < len(w) <= byte_cnn.LENGTH for w, _ in found) and (b"short", "de") in found
    assert len(byte_cnn.sample(docs, F.lit(True), "text", "lang", "doc_id", 1)) == 3 + 1


def test_windows_hold_the_whole_text():
    text = bytes(range(97, 123)) * 40
    assert byte_cnn.cut(text).tobytes().rstrip(b"\0") == text


def test_batches_do_not_matter(network):
    texts = [b"the house and the tree " * k for k in (1, 700, 3)] + [None, b"das Haus und der Baum"]
    together = byte_cnn.predict(network, texts)
    for (label, score), text in zip(together, texts, strict=True):
        one, value = byte_cnn.predict(network, [text])[0]
        assert (label, round(score, 5)) == (one, round(value, 5))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = byte_cnn.identify(docs).where(byte_cnn.held_out("doc_id"))
    share, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and share > 0.97


def test_awkward(awkward, nothing):
    rows = byte_cnn.identify(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de") and 0 < r["score"] <= 1) if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert byte_cnn.identify(nothing).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in byte_cnn.identify(unlabelled).collect()} == {("und", 0.0)}


def test_labels_are_no_input(awkward):
    wrong = awkward.withColumn("lang", F.when(byte_cnn.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    pick = lambda f: [(r["text"], r["lang_pred"], r["score"]) for r in byte_cnn.identify(f).collect()]
    assert sorted(pick(awkward), key=str) == sorted(pick(wrong), key=str)
