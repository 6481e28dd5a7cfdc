from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np

from perigee.llm import line_crf

LABELS = "doc_id bigint, quality int, toxic int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_counts_against_a_loop(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 1), (None, 1, 0), (8, None, None)], LABELS)
    more = spark.createDataFrame([(50, "a b c d e f a b c d e\na b\na b \na b"), (51, "é\x85x | y z\n" * 3)], "doc_id bigint, text string")
    docs = awkward.select("doc_id", "text").unionAll(more)
    got = [(r["id"], *[r[k] for k in range(1, 7)]) for r in line_crf.label_lines(docs, labels).collect()]
    assert sorted(got, key=str) == sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=str)
    assert line_crf.label_lines(nothing, labels.where("false")).count() == 0
    assert all(not (r["base_failed"] and r["kept"]) for r in line_crf.label_lines(docs, labels).collect())


def test_repeats_with_many_words():
    rng = np.random.default_rng(0)
    words = [b"w%d" % k for k in rng.permutation(9000)]
    words += words[100:130] + [b"z"] + words[5:9]
    assert line_crf.n_repeat_words(words) == 60


def test_sample_lines_come_from_the_whole_text(spark):
    lines = [[k] for k in range(1000)]
    got = [k for (k,) in line_crf.spread(lines)]
    assert len(got) == line_crf.SAMPLE_LINES and got[0] == 0 and got[-1] == 999 and 500 in got
    assert line_crf.spread(lines[:60]) == lines[:60]
    docs = spark.createDataFrame([(k, "a b\n" * k) for k in range(1, 9)] + [(3, None), (3, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 9)], LABELS)
    found = line_crf.sample(docs, labels, "doc_id", "text", 3)
    assert sorted(q for _, q in found) == [0, 0, 0, 1, 1, 1] and all(1 <= len(x) <= 8 for x, _ in found)


def random_chain(seed):
    rng = np.random.default_rng(seed)
    chain = line_crf.Chain()
    chain.w, chain.t, chain.s = rng.normal(size=chain.w.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    return chain, [[int(f) for f in rng.choice(line_crf.FEATURES, 4, replace=False)] for _ in range(6)]


def score(chain, lines, labels):
    return (
        chain.s[labels[0]]
        + sum(chain.w[line, y].sum() for line, y in zip(lines, labels, strict=True))
        + sum(chain.t[a, b] for a, b in itertools.pairwise(labels))
    )


def test_viterbi_and_marginals_against_all_labellings():
    for seed in range(10):
        chain, lines = random_chain(seed)
        every = list(itertools.product((0, 1), repeat=len(lines)))
        scores = np.array([score(chain, lines, y) for y in every])
        assert chain.decode(lines) == list(every[int(scores.argmax())])
        share = np.exp(scores) / np.exp(scores).sum()
        node, edge = chain._marginals(chain.emissions(lines))
        assert np.allclose(node, [sum(p for p, y in zip(share, every, strict=True) if y[i]) for i in range(len(lines))])
        want = np.zeros((2, 2))
        for p, y in zip(share, every, strict=True):
            for a, b in itertools.pairwise(y):
                want[a, b] += p
        assert np.allclose(edge, want)


def test_held_out_verdicts(spark):
    """Documents known to be good stay, most poor ones go."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fitted = labels.where("doc_id % 2 = 0")
    found = line_crf.label_lines(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi").unionAll(docs.join(fitted.select("doc_id"), "doc_id", "left_semi")), fitted)
    rows = found.join(labels, found["id"] == labels["doc_id"]).where("doc_id % 2 = 1 and not base_failed").groupBy("quality").agg({"content_share": "avg", "kept": "count"})
    kept = {r["quality"]: r["avg(content_share)"] for r in rows.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.5
