from __future__ import annotations

import corpus_pipeline
import numpy as np
from perigee.llm import simhash
from tests.llm.test_simhash import plain_groups


def edited_pairs():
    """Texts with a copy in which words are replaced; pairs by (bits, alike by five words)."""
    rng = np.random.default_rng(8)
    for number in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 300)]
        other = list(words)
        for k in rng.choice(300, 14, replace=False).tolist():
            other[k] = f"edit{k}"
        # what is repeated weighs in the fingerprint, not in the set of shingles
        line = " ".join(f"l{x}" for x in rng.integers(0, 10_000, 12)) + " "
        one, two = line * 60 + " ".join(words), line * 60 + " ".join(other)
        bits = bin(simhash.fingerprint(one.encode()) ^ simhash.fingerprint(two.encode())).count("1")
        yield one, two, bits, len(set(plain_groups([one, two]))) == 1


def test_fingerprints_link_documents_of_the_stage(spark):
    pairs = [(one, two) for one, two, bits, alike in edited_pairs() if bits <= simhash.MAX_BITS and not alike]
    assert len(pairs) > 5
    rows = [(10 * n + k, text, "en", "s", len(text)) for n, pair in enumerate(pairs) for k, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    components = {r["id"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    assert kept == sorted(set(components.values())) == [10 * n for n in range(len(pairs))]
    # similarity alone keeps both texts of every pair
    assert simhash.one_of_each(docs).count() == len(rows)
