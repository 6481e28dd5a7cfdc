from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from perigee.llm import components, simhash
from perigee.llm.shared import shared_folder


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, unsigned fingerprint); all pairs."""
    prints = np.array([fp for _, fp in rows], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(prints ^ fp) <= 2) for fp in prints]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min((label[j] for j in others if label[j] is not None), default=None)
            if least is not None and (label[i] is None or least < label[i]):
                label[i], changed = least, True
    return label


def test_fingerprint():
    for text in (None, "", " ", "one", "One two", "a b c d", "É b\x0bc d e f g a b c", "w " * 5000):
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('näh and far') AS h").first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest("näh and far".encode(), 42)


def test_near_duplicates_awkward(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    expected = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    got = [tuple(r) for r in simhash.near_duplicates(awkward).collect()]
    key = lambda x: (x[0] is None, x[0], x[1])
    want = [(i, int(np.uint64(plain_fingerprint(t)).view(np.int64)), c) for (i, t), c in zip(rows, expected, strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(3)
    prints = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist()) | {0, (1 << 64) - 1}
    for _ in range(12):  # chains and balls
        at = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2
        for _ in range(40):
            at ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))
            prints.add(at)
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    folder = shared_folder(spark)
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(3)
    roots = {r["node"]: r["root"] for r in components.connected(simhash.links(frame, folder), folder).collect()}
    label = plain_components(list(enumerate(prints)))
    groups = lambda of: {frozenset(i for i, x in enumerate(of) if x == y) for y in set(of)}
    assert groups([roots.get(p, p) for p in signed]) == groups(label)


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(200, 260)] + [(5, k) for k in range(6, 40)] + [(3, 3), (6, 5)]
    frame = spark.createDataFrame(path, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.connected(frame, shared_folder(spark)).collect()}
    assert got == {k: 200 for k in range(201, 261)} | {k: 5 for k in range(6, 40)}


def plain_groups(texts):
    """Connected groups of texts over 5-word Jaccard similarity 0.8, all pairs."""
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if 5 * both >= 4 * (len(one) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_one_of_each_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    rng = np.random.default_rng(5)
    edited = []  # near copies of whole texts, a word in sixty replaced
    for number, (_, text) in enumerate(rows[:60]):
        words = (text or "").split()
        for k in rng.choice(len(words), len(words) // 60, replace=False) if words else ():
            words[k] = f"edit{k}"
        edited.append((10_000 + number, " ".join(words)))
    rows += edited
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept = [r["doc_id"] for r in simhash.one_of_each(frame).collect()]
    groups = plain_groups([text for _, text in rows])
    assert len(set(groups)) < len(rows) - 40
    assert sorted(kept) == sorted({rows[g][0] for g in groups})


def test_sets_of_a_block_against_each_other():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (0, 5, 30, 30, 200, 0)]
    for one in sets:
        plain = [len(set(one) & set(x)) / len(set(one) | set(x)) if len(one) or len(x) else 1.0 for x in sets]
        assert simhash.Sets(sets).similarity(one).tolist() == plain


def test_one_of_each_awkward(spark, awkward, nothing):
    out = simhash.one_of_each(awkward)
    assert out.columns == awkward.columns
    # null, empty and blank texts are alike; the row without an id is no copy of another
    assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=lambda x: (x is None, x)) == [1, 3, 7, 8, 9, 10, None]
    assert simhash.one_of_each(nothing).count() == 0
    one = "a letter of some length to nobody in particular, as was the custom then"
    rows = [(None, one), (4, one), (4, "other words that have nothing to do with the rest"), (4, one)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.one_of_each(frame).collect()) == sorted([(4, one), rows[2]])
    both = spark.createDataFrame([(None, one), (None, f"{one} or not " * 9)], "doc_id bigint, text string")
    assert simhash.one_of_each(both).count() == 2


def test_alike_texts_are_found_whatever_else_is_in_their_groups(spark, tmp_path):
    """Texts share half their words with all others, and some with one other nearly all."""
    rng = np.random.default_rng(11)
    shared = " ".join(f"common{k}" for k in range(60))
    rows = []
    for number in range(60):
        own = [f"w{x}" for x in rng.integers(0, 10_000, 55)]
        rows.append((number, f"{shared} {' '.join(own)}"))
        if number % 3 == 0:
            own[50] = "changed"
            rows.append((1000 + number, f"{shared} {' '.join(own)}"))
    groups = plain_groups([text for _, text in rows])
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = [r["doc_id"] for r in simhash.one_of_each(frame).collect()]
    assert sorted(kept) == sorted({rows[g][0] for g in groups}) and len(kept) == 60

    for block in (400, simhash.BLOCK):
        rows_of, distinct, folder = prepared(spark, frame)
        roots = {bytes(r["node"]): bytes(r["root"]) for r in simhash.alike(distinct, rows_of, 5, 0.8, folder, block).collect()}
        nodes = {bytes(r["node"]) for r in distinct.select("node").collect()}
        assert len({roots.get(n, n) for n in nodes}) == 60


def prepared(spark, frame):
    """(node, id, text) rows, their sketches, and a folder."""
    rows = frame.select(F.unhex(F.md5("text")).alias("node"), F.col("doc_id").alias("id"), "text").cache()
    return rows, simhash.sketches(rows, 5).withColumnRenamed("id", "first").cache(), shared_folder(spark)


def compared_in(spark, rows, block):
    """Rows sent and links found in the first and in the second comparison, and components."""
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    texts_, distinct, folder = prepared(spark, frame)
    members = simhash.memberships(distinct).cache()
    first = simhash.first_texts(members, block)
    links = simhash.compared(first, texts_, 5, 0.8).cache()
    roots = components.connected(links, folder).cache()
    second = simhash.open_groups(members, roots, block)
    more = simhash.compared(second, texts_, 5, 0.8).cache()
    ends = {bytes(r["node"]): bytes(r["root"]) for r in simhash.alike(distinct, texts_, 5, 0.8, folder, block).collect()}
    nodes = {bytes(r["node"]) for r in distinct.select("node").collect()}
    return first.count(), links.count(), second.count(), more.count(), len({ends.get(n, n) for n in nodes}), members.count()


def test_a_large_group_of_unlike_texts_gives_no_rows(spark):
    """Two thirds of the shingles are shared: all meet in bands, and no two are alike."""
    shared = " ".join(f"common{k}" for k in range(240))
    rows = [(k, f"{shared} " + " ".join(f"own{k}x{i}" for i in range(80))) for k in range(300)]
    sent, links, again, more, left, members = compared_in(spark, rows, simhash.BLOCK)
    assert members > 300 and (links, more, left) == (0, 0, 300)
    assert sent <= 2 * members and again <= 2 * members


def test_a_large_group_of_near_copies_gives_fewer_rows_than_texts(spark):
    """Copies of one text with a tenth of its words changed: many pairs of them are unlike."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        words = list(base)
        for at in rng.integers(0, 60, 1).tolist():
            words[at * 5 : at * 5 + 12] = [f"edit{k}x{i}" for i in range(12)]
        rows.append((k, " ".join(words)))
    sent, links, again, more, left, members = compared_in(spark, rows, 20_000)
    parts = members // 10
    assert left == len(set(plain_groups([text for _, text in rows]))) == 1
    assert links < sent and links + more < 16 * 400 + parts and again <= 20 * members


def test_a_repeated_line_does_not_hide_a_near_copy(spark):
    """Fingerprints count repeats, similarity does not; the two texts share groups with each other alone."""
    rng = np.random.default_rng(3)
    rows = []
    for number in range(20):
        common = " ".join(f"w{x}" for x in rng.integers(0, 10_000, 300))
        line = " ".join(f"l{x}" for x in rng.integers(0, 10_000, 12))
        texts = [f"{common}\n{line}\n", f"{common}\n" + f"{line}\n" * 50]
        rows += [(2 * number, texts[0]), (2 * number + 1, texts[1])]
    groups = plain_groups([text for _, text in rows])
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = [r["doc_id"] for r in simhash.one_of_each(frame).collect()]
    assert sorted(kept) == sorted({rows[g][0] for g in groups}) and len(kept) == 20
