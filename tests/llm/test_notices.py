from __future__ import annotations

import re

from perigee.llm import notices


def plain_base(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in notices.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Licensed under the MIT License. Also UNDER, the mit-license; and CC BY NC cc by-nc",
    "Apache License, Version 2.0 apache license version 20",
    "Lisensed under the MIT licence",
    "This work is licensed under the GNU General Public Licence, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "nothing of the kind, licensed to nobody",
]


def test_base_against_a_loop(spark, awkward):
    docs = spark.createDataFrame(list(enumerate(TEXTS, 50)), "doc_id bigint, text string").unionAll(awkward.select("doc_id", "text"))
    rows = {(r["id"], r["n_words"]): r for r in notices.scan(docs).collect()}
    for doc_id, text in docs.collect():
        want = plain_base(text)
        r = rows[doc_id, want[0]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_finds_every_notice_within_its_edits():
    searcher = notices.Searcher()
    for k, (notice, _) in enumerate(notices.NOTICES):
        allowed = searcher.errors[k]
        for shift in range(0, len(notice) - 3 * allowed, 5):
            places = [shift + 3 * e for e in range(allowed)]
            bent = "".join("#" if i in places else c for i, c in enumerate(notice))
            found = searcher.fuzzy(f"some words before {bent} and after")
            assert any(f[0] == k and f[3] <= allowed for f in found), (notice, bent)
        for _, start, end, n in searcher.fuzzy(f"before {notice} after"):
            assert n <= max(searcher.errors)
    assert edits("kitten", "sitting") == 3


def test_labels(spark):
    found = {k: notices.Searcher().scan(t.encode()) for k, t in enumerate(TEXTS)}
    assert found[2][5] == "mit" and found[2][4] == "" and 0 < found[2][6] < 1
    assert found[3][5] == "gpl-3" and found[4][5] == "cc-by-nc" and found[5][5] == ""
    span = found[4][7][0]
    assert (span["start"], span["end"]) == (0, 7)


def test_empty(nothing):
    assert notices.scan(nothing).count() == 0


def plain_best_first(text, notice, allowed):
    """Edits of the notice's matches that do not overlap, the best first, in order of their place."""
    spans = [
        (n, start, end)
        for start in range(len(text))
        for end in range(start + len(notice) - allowed, min(len(text), start + len(notice) + allowed) + 1)
        if (n := edits(notice, text[start:end])) <= allowed
    ]
    taken = []
    for n, start, end in sorted(spans):
        if all(end <= a or start >= b for _, a, b in taken):
            taken.append((n, start, end))
    return [n for n, start, _ in sorted(taken, key=lambda x: x[1])]


def test_an_edited_notice_before_a_better_one():
    searcher = notices.Searcher()
    mit = next(k for k, (text, _) in enumerate(notices.NOTICES) if text == "licensed under the mit license")
    good, bent, worse = "licensed under the mit license", "licensed under the mit licens", "lisensed under the mit licence"
    for texts in ([bent, good], [bent, good, good, good], [good, bent], [worse, bent, good, worse, bent, good], [worse, good, bent]):
        text = " ".join(texts)
        found = [f for f in searcher.fuzzy(text) if f[0] == mit]
        assert [f[3] for f in found] == plain_best_first(text, good, searcher.errors[mit]), texts
        assert len(found) == len(texts)
        assert all(edits(good, text[start:end]) == n for _, start, end, n in found)
    spans = searcher.scan(f"{bent}\n{good}".encode())[7]
    assert [(s["start"], s["end"], s["edits"]) for s in spans] == [(0, 5, 1), (5, 10, 0)]
