from __future__ import annotations

import random

from perigee.llm import unit_dedup

LONG = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"ähnlich{k}" for k in range(30))


def plain(rows, least=25):
    """rows: (id, text); the earliest of equal lines stays."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[doc_id, text] = (None, [])
            continue
        left, gone, at = [], [], 0
        for number, line in enumerate(text.split("\n")):
            words = line.encode().lower().split()
            if len(words) >= least and tuple(words) in seen:
                gone.append((number, at, at + len(line)))
            else:
                left.append(line)
                if len(words) >= least:
                    seen.add(tuple(words))
            at += len(line) + 1
        out[doc_id, text] = ("\n".join(left), gone)
    return out


def test_against_a_loop(spark, awkward, nothing):
    rows = [
        (20, f"intro\n{LONG}\nend\n{LONG}"),
        (21, f"{LONG.upper()}\n  {OTHER}"),
        (22, f"🙂 first\n{OTHER}\r\n{LONG}"),
        (22, f"🙂 first\n{OTHER}\r\n{LONG}"),
        (23, LONG),
        (24, "\n".join([OTHER.replace(" ", "\t")] * 50)),
        (None, f"x\n{LONG}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionAll(awkward.select("doc_id", "text"))
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain(every)
    got = unit_dedup.deduplicate(docs.selectExpr("*", "'c' AS id", "'c' AS key", "'c' AS digest", "'c' AS removed").repartition(3)).collect()
    assert len(got) == len(every)
    have = sorted(((r["id"], r["text"], [tuple(x) for x in r["removed"]]) for r in got), key=str)
    assert have == sorted(((i, *want[i, t]) for i, t in every), key=str)
    assert unit_dedup.deduplicate(nothing).count() == 0


def test_offsets_point_into_the_original(spark):
    text = f"é\n{LONG}\nrest"
    docs = spark.createDataFrame([(1, LONG), (2, text)], "doc_id bigint, text string")
    row = next(r for r in unit_dedup.deduplicate(docs).collect() if r["id"] == 2)
    span = row["removed"][0]
    assert text[span["start"] : span["end"]] == LONG and row["text"] == "é\nrest"


def test_passages_of_short_lines(spark):
    passage = [f"line {k} of a verse that stands in both texts" for k in range(6)]  # 10 words each
    stanzas = [*passage[:3], "", *passage[3:]]
    rows = [
        (1, "\n".join(["first of all", *stanzas, "own end"])),
        (2, "\n".join(["another", "beginning of its own", *stanzas, "", "and another end"])),
        (3, "\n".join(["a lone line", passage[0], "between others", passage[4]])),
        (4, "\n".join([*passage[2:5], "a tail"])),
        (5, "\n".join([f"{LONG} ends", *passage[:2]])),
        (6, "\n".join([f"{LONG} ends", *passage[:2], "a few words more"])),
        (7, "\n".join(["once", *[f"item {k} of the list in one text" for k in range(5)]] * 2)),
        (8, "\n".join(["short and again"] * 30)),
        (9, "\n".join(["short and again"] * 30)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["id"]: r for r in unit_dedup.deduplicate(docs).collect()}
    once = "\n".join(["once", *[f"item {k} of the list in one text" for k in range(5)]])
    want = {
        1: rows[0][1],
        2: "another\nbeginning of its own\n\nand another end",
        3: rows[2][1],
        4: "a tail",
        5: rows[4][1],
        6: "a few words more",
        7: once,
        8: rows[7][1],
        9: "",
    }
    assert {k: r["text"] for k, r in got.items()} == want
    assert [r["line"] for r in got[2]["removed"]] == list(range(2, 9))
    for doc_id, text in rows:
        lines = text.split("\n")
        assert all(text[x["start"] : x["end"]] == lines[x["line"]] for x in got[doc_id]["removed"])


def test_units_against_all_runs():
    texts = ["\n".join(" ".join(["w"] * (n * 7 % 13)) for n in range(k, k + 30)) for k in range(13)]
    for text in [*texts, LONG, "", f"a\n{LONG}\nb"]:
        counts = [len(line.split()) for line in text.split("\n")]
        held = [k for k, n in enumerate(counts) if n]
        enough = {(a, b) for a in held for b in held if a <= b and sum(counts[a : b + 1]) >= 25}
        least = {(a, b) for a, b in enough if b == min(y for x, y in enough if x == a) or a == max(x for x, y in enough if y == b)}
        assert {u[:2] for u in unit_dedup.units_of(text.encode(), 25)} == least


def test_passages_within_lines_of_any_length(spark):
    """Passages of 50 words that begin and end within lines, with line feeds of their own."""
    draw = random.Random(12)
    rows, places = [], {}
    for number in range(40):
        passage = [f"p{number}w{draw.randrange(1000)}" for _ in range(50)]
        for doc_id in (number, 100 + number):
            words = [f"d{doc_id}x{k}" for k in range(60)]
            at = draw.randrange(1, 50)
            words[at:at] = passage
            text = "".join(w + draw.choice([" ", " ", "  ", "\n", "\t"]) for w in words)
            rows.append((doc_id, text))
            places[doc_id] = set(passage)
    got = {r["id"]: r for r in unit_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for doc_id, text in rows:
        gone = [text[x["start"] : x["end"]] for x in got[doc_id]["removed"]]
        assert bool(gone) == (doc_id >= 100)
        assert all(set(part.split()) <= places[doc_id] for part in gone)
        if gone:
            assert sum(len(part.split()) for part in gone) >= unit_dedup.MIN_WORDS
            words = [w for part in gone for w in part.split()]
            assert sorted([*got[doc_id]["text"].split(), *words]) == sorted(text.split())


def test_a_shared_passage_of_fifty_words_has_a_unit_in_common():
    draw = random.Random(13)
    for _ in range(200):
        passage = [f"w{draw.randrange(50)}" for _ in range(unit_dedup.MIN_WORDS + unit_dedup.REACH - 1)]
        texts = [" ".join([f"a{k}" for k in range(draw.randrange(80))] + passage + [f"{side}{k}" for k in range(draw.randrange(80))]) for side in "bc"]
        one, two = ({u[3] for u in unit_dedup.inner_units(t.encode(), unit_dedup.MIN_WORDS)} for t in texts)
        assert one & two


def test_short_texts_and_loops_of_words(spark):
    assert unit_dedup.inner_units(b"a few words", 25) == []
    assert len(unit_dedup.inner_units(" ".join(f"w{k}" for k in range(30)).encode(), 25)) == 1
    loop = "again and " * 60
    docs = spark.createDataFrame([(1, loop), (2, f"start {loop}")], "doc_id bigint, text string")
    got = {r["id"]: r["text"] for r in unit_dedup.deduplicate(docs).collect()}
    assert got[1] == loop and len(got[2].split()) <= unit_dedup.MIN_WORDS + 1
