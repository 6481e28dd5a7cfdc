from __future__ import annotations

import gzip
import hashlib
import io
import random
from pathlib import Path

import pyarrow.fs as fs
import pytest

from perigee.llm import warc
from perigee.llm.shared import shared_folder

PAGES = [
    (1, "http://a.example/x", "x" * 1500),
    (2, "http://a.example/y", "x" * 1500),
    (2, "http://a.example/y", "x" * 1500),
    (3, "http://b.example/", "x" * 1500),
    (4, "http://b.example/", "short"),
    (5, None, "short"),
    (6, "no scheme", None),
    (7, "http://A.example/\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (None, "http://a.example/x", "x" * 1500),
    (9, "http://a.example/x", "ü" * 200_000),
    (10, "", ""),
]


@pytest.fixture
def pages(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return frame.selectExpr("*", "'clash' AS page", "'clash' AS payload", "1 AS digest", "2 AS owner").repartition(3)


def test_captures(pages, spark):
    folder = shared_folder(spark)
    rows = warc.captures(pages, folder=folder).orderBy("range_no", "position").collect()
    keys = [(r["url_key"], r["captured"], str(r["page"] or "")) for r in rows]
    assert keys == sorted(keys)
    got = sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        again = page in (1, 2) and len(data) == 1500
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    one = next(r for r in rows if r["page"] == 9)
    files, root = fs.FileSystem.from_uri(folder)
    data = Path(root, "warc", one["archive"]).read_bytes()[one["offset"] : one["offset"] + one["length"]]
    assert warc.parsed(gzip.decompress(data))["payload"] == PAGES[9][2].encode()


def test_no_pages(pages):
    assert warc.captures(pages.where("false")).count() == 0


def test_archives_are_cut_and_ranges_are_many(pages, monkeypatch, spark):
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    many = pages.unionAll(pages.withColumn("page_id", pages["page_id"] + 100))
    rows = warc.captures(many).orderBy("range_no", "position").collect()
    assert len({r["range_no"] for r in rows}) > 1 and len(rows) == 2 * len(PAGES)
    keys = [(r["url_key"], r["captured"], str(r["page"] or "")) for r in rows]
    assert keys == sorted(keys)


def test_members_across_pieces(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    parts = [b"a" * 100, b"", b"bc" * 50]
    data = [gzip.compress(p) for p in parts]
    got = list(warc.members(io.BytesIO(b"".join(data))))
    assert [x[2] for x in got] == parts and [x[1] for x in got] == list(map(len, data))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[0][:-9])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)
