"""WARC archives of pages, and a globally ordered capture index by external merge.

Pages are written as WARC/1.1 records, each a gzip member of its own, into archives of
bounded size; equal payloads are written once and revisited. Each archive, read back,
gives a run: its captures sorted by URL key, timestamp and id. Runs are dealt to ranges
of that key, and each range merges its slices of the runs with a loser tree, so that
the ranges in order are the capture histories in order.

Archives stand in the shared folder and are named by attempt: a task that is repeated
writes new ones, and only those that a finished task has reported are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import column, rows_of, shared_folder, stored

LEAST_SHARED = 1000
ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 20_000
RANGE_ROWS = 100_000
LEVEL = 4
READ_BYTES = 1 << 20
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_704_067_200

ENTRY = (
    "run string, seq int, offset bigint, length bigint, url_key string, captured string, page string, "
    "payload_bytes bigint, payload_digest string, record_type string, refers_to string"
)


def url_key(url: str) -> str:
    """The host's labels from the top level down, then the rest, lower-cased."""
    _, found, rest = url.lower().partition("://")
    if not found:
        return url.lower()
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def record(page: str | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit keeps the HTTP head, with the full length, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"),
        (b"WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>".encode()),
        (b"WARC-Date", captured.encode()),
        (b"WARC-Payload-Digest", b"sha1:" + base64.b32encode(bytes.fromhex(digest))),
        (b"Content-Type", b"application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append((b"WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A").encode()))
    if page is not None:
        fields.append((b"Page-Id", page.encode()))
    if refers_to is not None:
        fields += [(b"WARC-Profile", PROFILE), (b"Refers-To-Page-Id", refers_to.encode())]
    fields.append((b"Content-Length", b"%d" % len(block)))
    return b"WARC/1.1\r\n" + b"".join(b"%s: %s\r\n" % f for f in fields) + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of a record and its payload; raises if the framing doesn't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = dict(line.split(b": ", 1) for line in lines[1:])
    size = int(fields[b"Content-Length"])
    if lines[0] != b"WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    return {"fields": fields, "payload": payload, "length": length}


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, reading a bounded piece at a time."""
    at, begin, inflate, parts = 0, 0, zlib.decompressobj(31), []
    while piece := stream.read(READ_BYTES):
        while piece:
            parts.append(inflate.decompress(piece))
            rest = inflate.unused_data if inflate.eof else b""
            at += len(piece) - len(rest)
            if inflate.eof:
                yield begin, at - begin, b"".join(parts)
                begin, inflate, parts = at, zlib.decompressobj(31), []
            piece = rest
    if any(parts):
        raise ValueError("the archive ends inside a record")


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers, one path is replayed a row."""

    def __init__(self, runs: list[list], key: Callable) -> None:
        self.runs, self.key = [iter(run) for run in runs], key
        self.k = len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _next(self, run: int):
        row = next(self.runs[run], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or x[0] == y[0] and a < b

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[1]
            win = self.winner
            self.heads[win] = self._next(win)
            node = (win + self.k) // 2
            while node:
                if self._beats(self.losers[node], win):
                    self.losers[node], win = win, self.losers[node]
                node //= 2
            self.winner = win


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page, url, captured, payload, digest, refers_to) rows; (archive, n) of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        stream, name, size, count = None, "", 0, 0

        def closed():
            stream.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n": pa.array([count], pa.int64())})

        for batch in batches:
            columns = [column(batch, c) for c in ("page", "url", "captured", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                if stream is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    files.create_dir(root, recursive=True)
                    stream = files.open_output_stream(f"{root}/{name}", compression=None)
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = squeeze.compress(record(*(v.as_py() for v in row))) + squeeze.flush()
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES or count >= ARCHIVE_RECORDS:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return records.mapInArrow(run, "archive string, n bigint")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The captures of each archive as a sorted run; payload digests are checked."""

    def entries(files: fs.FileSystem, root: str, name: str) -> Iterator[tuple]:
        with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for offset, length, data in members(stream):
                found = parsed(data)
                fields = found["fields"]
                digest = base64.b32decode(fields[b"WARC-Payload-Digest"][5:]).hex()
                kind = fields[b"WARC-Type"].decode()
                if kind == "response" and (len(found["payload"]) != found["length"] or hashlib.sha1(found["payload"]).hexdigest() != digest):
                    raise ValueError(f"{name}: the payload at {offset} isn't what was written")
                value = lambda k: fields[k].decode() if k in fields else None
                key = url_key(value(b"WARC-Target-URI") or "")
                yield offset, length, key, value(b"WARC-Date"), value(b"Page-Id"), found["length"], digest, kind, value(b"Refers-To-Page-Id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        for batch in batches:
            for name in column(batch, "archive").to_pylist():
                rows = sorted(entries(files, root, name), key=lambda r: (r[2], r[3], r[4] or ""))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(rows), pa.string()),
                        pa.array(range(len(rows)), pa.int32()),
                        *[pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)],
                    ],
                    names=[f.split()[0] for f in ENTRY.split(", ")],
                )

    return archives.select("archive").mapInArrow(run, ENTRY)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """All captures in global order: `range_no`, then `position` in it.

    Key ranges are cut at sampled quantiles of key, time and page, so that one URL with
    very many captures spans several ranges.
    """
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page").sortWithinPartitions("run", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        slices: dict[str, list[int]] = {}
        for row, name in enumerate(table.column("run").to_pylist()):
            slices.setdefault(name, []).append(row)
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page")), strict=True))
        key = lambda row: (keys[row][0], keys[row][1], keys[row][2] or "")
        merged = table.take(pa.array(list(LoserTree(list(slices.values()), key)), pa.int64()))
        at = pa.array(range(merged.num_rows), pa.int64())
        number = pa.array([TaskContext.get().partitionId()] * merged.num_rows, pa.int32())
        for batch in merged.append_column("range_no", number).append_column("position", at).combine_chunks().to_batches(10_000):
            yield batch

    return dealt.mapInArrow(run, ENTRY + ", range_no int, position bigint")


def captures(
    pages: DataFrame,
    captured: Column | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_shared: int = LEAST_SHARED,
    folder: str | None = None,
) -> DataFrame:
    """Archive all pages, read them back, and return the ordered capture index.

    Columns: page, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to,
    url_key, captured, archive, offset, length, range_no, position. Of equal payloads
    of `least_shared` bytes or more the row with the largest id is the response, the
    others revisit it; rows that repeat whole with that id are all responses. Null html
    is an empty payload; a null url has an empty key; a row without an id is always a
    response. `captured` defaults to one second per id. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    id_type = pages.schema[id_col].dataType
    if captured is None:
        captured = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"),
        F.col(f"`{url_col}`").alias("url"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where((F.length("payload") >= least_shared) & F.col("page").isNotNull()).select("page", "digest")
    owners = large.groupBy("digest").agg(F.max("page").alias("owner"), F.min("page").alias("least")).where("least <> owner")
    again = large.join(owners.select("digest", "owner"), "digest").where("page <> owner").distinct()
    again = stored(again, f"{folder}/revisits")
    records = rows.join(again, ["page", "digest"], "left").select(
        F.col("page").cast("string").alias("page"), "url", "captured", "payload", "digest", F.col("owner").cast("string").alias("refers_to")
    )
    archives = stored(write_archives(records, f"{folder}/warc"), f"{folder}/archives")
    n = archives.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    runs = stored(read_archives(archives.repartition(max(1, n[0]), "archive"), f"{folder}/warc"), f"{folder}/runs")
    merged = merge_runs(runs, max(1, -(-n[1] // RANGE_ROWS)))
    return merged.select(
        F.col("page").cast(id_type).alias("page"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
        "url_key",
        "captured",
        F.col("run").alias("archive"),
        "offset",
        "length",
        "range_no",
        "position",
    )
