"""Landed JSON arrays of any size, read by many tasks.

Spark's text reader takes a file in byte ranges if lines end often enough. Here a line
ends with a closing brace, so an array of objects has short lines whatever its layout. A
range alone can't tell whether it starts inside a string, or how deep: each one is
therefore summed up for both cases (quote parity, change of depth, and separators by
depth), the sums are combined along the file, and in a second pass every range cuts the
items that begin and end in it. What crosses ranges, one item a border, is put together
from its parts. Texts of whole items are never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from perigee.sources import payloads

# the scan travels with the job: executors need only numpy, pandas and pyarrow
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_END = "}"
NOT_JSON = "item_not_json"
QUOTE, ESCAPE, COMMA, OPEN, CLOSE = 0x22, 0x5C, 0x2C, (0x5B, 0x7B), (0x5D, 0x7D)
BLANKS = (0x20, 0x09, 0x0A, 0x0D)

_SIDE = "delta{0} bigint, lowest{0} bigint, commas{0} array<bigint>, marks{0} array<bigint>"
SUMMARY = f"file string, block bigint, flips boolean, first binary, {_SIDE.format(0)}, {_SIDE.format(1)}"
STARTS = "file string, block bigint, inside boolean, depth bigint, item bigint, whole boolean"
FRAGMENTS = "file string, block bigint, item bigint, complete boolean, closes boolean, text string"


def read_record_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record_text``, ``reject_reason`` and ``record_position`` of the items of JSON array
    files, with the ``payload_path`` they came from; equal to taking each file whole.

    A file that is no array, or has text behind it, is one row with a reason and no text
    (Spark passes over files of no bytes). An item that is no JSON is kept as it stands
    with a reason, and its neighbours stay. An empty array has no rows. The driver holds
    one small row per byte range of the files that have several, fewer than it plans tasks
    for. A text without closing braces is one line, read by one task. Files are scanned
    three times when the result is read once.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    starts = _starts(_lines(spark, path))
    verdict = starts.groupBy("file").agg(F.bool_and("whole").alias("whole"))
    known = {(r["file"], r["block"]): (r["inside"], r["depth"], r["item"]) for r in starts.where("block > 0").collect()}
    cut = _lines(spark, path).mapInArrow(lambda batches: _cut(batches, known), FRAGMENTS)
    glued = (
        cut.where(~F.col("complete"))
        .groupBy("file", "item")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"),
            F.bool_or("closes").alias("closes"),
        )
    )
    items = cut.where("complete").select("file", "item", "text", "closes").unionByName(glued.select("file", "item", "text", "closes"))
    nothing = (F.col("item") == 0) & F.col("closes") & F.col("text").rlike(r"^[ \t\n\r]*$")
    items = items.where(~nothing).join(verdict.where(~F.col("whole")), "file", "left_anti")
    parsed = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")
    one = F.size(parsed) == 1
    items = items.withColumn("_parsed", parsed).select(
        F.col("file").alias("payload_path"),
        F.when(one, F.get("_parsed", F.lit(0))).otherwise(F.col("text")).alias("record_text"),
        F.when(~F.coalesce(one, F.lit(False)), F.lit(NOT_JSON)).alias("reject_reason"),
        F.col("item").alias(payloads.POSITION),
    )
    bad = files.join(verdict.where("whole"), "file", "left_anti").select(
        F.col("file").alias("payload_path"),
        F.lit(None).cast("string").alias("record_text"),
        F.lit(payloads.NOT_A_LIST).alias("reject_reason"),
        F.lit(0).cast("bigint").alias(payloads.POSITION),
    )
    return items.unionByName(bad)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", LINE_END).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text")
    )


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside, depth, item, whole) at the start of every range."""
    summary = lines.mapInArrow(_summaries, SUMMARY)
    return summary.groupBy("file").applyInPandas(_combined, STARTS)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes): the lines of each range in order, with their ends put back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column(0).dictionary_encode()
        keys = np.stack([file.indices.to_numpy(), batch.column(1).to_numpy()])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            held = [x.as_buffer().to_pybytes() for x in batch.column(2).slice(a, b - a)]
            yield file[a].as_py(), int(keys[1, a]), b"".join(x + b"}" for x in held)


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(in a string, depth) behind each byte, from a start inside or outside of a string.

    A string's closing quote counts as outside. Text starts behind a brace, which ends any
    run of escapes.
    """
    quotes = np.flatnonzero(data == QUOTE)
    if (data == ESCAPE).any():
        place = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(data != ESCAPE, place, -1))
        before = quotes[quotes > 0] - 1
        escaped = np.zeros(len(quotes), bool)
        escaped[quotes > 0] = (before - last_other[before]) % 2 == 1
        quotes = quotes[~escaped]
    turns = np.zeros(len(data), np.int32)
    turns[quotes] = 1
    within = ((np.cumsum(turns) + inside) & 1).astype(bool)
    steps = np.isin(data, OPEN).astype(np.int32) - np.isin(data, CLOSE)
    steps[within] = 0
    return within, np.cumsum(steps)


class _Side:
    """What a range does, given that it starts inside (or outside) of a string."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.delta = inside, 0
        self.commas: dict[int, int] = {}
        self.marks: dict[int, int] = {}

    def add(self, data: np.ndarray) -> None:
        within, depth = structure(data, self.inside)
        depth = depth + self.delta
        for held, at in ((self.commas, (data == COMMA) & ~within), (self.marks, ~np.isin(data, BLANKS))):
            levels, counts = np.unique(depth[at], return_counts=True)
            for level, count in zip(levels.tolist(), counts.tolist(), strict=True):
                held[level] = held.get(level, 0) + count
        self.inside, self.delta = bool(within[-1]), int(depth[-1])

    def row(self) -> list:
        levels = [*self.commas, *self.marks, 0]
        low, high = min(levels), max(levels)
        spread = lambda held: [held.get(k, 0) for k in range(low, high + 1)]
        return [self.delta, low, spread(self.commas), spread(self.marks)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = pa.list_(pa.int64())
    types = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64(), pa.int64(), counts, counts] * 2]
    names = [part.split(" ")[0] for part in SUMMARY.split(", ")]
    key, sides, first, rows = None, (), b"", []

    def close() -> None:
        if key is not None:
            rows.append([*key, sides[0].inside, first, *sides[0].row(), *sides[1].row()])

    for file, block, text in _by_range(batches):
        if (file, block) != key:
            close()
            key, sides, first = (file, block), (_Side(False), _Side(True)), b""
        first = first or text.lstrip(bytes(BLANKS))[:1]
        data = np.frombuffer(text, np.uint8)
        for side in sides:
            side.add(data)
    close()
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _combined(ranges: pd.DataFrame) -> pd.DataFrame:
    """Where each range of one file starts, and whether the file is one array.

    The brace put back behind the file's last line is one too many: a whole array ends a
    level below its start, with its closing bracket alone at the start's level.
    """
    ranges = ranges.sort_values("block")
    inside, depth, item = False, 0, 0
    levels: dict[int, int] = {}
    out = []
    for row in ranges.to_dict("records"):
        out.append([row["file"], row["block"], inside, depth, item])
        side = int(inside)
        low = row[f"lowest{side}"] + depth
        for k, (commas, marks) in enumerate(zip(row[f"commas{side}"], row[f"marks{side}"], strict=True)):
            item += int(commas) if low + k == 1 else 0
            levels[low + k] = levels.get(low + k, 0) + int(marks)
        inside, depth = inside ^ bool(row["flips"]), depth + row[f"delta{side}"]
    outside = {k: n for k, n in levels.items() if k <= 0 and n}
    whole = ranges["first"].iloc[0] == b"[" and not inside and depth == -1 and outside == {0: 1, -1: 1}
    return pd.DataFrame([[*row, whole] for row in out], columns=["file", "block", "inside", "depth", "item", "whole"])


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple[bool, int, int]]) -> Iterator[pa.RecordBatch]:
    """Fragments of items: complete ones, and for items that cross ranges their parts."""
    key, inside, depth, item, begun, held = None, False, 0, 0, False, []
    names = [part.split(" ")[0] for part in FRAGMENTS.split(", ")]

    def batch_of(rows: list) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].view(pa.string())], names=names)

    for file, block, text in _by_range(batches):
        rows = []
        if (file, block) != key:
            if key is not None and depth > 0:
                rows.append((*key, item, False, False, b"".join(held)))
            if block and (file, block) not in starts:
                raise ValueError(f"{file} was split in other places than before")
            key, held, begun = (file, block), [], False
            inside, depth, item = starts.get(key, (False, 0, 0))
        data = np.frombuffer(text, np.uint8)
        within, after = structure(data, inside)
        after = after + depth
        before = np.concatenate(([depth], after[:-1]))
        edges = ~within & (((data == COMMA) & (after == 1)) | ((after == 0) & (before == 1)) | ((after == 1) & (before == 0)))
        at = 0
        for edge in np.flatnonzero(edges).tolist():
            if before[edge] == 1:
                closes = after[edge] == 0
                rows.append((*key, item, begun, bool(closes), b"".join([*held, text[at:edge]])))
                item += 1
            held, begun, at = [], True, edge + 1
        inside, depth = bool(within[-1]), int(after[-1])
        if depth > 0:
            held.append(text[at:])
        if rows:
            yield batch_of(rows)
    if key is not None and depth > 0:
        yield batch_of([(*key, item, False, False, b"".join(held))])
