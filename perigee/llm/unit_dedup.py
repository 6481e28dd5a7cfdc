"""Substring dedup by hashed units of text: the earliest of equal units stays.

There are units of two kinds. A unit of lines is a shortest run of lines that holds
enough words: a long enough line alone, or short lines together. A unit within a
paragraph begins where the text itself says so: at the place whose next words have the
least hash of all places nearby; it holds as many words, whatever the line feeds. Two
texts that share a passage cut it alike, so a shared passage of `min_words` + `REACH` - 1
words or more has a unit in common, wherever it begins and ends in the lines of either.

Units are normalised and hashed; digests are grouped globally, the earliest ranked
occurrence of each is kept, and all others are removed. Original offsets of what is
removed are retained.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import column, map_batches, rows_of, shared_folder, stored, texts

MIN_WORDS = 25
# places among which the one with the least hash of its next HASHED words begins a unit
REACH, HASHED = 26, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
REMOVED = "array<struct<line:int,start:bigint,end:bigint>>"


def _loops(run: list[bytes]) -> bool:
    """Whether the lines of a run repeat with a period of half the run or less."""
    return any(run[k:] == run[:-k] for k in range(1, len(run) // 2 + 1))


def units_of(text: bytes, min_words: int) -> list[tuple[int, int, bool, bytes]]:
    """(first line, last line, loops, digest) of the shortest runs of `min_words` words or
    more that begin or end at a line. Blank lines do not break a run."""
    held = [(number, words) for number, line in enumerate(text.split(b"\n")) if (words := line.lower().split())]
    sizes = [0, *accumulate(len(words) for _, words in held)]
    runs, at = set(), 0
    for end in range(1, len(held) + 1):
        first = at
        while sizes[end] - sizes[at] >= min_words:
            at += 1
        # runs from `first` to before `at` end here at the earliest; the last of them is the shortest before `end`
        runs.update((k, end) for k in range(first, at))
        if at:
            runs.add((at - 1, end))
    out = []
    for k, end in sorted(runs):
        lines = [b" ".join(words) for _, words in held[k:end]]
        digest = hashlib.blake2b(b" ".join(lines), digest_size=16).digest()
        out.append((held[k][0], held[end - 1][0], _loops(lines), digest))
    return out


def inner_units(text: bytes, min_words: int, reach: int = REACH) -> list[tuple[int, int, bool, bytes]]:
    """(first word, last word, loops, digest) of the units that the words themselves cut.

    Of equal hashes the first place counts, so of a loop every place may begin a unit.
    """
    words = text.lower().split()
    places = len(words) - min_words + 1
    if places < 1:
        return []
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = np.zeros(places, np.uint64)
    for k in range(min(HASHED, min_words)):
        mixed = (mixed ^ each[k : k + places]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    if places <= reach:
        chosen = [int(mixed.argmin())]
    else:
        near = np.lib.stride_tricks.sliding_window_view(mixed, reach)
        chosen = np.unique(near.argmin(1) + np.arange(len(near))).tolist()
    out = []
    for at in chosen:
        held = words[at : at + min_words]
        digest = hashlib.blake2b(b" ".join(held), digest_size=16, person=b"inner").digest()
        out.append((at, at + min_words - 1, _loops(held), digest))
    return out


def without(text: bytes, gone: list[dict]) -> tuple[bytes, list[dict]]:
    """The text less runs of lines and runs of words, and what was taken out of which
    line: its number, start and end in code points. Whole lines go with their feeds."""
    numbers = {k for run in gone if not run["inner"] for k in range(run["first"], run["last"] + 1)}
    value = text.decode("utf-8", "replace")
    spans = _spans(value, sorted((run["first"], run["last"]) for run in gone if run["inner"]))
    left, removed, at, next_span = [], [], 0, 0
    for number, line in enumerate(value.split("\n")):
        end = at + len(line)
        parts = []
        while next_span < len(spans) and spans[next_span][0] < end:
            start, stop = spans[next_span]
            if max(start, at) < min(stop, end):
                parts.append((max(start, at), min(stop, end)))
            if stop > end:
                break
            next_span += 1
        if number in numbers:
            removed.append({"line": number, "start": at, "end": end})
        else:
            rest, done = [], at
            for start, stop in parts:
                removed.append({"line": number, "start": start, "end": stop})
                rest.append(value[done:start])
                done = stop
            left.append("".join([*rest, value[done:end]]))
        at = end + 1
    return "\n".join(left).encode(), removed


def _spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end in the text of runs of words, runs that touch or overlap as one."""
    merged: list[list[int]] = []
    for first, last in runs:
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    if not merged:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[first][0], places[last][1]) for first, last in merged]


def _key(text_col: str):
    """A row's text by a hash: with the id it is a document, of which rows may repeat."""
    return F.xxhash64(F.coalesce(text_col, F.lit("")), F.col(text_col).isNull())


def units(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, key, inner, first, last, loops, digest) of the units of (id, text) rows: of
    lines, counted by line, and of words (inner), counted by word."""
    frame = documents.select("id", _key("text").alias("key"), "text").where(F.col("text").isNotNull())
    id_type = frame.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        flat, owner = [], []
        for row, text in enumerate(texts(batch)):
            found = [(False, *u) for u in units_of(text, min_words)] + [(True, *u) for u in inner_units(text, min_words)]
            flat += found
            owner += [row] * len(found)
        owner = pa.array(owner, pa.int64())
        made = list(zip(*flat, strict=True)) or [[]] * 5
        names = ("inner", "first", "last", "loops", "digest")
        return {"id": column(batch, "id").take(owner), "key": column(batch, "key").take(owner)} | dict(zip(names, map(list, made), strict=True))

    return map_batches(frame, f"id {id_type}, key bigint, inner boolean, first int, last int, loops boolean, digest binary", work)


def deduplicate(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, folder: str | None = None
) -> DataFrame:
    """Every row as (id, text, removed): the text left, and what was taken out of its lines.

    Units are the shortest runs of lines with `min_words` words or more, and runs of
    `min_words` words that begin where their hash is least nearby, compared with A-Z
    lower-cased and blanks (20, 09-0D, line feeds) collapsed; a short line goes only
    within a repeated run of that many words. Runs in which a few short lines or words
    come again and again are compared with other documents alone, so that such a loop
    stays where it first stands. Occurrences rank by id (nulls last), then by a hash of
    the text, then by place; an earliest one stays unless a unit that overlaps it goes.
    `removed` has line number, start and end in the original text in order; a whole
    line's feed goes with it, and so do blank lines within a removed run of lines. A null
    text stays null; rows that repeat whole are one document and fare alike; other
    columns are ignored.
    """
    folder = folder or shared_folder(documents.sparkSession)
    rows = rows_of(documents, id=id_col, text=text_col)
    found = stored(units(rows, min_words), f"{folder}/units")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key", "first")
    grouped = found.groupBy("digest").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = grouped.select("digest", *[F.col(f"kept.{x}").alias(f"kept_{x}") for x in ("id", "key", "first")])
    # written, so that both sides of the join are plain shuffles and a hot digest can be split
    kept = stored(kept, f"{folder}/kept")
    other = ~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    gone = found.join(kept, "digest").where(other | ((F.col("first") != F.col("kept_first")) & ~F.col("loops")))
    gone = gone.groupBy("id", "key").agg(F.collect_set(F.struct("inner", "first", "last")).alias("gone"))
    gone = stored(gone, f"{folder}/removed").select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), "gone")
    keyed = rows.withColumn("key", _key("text"))
    same = (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id"))
    out = keyed.join(gone, same, "left").select("id", "text", "gone")

    def work(batch: pa.RecordBatch) -> dict:
        left, removed = [], []
        for text, runs in zip(texts(batch), column(batch, "gone").to_pylist(), strict=True):
            rest, spans = without(text, runs) if runs else (text, [])
            left.append(rest)
            removed.append(spans)
        return {"id": column(batch, "id"), "text": pa.array(left, pa.binary()).view(pa.string()), "removed": removed}

    return map_batches(out, f"id {rows.schema['id'].dataType.simpleString()}, text string, removed {REMOVED}", work)
