"""Benchmark decontamination by an FM-index per training shard.

A shard is the texts of one map task, cut at a bound on its words. Words that occur in
no test phrase can't be part of a match, so they end a run; runs that are shorter than
every phrase can't hold one. The remaining runs are laid out as one sequence of word
numbers and indexed: suffix order, a wavelet matrix over the transform, and every
`SAMPLE`-th suffix position. All phrases are searched backwards at once, and matches
are located by walking to the next sampled position.

The test set is taken in blocks of bounded size. The driver holds one block (and one
partition of the test set) at a time; it is shipped to the tasks, which add its spans to
those of the blocks before, and what they return is written before the next block is
taken. So neither its size nor the number of blocks is tied to anyone's memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from perigee.llm.shared import column, shared_folder, stored, texts

WINDOW = 10
SAMPLE = 8
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20

# bytes that are no part of a word: 00-2F, 3A-60 and 7B-7F (A-Z are lower-cased first)
SPLIT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(SPLIT).split()


def windows(words: list, width: int = WINDOW) -> list[tuple]:
    """All runs of `width` words; one run of all words where there are fewer, if any."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Phrases:
    """The distinct windows of some items: word numbers from 2, rows, and their items."""

    def __init__(self, items: list[tuple], width: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        holders: dict[tuple, list] = {}
        for item, text in items:
            for window in set(windows(words_of(text), width)):
                numbers = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in window)
                holders.setdefault(numbers, []).append(item)
        self.items = list(holders.values())
        self.lengths = np.array([len(p) for p in holders], np.int64)
        self.shortest = int(self.lengths.min()) if holders else 0
        self.rows = np.zeros((len(holders), width), np.int64)
        for row, numbers in enumerate(holders):
            self.rows[row, : len(numbers)] = numbers


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling."""
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    ordered = sequence[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    step = 1
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        step *= 2
    return order


class Wavelet:
    """Ranks of a symbol in a prefix of the sequence: one bit row a level."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros, self.ones = [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        start = np.zeros_like(end)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = (symbol >> (self.bits - 1 - level)) & 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Count and locate phrases in a sequence of numbers that ends with its only 0."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        order = suffix_order(sequence)
        self.n = len(sequence)
        last = sequence[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=symbols + 1))))
        self.last = last
        self.wavelet = Wavelet(last, max(1, int(symbols).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.positions = order[self.sampled]

    def ranges(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase, all phrases searched backwards together."""
        low = np.zeros(len(rows), np.int64)
        high = np.full(len(rows), self.n, np.int64)
        for back in range(rows.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            if not len(live):
                break
            symbol = rows[live, lengths[live] - 1 - back]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps backwards until a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(live := np.flatnonzero(~self.sampled[at])):
            symbol = self.last[at[live]]
            at[live] = self.first[symbol] + self.wavelet.rank(symbol, at[live])
            steps[live] += 1
        return self.positions[self.sample_rank[at]] + steps


def matches(runs: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word position, phrase) of every occurrence; runs: text, start, words."""
    none = np.zeros(0, np.int64)
    if not runs or not len(phrases.lengths):
        return none, none, none
    parts, lengths = [], [len(run) + 1 for _, _, run in runs]
    for _, _, run in runs:
        parts += [run, np.ones(1, np.int64)]  # 1 ends a run, 0 the sequence
    index = FMIndex(np.concatenate([*parts, np.zeros(1, np.int64)]), len(phrases.vocabulary) + 1)
    low, high = index.ranges(phrases.rows, phrases.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(low)), counts)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    found = index.locate(rows)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    run = np.searchsorted(starts, found, "right") - 1
    text = np.array([t for t, _, _ in runs])[run]
    position = found - starts[run] + np.array([s for _, s, _ in runs])[run]
    return text, position, phrase


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The union of half-open spans as ordered, separate spans."""
    out: list[list[int]] = []
    for start, end in sorted(zip(starts, ends, strict=True)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _search(documents: DataFrame, text_col: str, items: list[tuple], width: int, item: DataType) -> DataFrame:
    phrases = Phrases(items, width)
    item_type, arrow_item = item.simpleString(), to_arrow_type(item)
    names = [n for n in documents.columns if n not in ("n_words", "hit_spans", "hit_items")]
    schema = ", ".join(f"`{n}` {documents.schema[n].dataType.simpleString()}" for n in names)
    schema += f", n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<{item_type}>"
    more = "hit_spans" in documents.columns

    def run(batches):
        for batch in batches:
            count, spans, found = [], [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            if more:
                for row, old in enumerate(column(batch, "hit_spans").to_pylist()):
                    spans[row] = [(s["start"], s["end"]) for s in old]
                for row, old in enumerate(column(batch, "hit_items").to_pylist()):
                    found[row].update(old)
            runs, held = [], 0

            def flush(runs, spans=spans, found=found):
                for text, position, phrase in zip(*(x.tolist() for x in matches(runs, phrases)), strict=True):
                    spans[text].append((position, position + int(phrases.lengths[phrase])))
                    found[text].update(item for item in phrases.items[phrase] if item is not None)

            number = phrases.vocabulary.get
            for row, text in enumerate(texts(batch, text_col)):
                tokens = words_of(text)
                count.append(len(tokens))
                if not phrases.shortest:
                    continue
                numbers = np.fromiter((number(w, 0) for w in tokens), np.int64, len(tokens))
                stops = np.concatenate(([-1], np.flatnonzero(numbers == 0), [len(numbers)]))
                for gap in np.flatnonzero(np.diff(stops) > phrases.shortest):
                    start, end = int(stops[gap]) + 1, int(stops[gap + 1])
                    # a long run is cut; what is cut shares a window less one word
                    for at in range(start, max(start + 1, end - width + 1), SHARD_WORDS):
                        part = numbers[at : min(end, at + SHARD_WORDS + width - 1)]
                        runs.append((row, at, part))
                        held += len(part)
                        if held >= SHARD_WORDS:
                            flush(runs)
                            runs, held = [], 0
            flush(runs)
            spans = [merged([s for s, _ in x], [e for _, e in x]) for x in spans]
            arrays = [column(batch, n) for n in names]
            struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays += [
                pa.array(count, pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], struct),
                pa.array([sorted(x) for x in found], pa.list_(arrow_item)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "hit_spans", "hit_items"])

    return documents.select(*[f"`{n}`" for n in names], *(["n_words", "hit_spans", "hit_items"] if more else [])).mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, width: int):
    """The test items in blocks of about `block_words` words, one at a time on the driver.

    A longer item is cut into parts that share a window less one word.
    """
    rows = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        words = words_of(text.encode())
        for at in range(0, max(1, len(words) - width + 1), block_words):
            part = words[at : at + block_words + width - 1]
            held.append((item, b" ".join(part)))
            size += len(part)
            if size >= block_words:
                yield held
                held, size = [], 0
    if held:
        yield held


def contaminated_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    folder: str | None = None,
) -> DataFrame:
    """`documents` with n_words, hit_spans (merged word spans) and hit_items (sorted).

    A phrase is any `window` consecutive words of a test item, or the whole item where
    it has fewer. Null and wordless texts have no words and no hits; null items are
    left out, items without an id hit but are not listed; an empty test set hits nothing.
    Rows may repeat. An input column that has the name of an output column is replaced by
    it. Item ids may be of any type that has an order. `folder` takes what is written
    between blocks.
    """
    item = benchmark.schema[item_col].dataType
    out, searched = documents.drop("n_words", "hit_spans", "hit_items"), 0
    for block in _blocks(benchmark, item_col, item_text_col, block_words, window):
        if searched:
            folder = folder or shared_folder(documents.sparkSession)
            out = stored(out, f"{folder}/block-{searched}")
        out = _search(out, text_col, block, window, item)
        searched += 1
    return out if searched else _search(out, text_col, [], window, item)


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def items_digest() -> Column:
    names = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return F.sha2(F.array_join(names, ","), 256)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between those of one span."""
    places = [m.span() for m in re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    for start, end in reversed(spans):
        text = text[: places[start][0]] + text[places[end - 1][1] :]
    return text
