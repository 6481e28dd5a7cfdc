"""Quality rules by line labelling: a linear-chain conditional random field.

Lines are described by a few discrete features. A chain of two labels, boilerplate and
content, is fitted in numpy on a bounded sample of texts whose quality is known; every
text is then decoded by Viterbi, and the share of its words that stand in content lines
decides whether it is kept.

Texts are labelled whole, lines are not. Training sequences are therefore spliced: the
lines of a good text, then those of a poor one, so that the chain sees both labels and
the change between them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.shared import column, map_batches, rows_of, smallest, texts

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
KEEP_SHARE = 0.5
SAMPLE_PER_CLASS = 300
SAMPLE_LINES = 60
STRETCHES = 3
EPOCHS = 6
RATE = 0.1
DECAY = 1e-4

_NOT_COUNTED = bytes(range(0x80, 0xC0)) + BLANKS
_SENTENCE_END = re.compile(rb"[.!?:;\"')]$")
_EDGES = (
    (0, 1, 3, 6, 11, 21, 51),  # words
    (1e-9, 0.05, 0.2, 0.6),  # symbols a word
    (0.02, 0.1, 0.5),  # capitals a byte
    (1e-9, 0.05, 0.3),  # digits a byte
    (3, 5, 7, 10),  # bytes a word
)
_FIRST = np.concatenate(([0], np.cumsum([len(e) + 1 for e in _EDGES]))).tolist()
FEATURES = _FIRST[-1] + 6


def n_repeat_words(words: list[bytes]) -> int:
    """Words inside runs of five words that are found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    code, size = ids[:n].copy(), len(numbers)
    for k in range(1, WINDOW):
        if size * len(numbers) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max()) + 1
        code = code * len(numbers) + ids[k : k + n]
        size *= len(numbers)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW : WINDOW + n] -= again
    return int(np.count_nonzero(np.cumsum(edges)))


def _bucket(value: float, edges: tuple) -> int:
    k = 0
    for edge in edges:
        if value < edge:
            break
        k += 1
    return k


def features(line: bytes, words: int, seen: bool, first: bool, last: bool) -> list[int]:
    """The numbers of a line's features: one of each scale, then the flags it has."""
    size = max(1, len(line))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    capitals = sum(map(line.count, _CAPITALS)) if size <= 64 else size - len(line.translate(None, _UPPER))
    digits = size - len(line.translate(None, b"0123456789")) if line else 0
    values = (words, symbols / max(1, words), capitals / size, digits / size, size / max(1, words))
    out = [at + _bucket(v, e) for at, v, e in zip(_FIRST, values, _EDGES, strict=False)]
    flags = (seen, first, last, not _SENTENCE_END.search(line.rstrip()), b"|" in line, b"!!" in line)
    return out + [_FIRST[-1] + k for k, flag in enumerate(flags) if flag]


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CAPITALS = [bytes([b]) for b in _UPPER]


class Chain:
    """Weights of two labels (0 boilerplate, 1 content): features, changes, start."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, 2))
        self.t = np.zeros((2, 2))
        self.s = np.zeros(2)

    def emissions(self, lines: list[list[int]]) -> list[list[float]]:
        w = self.w
        return [w[line].sum(axis=0).tolist() for line in lines]

    def fit(self, sequences: list[tuple[list[list[int]], list[int]]]) -> Chain:
        """Ascent of the conditional likelihood, one sequence at a time."""
        rng = np.random.default_rng(5)
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for k in rng.permutation(len(sequences)):
                lines, gold = sequences[k]
                node, edge = self._marginals(self.emissions(lines))
                for i, line in enumerate(lines):
                    self.w[line, 1] += rate * (gold[i] - node[i])
                    self.w[line, 0] -= rate * (gold[i] - node[i])
                seen = np.zeros((2, 2))
                np.add.at(seen, (gold[:-1], gold[1:]), 1)
                self.t += rate * (seen - edge) / len(lines)
                self.s[gold[0]] += rate
                self.s -= rate * np.array([1 - node[0], node[0]])
                self.w *= 1 - DECAY
                self.t *= 1 - DECAY
        return self

    def _marginals(self, scores: list[list[float]]) -> tuple[list[float], np.ndarray]:
        """Share of label 1 at each line, and the expected number of each change."""
        t = np.exp(self.t)
        local = np.exp(np.array(scores) - np.max(scores, axis=1, keepdims=True))
        forward, backward = np.zeros_like(local), np.ones_like(local)
        forward[0] = local[0] * np.exp(self.s)
        forward[0] /= forward[0].sum()
        for i in range(1, len(local)):
            forward[i] = local[i] * (forward[i - 1] @ t)
            forward[i] /= forward[i].sum()
        edge = np.zeros((2, 2))
        for i in range(len(local) - 2, -1, -1):
            ahead = local[i + 1] * backward[i + 1]
            pair = forward[i][:, None] * t * ahead[None]
            edge += pair / pair.sum()
            backward[i] = t @ ahead
            backward[i] /= backward[i].sum()
        node = forward * backward
        return (node[:, 1] / node.sum(axis=1)).tolist(), edge

    def decode(self, lines: list[list[int]]) -> list[int]:
        """The best labels of a text's lines (Viterbi); ties go to content."""
        if not lines:
            return []
        scores = self.emissions(lines)
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = scores[0][0] + self.s[0], scores[0][1] + self.s[1]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + t00 > b + t10, a + t01 > b + t11
            a, b = x + (a + t00 if from_a else b + t10), y + (a + t01 if from_b else b + t11)
            back.append((0 if from_a else 1, 0 if from_b else 1))
        label = 0 if a > b else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def lines_of(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """Features and word counts of the lines with a word, and the lines seen before."""
    seen: set[bytes] = set()
    lines, counts, again = [], [], 0
    parts = text.split(b"\n")
    for k, line in enumerate(parts):
        words = len(line.split())
        if words:
            known = line in seen
            again += known
            seen.add(line)
            lines.append(features(line, words, known, k == 0, k == len(parts) - 1))
            counts.append(words)
    return lines, counts, again


def spread(lines: list) -> list:
    """SAMPLE_LINES lines at most: stretches at even distances over the whole text."""
    if len(lines) <= SAMPLE_LINES:
        return lines
    size = SAMPLE_LINES // STRETCHES
    starts = np.linspace(0, len(lines) - size, STRETCHES).astype(int).tolist()
    return [line for start in starts for line in lines[start : start + size]]


def sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> list[tuple[list, int]]:
    """Lines of at most `per_class` texts of either quality, chosen by the hash of the id.

    Features are those of the whole text, found where the text is; of each text only the
    lines of `spread` leave the task.
    """
    good = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = smallest(good.withColumn("order", F.xxhash64(F.col("doc_id").cast("string"))), "quality", "order", per_class)
    ranks = Window.partitionBy("quality").orderBy("order", "doc_id")
    picked = picked.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= per_class)
    rows = rows_of(documents, id=id_col, text=text_col).where("id is not null and text is not null")
    # twice `per_class` rows at most
    rows = rows.join(F.broadcast(picked), rows["id"] == picked["doc_id"]).select("quality", "rank", "text")

    def work(batch: pa.RecordBatch) -> dict:
        return {n: column(batch, n) for n in ("quality", "rank")} | {"lines": [spread(lines_of(text)[0]) for text in texts(batch)]}

    described = map_batches(rows, "quality int, rank int, lines array<array<int>>", work)
    described = described.groupBy("quality", "rank").agg(F.min("lines").alias("lines")).orderBy("quality", "rank")
    return [(r["lines"], int(r["quality"])) for r in described.collect()]


def train(samples: list[tuple[list, int]]) -> Chain | None:
    """A fitted chain, or None unless there are lines of either quality."""
    by = {0: [], 1: []}
    for lines, quality in samples:
        if lines:
            by[quality].append(lines)
    if not by[0] or not by[1]:
        return None
    sequences = []
    for k in range(max(len(by[0]), len(by[1]))):
        good, poor = by[1][k % len(by[1])], by[0][k % len(by[0])]
        parts = [(good, 1), (poor, 0)] if k % 2 else [(poor, 0), (good, 1)]
        sequences.append((parts[0][0] + parts[1][0], [parts[0][1]] * len(parts[0][0]) + [parts[1][1]] * len(parts[1][0])))
    return Chain().fit(sequences)


def judge(text: bytes | None, chain: Chain | None) -> tuple:
    text = text or b""
    words = text.split()
    lines, counts, again = lines_of(text)
    repeats = n_repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    labels = chain.decode(lines) if chain else [1] * len(lines)
    content = sum(n for n, label in zip(counts, labels, strict=True) if label)
    share = content / max(1, len(words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), len(text.translate(None, _NOT_COUNTED)), symbols, again, repeats, failed, not failed and share >= KEEP_SHARE, share


def label_lines(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = SAMPLE_PER_CLASS,
) -> DataFrame:
    """Counts and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, content_share.

    The chain is fitted on at most `per_class` texts of each quality, of each at most
    SAMPLE_LINES lines in stretches over the whole text; texts are judged whole. Where one of
    the qualities has no text, all lines are content. A text that is null or blank has
    no words and fails. Ties in decoding go to content. Rows may repeat; columns other
    than id and text are ignored.
    """
    chain = train(sample(documents, labels, id_col, text_col, per_class))
    frame = rows_of(documents, id=id_col, text=text_col)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

    def work(batch: pa.RecordBatch) -> dict:
        rows = [judge(text, chain) for text in texts(batch)]
        return {"id": column(batch, "id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    schema = f"id {frame.schema['id'].dataType.simpleString()}, " + ", ".join(
        f"{n} {'boolean' if n in ('base_failed', 'kept') else 'double' if n == 'content_share' else 'bigint'}" for n in names
    )
    return map_batches(frame, schema, work)
