"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, pooled by their maximum
over a window of fixed length and classified by a softmax layer. The network is trained
in numpy on a bounded sample of labelled windows. Texts of any length are cut into
windows of that length, all of which are classified in batches; a text's scores are the
mean of its windows', weighted by their bytes.

After training, what a pair of bytes adds to the filters is tabulated, so a convolution
is the sum of two table rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.shared import column, map_batches, smallest, texts

UNKNOWN = "und"
LENGTH = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
SAMPLE_PER_LABEL = 400
WINDOWS_PER_TEXT = 3
EPOCHS = 6
BATCH = 64
RATE = 0.004
ROWS = 512
SEED = 7
LETTER = r"\p{L}"


@dataclass
class Network:
    """Labels in order, the filters tabulated by byte and place, biases, softmax layer."""

    labels: list
    filters: dict[int, list[np.ndarray]]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @cached_property
    def head(self) -> np.ndarray:
        """What the first two bytes of a place add to every filter, narrow filters first."""
        return np.concatenate([_pairs(*self.filters[width][:2]) for width in WIDTHS], axis=1)

    @cached_property
    def tail(self) -> np.ndarray:
        """What the next two bytes add to the filters of widths three and four."""
        three, four = self.filters[3], self.filters[4]
        return np.concatenate([_pairs(three[2], 0 * three[2]), _pairs(*four[2:])], axis=1)

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each window (rows of LENGTH bytes, zero padded)."""
        pairs = np.ascontiguousarray((windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]).T)
        best = np.full((len(windows), self.head.shape[1]), -np.inf, np.float32)
        total, more = np.empty_like(best), np.empty((len(windows), self.tail.shape[1]), np.float32)
        last = LENGTH - 2
        for place in range(LENGTH - 1):
            np.take(self.head, pairs[place], axis=0, out=total, mode="clip")
            if place < last:  # at the end, the filters of width four no longer fit, then those of three
                after = pairs[place + 2] if place + 2 < len(pairs) else windows[:, -1].astype(np.intp) * 256
                np.take(self.tail, after, axis=0, out=more, mode="clip")
                total[:, FILTERS:] += more
            fit = FILTERS * (3 if place < last - 1 else 2 if place < last else 1)
            np.maximum(best[:, :fit], total[:, :fit], out=best[:, :fit])
        return _softmax(np.maximum(best + self.bias, 0) @ self.weights + self.offset)


def _pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A row for each pair of bytes."""
    return (one[:, None] + two[None]).reshape(256 * 256, FILTERS)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(text: bytes, length: int = LENGTH) -> np.ndarray:
    """The whole text as windows; the last is zero padded."""
    data = np.frombuffer(text.lower(), np.uint8)
    rows = max(1, -(-len(data) // length))
    out = np.zeros(rows * length, np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, length)


def train(samples: list[tuple[bytes, object]]) -> Network | None:
    """Fit by Adam on the cross entropy of labelled windows; None without samples."""
    labels = sorted({label for _, label in samples})
    if not labels:
        return None
    number = {label: i for i, label in enumerate(labels)}
    x, y = [], []
    for text, label in samples:
        rows = cut(text)
        chosen = np.unique(np.linspace(0, len(rows) - 1, WINDOWS_PER_TEXT).astype(int))
        x.append(rows[chosen])
        y += [number[label]] * len(chosen)
    x, y = np.concatenate(x), np.array(y)
    rng = np.random.default_rng(SEED)
    size = FILTERS * len(WIDTHS)
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDING)), "o": np.zeros(len(labels)), "w": rng.normal(0, 0.1, (size, len(labels)))}
    for width in WIDTHS:
        p[f"f{width}"] = rng.normal(0, 0.3, (width * EMBEDDING, FILTERS))
        p[f"b{width}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = shuffled[at : at + BATCH]
            step += 1
            for k, g in _gradients(p, x[pick], y[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    filters = {w: [p["e"] @ part for part in p[f"f{w}"].reshape(w, EMBEDDING, FILTERS)] for w in WIDTHS}
    bias = np.concatenate([p[f"b{width}"] for width in WIDTHS])
    return Network(labels, filters, bias, p["w"], p["o"])


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> dict:
    n = len(x)
    embedded = p["e"][x]
    pooled, kept = [], {}
    for width in WIDTHS:
        places = x.shape[1] - width + 1
        stacked = np.concatenate([embedded[:, k : k + places] for k in range(width)], axis=2)
        total = stacked.reshape(-1, width * EMBEDDING) @ p[f"f{width}"]
        total = total.reshape(n, places, FILTERS)
        best = total.argmax(axis=1)
        top = np.take_along_axis(total, best[:, None], 1)[:, 0] + p[f"b{width}"]
        kept[width] = stacked, best, top > 0
        pooled.append(np.maximum(top, 0))
    pooled = np.concatenate(pooled, axis=1)
    error = _softmax(pooled @ p["w"] + p["o"])
    error[np.arange(n), y] -= 1
    error /= n
    g = {"w": pooled.T @ error, "o": error.sum(0), "e": np.zeros_like(p["e"])}
    back = error @ p["w"].T
    for i, width in enumerate(WIDTHS):
        stacked, best, open_ = kept[width]
        d = back[:, i * FILTERS : (i + 1) * FILTERS] * open_
        g[f"b{width}"] = d.sum(0)
        chosen = stacked[np.arange(n)[:, None], best]
        g[f"f{width}"] = np.einsum("nfe,nf->ef", chosen, d)
        into = d[:, :, None] * p[f"f{width}"].T[None]
        for k in range(width):
            at = x[np.arange(n)[:, None], best + k]
            np.add.at(g["e"], at.ravel(), into[:, :, k * EMBEDDING : (k + 1) * EMBEDDING].reshape(-1, EMBEDDING))
    return g


def sample(documents: DataFrame, training: Column, text_col: str, label_col: str, id_col: str, per_label: int) -> list:
    """Windows of at most `per_label` labelled texts of each label, with their labels.

    Texts are chosen by the hash of id and text. Of each, WINDOWS_PER_TEXT windows are
    taken, spread evenly from the text's beginning to its end.
    """
    text = F.col(f"`{text_col}`")
    rows = documents.where(training & F.col(f"`{label_col}`").isNotNull() & text.rlike(LETTER)).select(
        text.alias("text"),
        F.col(f"`{label_col}`").alias("label"),
        F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("order"),
    )
    room = F.greatest(F.length("text") - LENGTH, F.lit(0))
    places = [F.substring("text", F.floor(room * k / (WINDOWS_PER_TEXT - 1)).cast("int") + 1, F.lit(LENGTH)) for k in range(WINDOWS_PER_TEXT)]
    near = smallest(rows, "label", "order", per_label).select("label", "order", F.array_distinct(F.array(*places)).alias("windows"))
    # rows that repeat are counted before they meet, and no more than the limit come back
    near = near.groupBy("label", "order", "windows").agg(F.count("*").alias("n"))
    near = near.select("label", "order", "windows", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(per_label)))).alias("copy"))
    ranks = Window.partitionBy("label").orderBy("order", "windows", "copy")
    chosen = near.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= per_label).orderBy("label", "rank")
    return [(w.encode()[:LENGTH], r["label"]) for r in chosen.select("windows", "label").collect() for w in r["windows"]]


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1


def predict(network: Network | None, batch: list[bytes | None]) -> list[tuple[object, float]]:
    """(label, score) of each text; the windows of all texts are classified together."""
    out: list[tuple[object, float]] = [(UNKNOWN, 0.0)] * len(batch)
    if network is None:
        return out
    totals = np.zeros((len(batch), len(network.labels)))
    held: list[np.ndarray] = []
    owners: list[int] = []

    def classify() -> None:
        windows = np.concatenate(held)
        for at in range(0, len(windows), ROWS):
            part = windows[at : at + ROWS]
            weighted = network.scores(part) * np.count_nonzero(part, axis=1)[:, None]
            np.add.at(totals, np.array(owners[at : at + ROWS]), weighted)
        held.clear()
        owners.clear()

    for row, text in enumerate(batch):
        if text is None:
            continue
        for at in range(0, max(1, len(text)), LENGTH * ROWS):
            held.append(cut(text[at : at + LENGTH * ROWS]))
            owners += [row] * len(held[-1])
            if len(owners) >= ROWS:
                classify()
    if held:
        classify()
    for row, text in enumerate(batch):
        if text is not None:
            share = totals[row] / max(totals[row].sum(), 1e-12)
            out[row] = network.labels[int(share.argmax())], float(share.max())
    return out


def identify(
    documents: DataFrame,
    training: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_label: int = SAMPLE_PER_LABEL,
) -> DataFrame:
    """`documents` with lang_pred and score, learned from its labelled `training` rows.

    The fit takes at most `per_label` texts of each label, and of each WINDOWS_PER_TEXT
    windows spread over the whole text; prediction takes every text whole. Null texts, and those
    without a letter, are `und` with score zero, as is everything where there is
    nothing to learn from. Ids only serve to choose the sample; labels, sources and
    ids are no input of a prediction. Rows may repeat; an input column with the name
    of an output column is replaced by it.
    """
    if training is None:
        training = F.coalesce(~held_out(id_col), F.lit(True))
    network = train(sample(documents, training, text_col, label_col, id_col, per_label))
    names = [n for n in documents.columns if n not in ("lang_pred", "score")]
    schema = ", ".join(f"`{n}` {documents.schema[n].dataType.simpleString()}" for n in names)
    frame = documents.select(*[f"`{n}`" for n in names], F.coalesce(F.col(f"`{text_col}`").rlike(LETTER), F.lit(False)).alias("_letters"))

    def work(batch: pa.RecordBatch) -> dict:
        letters = column(batch, "_letters").to_pylist()
        found = predict(network, [text if letter else None for text, letter in zip(texts(batch, text_col), letters, strict=True)])
        out = {n: column(batch, n) for n in names}
        return out | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return map_batches(frame, schema + ", lang_pred string, score double", work)
