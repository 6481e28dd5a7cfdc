"""Vector code compression: product codes, with equal-average search for nearest entries.

A vector is cut into equal consecutive parts, and each part is replaced by the number of
the nearest entry in its position's codebook. Entries of a codebook lie in the order of
their component sums. By Cauchy and Schwarz the squared gap between two sums, over the
dimension of a part, is no more than the squared distance; so the search begins at the
sum of the part, goes outwards to the entry whose sum is next, and stops once that bound
strictly exceeds the best distance found. It is exact, ties included.

Codebooks are small (ENTRIES times the dimension of a vector), whatever the table's size;
a round sums up parts by entry in the tasks and then by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.shared import column, map_batches, rows_of, shared_folder, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
# whole components beyond are taken for it, so that squared distances of parts fit in 64 bits
MOST = 1 << 24
FAR = np.iinfo(np.int64).max


class Codebooks:
    """One codebook a part position, as an array (parts, entries, width) of integers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        sums = self.entries.sum(2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of each vector: arrays (vectors, parts).

        All parts of all vectors step outwards together, each until its own bound holds.
        """
        parts, count, width = self.entries.shape
        values = vectors.reshape(-1, width)
        position = np.tile(np.arange(parts), len(vectors))
        total = values.sum(1)
        right = np.empty(len(values), np.int64)
        for p in range(parts):
            right[p::parts] = np.searchsorted(self.sums[p], total[p::parts])
        left = right - 1
        best, entry = np.full(len(values), FAR), np.full(len(values), count)
        live = np.arange(len(values))
        while len(live):
            pos, low, high = position[live], left[live], right[live]
            below = np.where(low >= 0, total[live] - self.sums[pos, np.maximum(low, 0)], FAR)
            above = np.where(high < count, self.sums[pos, np.minimum(high, count - 1)] - total[live], FAR)
            down = below <= above
            gap = np.where(down, below, above)
            # the slack of the last place keeps rounding of large squares on the safe side
            go = (gap < FAR) & (gap.astype(np.float64) ** 2 * (1 - 1e-12) <= best[live].astype(np.float64) * width)
            live, down = live[go], down[go]
            at = np.where(down, left[live], right[live])
            tried = self.order[position[live], at]
            away = ((values[live] - self.entries[position[live], tried]) ** 2).sum(1)
            nearer = (away < best[live]) | ((away == best[live]) & (tried < entry[live]))
            best[live] = np.where(nearer, away, best[live])
            entry[live] = np.where(nearer, tried, entry[live])
            left[live] -= down
            right[live] += ~down
        return entry.reshape(-1, parts), best.reshape(-1, parts)

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, whole): rows with a vector of finite components, as whole numbers."""
    rows = rows_of(vectors, id=id_col, label=label_col, vector=vector_col)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    inside = lambda x: F.greatest(F.least(F.floor(x), F.lit(MOST)), F.lit(-MOST)).cast("int")
    whole = F.transform("vector", lambda x: inside(F.greatest(F.least(x.cast("double"), F.lit(float(MOST))), F.lit(float(-MOST))) * SCALE))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite).select("id", "label", whole.alias("whole"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = column(batch, "whole").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(batch.num_rows, -1)


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are the floored means of their parts; unused entries stay."""
    parts, count, width = books.entries.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((parts * count, width), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch)
                entry, _ = books.nearest(matrix)
                slot = (entry + np.arange(parts) * count).ravel()
                held += np.bincount(slot, minlength=parts * count)
                np.add.at(sums, slot, matrix.reshape(-1, width))
        used = np.flatnonzero(held)
        each = [np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[used].ravel(), np.repeat(held[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in each], names=["slot", "place", "total", "n"])

    found = rows.mapInArrow(totals, "slot bigint, place bigint, total bigint, n bigint")
    # as many rows as the codebooks have components
    means = found.groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    entries = books.entries.reshape(parts * count, width).copy()
    for slot, place, total, n in means:
        entries[slot, place] = total // n
    return Codebooks(entries.reshape(parts, count, width))


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    folder: str | None = None,
) -> tuple[DataFrame, Codebooks | None]:
    """(rows, codebooks): (id, label, codes, errors) of every kept row.

    Components are floor(256 x), beyond 2^24 either way taken for that; `codes` holds the
    entry of each part and `errors` its squared distance. Codebooks start as the parts of
    the `entries` smallest ids (all rows, where there are fewer; nulls last, equal ids by
    their vectors), and each round replaces an entry by the floored mean of its parts.

    Dropped are rows whose vector is null or empty, has a null or non-finite component,
    or has another length than the first row by that order. That length has to be
    divisible by `parts`, else ValueError. Labels may be null; rows may repeat, each
    counts; without kept rows there are no codebooks (None) and no rows. Other columns
    are ignored.
    """
    folder = folder or shared_folder(vectors.sparkSession)
    rows = quantised(vectors, id_col, vector_col, label_col)
    id_type, label_type = (rows.schema[x].dataType.simpleString() for x in ("id", "label"))
    schema = f"id {id_type}, label {label_type}, codes array<int>, errors array<bigint>"
    rows = stored(rows, f"{folder}/whole")
    ranked = (F.col("id").asc_nulls_last(), F.col("whole").asc())
    first = rows.orderBy(*ranked).limit(1).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], schema), None
    size = len(first[0]["whole"])
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("whole") == size)
    start = np.array([x["whole"] for x in rows.orderBy(*ranked).limit(entries).collect()], np.int64)
    books = Codebooks(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = improved(rows, books)

    def work(batch: pa.RecordBatch) -> dict:
        entry, away = books.nearest(_matrix(batch))
        ends = pa.array(np.arange(batch.num_rows + 1) * parts, pa.int32())
        return {
            "id": column(batch, "id"),
            "label": column(batch, "label"),
            "codes": pa.ListArray.from_arrays(ends, pa.array(entry.ravel().astype(np.int32))),
            "errors": pa.ListArray.from_arrays(ends, pa.array(away.ravel())),
        }

    return stored(map_batches(rows, schema, work), f"{folder}/codes"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """(id, codes, error, label_error): errors summed over parts, and over equal labels.

    A label may hold any share of the rows: its sum is formed in the tasks first, and the
    join brings one row a label to them (nulls are one label).
    """
    coded = coded.withColumn("error", F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("id", "label", "codes", "error", "label_error")


def reconstructed(coded: DataFrame, books: Codebooks) -> DataFrame:
    """`coded` with `vector`: the entries that its codes name, back on the scale of the input."""
    # cut at the middle of the whole numbers that floor to an entry
    table = (books.entries + 0.5) / SCALE
    names = [x for x in coded.columns if x != "vector"]
    schema = "".join(f"`{x}` {coded.schema[x].dataType.simpleString()}, " for x in names)

    def work(batch: pa.RecordBatch) -> dict:
        codes = column(batch, "codes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        found = table[np.arange(len(table)), codes].reshape(batch.num_rows, -1)
        ends = pa.array(np.arange(batch.num_rows + 1) * found.shape[1], pa.int32())
        values = pa.array(found.ravel().astype(np.float32))
        return {x: column(batch, x) for x in names} | {"vector": pa.ListArray.from_arrays(ends, values)}

    return map_batches(coded.select(*[f"`{x}`" for x in names]), f"{schema}vector array<float>", work)
