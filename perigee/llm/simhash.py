"""SimHash near-duplicates: segment popcounts, a grid under Manhattan distance, exact links.

Two fingerprints at Hamming distance d have segment popcounts at Manhattan distance d
at most. Popcount vectors are therefore cells of a grid: only fingerprints of one cell,
or of cells at most `MAX_BITS` apart, can be linked, and cells that far apart share a
cell one step away from both. Few cells of a large corpus have such company. The
fingerprints in them are verified exactly: two of them differ in two bits or fewer if
and only if they share a value that differs from each in one bit or none.

Neither step lists pairs. A cell has 2 * SEGMENTS neighbours and a value 64, so every
group that is formed holds at most 65 rows, however many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.components import connected
from perigee.llm.shared import column, map_batches, rows_of, shared_folder, stored, texts

BITS = 64
SEGMENTS = 32
WIDTH = BITS // SEGMENTS
MAX_BITS = 2
SEED = 42
CHUNK = 1 << 14

# similarity of texts: words of a shingle, least share of shingles, minima a band, bands
WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 4, 16
# distinct shingles of the texts that are compared at once
BLOCK = 1 << 20
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = 3) -> Iterator[np.ndarray]:
    """XXH64 values of the word shingles, repeats included, in chunks of bounded size."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(tokens) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)


def majority(chunks: Iterable[np.ndarray]) -> int:
    """Bits that are set in over half of the values; no values give zero."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in chunks:
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Majority bits of the XXH64 values of the word shingles, repeats included."""
    return majority(shingles(text, words))


def fingerprints(documents: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row; fp holds the 64 bits as a signed long."""
    frame = rows_of(documents, id=id_col, text=text_col)
    id_type = frame.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(text, words) for text in texts(batch)], np.uint64)
        return {"id": column(batch, "id"), "fp": pa.array(values.view(np.int64))}

    return map_batches(frame, f"id {id_type}, fp bigint", work)


def cell(fp: str) -> Column:
    """The popcounts of the segments, `WIDTH` bits each, packed into a long."""
    parts = [
        F.shiftleft(F.bit_count(F.shiftrightunsigned(F.col(fp), WIDTH * k).bitwiseAND((1 << WIDTH) - 1)).cast("long"), WIDTH * k)
        for k in range(SEGMENTS)
    ]
    return reduce(Column.bitwiseOR, parts)


def _steps(packed: str) -> Column:
    """A cell and its neighbours at Manhattan distance one, within the grid."""
    around = [F.col(packed)]
    for k in range(SEGMENTS):
        count = F.shiftrightunsigned(F.col(packed), WIDTH * k).bitwiseAND((1 << WIDTH) - 1).cast("long")
        for other, within in ((count - 1, count > 0), (count + 1, count < WIDTH)):
            changed = F.shiftleft(count.bitwiseXOR(other), WIDTH * k)
            around.append(F.when(within, F.col(packed).bitwiseXOR(changed)))
    return F.filter(F.array(*around), lambda x: x.isNotNull())


def links(distinct: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) that connect all distinct `fp` within two bits of each other."""
    cells = distinct.select(cell("fp").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    cells = stored(cells, f"{folder}/cells")
    touched = cells.select("cell", F.explode(_steps("cell")).alias("near"))
    # at most 2 * SEGMENTS + 1 cells touch a cell
    shared = touched.groupBy("near").agg(F.count("*").alias("n"), F.collect_list("cell").alias("cells")).where("n > 1")
    company = shared.select(F.explode("cells").alias("cell")).unionAll(cells.where("n > 1").select("cell")).distinct()
    kept = distinct.select("fp", cell("fp").alias("cell")).join(company, "cell", "left_semi").select("fp")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(BITS)])
    near = kept.select("fp", F.explode(flips).alias("value"))
    # at most BITS + 1 fingerprints share a value, and all of them are within two bits
    groups = near.groupBy("value").agg(F.count("*").alias("n"), F.collect_list("fp").alias("fps"), F.min("fp").alias("b"))
    return groups.where("n > 1").select(F.explode("fps").alias("a"), "b").where("a <> b")


def rooted_prints(rows: DataFrame, distinct: DataFrame, folder: str) -> DataFrame:
    """`rows` with the root of their fingerprint's component; `distinct` has each `fp` once."""
    roots = connected(links(distinct, folder), folder).withColumnRenamed("node", "fp")
    return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    documents: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Fingerprint and component of every row: (id, fp, component).

    `component` is the smallest id that is reached over links of at most two differing
    bits, itself included. Null and blank texts have fingerprint zero and link like any
    other. A null id takes part but never names a component unless all its ids are null.
    Rows may repeat; an empty table gives an empty result; other columns are ignored.
    """
    folder = folder or shared_folder(documents.sparkSession)
    prints = stored(fingerprints(documents, words, id_col, text_col), f"{folder}/prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), f"{folder}/distinct")
    rooted = stored(rooted_prints(distinct, distinct, folder), f"{folder}/rooted")
    # only components of several fingerprints need another minimum
    several = rooted.where("root <> fp").select("root").distinct()
    least = rooted.join(several, "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of shingles under each permutation, band by band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    if len(hashes):
        for k in range(BANDS * ROWS):
            low[k] = ((hashes ^ _MIX[0, k]) * _MIX[1, k]).min()
    return low


def band_values(low: np.ndarray) -> list[int]:
    """A signed value for each band of minima."""
    parts = low.reshape(BANDS, ROWS)
    return [np.uint64(xxhash.xxh64_intdigest(part.tobytes(), band)).astype(np.int64).item() for band, part in enumerate(parts)]


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, words)]))


class Sets:
    """Shingle sets of a block of texts, by shingle: which texts hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def similarity(self, one: np.ndarray) -> np.ndarray:
        """The Jaccard similarity of a set to each of the block's; two empty ones are alike."""
        low = np.searchsorted(self.values, one, "left")
        counts = np.searchsorted(self.values, one, "right") - low
        place = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(self.owner[place], minlength=len(self.sizes))
        union = len(one) + self.sizes - both
        return np.where(union > 0, both / np.maximum(union, 1), 1.0)


class Forest:
    """Which nodes are connected so far; joining two tells whether that was new."""

    def __init__(self) -> None:
        self.up: dict = {}

    def top(self, node):
        while (parent := self.up.get(node, node)) != node:
            self.up[node] = self.up.get(parent, parent)
            node = parent
        return node

    def join(self, a, b) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def sketches(rows: DataFrame, words: int, print_words: int | None = None) -> DataFrame:
    """(node, id, size, bands, fp) of rows (node, id, text); size: distinct shingles; fp: the
    fingerprint over shingles of `print_words` words, if that is given."""
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        sizes, bands, prints = [], [], []
        for text in texts(batch):
            if print_words is not None:
                prints.append(fingerprint(text, print_words))
            held = shingle_set(text, words)
            sizes.append(len(held))
            bands.append(band_values(minima(held)))
        fp = pa.nulls(len(sizes)) if print_words is None else pa.array(np.array(prints, np.uint64).view(np.int64))
        return {"node": column(batch, "node"), "id": column(batch, "id"), "size": sizes, "bands": bands, "fp": fp}

    return map_batches(rows, f"node binary, id {id_type}, size bigint, bands array<bigint>, fp bigint", work)


def fingerprint_links(distinct: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) of the texts (node, fp) of each component of fingerprints, as
    `near_duplicates` connects them, with the component's first text."""
    prints = stored(distinct.select("fp").distinct(), f"{folder}/prints")
    rooted = stored(rooted_prints(distinct.select("node", "fp"), prints, folder).select("node", "root"), f"{folder}/rooted")
    groups = rooted.groupBy("root").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b <> high")
    return rooted.join(groups.drop("high"), "root").where("node <> b").select(F.col("node").alias("a"), "b")


def memberships(distinct: DataFrame) -> DataFrame:
    """(band, value, node, size, low): the texts of every group of a band with its first
    text. Texts alone in a group are left out."""
    banded = distinct.select("node", "size", F.posexplode("bands").alias("band", "value"))
    groups = banded.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return banded.join(groups.where("low <> high").drop("high"), ["band", "value"])


def first_texts(members: DataFrame, block: int) -> DataFrame:
    """(part, node, root, asked): what is compared first, the texts of each group with
    the group's first text. A part holds texts of one first text, about `block` shingles
    of them, and the first text itself (asked); texts that meet again come once."""
    pairs = members.where("node <> low").select("low", "node", "size").distinct()
    parts = pairs.groupBy("low").agg(F.ceil(F.sum("size") / block).alias("parts"))
    placed = pairs.join(parts, "low").withColumn("part", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))))
    placed = placed.select(F.struct("low", "part").alias("part"), "low", "node")
    asked = placed.select("part", F.col("low").alias("node")).distinct()
    rows = placed.select("part", "node", F.col("node").alias("root"), F.lit(False).alias("asked"))
    return rows.unionByName(asked.select("part", "node", F.col("node").alias("root"), F.lit(True).alias("asked")))


def open_groups(members: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(part, node, root, asked): texts of groups that are not connected throughout.

    Texts of the group's largest component are not asked about. The rest is compared with
    the whole group, in blocks of about `block` shingles either way, so that a task holds
    two blocks, however large the group is.
    """
    known = members.join(roots, "node", "left").select("band", "value", "node", "size", F.coalesce("root", "node").alias("root"))
    sizes = known.groupBy("band", "value", "root").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    groups = sizes.groupBy("band", "value").agg(
        F.max_by("root", F.struct("size", "n", "root")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("size"), F.count("*").alias("tops")
    )
    blocks = lambda size: F.greatest(F.ceil(size / block), F.lit(1))
    groups = groups.where("tops > 1").select(
        "band", "value", "main", blocks(F.col("size")).alias("whole"), blocks(F.col("size") - F.col("most")).alias("rest")
    )
    rows = known.join(groups, ["band", "value"])
    own = F.xxhash64("node", F.lit(BANDS))

    def placed(mine: str, others: str, asked: bool) -> DataFrame:
        """A row in its own block, once for every block of the other side."""
        side = rows.where("root <> main") if asked else rows
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(f"{others}_block")
        side = side.select("band", "value", "node", "root", F.pmod(own, F.col(mine)).alias(f"{mine}_block"), every)
        return side.select(F.struct("band", "value", "rest_block", "whole_block").alias("part"), "node", "root", F.lit(asked).alias("asked"))

    return placed("rest", "whole", True).unionByName(placed("whole", "rest", False))


def compared(placed: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) between alike texts of a part that are not connected yet, exactly.
    `rows` has each text once: (node, text).

    In a part every text asked about is compared with all others, one after the other,
    unless it is connected with all of them by then. Links that add nothing to what is
    connected are not returned: a part gives fewer links than it has texts.
    """
    sent = placed.join(rows, "node")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(text.encode(), words) for text in frame["text"]]
        nodes, tops, asks = (frame[c].tolist() for c in ("node", "root", "asked"))
        others = [k for k, asked in enumerate(asks) if not asked]
        block, forest, out = Sets([sets[k] for k in others]), Forest(), []
        for node, top in zip(nodes, tops, strict=True):
            forest.join(node, top)
        for k in (k for k, asked in enumerate(asks) if asked):
            mine = forest.top(nodes[k])
            if all(forest.top(nodes[i]) == mine for i in others):
                continue
            for i in np.flatnonzero(block.similarity(sets[k]) >= least).tolist():
                if forest.join(nodes[k], nodes[others[i]]):
                    out.append((nodes[k], nodes[others[i]]))
        return pd.DataFrame(out, columns=["a", "b"])

    return sent.groupBy("part").applyInPandas(work, "a binary, b binary")


def _copy(id_column: Column) -> Column:
    """An id as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("+"), id_column.cast("string")), F.lit("-"))


def alike(
    distinct: DataFrame, rows: DataFrame, words: int, least: float, folder: str, block: int = BLOCK, linked: DataFrame | None = None
) -> DataFrame:
    """(node, root) of the groups of alike texts; those that `linked` (a, b) has are linked.

    Texts are compared with the first text of their groups, at one comparison a text and
    group; then whatever shares a group and is not connected yet is compared, so that no
    link between components is lost.
    """
    members = stored(memberships(distinct), f"{folder}/members")
    # the texts in groups, each once; all others are not sent again
    chosen = members.select("node").distinct().join(distinct.select("node", "first"), "node")
    chosen = chosen.select("node", _copy(F.col("first")).alias("copy"))
    rows = rows.select("node", _copy(F.col("id")).alias("copy"), "text").join(chosen, ["node", "copy"], "left_semi")
    rows = stored(rows.dropDuplicates(["node", "copy"]).drop("copy"), f"{folder}/grouped-texts")
    links = stored(compared(first_texts(members, block), rows, words, least), f"{folder}/first-links")
    links = links if linked is None else links.unionByName(linked)
    roots = stored(connected(links, f"{folder}/first"), f"{folder}/roots")
    more = stored(compared(open_groups(members, roots, block), rows, words, least), f"{folder}/more-links")
    return connected(more.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), f"{folder}/second")


def one_of_each(
    documents: DataFrame,
    words: int = WORDS,
    least: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    print_words: int | None = None,
) -> DataFrame:
    """The rows of `documents`, one of each group of copies and near copies.

    With `print_words`, two texts are linked if `near_duplicates` links their fingerprints
    over shingles of so many words: popcount cells, the grid, exact links of two bits at
    most. Two texts are also alike if their sets of word shingles have a Jaccard similarity
    of `least` or more. At that distance fingerprints differ in about ten bits, where a
    popcount bound no longer tells pairs apart; these candidates are found by bands of
    minima over the shingles and verified exactly.

    Groups are connected over these links, and the row with the smallest id stays (an
    id before none, then the smallest text hash). Equal texts (by 128-bit hashes) are one
    text; a null text counts as empty, and texts without words are alike. Rows may
    repeat, and so may ids: rows are told apart by their text. An empty table stays empty.
    """
    folder = folder or shared_folder(documents.sparkSession)
    node = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    rows = documents.select(node.alias("node"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = stored(sketches(rows, words, print_words), f"{folder}/sketches")
    once = [F.any_value(name).alias(name) for name in ("size", "bands", "fp")]
    distinct = stored(found.groupBy("node").agg(F.min("id").alias("first"), *once), f"{folder}/texts")
    linked = None
    if print_words is not None:
        linked = stored(fingerprint_links(distinct, f"{folder}/fingerprints"), f"{folder}/fingerprint-links")
    roots = alike(distinct, rows, words, least, folder, linked=linked)
    grouped = distinct.select("node", "first").join(roots, "node", "left")
    # only members of groups are ranked; texts of their own stay as they are
    names = grouped.where("root is not null").select("root").distinct()
    several = distinct.select("node", "first").join(roots, "node").unionByName(
        distinct.select("node", "first").join(names, distinct["node"] == names["root"]).select("node", "first", F.col("root"))
    )
    best = several.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best"))
    dropped = several.join(best, "root").where("node <> best.node").select("node")
    kept = stored(distinct.select("node", "first").join(dropped, "node", "left_anti"), f"{folder}/kept")
    kept = kept.select(F.col("node").alias("_text_node"), _copy(F.col("first")).alias("_text_copy"))
    # one shuffle of the rows: copies of a text lie apart by their ids, rows that repeat meet
    chosen = documents.withColumns({"_text_node": node, "_text_copy": _copy(F.col(f"`{id_col}`"))})
    chosen = chosen.join(kept, ["_text_node", "_text_copy"], "left_semi").dropDuplicates(["_text_node", "_text_copy"])
    return chosen.select(*[f"`{c}`" for c in documents.columns])
