"""Ranked lexical search: summed accumulators of short lists inside a walk over long ones.

Documents become postings of the searched terms, a written table. A task turns postings
into shards of bounded size: one list of (document, score) a term, documents in the order
of their ids. An item is then searched in a shard in two ways at once. Its short lists
are taken term by term: their scores are summed into accumulators. These count as one
list more, with the largest accumulator as its bound, and take part with the long lists
in a walk by document. The walk goes through a window of documents at a time. Lists whose
bounds together can't lift a document over the worst one kept are not walked but asked:
only for documents that other lists brought up and that can still get there.

The best of all shards are ranked by Spark. Searched items come in blocks of bounded size;
a block costs one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.fmindex import words_of
from perigee.llm.shared import column, map_batches, rows_of, shared_folder, stored, texts

TOP = 20
# characters of items that are searched in one pass, and postings that are indexed at once
BLOCK_CHARS = 1 << 22
SHARD_POSTINGS = 1 << 21
# of a shard's documents, the share that lists may have to count as short; windows of documents
SHORT = 1 / 32
FIRST_WINDOW, LAST_WINDOW = 1 << 8, 1 << 13
# first-level groups of an item's candidates in the final ranking
SPREAD = 64

UNIT, FLAT, SLOPE = 1_000_000_000, 75, 25


def weight(documents: int, holding: int) -> int:
    """The weight of a term that `holding` of `documents` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(times: np.ndarray, words: np.ndarray, documents: int, all_words: int) -> np.ndarray:
    """What a posting gives per unit of its term's weight; words: terms of its document."""
    m = FLAT + (SLOPE * words * documents) // all_words
    return (UNIT * times) // (1000 * times + 12 * m)


class Shard:
    """Lists of documents and scores by term, documents in the order of their ids."""

    def __init__(self, terms: np.ndarray, documents: np.ndarray, scores: np.ndarray, size: int, n_terms: int) -> None:
        order = np.lexsort((documents, terms))
        self.size = size
        self.documents, self.scores = documents[order], scores[order]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=n_terms))))

    def list_of(self, term: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[term], self.ends[term + 1]
        return self.documents[a:b], self.scores[a:b] * weight

    def best(self, query: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best documents with a score above zero, best first
        and equal ones in the order of ids; query: terms and their weights."""
        lists = [self.list_of(term, w) for term, w in query if w > 0 and self.ends[term + 1] > self.ends[term]]
        short = [x for x in lists if len(x[0]) <= self.size * SHORT]
        walked = [x for x in lists if len(x[0]) > self.size * SHORT]
        if short:
            walked.append(accumulated(short))
        return walk(walked, self.size, top)


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists summed by document, term at a time, as one list in document order."""
    documents, place = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    sums, at = np.zeros(len(documents), np.int64), 0
    for held, scores in lists:
        sums[place[at : at + len(held)]] += scores
        at += len(held)
    return documents, sums


def walk(lists: list[tuple[np.ndarray, np.ndarray]], size: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The best documents of the lists' sums, in windows of documents from the first on.

    Lists are ordered by their bounds. Those at the front whose bounds sum up to no more
    than the worst score kept can't bring in a document by themselves (a later document
    of the same score ranks behind), so windows begin at the next document of another
    list, and the front lists are searched only for what remains possible.
    """
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    reach = np.cumsum([int(scores.max()) for _, scores in lists])
    kept_docs, kept_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    worst, front, at, window = 0, 0, 0, FIRST_WINDOW
    places = [0] * len(lists)
    while True:
        while front < len(lists) and reach[front] <= worst:
            front += 1
        nexts = []
        for k in range(front, len(lists)):
            places[k] += int(np.searchsorted(lists[k][0][places[k] :], at))
            if places[k] < len(lists[k][0]):
                nexts.append(int(lists[k][0][places[k]]))
        if not nexts:
            return kept_docs, kept_scores
        at = min(nexts)
        end = min(at + window, size)
        sums = np.zeros(end - at, np.int64)
        for k in range(front, len(lists)):
            documents, scores = lists[k]
            stop = places[k] + int(np.searchsorted(documents[places[k] :], end))
            sums[documents[places[k] : stop] - at] += scores[places[k] : stop]
            places[k] = stop
        found = np.flatnonzero(sums)
        for k in range(front - 1, -1, -1):
            found = found[sums[found] + reach[k] > worst]
            documents, scores = lists[k]
            place = np.minimum(np.searchsorted(documents, found + at), len(documents) - 1)
            held = documents[place] == found + at
            sums[found[held]] += scores[place[held]]
        found = found[sums[found] > worst]
        if len(found):
            kept_docs = np.concatenate((kept_docs, found + at))
            kept_scores = np.concatenate((kept_scores, sums[found]))
            order = np.lexsort((kept_docs, -kept_scores))[:top]
            kept_docs, kept_scores = kept_docs[order], kept_scores[order]
            if len(order) == top:
                worst = int(kept_scores[-1])
        at, window = end, min(2 * window, LAST_WINDOW)


def postings(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, words, terms, times): of each document with a term, the number of its terms
    with repeats, and which searched terms it holds how many times."""
    id_type = documents.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        rows, words, terms, times, ends = [], [], [], [], [0]
        number = vocabulary.get
        for row, text in enumerate(texts(batch)):
            found = words_of(text)
            if not found:
                continue
            counts = Counter(map(number, found))
            counts.pop(None, None)
            rows.append(row), words.append(len(found))
            terms.extend(counts.keys()), times.extend(counts.values())
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        return {
            "id": column(batch, "id").take(pa.array(rows, pa.int64())),
            "words": words,
            "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
            "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
        }

    return map_batches(documents, f"id {id_type}, words bigint, terms array<int>, times array<bigint>", work)


def _shards(batches: Iterator[pa.RecordBatch], documents: int, all_words: int, n_terms: int, most: int) -> Iterator[tuple[pa.Array, Shard]]:
    """(ids in order, shard) for about `most` postings each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> tuple[pa.Array, Shard]:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [("id", "ascending")], null_placement="at_end")).combine_chunks()
        terms, times = (table.column(x).combine_chunks() for x in ("terms", "times"))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(table.num_rows), sizes)
        words = table.column("words").to_numpy()[row]
        scores = impacts(times.flatten().to_numpy(), words, documents, all_words)
        return table.column("id").combine_chunks(), Shard(terms.flatten().to_numpy(), row, scores, table.num_rows, n_terms)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(column(batch, "terms").flatten())
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _searched(found: DataFrame, queries: list[list[tuple[int, int]]], numbers: list[int], n_terms: int, totals: tuple[int, int], top: int, most: int) -> DataFrame:
    """(item, doc, score): the best documents of each shard for each item of a block."""
    schema = f"item bigint, doc {found.schema['id'].dataType.simpleString()}, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shard in _shards(batches, *totals, n_terms, most):
            for number, query in zip(numbers, queries, strict=True):
                documents, scores = shard.best(query, top)
                if len(documents):
                    item = pa.array(np.full(len(documents), number), pa.int64())
                    yield pa.RecordBatch.from_arrays([item, ids.take(pa.array(documents)), pa.array(scores)], names=["item", "doc", "score"])

    return found.mapInArrow(run, schema)


def search(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_chars: int = BLOCK_CHARS,
    shard_postings: int = SHARD_POSTINGS,
    folder: str | None = None,
) -> DataFrame:
    """(item, rank, doc, score): of all documents the `top` best for each item.

    Terms are runs of ASCII letters and digits and of all other characters, A-Z
    lower-cased. Equal scores rank by the document's id (nulls last). Null texts and texts
    without a term are no documents; items without a term, and items no document shares a
    term with, have no rows. Documents that repeat count each. Items that repeat whole are
    one item; rows of one item id with different texts are items of their own under that
    id. No documents or no items give no rows; other columns are ignored.
    """
    folder = folder or shared_folder(documents.sparkSession)
    docs = rows_of(documents, id=id_col, text=text_col)
    asked = rows_of(items, item=item_col, text=item_text_col).where(F.col("text").isNotNull()).distinct()
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    # items are told apart by their place in a written table
    blocks = -(-chars // block_chars)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(blocks, 1)))
    asked = stored(asked.select(F.monotonically_increasing_id().alias("number"), "item", "text", block.alias("block")), f"{folder}/items")
    parts = []
    for b in range(blocks):
        rows = asked.where(F.col("block") == b).select("number", "text").collect()
        terms = [Counter(words_of(text.encode())) for _, text in rows]
        vocabulary = {term: k for k, term in enumerate(sorted({t for counts in terms for t in counts}))}
        found = stored(postings(docs, vocabulary), f"{folder}/postings-{b}")
        n, all_words = found.agg(F.count("*"), F.sum("words")).first()
        if not n:
            break
        # one row a term of the block
        held = dict(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect())
        weights = {k: weight(n, df) for k, df in held.items()}
        queries = [[(k, weights[k] * times) for t, times in counts.items() if (k := vocabulary[t]) in weights] for counts in terms]
        best = _searched(found, queries, [number for number, _ in rows], len(vocabulary), (n, all_words), top, shard_postings)
        parts.append(stored(_ranked(best, top), f"{folder}/best-{b}"))
    if not parts:
        nothing = asked.limit(0).select("number")
        parts = [nothing.select(F.col("number").alias("item"), F.lit(0).alias("rank"), F.lit(None).cast(docs.schema["id"].dataType).alias("doc"), F.col("number").alias("score"))]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    named = asked.select(F.col("number"), F.col("item").alias("name"))
    return every.join(named, F.col("item") == F.col("number")).select(F.col("name").alias("item"), "rank", "doc", "score")


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """The best of all shards, first within groups of them, then over these."""
    order = (F.col("score").desc(), F.col("doc").asc_nulls_last())
    spread = best.withColumn("group", F.spark_partition_id() % SPREAD)
    for keys in (["item", "group"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        spread = spread.withColumn("rank", place).where(F.col("rank") <= top)
    return spread.select("item", "rank", "doc", "score")
