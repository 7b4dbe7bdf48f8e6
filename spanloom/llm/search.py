"""Ranked lexical search: the best documents of each item, by presence masks.

Terms are lower-cased (A-Z) runs of letters, digits and characters beyond ASCII. A document scores, for each term of an item (repeats
count), the term's weight times a saturated frequency, all in 64-bit integers; the weights follow from how many documents hold a term,
counted over the whole corpus.

Documents come in blocks of up to BLOCK_DOCS, kept inside one task. For each item, the posting lists of its terms set bits, one for
each distinct term, and documents with the same bits form a group: the mask of the matched terms. A mask's score is at most the sum
of its terms' greatest contributions within the block, so masks are evaluated by descending bound, exactly, until no bound reaches the
item's least kept score; equal bounds are evaluated, as a smaller id may win. What a task keeps goes on from block to block, TOP
rows an item, and its rows alone are shuffled; they are ranked by item and part first, so no task ranks an item's rows of all tasks.

The items are the stated query set. They are held in blocks of at most BLOCK_TERMS terms, counted with repeats, by hash and
number, and all documents run against a block in two scans, one that counts and one that scores. Nothing else is broadcast.

Defined cases: null or empty texts have no terms, are not counted as documents and are never found. An item without terms, or whose
terms no document holds, has no rows; items that share an id are ranked each by itself. Documents that share an id are ranked each by
itself; equal scores go by ascending id, null last. Empty tables give empty results. Terms are told apart by 64-bit hashes, which are
exact up to eight bytes; two different terms of an item block with the same hash are an error. Scores are 64-bit: a text of more than 10^9 terms would
need more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import saved, small_batches

TOP = 10
#: Terms of one block of items, with repeats.
BLOCK_TERMS = 1_000_000
#: Documents of one block, and bytes of text beyond which it is closed.
BLOCK_DOCS = 4096
BLOCK_BYTES = 32 << 20
#: Parts that the kept rows of one item are ranked in first.
PARTS = 64
NO_ID = -(2**63)


@dataclass
class Items:
    """A block of items: distinct terms by hash, and each item's distinct terms with how often it has them."""

    rows: list[int]
    term: np.ndarray
    of: list[np.ndarray]
    times: list[np.ndarray]


def _held(items: list[tuple[int, str | None]]) -> Items:
    tokens = _text.tokenize(pa.array([t for _, t in items], pa.string()), _text.ALNUM)
    term, first, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
    word = lambda i: _text.ALNUM.fold[tokens.data[tokens.start[i] : tokens.end[i]]].tobytes()
    size = tokens.end - tokens.start
    for i in np.flatnonzero(size > 8):  # shorter words have their own hash
        if word(i) != word(first[inverse[i]]):
            raise ValueError("two terms share a hash")
    counted = [np.unique(inverse[tokens.of(i)], return_counts=True) for i in range(len(items))]
    return Items([n for n, _ in items], term, [a for a, _ in counted], [b for _, b in counted])


def _blocks(items: list[tuple[int, str | None]]) -> Iterator[Items]:
    """Blocks of whole items; one item may be longer than a block."""
    block, size = [], 0
    for number, text in items:
        own = len(_text.tokenize(pa.array([text], pa.string()), _text.ALNUM).hash)
        if block and size + own > BLOCK_TERMS:
            yield _held(block)
            block, size = [], 0
        block.append((number, text))
        size += own
    if block:
        yield _held(block)


def _postings(tokens: _text.Tokens, rows: int, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, frequency) by term and row, of the terms that items hold."""
    at = np.minimum(np.searchsorted(term, tokens.hash), len(term) - 1)
    own = np.flatnonzero(term[at] == tokens.hash)
    row = np.repeat(np.arange(rows), np.diff(tokens.ptr))
    key, tf = np.unique(at[own] * rows + row[own], return_counts=True)
    return key // rows, key % rows, tf


def _counts(docs: DataFrame, held: Items) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and for each term of the block the documents that hold it."""
    term = held.term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(term) + 1, np.int64), 0, 0
        for batch in _text.slices(batches):
            tokens = _text.tokenize(batch.column("text"), _text.ALNUM)
            n += int(np.count_nonzero(np.diff(tokens.ptr)))
            total += len(tokens.hash)
            if len(term):
                df += np.bincount(_postings(tokens, batch.num_rows, term)[0], minlength=len(df))
        names = np.append(np.flatnonzero(df), [-1, -2])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.append(df[df > 0], [n, total]), pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = {r.term: r.n for r in found.collect()}  # at most a row for each term of the block
    df = np.zeros(len(term), np.int64)
    for t, n in known.items():
        if t >= 0:
            df[t] = n
    return known.get(-1, 0), known.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _masks(rows: int, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks (bits, 64 terms a word) of the rows that any list holds; each such row, and its mask's number."""
    bits = np.zeros(((len(lists) + 63) // 64, rows), np.uint64)
    for i, own in enumerate(lists):
        bits[i // 64, own] |= np.uint64(1 << (i % 64))
    row = np.flatnonzero(bits.any(axis=0))
    group = np.zeros(len(row), np.int64)
    for word in bits[:, row]:
        value = np.unique(word, return_inverse=True)[1]
        group = np.unique(group * (len(row) + 1) + value, return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    return bits[:, row[first]], row, group


@dataclass
class Kept:
    """An item's best (score, id) so far, the best first."""

    score: np.ndarray
    key: np.ndarray

    def add(self, score: np.ndarray, key: np.ndarray, top: int) -> None:
        s, k = np.append(self.score, score), np.append(self.key, key)
        order = np.lexsort((k, k == NO_ID, -s))[:top]
        self.score, self.key = s[order], k[order]


def _ranked(kept: Kept, lists: list[np.ndarray], gains: list[np.ndarray], key: np.ndarray, top: int) -> int:
    """Evaluate one item over a block; the number of masks evaluated."""
    bits, row, group = _masks(len(key), lists)
    if not len(row):
        return 0
    most = np.array([int(g.max()) if len(g) else 0 for g in gains], np.int64)
    bound = np.zeros(bits.shape[1], np.int64)
    for i, m in enumerate(most):
        bound += ((bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64) * m
    order = np.argsort(-bound, kind="stable")
    by_group = np.argsort(group, kind="stable")
    start = np.searchsorted(group[by_group], np.arange(len(order) + 1))
    at, step = 0, top
    while at < len(order):
        least = max(1, int(kept.score[-1])) if len(kept.score) >= top else 1
        chosen = order[at : at + step]
        chosen = chosen[bound[chosen] >= least]
        if not len(chosen):
            break
        own = np.sort(np.concatenate([row[by_group[start[g] : start[g + 1]]] for g in chosen]))
        score = np.zeros(len(own), np.int64)
        for rows, gain in zip(lists, gains, strict=True):
            if len(rows):
                found = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
                score += np.where(rows[found] == own, gain[found], 0)
        kept.add(score[score > 0], key[own[score > 0]], top)
        at += len(chosen)
        step *= 2
    return at


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks."""
    held, rows, size = [], 0, 0
    for batch in _text.slices(batches):
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BLOCK_DOCS or size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scored(docs: DataFrame, held: Items, n_docs: int, n_terms: int, df: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score) of the rows that tasks keep."""
    weight = weights(n_docs, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Kept(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in held.rows]
        for batch in _gathered(batches):
            tokens = _text.tokenize(batch.column("text"), _text.ALNUM)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            m = 25 + (75 * np.diff(tokens.ptr).astype(np.int64) * n_docs) // max(n_terms, 1)
            term, row, tf = _postings(tokens, batch.num_rows, held.term)
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            at = np.searchsorted(term, np.arange(len(held.term) + 1))
            for kept, own, times in zip(best, held.of, held.times, strict=True):
                spans = [slice(at[t], at[t + 1]) for t in own]
                _ranked(kept, [row[s] for s in spans], [gain[s] * n for s, n in zip(spans, times, strict=True)], key, top)
        numbers = np.repeat(np.array(held.rows, np.int64), [len(b.key) for b in best])
        both = [np.concatenate([getattr(b, c) for b in best]) if best else np.empty(0, np.int64) for c in ("key", "score")]
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["item", "key", "score"])

    return docs.mapInArrow(run, "item long, key long, score long").withColumn("part", F.spark_partition_id() % PARTS)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every row of ``items`` with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    numbered = saved(items.select(F.monotonically_increasing_id().alias("item"), F.col(item).alias("item_id"), F.col(item_text).alias("item_text")), "items")
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text).alias("text"))
    parts = []
    for held in _blocks_of(numbered):
        n_docs, n_terms, df = _counts(own, held)
        parts.append(saved(_scored(own, held, n_docs, n_terms, df, top), "ranked"))
    if not parts:
        parts = [spark.createDataFrame([], "item long, key long, score long, part int")]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), F.col("key") == NO_ID, "key"]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    doc_id = F.when(F.col("key") != NO_ID, F.col("key"))
    return last.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), "score")


def _blocks_of(items: DataFrame) -> Iterator[Items]:
    """The items in blocks, streamed to the driver partition by partition."""
    return _blocks(((r.item, r.item_text) for r in items.select("item", "item_text").toLocalIterator()))
