"""Near-duplicate documents by SimHash: a join of fingerprints over pivot distance tables.

A fingerprint is 64 bits: a bit is 1 where it is set in over half of the XXH64 hashes (seed 42) of a text's shingles, repeats included. Two
fingerprints link where at most RADIUS = 2 bits differ.

The pivots are reference fingerprints: on each aligned block of bits, all Walsh codewords of the block's width. A fingerprint's Hamming
distances to them are precomputed once for each *distinct* fingerprint. Distances to two references differ by no more than the two
fingerprints do, so a pair whose coordinates differ by more than RADIUS anywhere can't be a link: it is discarded without being
looked at. Two uses are made of that:

* Candidates. Differing bits spoil at most RADIUS blocks, so on the others, at least two of four, the coordinates of a link's ends
  differ by 0 throughout. Fingerprints therefore meet under each choice of two blocks whose coordinate rows they share. Walsh
  codewords have full rank, so such rows are equal only where the blocks are: a node fixes the bits of its two blocks.
* Within a node, members' coordinate tables are compared, pairs beyond RADIUS in any coordinate are discarded, and survivors are verified on
  the fingerprints themselves.

A node of more than NODE_LIMIT fingerprints deals its members again, by four blocks of what bits it leaves free: 32 at first, then 16,
then 8. Nodes of the last level hold at most 256 distinct fingerprints, whatever the data, so no pair is lost, no node is unbounded and
nothing is dropped. A node gives the links that span its components and not all pairs.

Defined cases: texts without words (null, empty, only separators) have fingerprint 0 and link like any other. Fewer words than a
shingle make one shingle of all words. Equal fingerprints are one node of the graph. Null ids never name a component unless it has no
other. Texts of any length are hashed in parts. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._components import components, with_least
from ._spark import saved, small_batches

RADIUS = 2
BLOCKS = 4
SHINGLE = 3
SEED = 42
#: Members of a node that are compared at once.
NODE_LIMIT = 256
#: Shingles that are hashed at a time.
PART = 1 << 16


def walsh(width: int) -> np.ndarray:
    """(width, width) bits: the Walsh codewords of a power of two."""
    at = np.arange(width)
    return np.bitwise_count(at[:, None] & at[None, :]).astype(np.uint8) & 1


def distances(block: np.ndarray, width: int) -> np.ndarray:
    """(n, width) Hamming distances of ``width``-bit values to the codewords."""
    bits = ((block[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.int32)
    words = walsh(width).astype(np.int32)
    return (bits.sum(axis=1, keepdims=True) + words.sum(axis=1) - 2 * (bits @ words.T)).astype(np.uint8)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # both by ASCII alone
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    first, last = start[: len(words) - k + 1], end[k - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), PART):
        spans = zip(first[at : at + PART].tolist(), last[at : at + PART].tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(first)))


def fingerprints(docs: DataFrame, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            found = np.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_text.signed(found), pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    """(node, free, fp): each fingerprint under each choice of two blocks of the bits that its node leaves free.

    ``free`` are those bits, packed; a node is known by a hash of the node it comes from, the choice, and the coordinate rows of its blocks.
    """
    width = 64 >> (level + 2)
    choices = list(combinations(range(BLOCKS), BLOCKS - RADIUS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, free, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "free", "fp"))
            bits = free.view(np.uint64)
            block = [(bits >> np.uint64(width * b)) & np.uint64((1 << width) - 1) for b in range(BLOCKS)]
            table = [distances(b, width) for b in block]
            row = [reduce(lambda h, c: _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + c), table[b].T.astype(np.uint64), np.zeros(len(fp), np.uint64)) for b in range(BLOCKS)]
            for number, kept in enumerate(choices):
                name = _text.mix(node.view(np.uint64) + np.uint64(number + 1))
                for b in kept:
                    name = _text.mix(name * np.uint64(0xD1342543DE82EF95) + row[b])
                left = [b for b in range(BLOCKS) if b not in kept]
                rest = reduce(lambda x, b: x | b, (block[b] << np.uint64(width * i) for i, b in enumerate(left)))
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(name)), pa.array(_text.signed(rest)), pa.array(fp)], ["node", "free", "fp"])

    return rows.mapInArrow(run, "node long, free long, fp long")


def _linked(fps: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Links that span the components of a node, and how many pairs passed the tables."""
    n = len(fps)
    bits = fps.view(np.uint64)
    blocks = [distances((bits >> np.uint64(16 * b)) & np.uint64(0xFFFF), 16) for b in range(BLOCKS)]
    # a full reference takes a codeword on every block: its distance is the sum of theirs
    table = np.concatenate([sum(b.astype(np.int16) for b in blocks), *(b.astype(np.int16) for b in blocks)], axis=1)
    root, links, passed = np.arange(n), [], 0
    for i in range(n - 1):
        near = np.flatnonzero((np.abs(table[i + 1 :] - table[i]) <= RADIUS).all(axis=1)) + i + 1
        passed += len(near)
        for j in near[np.bitwise_count(bits[near] ^ bits[i]) <= RADIUS]:
            if root[i] != root[j]:
                links.append((int(fps[i]), int(fps[j])))
                root[root == root[j]] = root[i]
    return links, passed


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node -> links (a, b) between fingerprints."""
    held: list[np.ndarray] = []
    current = None

    def closed() -> pa.RecordBatch:
        links, _ = _linked(np.unique(np.concatenate(held)))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        node, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp"))
        cut = np.flatnonzero(np.diff(node)) + 1
        for s, e in zip([0, *cut], [*cut, len(node)], strict=True):
            if node[s] != current:
                if sum(map(len, held)) > 1:
                    yield closed()
                held, current = [], node[s]
            held.append(fp[s:e])
    if sum(map(len, held)) > 1:
        yield closed()


def links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` -> links (a, b) that join all fingerprints that chains of links join."""
    rows = distinct.select(F.lit(0).cast("long").alias("node"), F.col("fp").alias("free"), "fp")
    out = []
    for level in range(3):
        rows = saved(_dealt(rows, level), "simhash-nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        last = level == 2
        small = rows.join(sizes.where(F.lit(last) | (F.col("n") <= NODE_LIMIT)).select("node"), "node", "left_semi")
        ordered = small.select("node", "fp").repartition("node").sortWithinPartitions("node", "fp")
        out.append(saved(ordered.mapInArrow(_compare, "a long, b long").distinct(), "simhash-links"))
        if last:
            break
        large = sizes.where(F.col("n") > NODE_LIMIT).select("node")
        if large.isEmpty():
            break
        rows = rows.join(large, "node", "left_semi")
    return reduce(DataFrame.unionByName, out)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint as 16 hex digits, component_id."""
    found = saved(fingerprints(docs, k, key, text), "fingerprints")
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = saved(distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("root", "fp")).drop("root"), "fingerprint-components")
    least = with_least(named, "component", "least").select("fp", F.col("root").alias("component_id"))
    out = found.join(least, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
