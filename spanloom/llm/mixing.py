"""Mixing sources to target weights: fixed-length blocks, drawn by shard and joined by index.

1. Each source's words form one stream, documents in a fixed order; the stream is cut into blocks of
   BLOCK words, the last one shorter. Positions come from a two-level prefix sum (about the square root
   of a source's rows in each of as many buckets), so a source with a third of all rows is no task's
   alone.
2. A source's target becomes a number of slots. Output shards of SHARD_SLOTS slots draw their counts of each
   source: a multinomial draw conditional on every source's total, so that targets are met (a multivariate
   hypergeometric one). Draws form a binary tree: a node's slots are split between its halves at random, from
   a seed of its own, so each task draws the shards of its range by itself, and all tasks agree.
3. A source's n-th slot maps to block perm(n mod blocks) of its round n div blocks, where perm is a
   keyed pseudorandom permutation of the source's block numbers (a Feistel network with cycle walking),
   another for each round.
4. Slots and blocks join by (source, block number); keys are unique on the block side, so nothing skews.

Source weights: 1, 2, 3 and so on again, for the sources by code point, null last. Targets share all
words by weight; none exceeds LIMIT times its source's words, the excess goes to the others by weight
until none is above.

The driver holds one row for each source (name, rows, words): it is the list that the weights are given
for. Everything else stays distributed, and nothing depends on how many slots or shards there are.

Defined cases: null and empty texts have size 0 and take 0. A null source is a source. Repeated rows are
separate documents. Ids may repeat or lack. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved, small_batches

BLOCK = 64
WEIGHTS = (1, 2, 3)
LIMIT = 3
SHARD_SLOTS = 1 << 16
#: Most tasks that draw and write out slots; each takes a range of shards.
MAX_TASKS = 20_000
#: Sources whose table is broadcast; more are joined by salted keys.
BROADCAST_SOURCES = 1_000_000
_SALTS = 64
#: Items that are picked one by one rather than by binomial draws.
FEW = 64
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    rows: int
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[int], limit: int = LIMIT) -> list[Fraction]:
    """Shares of the total by weight, none above ``limit`` times its size."""
    total, capped = Fraction(sum(sizes)), set()
    while True:
        open_weight = sum(w for i, w in enumerate(weights) if i not in capped)
        left = total - sum(limit * sizes[i] for i in capped)
        out = [Fraction(limit * s) if i in capped else left * w / open_weight for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        above = {i for i, t in enumerate(out) if i not in capped and t > limit * sizes[i]}
        if not above:
            return out
        capped |= above


def plan(rows: list[tuple[str | None, int, int]], block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> list[Source]:
    """(name, rows, words) of every source -> its target, blocks and slots."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[2] for r in rows]
    found = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], limit) if sum(sizes) else [Fraction(0)] * len(rows)
    out = []
    for number, ((name, count, size), target) in enumerate(zip(rows, found, strict=True)):
        blocks = -(-size // block)
        slots = min(round(target * blocks / size), limit * blocks) if size else 0
        out.append(Source(number, name, count, size, float(target), blocks, slots))
    return out


def picked(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are in a random ``n`` of the items, every choice of ``n`` being as likely.

    Each item goes in by itself with probability n / total, which makes a binomial draw for each kind; what
    is too much then goes at random, or what lacks comes. The surplus is about the root of ``n``, so the
    same steps again soon leave a FEW, which are picked one by one. Exact at any size.
    """
    total = int(counts.sum())
    if 2 * n > total:
        return counts - picked(counts, total - n, rng)
    if n <= FEW:
        out, left = np.zeros_like(counts), np.cumsum(counts)
        for _ in range(n):
            at = int(np.searchsorted(left, rng.integers(left[-1]), "right"))
            out[at] += 1
            left[at:] -= 1
        return out
    out = rng.binomial(counts, n / total)
    over = int(out.sum()) - n
    return out - picked(out, over, rng) if over > 0 else out + picked(counts - out, -over, rng)


def drawn(slots: np.ndarray, number: int, first: int, last: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards ``first`` to ``last`` - 1 of ``number``: (shard, counts by source, slots of each source before it).

    A node of the tree is a range of shards; its slots are split by a generator seeded with the range.
    """
    total = int(slots.sum())
    start = lambda shard: total * shard // number
    nodes = [(0, number, slots, np.zeros_like(slots))]
    while nodes:
        a, b, own, before = nodes.pop()
        if b <= first or a >= last:
            continue
        if b - a == 1:
            yield a, own, before
            continue
        middle = (a + b) // 2
        left = picked(own, start(middle) - start(a), np.random.Generator(np.random.PCG64([seed, a, b])))
        nodes += [(middle, b, own - left, before + left), (a, middle, left, before)]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), applied to ``index`` element by element."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    half = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & half[todo]
        for turn in range(4):
            x = (right + key[todo] * np.uint64(2 * turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & half[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _table(spark, sources: list[Source]) -> DataFrame:
    """The sources as a table, one row each: number, source, source_size, target."""
    return spark.createDataFrame([(s.number, s.name, s.size, s.target) for s in sources], "number int, source string, source_size long, target double")


def _with_source(rows: DataFrame, table: DataFrame, count: int, condition: Column) -> DataFrame:
    """``rows`` beside their source's row: broadcast up to a bound, beyond it by keys that are salted on both sides."""
    if count <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), condition)
    salted = table.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(_SALTS))).join(salted, condition & (F.col("salt") == F.col("salt_of")))


@dataclass
class Mix:
    """A drawn mixture: ``documents`` with their places, ``slots`` of the output, and the plan."""

    documents: DataFrame
    slots: DataFrame
    sources: list[Source]
    block: int

    def spans(self) -> DataFrame:
        """Blocks that each document reaches into, with the words of it in each; null for empty ones."""
        begin, end = F.col("begin"), F.col("begin") + F.col("size")
        first, last = F.floor(begin / self.block).cast("long"), F.floor((end - 1) / self.block).cast("long")
        blocks = F.when(F.col("size") > 0, F.sequence(first, last))
        rows = self.documents.withColumn("index", F.explode_outer(blocks))
        words = F.least(end, (F.col("index") + 1) * self.block) - F.greatest(begin, F.col("index") * self.block)
        return rows.withColumn("words", words).withColumn("from", F.greatest(F.lit(0).cast("long"), F.col("index") * self.block - begin))

    def output(self) -> DataFrame:
        """The mixture itself: (shard, slot, number, index) with the pieces of documents in each block."""
        return self.slots.hint("merge").join(self.spans().where("index is not null"), ["number", "index"])

    def blocks(self, docs: DataFrame) -> DataFrame:
        """(number, index, words): the text of every block, of the documents that were mixed. A block has few pieces, a word each at least."""
        said = F.coalesce(F.col("text"), F.lit(""))
        texts = docs.select(F.col("doc_id").cast("long").alias("of"), F.xxhash64(said).alias("mark_of"), said.alias("text")).dropDuplicates(["of", "mark_of"])
        spans = self.spans().where("index is not null")
        cut = spans.groupBy("doc_id", "mark", "number", "bucket", "place", "begin").agg(F.collect_list(F.struct("index", "from", "words")).alias("spans"))
        met = cut.join(texts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("mark_of")))
        piece = lambda words: F.transform("spans", lambda x: F.struct(x["index"].alias("index"), F.array_join(F.slice(words, x["from"].cast("int") + 1, x["words"].cast("int")), " ").alias("words")))
        found = F.explode(F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), piece), F.lit(0)))
        pieces = met.select("number", "begin", found.alias("x")).select("number", "begin", "x.*")
        ordered = F.array_sort(F.collect_list(F.struct("begin", "words")))
        return pieces.groupBy("number", "index").agg(F.array_join(F.transform(ordered, lambda x: x["words"]), " ").alias("words"))

    def packed(self, docs: DataFrame) -> DataFrame:
        """(shard, slot, number, index, words): the mixture's own text, block by block, joined by index."""
        return self.slots.hint("merge").join(self.blocks(docs), ["number", "index"]).select("shard", "slot", "number", "index", "words")

    def taken(self) -> DataFrame:
        """For each document the words that the mixture takes of it, repeats counted."""
        uses = self.slots.groupBy("number", "index").agg(F.count("*").alias("uses"))
        # the slots' size can't be estimated from the few draws that they are generated from
        joined = self.spans().join(uses.hint("merge"), ["number", "index"], "left")
        key = ["doc_id", "mark", "size", "number", "bucket", "place"]
        return joined.groupBy(*key).agg(F.coalesce(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))), F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> Mix:
    """Plan and draw a mixture of ``docs`` (doc_id, source, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    said = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(said, F.lit(WORD)).cast("long")
    sized = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(said).alias("mark"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()
    sources = plan([(r.source, r.rows, r.size) for r in totals], block, weights, limit)
    buckets = max(1, round(max((s.rows for s in sources), default=1) ** 0.5))
    names = _table(spark, sources).select(F.col("source").alias("name"), "number")
    numbered = _with_source(sized, names, len(sources), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "mark", "size", "number", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)).alias("bucket"))
    mass = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("mass"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(mass.select("number", "bucket", F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("start")), "bucket-starts")
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "mark", "size")
    placed = numbered.withColumn("place", F.row_number().over(inside)).withColumn("ahead", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    documents = placed.join(starts, ["number", "bucket"]).select("doc_id", "mark", "size", "number", "bucket", "place", (F.col("start") + F.col("ahead")).alias("begin"))
    return Mix(documents, slots(spark, sources, seed), sources, block)


def slots(spark, sources: list[Source], seed: int = SEED, per_shard: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, number, index): which block fills each slot of each shard. Every task draws its own shards."""
    wanted, blocks = np.array([s.slots for s in sources], np.int64), np.array([s.blocks for s in sources], np.int64)
    number = -(-int(wanted.sum()) // per_shard) if sources else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("id").to_pylist()  # a range, in order
            for shard, counts, before in drawn(wanted, number, own[0], own[-1] + 1, seed) if own else ():
                slot = 0
                for i in np.flatnonzero(counts).tolist():
                    n = int(counts[i])
                    order = before[i] + np.arange(n)
                    turn, index = order // blocks[i], order % blocks[i]
                    key = (turn.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(i * 7919 + seed)) * np.uint64(0xD1342543DE82EF95)
                    found = permuted(index, np.full(n, blocks[i]), key)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(slot + np.arange(n)), pa.array(np.full(n, i, np.int32)), pa.array(found)], ["shard", "slot", "number", "index"])
                    slot += n

    return spark.range(0, number, 1, min(MAX_TASKS, max(1, number))).mapInArrow(run, "shard long, slot long, number int, index long")


def digest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    mixed = mix(docs, block)
    facts = _table(docs.sparkSession, mixed.sources).withColumnRenamed("number", "of")
    return _with_source(mixed.taken(), facts, len(mixed.sources), F.col("number") == F.col("of")).select("doc_id", "source", "size", "source_size", "target", "taken")
