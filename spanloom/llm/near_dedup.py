"""Near-duplicate documents: chosen-path set similarity join on word shingles.

Texts become sets of distinct ``k``-word shingles (A-Z lower-cased words; fewer than ``k`` words are
one shingle). Equal sets, by a 128-bit digest, collapse into a class first, so exact copies never meet.
Independent trees then branch the classes by one minwise token a level: classes that agree on the chosen
coordinates share a node. A node of at most NODE_LIMIT classes is compared exhaustively on short
signatures, which gives groups of that node alone; a larger one branches again, and one that is still
large at the last level is a group as it stands. Every group, equal ones once, is confirmed on full sets, and there a
link holds exactly where 100 * |A & B| >= threshold * |A | B|. Only confirmed links ever join documents,
so unlike ones are never chained into one group. Groups of more than one block are compared block by
block, so no task holds a whole group.

A pair at similarity s shares a node of level l in one tree with probability s**l. Every class takes as many trees as suffice at the last
level, after which a pair at the threshold is apart with probability MISS at most: 27 trees of four levels at 0.8. Their number doesn't depend on how a class fared, as
that may depend on whom it failed to meet. The first FIRST_TREES trees come by themselves, so that what they join needn't be compared again.
Signature comparison lets a pair at the threshold pass up to five
standard deviations below, and stops 8e-7 of such pairs at 0.8. Later rounds skip pairs that confirmed
links have joined already, so a large group of copies is compared in the first trees and not in all.
A row of a tree carries the four tokens that it chooses, 16 bytes, down its levels.

Texts are read once for the tokens of all trees, and twice more for confirmation: after the first trees, and after all others
together. Each of these shuffles texts by row once, whatever the number of trees or rounds, so what is moved grows as the input does.

Defined cases: documents without words (null, empty, only separators) have an empty set, are linked
with nothing and are kept. Repeated rows fall into one class. Rows that share an id but not a text are
documents of their own, and so are rows without an id. A null id never names a component unless all its
documents have null ids. Empty tables give empty results; extra columns are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._components import components, with_least
from ._spark import saved, small_batches

TREES = 13
#: Trees of the first round; what they join needs no comparison in the others.
FIRST_TREES = 2
LEVELS = 4
#: Minwise tokens of a class that make its signature, a byte each.
COORDINATES = 60
NODE_LIMIT = 128
#: A pair at the threshold shares no node of the last level in any of all trees with this probability at most.
MISS = 1e-6
#: Shingles and sets of one confirmation block.
BLOCK_SHINGLES = 1 << 19
BLOCK_SETS = 1024

def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` hash functions: those of a tree's levels follow one another, tree by tree."""
    rng = np.random.Generator(np.random.PCG64(99))
    pairs = rng.integers(0, 2**63, (n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def gain(level: int, threshold: int) -> float:
    """Minus the logarithm of the chance that a pair at the threshold is apart at ``level`` of a tree."""
    apart = 1 - (threshold / 100) ** level
    return -math.log(apart) if 0 < apart < 1 else TARGET


#: The sum of gains that is enough.
TARGET = -math.log(MISS)


def all_trees(threshold: int) -> int:
    """Trees that are enough even if every node is at the last level."""
    return max(TREES, math.ceil(TARGET / gain(LEVELS, threshold)))


#: What stands for a null id wherever rows are matched by id.
NO_ID = -(2**63)


def _minima(parts: list[np.ndarray], xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """For each non-empty set its minwise token at each coordinate, as 32-bit numbers."""
    flat = np.concatenate(parts)
    at = np.cumsum([0, *map(len, parts[:-1])])
    out = np.empty((len(parts), len(xor)), np.uint32)
    for i in range(len(xor)):
        out[:, i] = np.minimum.reduceat((flat ^ xor[i]) * mul[i], at) >> np.uint64(32)
    return out


def _digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    tokens = _text.tokenize(batch.column(text), _text.SPACED)
    return [_text.shingles(tokens.hash[tokens.of(i)], k) for i in range(batch.num_rows)]


def _row_key(key: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("rep_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rep_mark")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rep_id, rep_mark, text): a row is known by its id and a hash of its text, for ids may repeat or lack."""
    return docs.select(*_row_key(key, text), F.col(text).alias("text"))


def features(docs: DataFrame, k: int, trees: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rep_id, rep_mark, digest, n_shingles, minima, marks) of each row; digest and minima null without words.

    ``minima`` are the tokens of all ``trees``, ``marks`` the low bytes of the first: the short signature that nodes compare.
    """
    n = max(trees * LEVELS, COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = _coordinates(n)
        for batch in _text.slices(batches):
            sets = _sets(batch, "text", k)
            full = [i for i, s in enumerate(sets) if len(s)]
            minima = dict(zip(full, _minima([sets[i] for i in full], xor, mul), strict=True)) if full else {}
            known = [minima.get(i) for i in range(len(sets))]
            own = [pa.array([None if m is None else _digest(s) for s, m in zip(sets, known, strict=True)], pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array([None if m is None else m[: trees * LEVELS].tobytes() for m in known], pa.binary()), pa.array([None if m is None else m[:COORDINATES].astype(np.uint8).tobytes() for m in known], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("rep_id"), batch.column("rep_mark"), *own], ["rep_id", "rep_mark", "digest", "n_shingles", "minima", "marks"])

    small_batches(docs.sparkSession)
    return _keyed(docs, key, text).mapInArrow(run, "rep_id long, rep_mark long, digest binary, n_shingles long, minima binary, marks binary")


def _classes(found: DataFrame) -> DataFrame:
    """One row for each distinct set: its number, the row that stands for it, and its least id."""
    rep = F.min(F.struct("rep_id", "rep_mark"))
    least = F.min(F.when(F.col("rep_id") != NO_ID, F.col("rep_id")))
    one = found.where("digest is not null").groupBy("digest").agg(rep.alias("rep"), least.alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "minima", "marks")])
    return one.select(F.monotonically_increasing_id().alias("set_key"), "digest", "rep.*", "least", "n_shingles", "minima", "marks")


def _token(level: int):
    """The minwise token that a tree chooses at a level: four bytes of ``path``."""
    return F.substring(F.col("path"), level * 4 + 1, 4)


def _passing(threshold: int) -> int:
    """Agreeing one-byte minima that let a pair pass: five deviations below the threshold's mean."""
    t = threshold / 100
    return max(1, int(COORDINATES * t - 5 * (COORDINATES * t * (1 - t)) ** 0.5))


def _similar(key: np.ndarray, label: np.ndarray, mark: np.ndarray, size: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Groups of a node's rows that signatures find similar across labels; the rest need no confirmation."""
    least, n = _passing(threshold), len(key)
    root, met = np.arange(n), np.zeros(n, bool)
    for i in range(n - 1):
        other = slice(i + 1, n)
        near = (np.minimum(size[other], size[i]) * 100 >= threshold * np.maximum(size[other], size[i])) & (label[other] != label[i])
        hit = np.flatnonzero(near & ((mark[other] == mark[i]).sum(axis=1) >= least)) + i + 1
        if len(hit):
            met[i] = met[hit] = True
            groups = np.unique(root[np.append(hit, i)])
            root[np.isin(root, groups)] = groups[0]
    return [key[met & (root == r)] for r in np.unique(root[met])]


def _compare(threshold: int):
    """Rows sorted by node, nodes of at most NODE_LIMIT rows -> (grp, set_key) of each group of similar rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def closed() -> pa.RecordBatch:
            found = [np.sort(g) for g in _similar(*(np.concatenate(x) for x in zip(*held, strict=True)), threshold)]
            names = [int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "little", signed=True) for g in found]
            keys = np.concatenate(found) if found else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), list(map(len, found)))), pa.array(keys)], ["grp", "set_key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, key, label, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "set_key", "label", "n_shingles"))
            mark = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(len(node), COORDINATES)
            cut = np.flatnonzero(np.diff(node)) + 1
            for s, e in zip([0, *cut], [*cut, len(node)], strict=True):
                if node[s] != current:
                    if len(held) > 1 or held and len(held[0][0]) > 1:
                        yield closed()
                    held, current = [], node[s]
                held.append((key[s:e], label[s:e], mark[s:e], size[s:e]))
        if held:
            yield closed()

    return run


def _branched(classes: DataFrame, labels: DataFrame | None, trees: range, threshold: int) -> DataFrame:
    """Groups (grp, set_key) from some trees.

    ``labels(set_key, label)`` tells what earlier trees have joined. Only (node, set_key) rows of nodes that hold two labels or more
    fetch their marks, so the many classes that meet nobody never travel with them.
    """
    own = classes.select("set_key", "minima")
    own = own.withColumn("label", F.col("set_key")) if labels is None else own.join(labels, "set_key")
    rows = own.select("set_key", "label", "minima", F.explode(F.sequence(F.lit(trees.start), F.lit(trees.stop - 1))).alias("tree"))
    rows = rows.select("set_key", "label", "tree", F.substring("minima", F.col("tree") * (4 * LEVELS) + 1, F.lit(4 * LEVELS)).alias("path"))
    rows = rows.select("set_key", "label", "path", F.xxhash64("tree", F.lit(0), _token(0)).alias("node"))
    out = None
    for level in range(LEVELS):
        rows = saved(rows, "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("set_key").alias("least"), F.min("label").alias("low"), F.max("label").alias("high"))
        sizes = saved(sizes.where("low < high").select("node", "n", "least"), "node-sizes")
        small = rows.join(sizes.where(F.col("n") <= NODE_LIMIT).select("node"), "node").select("node", "set_key", "label")
        ordered = small.join(classes.select("set_key", "n_shingles", "marks"), "set_key").repartition("node").sortWithinPartitions("node", "set_key")
        groups = ordered.mapInArrow(_compare(threshold), "grp long, set_key long")
        out = groups if out is None else out.unionByName(groups)
        large = sizes.where(F.col("n") > NODE_LIMIT)
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            # the large nodes of several trees that have the same least member are one group
            out = out.unionByName(rows.join(large, "node").select(F.col("least").alias("grp"), "set_key"))
            break
        deeper = rows.join(large.select("node"), "node")
        rows = deeper.select("set_key", "label", "path", F.xxhash64("node", F.lit(level + 1), _token(level + 1)).alias("node"))
    return saved(out.distinct(), "groups")


def links(docs: DataFrame, classes: DataFrame, k: int, threshold: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Confirmed links (a, b) between classes, as many as join every pair of classes that chains of links join."""
    members = classes.select("set_key", "rep_id", "rep_mark", "digest", "n_shingles")
    confirmed = lambda groups: saved(confirm(docs, groups.join(members, "set_key"), k, threshold, key, text), "links")
    found = confirmed(_branched(classes, None, range(FIRST_TREES), threshold))
    # what the first trees have joined is most of it; the labels serve the others
    joined = components(found).select(F.col("node").alias("set_key"), F.col("root").alias("label"))
    labels = saved(classes.select("set_key").join(joined, "set_key", "left").withColumn("label", F.coalesce("label", "set_key")), "labels")
    return found.unionByName(confirmed(_branched(classes, labels, range(FIRST_TREES, all_trees(threshold)), threshold)))


def _confirmed(sets: list[np.ndarray], threshold: int, split: int | None) -> list[tuple[int, int]]:
    """Spanning links among sets (across ``split`` only, if given) that hold on full sets.

    Sets that are linked already are not compared again, nor are sets whose sizes rule a link out;
    intersections are counted through an index of the elements.
    """
    n = len(sets)
    root = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    value, owner_by_value = flat[order], owner[order]
    start = np.append(0, np.flatnonzero(np.diff(value)) + 1)
    group_of = np.empty(len(flat), np.int64)
    group_of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(flat))))
    stop = np.append(start[1:], len(flat))
    ptr = np.append(0, np.cumsum(size))
    links = []
    for i in range(n):
        if np.all(root == root[i]):
            continue
        near = (np.minimum(size, size[i]) * 100 >= threshold * np.maximum(size, size[i])) & (root != root[i])
        near[:i] &= split is not None  # within one block, earlier rows have met this one already
        if split is not None:
            near[: i + 1] = False
            if i < split:
                near[:split] = False
            else:
                near[:] = False
        if not near.any():
            continue
        groups = group_of[ptr[i] : ptr[i + 1]]
        spans = [owner_by_value[a:b] for a, b in zip(start[groups], stop[groups], strict=True)]
        both = np.bincount(np.concatenate(spans), minlength=n)
        hit = np.flatnonzero(near & (100 * both >= threshold * (size + size[i] - both)))
        for j in hit:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def confirm(docs: DataFrame, groups: DataFrame, k: int, threshold: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups (grp, set_key, rep_id, rep_mark, digest, n_shingles) -> confirmed links (a, b) between classes.

    Members are dealt to blocks of about BLOCK_SHINGLES; a group of one block is one task's work, of
    several one for each pair of blocks.
    """
    total = groups.groupBy("grp").agg(F.sum("n_shingles").alias("mass"), F.count("*").alias("sets"))
    blocks = F.ceil(F.greatest(F.col("mass") / BLOCK_SHINGLES, F.col("sets") / BLOCK_SETS)).cast("long")
    dealt = groups.join(saved(total.select("grp", blocks.alias("blocks")), "blocks"), "grp")
    dealt = dealt.select("grp", "set_key", "rep_id", "rep_mark", "digest", "blocks", F.pmod(F.xxhash64("set_key"), F.col("blocks")).alias("block"))
    # a class may be in many groups: its text is fetched once, and its set goes to each
    wanted = dealt.groupBy("rep_id", "rep_mark", "digest", "set_key").agg(F.collect_list(F.struct("grp", "blocks", "block")).alias("places"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            sets = _sets(batch, "text", k)
            keep = [i for i, want in enumerate(batch.column("digest").to_pylist()) if len(sets[i]) and _digest(sets[i]) == want]
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("set_key").take(index), batch.column("places").take(index), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["set_key", "places", "members"])

    small_batches(docs.sparkSession)
    texts = _keyed(docs, key, text).join(saved(wanted, "wanted").hint("merge"), ["rep_id", "rep_mark"]).select("set_key", "digest", "places", "text")
    sets = texts.mapInArrow(sets_of, "set_key long, places array<struct<grp:long,blocks:long,block:long>>, members binary")
    placed = sets.select("set_key", "members", F.explode("places").alias("p")).select("set_key", "members", "p.*")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = placed.select("grp", "set_key", "block", "members", other.alias("other"))
    paired = paired.select("grp", "set_key", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "members")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            rows = list({r[1]: r for r in rows}.values())  # repeated rows of the table repeat a set
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            two = rows[0][3] != rows[0][4]
            split = sum(r[0] == rows[0][3] for r in rows) if two else None
            pairs = _confirmed(sets, threshold, split)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in pairs], pa.int64()), pa.array([rows[j][1] for _, j in pairs], pa.int64())], ["a", "b"])

        held, current = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "set_key", "members", "x", "y", "grp")]
            for block, set_key, members, x, y, grp in zip(*columns, strict=True):
                if (grp, x, y) != current:
                    if len(held) > 1:
                        yield found(held)
                    held, current = [], (grp, x, y)
                held.append((block, set_key, members, x, y))
        if len(held) > 1:
            yield found(held)

    return paired.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "block", "set_key").mapInArrow(link, "a long, b long")


def judged(docs: DataFrame, k: int, threshold: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: rep_id, rep_mark, n_shingles, component (a class number, null without words) and its least id."""
    every = features(docs, k, all_trees(threshold), key, text)
    found = saved(every, "features")
    classes = saved(_classes(found), "classes")
    joined = components(links(docs, classes, k, threshold, key, text)).select(F.col("node").alias("set_key"), "root")
    named = saved(classes.select("set_key", "digest", "least").join(joined, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")), "named")
    least = with_least(named.withColumnRenamed("root", "component"), "component", "least")
    final = saved(least.select("digest", "component", F.col("root").alias("component_id")), "components")
    return found.select("rep_id", "rep_mark", "n_shingles", "digest").join(final, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    doc_id = F.when(F.col("rep_id") != NO_ID, F.col("rep_id"))
    out = judged(docs, k, threshold, key, text).select(doc_id.alias("doc_id"), "n_shingles", F.when(F.col("component").isNull(), doc_id).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), ties by a hash of the text.

    Rows that differ in id or text are never taken for each other; of rows that repeat both, one stays if
    there are words in it, and all stay if there are none.
    """
    found = judged(docs, k, threshold, key, text).where("component is not null")
    first = F.min(F.struct((F.col("rep_id") == NO_ID).alias("lacks"), "rep_id", "rep_mark"))
    keepers = found.groupBy("component").agg(first.alias("first")).select("first.rep_id", "first.rep_mark")
    rows = ["rep_id", "rep_mark"]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    wordless = ~F.coalesce(quoted[text], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # rows that repeat id and text differ in the others alone
    order = F.xxhash64(F.to_json(F.struct(*[v.alias(f"c{i}") for i, (c, v) in enumerate(quoted.items()) if c != text])))
    whole = docs.select(F.struct(*quoted.values()).alias("row"), order.alias("order"), wordless.alias("wordless"), *_row_key(key, text))
    kept = whole.where("not wordless").join(keepers, rows, "left_semi")
    one = kept.withColumn("place", F.row_number().over(Window.partitionBy(*rows).orderBy("order"))).where("place = 1")
    return one.select("row.*").unionByName(whole.where("wordless").select("row.*"))
