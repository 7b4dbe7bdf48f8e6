"""Average-linkage discovery, exact and distributed.

Two groups merge only if their average distance is within the threshold, so some pair across them is. Every
final cluster therefore lies inside one connected component of the graph of pairs within the threshold, and
components don't influence each other: (1) block pairs of vectors are compared by matrix products and give
edges; (2) components of the edges; (3) exact average linkage within each component. A scope of at most DIRECT vectors is one
task's work from the start, as three rounds of jobs would cost more than its matrix. ``discover_vectors`` is the plain form for one group.

(1) Vectors are dealt to the nearest of some pivots, and a block knows its cap: a centre, and the greatest angle between it and a
member. By the triangle inequality on angles no vectors of two blocks are closer than their centres' angle less both caps', so block
pairs for which that exceeds the threshold's angle are never made.

Where caps rule out less than half of the block pairs, a spanning pass deals the scope's vectors to few large blocks instead, as each vector travels
once for each block of its scope.

(3) The average distance of two groups is 1 - s_a.s_b / (n_a n_b), where s is the sum of a group's unit vectors, so a group is one vector
whatever its size, and no distance matrix is kept. Average linkage is reducible: a merger comes no closer to a third group than the
closer of its parts was. So *reciprocal nearest neighbours* may merge at the same time, a group none of whose neighbours is within the threshold is final,
and a group whose nearest neighbour is still there keeps it. A component beyond LOCAL groups goes through such rounds, in which
block pairs find the nearest neighbours of the groups that need one; once LOCAL groups are left, one task ends it. Exact copies are one group before
the first round. Memory is linear in the component, and a task's is bounded: products are made and judged strip by strip.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path, ship, written

MERGE_THRESHOLD = 0.35
MIN_CLUSTER_SIZE = 5
BLOCK = 2048
#: Bytes of a large block's vectors, the blocks that a scope has at least if BLOCK allows, and the rows of a product at a time.
WIDE = 4 << 20
FEW = 8
STRIP = 256
#: Groups of one component whose matrix one task holds.
LOCAL = 4_000
#: Pivots of a scope at most, and vectors of it that they are chosen from.
PIVOTS = 64
SAMPLE = 512
#: Vectors of a scope that one task links without looking for components first.
DIRECT = 2_500
_SLACK = 1e-9
_TIE = 1e-12


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def agglomerate(vectors: np.ndarray, threshold: float = MERGE_THRESHOLD, sizes: np.ndarray | None = None) -> list[list[int]]:
    """Groups of row numbers by average linkage on cosine distance; merging stops above the threshold.

    With ``sizes`` a row is a group of so many vectors, and the sum of its unit vectors. A cached nearest neighbour for each row makes a merge linear: distances of the merged group are the
    size-weighted means of its parts', and only rows whose neighbour went away look again.
    """
    n = len(vectors)
    if n == 0:
        return []
    unit = _unit(np.asarray(vectors, np.float64)) if sizes is None else vectors / sizes[:, None]
    d = 1.0 - np.clip(unit @ unit.T, -1.0, 1.0)
    np.fill_diagonal(d, np.inf)
    members: list[list[int]] = [[i] for i in range(n)]
    size = np.ones(n) if sizes is None else np.asarray(sizes, np.float64).copy()
    alive = np.ones(n, bool)
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    while alive.sum() > 1:
        i = int(np.argmin(np.where(alive, best, np.inf)))
        if not best[i] <= threshold:
            break
        a, b = sorted((i, int(near[i])))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[a] = row[b] = np.inf
        row[~alive] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        members[a] += members[b]
        alive[b], best[b] = False, np.inf
        stale = np.flatnonzero(alive & ((near == a) | (near == b)))
        stale = np.union1d(stale, [a])
        near[stale] = d[stale].argmin(axis=1)
        best[stale] = d[stale, near[stale]]
        closer = alive & (d[:, a] < best)
        near[closer], best[closer] = a, d[closer, a]
    return [sorted(members[i]) for i in range(n) if alive[i]]


def discover_vectors(vectors: list, threshold: float = MERGE_THRESHOLD, least: int = MIN_CLUSTER_SIZE) -> tuple[list[list[int]], list[int]]:
    """(clusters by size and first member, noise) of one set of vectors."""
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors differ in size")
    groups = agglomerate(np.asarray(vectors, np.float64).reshape(len(vectors), -1), threshold)
    clusters = sorted((g for g in groups if len(g) >= least), key=lambda g: (-len(g), g[0]))
    return clusters, sorted(i for g in groups if len(g) < least for i in g)


def _forest(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Star links of the components of a block pair: rows number from 0, columns follow, or are the rows.

    A search by levels from each row not yet reached; each row and column is looked at once.
    """
    n = len(near)
    rows, cols = near.any(axis=1), np.ones(near.shape[1], bool)
    links = []
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        fresh = np.array([start])
        rows[start] = False
        if same:
            cols[start] = False
        while len(fresh):
            across = np.flatnonzero(near[fresh].any(axis=0) & cols)
            cols[across] = False
            if same:
                rows[across] = False
                fresh = across
                links += [(start, i) for i in across.tolist()]
                continue
            links += [(start, n + i) for i in across.tolist()]
            fresh = np.flatnonzero(near[:, across].any(axis=1) & rows)
            rows[fresh] = False
            links += [(start, i) for i in fresh.tolist()]
    return links


def _near(p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows are within the threshold of each other."""
    out = np.empty((len(p), len(q)), bool)
    for s in range(0, len(p), STRIP):
        np.less_equal(1.0 - np.clip(p[s : s + STRIP] @ q.T, -1.0, 1.0), threshold + _SLACK, out=out[s : s + STRIP])
    return out


def _closest(p: np.ndarray, q: np.ndarray, same: np.ndarray | None = None, both: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distance, place) of the nearest row of ``q`` for each of ``p``, and for ``both`` the other way round as well; the first of those that rounding can't tell apart.

    ``same`` is each row's own place in ``q``, which is no neighbour.
    """
    best, at = np.empty(len(p)), np.empty(len(p), np.int64)
    back, back_at = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
    for s in range(0, len(p), STRIP):
        product = p[s : s + STRIP] @ q.T
        if same is not None:
            product[np.arange(len(product)), same[s : s + STRIP]] = -np.inf
        top = product.max(axis=1)
        best[s : s + STRIP], at[s : s + STRIP] = top, (product >= (top - _TIE)[:, None]).argmax(axis=1)
        if both:
            top = product.max(axis=0)
            closer = np.flatnonzero(top > back + _TIE)
            back_at[closer] = s + (product[:, closer] >= top[closer] - _TIE).argmax(axis=0)
            back[closer] = top[closer]
    found = [(best, at), (back, back_at)] if both else [(best, at)]
    return [(np.round(1.0 - np.clip(x, -np.inf, 1.0), 12), y) for x, y in found]


def _stacked(column) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.stack([np.frombuffer(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def packed(items: DataFrame, scope: list[str], keep: list[str]) -> DataFrame:
    """(scope, keep.., unit): unit vectors as packed doubles, which cost Arrow a copy and no list of numbers."""
    rows = items.select(*scope, *keep, F.col("vector").cast("array<double>").alias("unit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len({len(v) for v in batch["unit"]}) > 1:
                raise ValueError("vectors differ in size")
            own = _unit(np.array(batch["unit"].tolist(), np.float64).reshape(len(batch), -1)) if len(batch) else []
            yield batch.assign(unit=[x.tobytes() for x in own])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields[:-1], T.StructField("unit", T.BinaryType())]))


def _angle(cosine) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _chosen(sample: np.ndarray, most: int) -> list[int]:
    """Pivots among a sample: each the farthest from those before it."""
    found, near = [0], sample @ sample[0]
    while len(found) < min(most, len(sample)):
        at = int(near.argmin())
        if near[at] >= 1.0 - _SLACK:
            break
        found.append(at)
        near = np.maximum(near, sample @ sample[at])
    return found


def _parts(n, size):
    """Blocks of ``n`` vectors of ``size`` bytes: of WIDE bytes, but FEW at least, and never smaller than BLOCK vectors."""
    return F.least(F.ceil(n / BLOCK), F.greatest(F.ceil(n * size / WIDE), F.lit(FEW))).cast("int")


def widened(blocks: DataFrame, pairs: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """``blocks`` and ``pairs``, with large blocks and all their pairs in the scopes where more than half of the pairs are left."""
    sizes = blocks.groupBy(*scope).agg(_parts(F.count("*"), F.max(F.length("unit"))).alias("_k"), F.countDistinct("block").alias("_b"))
    left = pairs.groupBy(*scope).agg(F.count("*").alias("_p")).join(sizes, scope)
    dense = written(left.where((F.col("_p") * 4 > F.col("_b") * (F.col("_b") + 1)) & (F.col("_k") < F.col("_b"))).select(*scope, "_k"), "dense")
    dealt = blocks.join(dense, scope, "left").withColumn("block", F.when(F.col("_k").isNull(), F.col("block")).otherwise(F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))).drop("_k")
    last = F.col("_k") - 1
    every = dense.withColumn("x", F.explode(F.sequence(F.lit(0), last))).withColumn("y", F.explode(F.sequence("x", last))).select(*scope, "x", "y")
    return dealt, pairs.join(dense, scope, "left_anti").select(*scope, "x", "y").unionByName(every)


def capped(units: DataFrame, scope: list[str]) -> DataFrame:
    """``units(scope.., id, unit)`` dealt to blocks: (scope, id, unit, block), blocks of about BLOCK vectors near one pivot.

    A scope's pivots, PIVOTS at most, meet its vectors chunk by chunk, so no task holds a scope.
    """
    fields = {f.name: f for f in units.schema.fields}
    sizes = units.groupBy(*scope).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_chunks"))
    few = Window.partitionBy(*scope).orderBy(F.xxhash64("id"), "id")
    sample = units.withColumn("_place", F.row_number().over(few)).where(F.col("_place") <= SAMPLE).select(*scope, "unit").join(sizes, scope)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        own = group.iloc[_chosen(_stacked(group["unit"]), min(PIVOTS, int(group["_chunks"].iloc[0]) * 4))]
        return own[[*scope, "unit", "_chunks"]].astype(object).assign(_pivot=range(len(own)))

    chosen = sample.groupBy(*scope).applyInPandas(choose, T.StructType([*(fields[c] for c in scope), fields["unit"], T.StructField("_chunks", T.IntegerType()), T.StructField("_pivot", T.IntegerType())]))
    pivots = chosen.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).select(*scope, "_chunk", "_pivot", F.col("unit").alias("_at"))
    dealt = units.join(sizes, scope).withColumn("_chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).drop("_chunks")

    def deal(key: tuple, members: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame(columns=[*scope, "id", "unit", "cell"])
        near = _stacked(members["unit"]) @ _stacked(known.sort_values("_pivot")["_at"]).T
        return members[[*scope, "id", "unit"]].astype(object).assign(cell=near.argmax(axis=1))

    by = [*scope, "_chunk"]
    cells = dealt.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInPandas(deal, T.StructType([*(fields[c] for c in (*scope, "id", "unit")), T.StructField("cell", T.IntegerType())]))
    cells = written(cells, "cells")
    parts = cells.groupBy(*scope, "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("_parts")).cast("int")
    return cells.join(parts, [*scope, "cell"]).select(*scope, "id", "unit", (F.col("cell") + part * PIVOTS).alias("block"))


def block_pairs(blocks: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(scope, x, y), x <= y: the pairs of blocks that may hold vectors within the threshold of each other."""
    fields = {f.name: f for f in blocks.schema.fields}

    def cap(group: pd.DataFrame) -> pd.DataFrame:
        own = _stacked(group["unit"])
        center = _unit(own.sum(axis=0, keepdims=True))
        # a zero vector is at no angle, and farther from all than any threshold: its cap is the whole sphere
        return group[[*scope, "block"]].head(1).astype(object).assign(center=[center.tobytes()], cap=float(_angle(own @ center[0]).max()) if np.any(own, axis=1).all() else np.pi)

    caps = blocks.groupBy(*scope, "block").applyInPandas(cap, T.StructType([*(fields[c] for c in scope), fields["block"], T.StructField("center", T.BinaryType()), T.StructField("cap", T.DoubleType())]))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block", ignore_index=True)
        centers, caps = _stacked(group["center"]), group["cap"].to_numpy()
        apart = _angle(centers @ centers.T) - caps[:, None] - caps
        x, y = np.nonzero(np.triu(apart <= _angle(1.0 - threshold - _SLACK) + 1e-7))
        return pd.DataFrame({**{c: [group[c].iloc[0]] * len(x) for c in scope}, "x": group["block"].to_numpy()[x], "y": group["block"].to_numpy()[y]}, dtype=object)

    return caps.groupBy(*scope).applyInPandas(pair, T.StructType([*(fields[c] for c in scope), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))


def edges(items: DataFrame, scope: list[str], threshold: float = MERGE_THRESHOLD, spanning: bool = False) -> DataFrame:
    """(scope, a, b, distance) of pairs within the threshold, a < b, from ``items(scope.., id, vector)``.

    ``spanning`` gives, of each block pair, only links that span its components: enough for components,
    and no more rows than vectors.

    A scope of one block is a group; of larger ones each pair of blocks that caps don't keep apart is. A group is a
    matrix product: a task holds two blocks whatever the size of the scope.
    """
    ship(items.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in scope) + f", a {kinds['id']}, b {kinds['id']}, distance double"
    units = packed(items, scope, ["id"])
    widest = items.groupBy(*scope).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if widest <= BLOCK:
        paired = units.select("*", F.lit(0).alias("block"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    else:
        blocks = written(capped(units, scope), "blocks")
        pairs = block_pairs(blocks, scope, threshold)
        if spanning:
            blocks, pairs = widened(blocks, written(pairs, "pairs"), scope)
        both = pairs.select(*scope, "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
        paired = blocks.join(both, [*scope, "block"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
        left, right = group[group["block"] == x], group[group["block"] == y]
        p, q = _stacked(left["unit"]), _stacked(right["unit"])
        if not len(p) or not len(q):
            return pd.DataFrame(columns=[*scope, "a", "b", "distance"])
        if p.shape[1] != q.shape[1]:
            raise ValueError("vectors differ in size")
        if spanning:
            ids = left["id"].tolist() if x == y else [*left["id"], *right["id"]]
            links = _forest(_near(p, q, threshold), x == y)
            return pd.DataFrame({**{c: [group[c].iloc[0]] * len(links) for c in scope}, "a": [ids[u] for u, _ in links], "b": [ids[v] for _, v in links], "distance": [threshold] * len(links)}, dtype=object)
        distance = 1.0 - np.clip(p @ q.T, -1.0, 1.0)
        i, j = np.nonzero(distance <= threshold + _SLACK)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = (a < b) if x == y else np.ones(len(a), bool)
        a, b, found = a[keep], b[keep], distance[i, j][keep]
        return pd.DataFrame({**{c: [group[c].iloc[0]] * len(a) for c in scope}, "a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "distance": found}, dtype=object)

    return paired.groupBy(*scope, "x", "y").applyInPandas(compare, schema)


def components(items: DataFrame, links: DataFrame, scope: list[str], name: str = "root") -> DataFrame:
    """(scope, id, root) with ``root`` under the name given: the least id each item reaches over ``links(scope, a, b)``.

    Labels take the least of their neighbourhood and then jump to their label's label; rounds are written
    to the shared folder, so lineage stays short and a lost executor costs no more than a read.
    """
    both = written(links.select(*scope, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(*scope, F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
    labels = written(items.select(*scope, "id", F.col("id").alias("_root")), "labels")
    while True:
        around = both.join(labels.withColumnsRenamed({"id": "v", "_root": "r"}), [*scope, "v"]).groupBy(*scope, F.col("u").alias("id")).agg(F.min("r").alias("least"))
        met = labels.join(around, [*scope, "id"], "left").select(*scope, "id", F.least("_root", F.coalesce("least", "_root")).alias("_root"), F.col("_root").alias("was"))
        jumps = met.select(*scope, F.col("id").alias("_root"), F.col("_root").alias("next"))
        moved = written(met.join(jumps, [*scope, "_root"], "left").select(*scope, "id", F.least("_root", F.coalesce("next", "_root")).alias("_root"), "was"), "labels")
        if moved.where("_root <> was").isEmpty():
            return moved.select(*scope, "id", F.col("_root").alias(name))
        labels = moved.drop("was")


def _nearest(live: DataFrame, stale: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, id, other, distance): the nearest live group within the threshold of each stale one, ties to the pair of least ids."""
    kinds = {f.name: f.dataType.simpleString() for f in live.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", id {kinds['id']}, other {kinds['id']}, distance double"
    sizes = live.groupBy(*by).agg(_parts(F.count("*"), F.max(F.length("total"))).alias("_blocks"))
    marked = live.join(stale.select(*by, "id", F.lit(True).alias("_stale")), [*by, "id"], "left").withColumn("_stale", F.coalesce("_stale", F.lit(False)))
    dealt = marked.join(sizes, by).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    paired = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = paired.select(*by, "id", "n", "total", "_stale", "_b", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        x, y = int(group["_x"].iloc[0]), int(group["_y"].iloc[0])
        group = group.sort_values("id")  # the first of equals has the least id
        sides = [group[group["_b"] == x], group[group["_b"] == y]]
        means = [_stacked(g["total"]) / g["n"].to_numpy()[:, None] if len(g) else None for g in sides]
        wants = [g["_stale"].to_numpy(bool) for g in sides]
        out = []

        def add(i: int, want: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
            own, other = sides[i]["id"].to_numpy()[want], sides[1 - i]["id"].to_numpy()[at]
            close = best <= threshold
            out.append(pd.DataFrame({**{c: [group[c].iloc[0]] * int(close.sum()) for c in by}, "id": own[close], "other": other[close], "distance": best[close]}, dtype=object))

        if x == y:
            if wants[0].any():
                add(0, wants[0], *_closest(means[0][wants[0]], means[0], np.flatnonzero(wants[0]))[0])
        elif len(sides[0]) and len(sides[1]):
            if wants[0].mean() + wants[1].mean() > 1:  # one product serves both
                for i, (best, at) in enumerate(_closest(*means, both=True)):
                    add(i, wants[i], best[wants[i]], at[wants[i]])
            else:
                for i in (0, 1):
                    if wants[i].any():
                        add(i, wants[i], *_closest(means[i][wants[i]], means[1 - i])[0])
        return pd.concat(out) if out else pd.DataFrame(columns=[*by, "id", "other", "distance"])

    found = paired.groupBy(*by, "_x", "_y").applyInPandas(search, schema)
    order = F.struct("distance", F.least("id", "other"), F.greatest("id", "other"))
    return found.groupBy(*by, "id").agg(F.min_by("other", order).alias("other"), F.min("distance").alias("distance"))


def _summed(pairs: DataFrame) -> DataFrame:
    """Rows (.., total, total_2) with ``total`` the sum of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = zip(batch["total"], batch["total_2"], strict=True)
            yield batch.drop(columns="total_2").assign(total=[(np.frombuffer(a, np.float64) + np.frombuffer(b, np.float64)).tobytes() for a, b in both])

    return pairs.mapInPandas(run, T.StructType([f for f in pairs.schema.fields if f.name != "total_2"]))


def _multiplied(groups: DataFrame) -> DataFrame:
    """Rows (.., n, total) with ``total``, a vector that n rows have, as their sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(total=[(np.frombuffer(x, np.float64) * n).tobytes() for x, n in zip(batch["total"], batch["n"], strict=True)])

    return groups.mapInPandas(run, groups.schema)


def merged(units: DataFrame, by: list[str], threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rounds of reciprocal nearest neighbours over ``units(by.., id, unit)``: groups (by, id, n, total) that may still merge, those that are final, and (by, id, head), the group of each vector.

    A group's id is its least member's. Rounds end once no component has more than LOCAL groups that may still merge; components that are small enough are
    left as they are.
    """
    # a zero vector is near none, its copies neither
    zero = F.btrim(F.col("unit").cast("string"), F.lit("\0")) == ""
    lone = zero | F.lit(threshold <= _SLACK)
    units = written(units.select(*by, "id", "unit", F.when(lone, F.concat(F.lit("id "), F.col("id").cast("string"))).otherwise("").alias("_own")), "units")
    copies = written(units.groupBy(*by, "unit", "_own").agg(F.min("id").alias("first"), F.count("*").alias("n")), "copies")
    live = written(_multiplied(copies.select(*by, F.col("first").alias("id"), "n", F.col("unit").alias("total"))), "live")
    items, near = live.select(*by, "id"), None
    spark, rounds = units.sparkSession, new_path(units.sparkSession, "rounds")
    for k in itertools.count():
        wide = written(live.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > LOCAL).select(*by), "wide")
        if wide.isEmpty():
            break
        active = live.join(wide, by, "left_semi")
        stale = active.select(*by, "id") if near is None else active.select(*by, "id").join(near, [*by, "id"], "left_anti")
        fresh = _nearest(active, stale, by, threshold)
        near = written(fresh if near is None else near.join(wide, by, "left_semi").unionByName(fresh), "near")
        back = near.select(*by, F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = written(near.where("id < other").join(back, [*by, "id", "other"], "left_semi").select(*by, F.col("id").alias("a"), F.col("other").alias("b")), f"pairs-{k}", rounds)
        if pairs.isEmpty():  # distances that rounding tells apart from one side only
            order = F.struct("distance", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
            closest = near.groupBy(*by).agg(F.min(order).alias("x")).select(*by, "x.a", "x.b")
            pairs = written(closest, f"pairs-{k}-closest", rounds)
        ends = pairs.select(*by, F.explode(F.array("a", "b")).alias("id"))
        alone = active.join(near.select(*by, "id"), [*by, "id"], "left_anti")  # nothing within the threshold, now or later
        two = live.select(*by, F.col("id").alias("b"), F.col("n").alias("n_2"), F.col("total").alias("total_2"))
        joined = live.join(pairs.withColumn("id", F.col("a")), [*by, "id"]).join(two, [*by, "b"])
        fused = _summed(joined.select(*by, "id", (F.col("n") + F.col("n_2")).alias("n"), "total", "total_2"))
        rest = live.join(wide, by, "left_anti").unionByName(active.join(near.select(*by, "id"), [*by, "id"], "left_semi").join(ends, [*by, "id"], "left_anti"))
        after = written(rest.unionByName(fused).withColumn("_done", F.lit(False)).unionByName(alone.withColumn("_done", F.lit(True))), f"live-{k}", rounds)
        live = after.where("not _done").drop("_done")
        # a neighbour that was merged has to be looked for again, and so has a merged group's
        kept = near.join(ends, [*by, "id"], "left_anti").join(ends.withColumnRenamed("id", "other"), [*by, "other"], "left_anti")
        near = kept.select(*near.columns)
    # all rounds at once: a scan each, however many there were
    heads = components(items, spark.read.schema(pairs.schema).parquet(f"{rounds}/pairs-*"), by, "head") if k else items.withColumn("head", F.col("id"))
    final = spark.read.schema(after.schema).parquet(f"{rounds}/live-*").where("_done").drop("_done") if k else live.limit(0)
    of = units.join(copies.drop("n"), [*by, "unit", "_own"]).select(*by, "id", "first")
    return live, final, of.join(heads.withColumnRenamed("id", "first"), [*by, "first"]).select(*by, "id", "head")


def discover(items: DataFrame, scope: list[str], threshold: float = MERGE_THRESHOLD, least: int = MIN_CLUSTER_SIZE) -> DataFrame:
    """``items(scope.., id, vector)`` -> (scope, id, cluster): the least id of its cluster, null for noise."""
    ship(items.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in scope) + f", id {kinds['id']}, cluster {kinds['id']}"

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        clusters, _ = discover_vectors(group["vector"].tolist(), threshold, least)
        ids, out = group["id"].tolist(), [None] * len(group)
        for members in clusters:
            for i in members:
                out[i] = ids[members[0]]
        return group[[*scope, "id"]].assign(cluster=pd.Series(out, dtype=object))

    def end(group: pd.DataFrame) -> pd.DataFrame:
        """The last mergers of a component's groups: (by, head, cluster)."""
        group = group.sort_values("id", ignore_index=True)
        n = group["n"].to_numpy()
        ids, out = group["id"].tolist(), [None] * len(group)
        for members in agglomerate(_stacked(group["total"]), threshold, n):
            if n[members].sum() >= least:
                for i in members:
                    out[i] = ids[members[0]]
        return group[[*scope, "root", "id"]].rename(columns={"id": "head"}).astype(object).assign(cluster=pd.Series(out, dtype=object))

    sizes = items.groupBy(*scope).agg(F.count("*").alias("_n"))
    wide = written(sizes.where(F.col("_n") > DIRECT).select(*scope), "wide")
    if wide.isEmpty():
        return items.groupBy(*scope).applyInPandas(link, schema)
    narrow = items.join(wide, scope, "left_anti").groupBy(*scope).applyInPandas(link, schema)
    rest = items.join(wide, scope, "left_semi")
    named = components(rest, edges(rest, scope, threshold, spanning=True).drop("distance"), scope)
    mass = named.groupBy(*scope, "root").agg(F.count("*").alias("_n"))
    worth = rest.join(named, [*scope, "id"]).join(mass, [*scope, "root"])
    small = worth.where(F.col("_n") < least).select(*scope, "id", F.lit(None).cast(kinds["id"]).alias("cluster"))
    middle = worth.where((F.col("_n") >= least) & (F.col("_n") <= LOCAL)).groupBy(*scope, "root").applyInPandas(link, schema)
    out = narrow.unionByName(middle).unionByName(small)
    by = [*scope, "root"]
    if mass.where(F.col("_n") > LOCAL).isEmpty():
        return out
    groups, final, heads = merged(packed(worth.where(F.col("_n") > LOCAL), by, ["id"]), by, threshold)
    ended = groups.groupBy(*by).applyInPandas(end, ", ".join(f"`{c}` {kinds[c]}" for c in scope) + f", root {kinds['id']}, head {kinds['id']}, cluster {kinds['id']}")
    lone = final.select(*by, F.col("id").alias("head"), F.when(F.col("n") >= least, F.col("id")).alias("cluster"))
    ended = ended.unionByName(lone)
    return out.unionByName(heads.join(ended, [*by, "head"]).select(*scope, "id", "cluster"))
