"""Vector columns over ``array<double>``: dot, norm, cosine, mean, running centroid and nearest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, ship


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def same_size(a: Column, b: Column) -> Column:
    """``a``, or an error where the two differ in size."""
    message = F.concat(F.lit("vectors differ in size: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(message).cast("array<double>"))


def dot(a: Column, b: Column, checked: bool = True) -> Column:
    left = same_size(a, b) if checked else a
    return F.aggregate(F.zip_with(left, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if either norm is 0; within [-1, 1]."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), size))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def normalize(a: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, name: str = "centroid", total: bool = False) -> DataFrame:
    """Component-wise mean (or ``total``) for each group; ragged groups are an error.

    Every Arrow batch sums up its groups first, so what is shuffled, component by component, is one vector for
    each batch and group and not one for each row.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, as_double(F.col(vector)).alias("_v")).where("_v is not null")
    key_fields = [rows.schema[c] for c in keys]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["_size"] = batch["_v"].map(len)
            out = [(*key, int(len(part)), np.sum(np.stack(part["_v"].tolist()), axis=0) if key[-1] else np.empty(0)) for key, part in batch.groupby([*keys, "_size"], sort=False, dropna=False)]
            if out:
                yield pd.DataFrame(out, columns=[*keys, "_size", "_n", "_sum"])

    partial = rows.mapInPandas(summed, T.StructType([*key_fields, T.StructField("_size", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_sum", T.ArrayType(T.DoubleType()))]))
    parts = partial.select(*keys, "_size", "_n", F.posexplode("_sum").alias("_at", "_x"))
    cells = parts.groupBy(*keys, "_at").agg((F.sum("_x") if total else F.sum("_x") / F.sum("_n")).alias("_x"), F.min("_size").alias("_low"), F.max("_size").alias("_high"))
    out = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_x"))).alias("_cells"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    values = F.transform("_cells", lambda c: c["_x"])
    return out.select(*keys, F.when(F.col("_low") == F.col("_high"), values).otherwise(F.raise_error(F.lit("vectors of one group differ in size")).cast("array<double>")).alias(name))


def update_centroid(centroid: Column, count: Column, vector: Column) -> Column:
    """Running mean: (c * n + v) / (n + 1); the vector itself where n is 0."""
    moved = F.zip_with(centroid, vector, lambda c, v: (c * count + v) / (count + 1))
    return F.when(count < 0, F.raise_error(F.lit("a centroid can't have a negative count")).cast("array<double>")).when(count == 0, vector).otherwise(moved)


def fold_centroid(centroid: Column, count: Column, total: Column, added: Column) -> Column:
    """The batch form: (c * n + sum of vectors) / (n + k)."""
    return F.zip_with(centroid, total, lambda c, s: (c * count + s) / (count + added))


#: Bytes of centroids that are held beside every task at a time.
HELD_BYTES = 64 << 20
#: Blocks of centroids whose results are put together before the next ones are compared.
TOGETHER = 16


def nearest(items: DataFrame, themes: DataFrame, item: str = "item_id", scope: list[str] | None = None) -> DataFrame:
    """Each item's most similar theme within its scope, ties to the smallest theme id.

    ``items(item, scope.., vector)`` and ``themes(theme_id, scope.., centroid)``. Themes are evaluated once and measured. Blocks of them of
    about HELD_BYTES go to every task, one after the other: a batch of items is one matrix product with a block and
    gives a row's best place in it, so no pairs are made and no vectors are shuffled, however many themes there are. With several blocks, the usual case being one, an
    item's best of each are compared, after partial aggregation.
    """
    scope = scope or []
    known = checkpointed(themes.select("theme_id", *scope, as_double(F.col("centroid")).alias("centroid")))
    size = known.agg(F.coalesce(F.sum(F.size("centroid") * 8 + 64), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, min(size.n, math.ceil(size.bytes / max(HELD_BYTES, 1))))
    ship(items.sparkSession)
    best = None
    for first in range(0, blocks, TOGETHER):
        parts = [] if best is None else [best]
        for block in range(first, min(first + TOGETHER, blocks)):
            rows = known if blocks == 1 else known.where(F.pmod(F.xxhash64("theme_id"), F.lit(blocks)) == block)
            parts.append(_nearest_held(items, rows.collect(), item, scope))
        if blocks == 1:
            return parts[0]
        every = reduce(DataFrame.unionByName, parts)
        order = F.struct(-F.col("similarity"), F.col("theme_id"))
        best = every.groupBy(item, *scope).agg(F.min_by("theme_id", order).alias("theme_id"), F.max("similarity").alias("similarity"))
        best = checkpointed(best) if first + TOGETHER < blocks else best
    return best


def _nearest_held(items: DataFrame, rows: list, item: str, scope: list[str]) -> DataFrame:
    """The same against themes that the driver holds."""
    held: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r.theme_id):
        held.setdefault(tuple(r[c] for c in scope), []).append(r)
    known = {k: ([r.theme_id for r in own], _units(own[0].centroid, [r.centroid for r in own])) for k, own in held.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = batch.groupby(scope, sort=False, dropna=False) if scope else [((), batch)]
            for key, part in parts:
                names, units = known.get(tuple(key), ([], None))
                if not names:
                    continue
                wide = {len(v) for v in part["vector"]} - {units.shape[1]}
                if wide:
                    raise ValueError(f"vectors differ in size: {wide.pop()} and {units.shape[1]}")
                found = np.clip(_units(part["vector"].iloc[0], part["vector"].tolist()) @ units.T, -1.0, 1.0)
                at = found.argmax(axis=1)
                yield part[[item, *scope]].assign(theme_id=[names[i] for i in at], similarity=found[np.arange(len(at)), at])

    own = items.select(item, *scope, as_double(F.col("vector")).alias("vector"))
    fields = [own.schema[c] for c in (item, *scope)]
    return own.mapInPandas(run, T.StructType([*fields, T.StructField("theme_id", T.StringType()), T.StructField("similarity", T.DoubleType())]))


def _units(first, vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(len(vectors), len(first))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
