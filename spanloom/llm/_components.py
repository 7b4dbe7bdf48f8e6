"""Connected components of an edge table, with no state on the driver and lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved

#: A node with more than this share of all rows is a hub; there are at most this many.
HUBS = 500


def with_least(rows: DataFrame, key: str, other: str, count: int | None = None) -> DataFrame:
    """``rows`` (``count`` of them, counted where it isn't given) with ``root``, the least of ``other`` among the rows of a row's ``key``.

    The least is an aggregate, combined before the shuffle, and is joined back. A hub's rows would all meet
    it in one task, so hubs, of which there are HUBS at most, are broadcast, and their rows stay where they are.
    """
    count = rows.count() if count is None else count
    least = rows.groupBy(key).agg(F.min(other).alias("root"), F.count("*").alias("degree"))
    hubs = least.where(F.col("degree") > count // HUBS).select(key, F.col("root").alias("hub_root"))
    met = rows.join(F.broadcast(hubs), key, "left")
    rest = met.where("hub_root is null").drop("hub_root").join(least.select(key, "root"), key)
    return met.where("hub_root is not null").withColumnRenamed("hub_root", "root").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``: the smallest node reachable, for every node named.

    Alternates large-star and small-star rewrites (Kiveris et al., 2014): every round links each
    node's greater neighbours, then its smaller ones, to the least of its neighbourhood, so hubs
    shrink to stars in about a logarithmic number of rounds. Neighbourhoods are never gathered, and
    what a round makes is written before the next one reads it.
    """
    pairs = saved(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    sums = _sums(pairs)
    while sums[0]:
        both = pairs.select(F.explode(F.array(F.struct(F.col("lo").alias("n"), F.col("hi").alias("m")), F.struct(F.col("hi").alias("n"), F.col("lo").alias("m")))).alias("x")).select("x.*")
        large = with_least(both, "n", "m", 2 * sums[0]).where("m > n").select(F.least("root", "n").alias("lo"), F.col("m").alias("hi")).distinct()
        small = with_least(large, "hi", "lo", sums[0])
        links = F.explode(F.array(F.struct("root", F.col("lo").alias("other")), F.struct("root", F.col("hi").alias("other"))))
        pairs = saved(small.select(links.alias("x")).select(F.col("x.root").alias("lo"), F.col("x.other").alias("hi")).where("lo <> hi").distinct(), "stars")
        before, sums = sums, _sums(pairs)
        if before == sums:
            break
    nodes = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _sums(pairs: DataFrame) -> tuple:
    """How many pairs there are, and an order-free sum over them that tells tables apart."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
