"""Merkle manifest of a dataset: concatenated-level strings.

Every row is a leaf, the digest of its fields, each written with its length so that no two rows read alike. Leaves of a
group (a language) ascend by id; while a level holds several nodes, each run of ``fan_out`` consecutive ones, the last
of which may be shorter, becomes the digest of its members' hex text. What remains is the group's root, and the groups'
roots, in order of their names, make the root of the dataset in the same way.

A group is dealt to aligned blocks of BLOCK nodes (the power of ``fan_out`` next below), and a block keeps each of its levels
as *one* hex string: a parent is the digest of a fixed-width substring, and a node's siblings in its run are the
substrings that flank it. The roots of the blocks are the nodes of the next round, which works alike, so a tree of n leaves takes
log(n) / log(BLOCK) rounds and no row ever holds more than a block. Rounds that go down again hand each block the
sibling segments above it. Level strings are kept as binary columns: a substring of bytes costs what it holds, one of
characters what stands before it.

Positions come from a range sort by group and id with counts of each range added up, so no group passes through one task:
a group that holds most rows is many ranges and many blocks. Texts aren't shuffled: leaves are made where rows are read.

Defined cases: a null field counts as ``-``, unlike an empty one. Null groups and ids come first. Rows that share group and id
are ordered by their leaves; equal rows are leaves of their own, with proofs of their own place. An empty table has no leaf and no root. Columns
that are not named are no part of a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: Most nodes of a block: 64 KB of hex text in its widest level.
BLOCK = 1024
#: Hex digits of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of the fields, in their order: ``-`` for null, else byte count, colon and value."""
    text = [c.cast("string") for c in fields.values()]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(grp, ..)`` with ``pos``, a row's place in its group by ``order``, and ``n``, the group's size.

    Ranges are written with each row's number in them; how many rows of the group earlier ranges hold is added up over (range, group).
    """
    dealt = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    number = F.monotonically_increasing_id()
    dealt = saved(dealt.withColumn("range", F.shiftright(number, 33)).withColumn("number", number), "merkle-ranges")
    held = dealt.groupBy("range", "grp").agg(F.min("number").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    offsets = held.select("range", "grp", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("offset"), F.sum("held").over(whole).alias("n"))
    return dealt.join(offsets, ["range", "grp"]).withColumn("pos", F.col("number") + F.col("offset")).drop("range", "number", "offset")


def _size(fan_out: int) -> tuple[int, int]:
    """(levels of a block, nodes of a block)."""
    levels = 1
    while fan_out ** (levels + 1) <= BLOCK:
        levels += 1
    return levels, fan_out**levels


def _part(level: Column, first: Column, count: Column) -> Column:
    """``count`` nodes of a level string from node ``first`` (0 is the first); fewer where the string ends."""
    return F.substring(level, (first * WIDTH + 1).cast("int"), F.greatest(count * WIDTH, F.lit(0)).cast("int"))


def _parents(level: Column, fan_out: int) -> Column:
    runs = F.ceil(F.length(level) / (WIDTH * fan_out)).cast("int")
    made = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(_part(level, i * fan_out, F.lit(fan_out)), 256))
    return F.array_join(made, "").cast("binary")


def _levels(nodes: Column, n: Column, fan_out: int) -> Column:
    """All level strings of a block, the lowest first; a block of a larger tree goes up all its levels, a whole tree to one node."""
    levels, size = _size(fan_out)
    lowest = F.array_join(nodes, "").cast("binary")
    top = lambda made: F.element_at(made, -1)
    more = lambda made: (n > size) | (F.length(top(made)) > WIDTH)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(lowest), lambda made, _: F.when(more(made), F.concat(made, F.array(_parents(top(made), fan_out)))).otherwise(made))


def _flanks(levels: Column, pos: Column, fan_out: int) -> Column:
    """For the node at ``pos`` of a block, level by level, what stands left and right of it in its run."""

    def of(level: Column, depth: Column) -> Column:
        own = F.floor(pos / F.pow(F.lit(float(fan_out)), depth)).cast("int")
        start = own - own % fan_out
        return F.struct(_part(level, start, own - start).cast("string").alias("left"), _part(level, own + 1, start + (fan_out - 1) - own).cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), of)


def _top() -> Column:
    return F.element_at("levels", -1).cast("string")


def rounds(nodes: DataFrame, fan_out: int = 2) -> list[DataFrame]:
    """Blocks (grp, block, n, nodes, levels) of each round over ``nodes(grp, pos, n, node, ..)``.

    ``grp`` is not null, ``pos`` counts from 0, ``n`` is the group's size. A group leaves the rounds with the one where a single block holds it.
    """
    levels, size = _size(fan_out)
    found, rest = [], nodes
    while True:
        kept = [c for c in rest.columns if c not in ("grp", "pos", "n")]
        own = F.struct((F.col("pos") % size).cast("int").alias("pos"), *kept)
        blocks = rest.groupBy("grp", F.floor(F.col("pos") / size).alias("block"), "n").agg(F.array_sort(F.collect_list(own)).alias("nodes"))
        made = saved(blocks.withColumn("levels", _levels(F.transform("nodes", lambda x: x["node"]), F.col("n"), fan_out)), "merkle-blocks")
        found.append(made)
        rest = made.where(F.col("n") > size).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), _top().alias("node"))
        if rest.isEmpty():
            return found


_PATH = "array<struct<left:string,right:string>>"


def roots(found: list[DataFrame], fan_out: int = 2) -> DataFrame:
    """(grp, root) of every group."""
    done = [made.where(F.col("n") <= _size(fan_out)[1]).select("grp", _top().alias("root")) for made in found]
    return reduce(DataFrame.unionByName, done)


def paths(found: list[DataFrame], fan_out: int = 2, above: DataFrame | None = None) -> DataFrame:
    """The nodes of the first round, (grp, x, path, root): ``path`` holds the flanks (left, right) from a node up to its group's root.

    With ``above(grp, path, ..)`` it goes on along that path, and a node takes the other columns of ``above`` in place of ``root``.
    """
    size = _size(fan_out)[1]
    carried = ["root"] if above is None else [c for c in above.columns if c not in ("grp", "path")]
    upper, out = None, None
    for made in reversed(found):
        whole = made.where(F.col("n") <= size)
        if above is None:
            whole = whole.withColumns({"up": F.array().cast(_PATH), "root": _top()})
        else:
            whole = whole.join(above.withColumnRenamed("path", "up"), "grp")
        part = made.where(F.col("n") > size)
        blocks = whole if upper is None else whole.unionByName(part.join(upper, ["grp", "block"]))
        # paths are made inside the array, so that the level strings are not copied to each of its rows
        with_path = F.transform("nodes", lambda x: F.struct(x.alias("x"), F.concat(_flanks(F.col("levels"), x["pos"], fan_out), F.col("up")).alias("path")))
        out = blocks.select("grp", "block", *carried, F.explode(with_path).alias("of")).select("grp", "block", "of.x", "of.path", *carried)
        upper = out.select("grp", (F.col("block") * size + F.col("x.pos")).alias("block"), F.col("path").alias("up"), *carried)
    return out.select("grp", "x", "path", *carried)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the flanks of its path lead to."""
    return F.aggregate(path, node, lambda own, run: digest(F.concat(run["left"], own, run["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, each level from left to right."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, fan_out: int = 2) -> DataFrame:
    """(key, group, leaf, subroot, root, path, tampered_leaf) of every row of ``docs``; ``path`` leads from the leaf through its subroot to the root.

    ``tampered`` replaces fields in a second leaf, which is null where it is the same.
    """
    named = {f: F.col(f"`{f}`") for f in fields}
    own, other = leaf(named), leaf(named | (tampered or {}))
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null comes before any name
    rows = docs.select(name.alias("grp"), named[key].alias("key") if key in named else F.col(f"`{key}`").alias("key"), own.alias("node"), F.nullif(other, own).alias("tampered_leaf") if tampered else F.lit(None).cast("string").alias("tampered_leaf"))
    leaves = rounds(_ranked(rows, ["key", "node"]), fan_out)
    subroots = saved(roots(leaves, fan_out), "merkle-roots")
    tops = rounds(_ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node")), ["name"]), fan_out)
    above = paths(tops, fan_out).select(F.col("x.name").alias("grp"), "path", F.col("x.node").alias("subroot"), "root")
    found = paths(leaves, fan_out, above)
    named_group = F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1))
    return found.select(F.col("x.key").alias(key), named_group.alias(group), F.col("x.node").alias("leaf"), "subroot", "root", "path", F.col("x.tampered_leaf").alias("tampered_leaf"))


def verified(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The manifest's rows as digests: proof_sha256, and the root that the row as found now leads to."""
    again = folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    out = found.select(key, "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def summary(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked after one was added to ``n_chars`` where 7 divides the CRC-32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return verified(manifest(docs, tampered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))
