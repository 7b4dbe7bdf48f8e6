"""Document fingerprints by winnowing, in native expressions throughout.

Every run of GRAM characters (code points) of a text is a gram. Gram hashes roll over the text in two steps,
each sharing its work among overlapping grams: four characters give one hash at every place, and four of those,
four places apart, give a gram's. Of every WINDOW consecutive gram hashes the least is chosen, the rightmost of
equals, and kept once with its position; hashes beyond the leasts that windows share go first, the others that no window can choose in passes, and the rest are the choices.
Two texts that share a run of GRAM + WINDOW - 1 characters share a fingerprint for certain, whatever stands before it, and runs shorter than GRAM never count. A text of fewer characters than GRAM is one gram; one with
fewer grams than WINDOW is one window.

Texts go in pieces of PIECE windows, which overlap by a window, so arrays stay small however long a text is. In
a piece a hash (50 bits) and its place (inverted) are packed into one long, so that the least of a window is the
least hash at its rightmost place; what is kept is the hash and the position in the text, a long each. Likeness
is the share of common hashes among all hashes of two fingerprints, 1 for two empty ones.

An edited text that is one text's beginning and another's shares their windows: as choices never go
back, those of the windows within a beginning are the text's own up to the last such window's choice.
Only windows across the joint are worked out anew.

Texts are not gathered: a document meets its successor within a bucket of neighbouring ids, whose bounds
are approximate quantiles, and a bucket's last document meets the head of the next bucket. An id that fills more than
one bucket (or no id) is split by a hash of the text.

Defined cases: a null text is empty, and an empty text has an empty fingerprint. Documents are ordered by
doc_id (null first) and by a hash of the text among equal ids; the last one's successor is the first. Repeated
rows have equal fingerprints. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 16
WINDOW = 64
#: Windows that start within so many places, a power of two and at most WINDOW, share what bounds their choices.
BLOCK = 32
#: Windows of one piece of a text, and the bits that hold a place in it.
PIECE = 1 << 12
_PLACES = 13
_LAST = (1 << _PLACES) - 1
_HASH = ((1 << 50) - 1) << _PLACES
#: Characters of one window.
SPAN = GRAM + WINDOW - 1
#: Documents of one bucket, and the most buckets; their bounds are held by the driver.
BUCKET_ROWS = 512
MAX_BUCKETS = 1 << 16

PRINTS = "array<struct<hash:long,at:long>>"


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rolled(values: Column, join) -> Column:
    """At every place ``join`` of four values from there on; null past the end."""
    return F.transform(values, lambda x, i: join(x, *[F.get(values, i + j) for j in (1, 2, 3)]))


def _low(grams: Column) -> Column:
    """The packed hashes, of more than WINDOW, that a window may choose, by one comparison each: about one in eighteen, all choices among them.

    Windows that start within the same BLOCK places share the places from the block's last start to its first window's end, so none of them chooses more than
    the least hash there. A place lies in windows of its own block and of the two before.
    """
    block = lambda at: F.shiftright(at, BLOCK.bit_length() - 1)
    shared = F.transform(F.sequence(F.lit(0), block(F.size(grams) - 1)), lambda b: F.array_min(F.slice(grams, b * BLOCK + BLOCK, F.lit(WINDOW - BLOCK + 1))))
    bounds = lambda least: F.transform(least, lambda x, b: F.greatest(x, *[F.get(least, b - n) for n in range(1, (WINDOW - 1) // BLOCK + 2)]))
    return _let(shared, lambda least: _let(bounds(least), lambda most: F.filter(grams, lambda x, i: x <= F.get(most, block(i)))))


def _least(grams: Column) -> Column:
    """The least of every window of packed hashes, each once, in order of place.

    Of the low ones, a hash goes if a lesser one lies before it and another behind it, or the end, and no window fits between them; no window chooses it. Hashes
    between two choices that follow each other are greater than both, so they go in passes, of which every one takes the greatest; there are WINDOW - 1 at most.
    """
    end = F.lit(_LAST) - F.size(grams)

    def thinner(xs: Column) -> Column:
        apart = lambda i: F.coalesce(F.get(xs, i - 1).bitwiseAND(_LAST), F.lit(_LAST + 1)) - F.coalesce(F.get(xs, i + 1).bitwiseAND(_LAST), end)
        return F.filter(xs, lambda x, i: (x < F.get(xs, i - 1)) | (x < F.get(xs, i + 1)) | (apart(i) > WINDOW))

    step = lambda s: _let(thinner(s["xs"]), lambda ys: F.struct(ys.alias("xs"), (F.size(ys) == F.size(s["xs"])).alias("done")))
    passes = F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), F.struct(_low(grams).alias("xs"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(step(s)), lambda s: s["xs"])
    return F.when(F.size(grams) <= WINDOW, F.array(F.array_min(grams))).otherwise(passes)


def _chosen(piece: Column) -> Column:
    """The packed (hash, place) pairs that winnowing chooses in a piece, in order of place."""

    def packed(fours):
        grams = F.greatest(F.size(fours) - (GRAM - 1), F.lit(1))
        starts = F.slice(fours, 1, grams)
        value = lambda x, i: F.xxhash64(x, *[F.get(fours, i + j) for j in (4, 8, 12)])
        return F.transform(starts, lambda x, i: value(x, i).bitwiseAND(_HASH).bitwiseOR(F.lit(_LAST) - i))

    return _let(F.split(piece, ""), lambda cs: _let(_rolled(cs, F.xxhash64), lambda fours: _let(packed(fours), _least)))


def _onward(prints: Column) -> Column:
    """Prints in order of position, each position once."""
    return F.filter(prints, lambda x, i: (i == 0) | (x["at"] > F.get(prints, i - 1)["at"]))


def fingerprint(text: Column) -> Column:
    """The (hash, at) pairs that winnowing chooses, in order of position."""
    windows = F.greatest(F.length(text) - (SPAN - 1), F.lit(1))
    pieces = F.sequence(F.lit(0), F.floor((windows - 1) / PIECE).cast("int"))

    def prints(number):
        piece = F.substring(text, number * PIECE + 1, F.lit(PIECE + SPAN - 1))
        place = lambda x: F.lit(_LAST) - x.bitwiseAND(_LAST) + number.cast("long") * PIECE
        return F.transform(_chosen(piece), lambda x: F.struct(F.shiftright(x, _PLACES).alias("hash"), place(x).alias("at")))

    found = F.when(windows <= PIECE, prints(F.lit(0))).otherwise(_let(F.flatten(F.transform(pieces, prints)), _onward))
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast(PRINTS))


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: x["hash"]))


def positions(prints: Column) -> Column:
    """Positions of the chosen grams, in characters."""
    return F.transform(prints, lambda x: x["at"])


def shown(prints: Column) -> Column:
    """A fingerprint as text: ``hash@position`` for each chosen gram."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.hex(x["hash"]), F.lit("@"), x["at"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Common hashes as a share of all, for two distinct hash arrays."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``prints``: each row's fingerprint. One scan, no shuffle."""
    return docs.withColumn("prints", fingerprint(F.coalesce(F.col(text), F.lit(""))))


def _shifted(prints: Column, by: Column) -> Column:
    return _let(by, lambda more: F.transform(prints, lambda x: F.struct(x["hash"].alias("hash"), (x["at"] + more).alias("at"))))


def _within(prints: Column, size: Column) -> Column:
    """The prints that the windows within the first ``size`` characters of a text choose.

    The last such window's choice is the least print in it, the rightmost of equals, and no window before it chooses beyond that. The size is evaluated once,
    not for each print: it comes of a text's length, which is counted through the whole text.
    """

    def kept(last: Column) -> Column:
        inside = F.filter(prints, lambda x: x["at"].between(last, last + WINDOW - 1))
        choice = -F.array_min(F.transform(inside, lambda x: F.struct(x["hash"].alias("hash"), (-x["at"]).alias("back"))))["back"]
        return F.when(last >= 0, _let(choice, lambda most: F.filter(prints, lambda x: x["at"] <= most))).otherwise(F.array().cast(PRINTS))

    return _let((size - SPAN).cast("long"), kept)


def joined(first: Column, first_prints: Column, size: Column, second: Column, second_prints: Column, more: Column) -> Column:
    """The fingerprint of a text of the first ``size`` characters of one and the first ``more`` of another text."""
    start = F.greatest(size - SPAN + 1, F.lit(0))  # the first window that leaves the first text
    own = F.substring(first, start + 1, size - start)
    across = F.concat(own, F.left(second, F.when(more >= SPAN, F.lit(SPAN - 1)).otherwise(more)))
    fresh = F.when((start > 0) & (F.length(across) < SPAN), F.array().cast(PRINTS)).otherwise(_shifted(fingerprint(across), start.cast("long")))
    return _let(F.concat(_within(first_prints, size), fresh, _shifted(_within(second_prints, more), size.cast("long"))), _onward)


def _bucket(key: Column, mark: Column, cuts: list[int]) -> Column:
    """How many distinct cuts lie below a key, by binary search in a literal array, and a part for keys that are several cuts."""
    if not cuts:
        return F.lit(0).cast("long")
    times = Counter(cuts)
    bounds = sorted(times)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    table, many = F.lit(bounds), F.lit([times[b] for b in bounds])
    take = lambda low, step: F.when((low + step <= len(bounds)) & (F.get(table, low + step - 1) < key), low + step).otherwise(low)
    part = lambda b: F.when((F.get(table, b) == key) & (F.get(many, b) > 1), F.floor((mark / F.lit(2.0**64) + 0.5) * F.get(many, b)).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return _let(F.aggregate(F.lit(steps), F.lit(0), take), lambda b: F.shiftleft(b.cast("long"), 20) + part(b))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, beside those of its edited text and of its successor.

    The edited text ends in the successor's beginning: its last floor(n/2) code points give way to the
    first as many of the successor, or all of them.
    """
    own = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    said = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), own.alias("place"), F.xxhash64(said).alias("mark"), said.alias("text"))
    ids = docs.select(own.alias("place"))
    number = min(MAX_BUCKETS, ids.count() // BUCKET_ROWS + 1)
    cuts = []
    if number > 1:
        cuts = ids.agg(F.percentile_approx("place", [i / number for i in range(1, number)], max(10_000, 4 * number)).alias("at")).first().at
    placed = rows.withColumn("bucket", _bucket(F.col("place"), F.col("mark"), cuts))

    first = placed.select("bucket", "place", "mark").groupBy("bucket").agg(F.min(F.struct("place", "mark")).alias("head"))
    in_order = Window.orderBy("bucket")
    after = first.select("bucket", F.coalesce(F.lead("head").over(in_order), F.first("head").over(in_order)).alias("head")).select("bucket", "head.*")
    # one row a bucket, twice MAX_BUCKETS at most
    heads = rows.join(F.broadcast(after), ["place", "mark"]).groupBy("bucket").agg(F.min("text").alias("head_text")).withColumnRenamed("bucket", "of")

    near = placed.repartition("bucket").withColumn("prints", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("place", "mark", "text")
    led = near.withColumn("next_text", F.lead("text").over(order)).withColumn("next_prints", F.lead("prints").over(order))
    met = led.join(heads, (F.col("bucket") == F.col("of")) & F.col("next_text").isNull(), "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    found = met.select("doc_id", "text", "prints", n.alias("n"), half.alias("half"), F.coalesce("next_text", "head_text").alias("after"), F.coalesce(F.col("next_prints"), fingerprint(F.col("head_text"))).alias("next_prints"))
    kept, taken = F.col("n") - F.col("half"), F.least("half", F.length("after"))
    edited = F.concat(F.left("text", kept), F.left("after", F.col("half")))
    prints = joined(F.col("text"), F.col("prints"), kept, F.col("after"), F.col("next_prints"), taken)
    return found.select("doc_id", F.col("n").cast("long").alias("n_chars"), "prints", "next_prints", edited.alias("edited"), prints.alias("edited_prints"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    found = compared(docs)
    own = hashes(F.col("prints"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("prints")).alias("fingerprint"), shown(F.col("edited_prints")).alias("edited_fingerprint"), likeness(own, hashes(F.col("edited_prints"))).alias("near_edited"), likeness(own, hashes(F.col("next_prints"))).alias("near_next")
    )
