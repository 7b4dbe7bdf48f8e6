"""Repeated passages: a sparse suffix array over content-selected positions.

Words are A-Z lower-cased runs of non-white-space. A passage counts as repeated if it has MIN_WORDS
words or more and occurs more than once anywhere, in one document or in several.

1. Suffixes are retained at minimiser positions only: of each SELECT consecutive ANCHOR-grams the one
   with the least hash (leftmost of equals). ANCHOR + SELECT - 1 = MIN_WORDS, so every window of
   MIN_WORDS words retains a suffix inside itself, chosen by its content alone: two copies of a
   passage retain the same suffixes. Suffixes whose first ANCHOR words nobody else has, by a sort of
   their hashes, go.
2. The others are sorted by the words that follow (the suffix array proper, MIN_WORDS deep) and then by
   those before. Neighbours are compared word for word: equal ones are copies of one passage, and those
   that share ANCHOR words are one group.
3. Within a group matches are extended left and right: for every left extent the members that agree on
   that many words before the anchor, and on enough after it for MIN_WORDS in all, repeat each other.
   The greatest and the least such extent of a suffix bound what it covers, as all its windows hold its
   anchor; what all suffixes cover, put together, is exactly the repeated text. The first occurrence by
   (doc_id, position) stays, all others go.

Both sorts are by range and end in the document and position, so a suffix that a third of all documents
share is spread over many tasks. A group that reaches a task's border, or has more than GROUP unlike
members, is not gathered: of equal windows in a part of it the first is written out, the others are settled there. What is
written out is sorted by 128-bit hashes of its words and compared with its neighbours, which gives the same spans.

Defined cases: null and empty texts have no words and no passages. Rows that repeat id and text are
one document; rows that share an id only are several, in order of a hash of the text. Rows without an
id come first in order. An empty table gives empty results; other columns are kept by ``remove`` and
ignored by ``passages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import saved, small_batches

MIN_WORDS = 50
ANCHOR = 20
#: Members of a group that one task compares by itself, and suffixes that it handles at a time.
GROUP = 1 << 15
CHUNK = 1 << 14
NO_ID = -(2**63)

_PLACE = ["doc_id", "mark", "place"]


def _row_key(key: str, text: str) -> list:
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark")]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id (null: the least long), mark (a hash of the text, for ids that repeat or lack) and text."""
    return docs.select(*_row_key(key, text), F.col(text).alias("text"))


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(hash, doc_id, mark, place) of the retained suffixes: the hash of their first words, and where they start."""
    select = min_words - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            tokens = _text.tokenize(batch.column("text"), _text.SPACED)
            starts = np.arange(max(0, len(tokens.hash) - min_words + 1))
            row = np.searchsorted(tokens.ptr, starts, "right") - 1
            starts = starts[starts + min_words <= tokens.ptr[row + 1]]
            if not len(starts):
                continue
            grams = _text.windows(tokens.hash, anchor)
            least = np.lib.stride_tricks.sliding_window_view(grams, select).argmin(axis=1)
            kept = np.unique(starts + least[starts])
            row = np.searchsorted(tokens.ptr, kept, "right") - 1
            doc, mark = _columns(batch, ["doc_id", "mark"])
            yield pa.RecordBatch.from_arrays([pa.array(_text.signed(grams[kept])), pa.array(doc[row]), pa.array(mark[row]), pa.array((kept - tokens.ptr[row]).astype(np.int64))], ["hash", *_PLACE])

    return docs.mapInArrow(run, "hash long, doc_id long, mark long, place long")


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sort (by.., doc_id, mark, place) and keep places that share ``by`` with a neighbour, ``first`` the first of them.

    Equal rows come from repeated rows of the table, and are one: the range sort brings them to one task.
    Rows at a task's ends are kept as ``edge`` and judged against the neighbouring tasks' ends.
    """
    names, depth = [*by, *_PLACE], len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, opens: bool, closes: bool) -> pa.RecordBatch:
            key = rows[:depth]
            same = (key[:, 1:] == key[:, :-1]).all(axis=0)
            as_before = np.append(before is not None and bool((key[:, 0] == before).all()), same)
            as_after = np.append(same, after is not None and bool((key[:, -1] == after).all()))
            edge = np.zeros(key.shape[1], bool)
            edge[0] |= opens
            edge[-1] |= closes
            keep = np.flatnonzero(as_before | as_after | edge)
            return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in rows), pa.array(~as_before[keep]), pa.array((as_before | as_after)[keep]), pa.array(edge[keep])], [*names, "first", "twin", "edge"])

        held, before, opens = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack(_columns(batch, names))
            own = np.append(held is None or (new[:, 0] != held[:, -1]).any(), (new[:, 1:] != new[:, :-1]).any(axis=0))
            if not own.any():
                continue
            new = new[:, own]
            if held is not None:
                yield judged(held, before, new[:depth, 0], opens, False)
                before, opens = held[:depth, -1], False
            held = new
        if held is not None:
            yield judged(held, before, None, opens, True)

    spread = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    found = saved(spread.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", first boolean, twin boolean, edge boolean"), "neighbours")
    alike = Window.partitionBy(*by)
    edges = found.where("edge").withColumn("n", F.count("*").over(alike)).withColumn("at", F.row_number().over(alike.orderBy(*_PLACE)))
    edges = edges.select(*_PLACE, (F.col("first") & (F.col("at") == 1)).alias("first"), (F.col("twin") | (F.col("n") > 1)).alias("twin")).where("twin")
    return found.where("not edge").select(*_PLACE, "first").unionByName(edges.drop("twin"))


def contexts(docs: DataFrame, hits: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(after, before, doc_id, mark, place): the words from each suffix on and those before it, each word with one space behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            tokens = _text.tokenize(batch.column("text"), _text.SPACED)
            size = tokens.end - tokens.start + 1
            at = np.append(0, np.cumsum(size))
            plain = np.append(_text.SPACED.fold[tokens.data], np.uint8(32))[np.repeat(tokens.start - at[:-1], size) + np.arange(at[-1])]
            plain[at[1:] - 1] = 32
            raw = plain.tobytes()
            places = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(places.value_lengths(), np.int64))
            place = np.asarray(places.flatten(), np.int64)
            word = place + tokens.ptr[row]
            low, high = at[np.maximum(word - (min_words - anchor), tokens.ptr[row])], at[np.minimum(word + min_words, tokens.ptr[row + 1])]
            doc, mark = _columns(batch, ["doc_id", "mark"])
            for a in range(0, len(place), CHUNK):
                part = slice(a, a + CHUNK)
                spans = list(zip(low[part].tolist(), at[word[part]].tolist(), high[part].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([raw[m:h] for _, m, h in spans], pa.binary()), pa.array([raw[x:m] for x, m, _ in spans], pa.binary()), pa.array(doc[row[part]]), pa.array(mark[row[part]]), pa.array(place[part])], ["after", "before", *_PLACE])

    places = hits.groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places"))
    found = docs.join(places, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")
    return found.mapInArrow(run, "after binary, before binary, doc_id long, mark long, place long")


_FOUND = "doc_id long, mark long, start long, end long, removed boolean, one long, two long"


class _Suffixes:
    """Sorted suffixes with the hashes of the words around them, folded outwards from the anchor."""

    def __init__(self, rows: list[tuple], min_words: int, anchor: int, hashes: int = 1):
        self.min_words, self.most = min_words, min_words - anchor
        self.doc, self.mark, self.place, self.group = (np.array(x, np.int64) for x in zip(*((r[2], r[3], r[4], r[5]) for r in rows), strict=True))
        after, before = (_text.tokenize(pa.array([r[i] for r in rows], pa.binary()), _text.RAW) for i in (0, 1))
        self.right, self.left = np.diff(after.ptr), np.diff(before.ptr)
        n, steps = len(rows), np.arange(1, self.most + 1)
        self.ahead, self.behind = np.zeros((2, hashes, n, self.most + 1), np.uint64)
        word = lambda t, at, ok: np.where(ok, t.hash[np.minimum(at, max(0, len(t.hash) - 1))] if len(t.hash) else np.uint64(0), np.uint64(0))
        first = word(after, after.ptr[:-1, None] + np.arange(anchor), np.ones((n, anchor), bool))
        on = word(after, after.ptr[:-1, None] + anchor - 1 + steps, self.right[:, None] >= anchor + steps)
        back = word(before, np.maximum(before.ptr[1:, None] - steps, 0), self.left[:, None] >= steps)
        for h, salt in enumerate(_SALTS[:hashes]):
            for j in range(anchor):
                self.ahead[h, :, 0] = _text.mix(self.ahead[h, :, 0] * salt + first[:, j])
            for j in range(self.most):
                self.ahead[h, :, j + 1] = _text.mix(self.ahead[h, :, j] * salt + on[:, j])
                self.behind[h, :, j + 1] = _text.mix(self.behind[h, :, j] * salt + back[:, j])

    def fits(self, extent: int) -> np.ndarray:
        """Suffixes with a window that starts ``extent`` words before them."""
        return np.flatnonzero((self.left >= extent) & (self.right >= self.min_words - extent))

    def window(self, extent: int, rows: np.ndarray, h: int) -> np.ndarray:
        return _text.mix(self.behind[h, rows, extent] * _SALTS[h] + self.ahead[h, rows, self.most - extent] + np.uint64(extent))

    def compare(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each extent, (extent, rows, hashes) of its different windows, each at its first occurrence; ``spans`` then has the rest."""
        n = len(self.place)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.place, self.mark, self.doc))] = np.arange(n)
        self.widest, self.least = np.full((2, n), -1), np.full((2, n), self.most + 1)
        for extent in range(self.most + 1):
            rows = self.fits(extent)
            if not len(rows):
                continue
            own = [self.window(extent, rows, h) for h in range(len(self.ahead))]
            key = np.stack([_text.mix(own[0] + self.group[rows].astype(np.uint64)), *own[1:]])
            order = np.lexsort((rank[rows], *key))
            rows, key = rows[order], key[:, order]
            first = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
            size = np.diff(np.append(np.flatnonzero(first), len(rows)))
            twin = np.repeat(size > 1, size)
            for kind, hit in enumerate((rows[twin], rows[twin & ~first])):
                self.widest[kind, hit] = extent
                self.least[kind, hit] = np.minimum(self.least[kind, hit], extent)
            yield extent, rows[first], np.stack(own)[:, order[first]]

    def spans(self) -> Iterator[tuple]:
        """What members repeat of each other: (row, start, end, removed)."""
        for kind in (0, 1):
            rows = np.flatnonzero(self.widest[kind] >= 0)
            yield rows, self.place[rows] - self.widest[kind, rows], self.place[rows] - self.least[kind, rows] + self.min_words, bool(kind)


_SALTS = (np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F))


def _extended(min_words: int, anchor: int):
    """Suffixes sorted by the words after and before -> spans that repeat, and windows of groups that go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # unlike members of groups that are not settled yet
        last, head, group, unsettled = None, b"", -1, True  # unsettled: the group reaches back beyond what is held

        def out(doc, mark, start, end, removed, one=None, two=None) -> pa.RecordBatch:
            n = len(doc)
            hashes = [pa.nulls(n, pa.int64()) if x is None else pa.array(_text.signed(x)) for x in (one, two)]
            return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (doc, mark, start, end)), pa.array(np.full(n, removed)), *hashes], ["doc_id", "mark", "start", "end", "removed", "one", "two"])

        def windows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), CHUNK):
                found = _Suffixes(rows[a : a + CHUNK], min_words, anchor, 2)
                for extent, at, (one, two) in found.compare():
                    start = found.place[at] - extent
                    yield out(found.doc[at], found.mark[at], start, start + min_words, False, one, two)
                for at, start, end, removed in found.spans():
                    yield out(found.doc[at], found.mark[at], start, end, removed)

        def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                found = _Suffixes(rows, min_words, anchor)
                for _ in found.compare():
                    pass
                for at, start, end, removed in found.spans():
                    yield out(found.doc[at], found.mark[at], start, end, removed)

        def split(rows: list[tuple], ended: bool) -> Iterator[pa.RecordBatch]:
            """Settle all groups but the last, which may go on; that one too, by its windows, if it is too large or at the task's end."""
            nonlocal held, unsettled
            a = next((i for i, r in enumerate(rows) if r[5] != rows[0][5]), len(rows)) if unsettled else 0
            b = next((i for i in range(len(rows), a, -1) if rows[i - 1][5] != rows[-1][5]), a)
            yield from windows(rows[:a])
            if a == len(rows):
                held = []
                return
            yield from settle(rows[a:b])
            held, unsettled = rows[b:], False
            if ended or len(held) > GROUP:
                yield from windows(held)
                held, unsettled = [], True

        for batch in batches:
            after, before = batch.column("after").to_pylist(), batch.column("before").to_pylist()
            copies: list[tuple] = []
            for row in zip(after, before, *(batch.column(c).to_pylist() for c in _PLACE), strict=True):
                if last is not None and row[:2] == last[:2]:
                    if row != last[:5]:
                        if not last[5]:  # the first of its copies repeats as well
                            copies.append((*last[:5], False))
                        copies.append((*row, True))
                        last = (*row, True)
                    continue
                if last is None or not row[0].startswith(head):
                    head, group = _head(row[0], anchor), group + 1
                held.append((*row, group))
                last = (*row, False)
            for removed in (False, True):
                rows = [r for r in copies if r[5] is removed]
                if rows:
                    yield out([r[2] for r in rows], [r[3] for r in rows], [r[4] - r[1].count(b" ") for r in rows], [r[4] + r[0].count(b" ") for r in rows], removed)
            if len(held) >= CHUNK:
                yield from split(held, False)
        if held:
            yield from split(held, True)

    return run


def _head(after: bytes, anchor: int) -> bytes:
    """The first ``anchor`` words of a suffix, with the space behind each."""
    at = 0
    for _ in range(anchor):
        at = after.index(b" ", at) + 1
    return after[:at]


def _union(spans):
    """Disjoint spans in order that cover what ``spans`` (start, end) cover."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def add(state, x):
        grown = F.struct(state["start"].alias("start"), F.greatest(state["end"], x["end"]).alias("end"), state["done"].alias("done"))
        closed = F.when(state["end"] >= 0, F.array_append(state["done"], F.struct(state["start"].alias("start"), state["end"].alias("end")))).otherwise(state["done"])
        return F.when((state["end"] >= 0) & (x["start"] <= state["end"]), grown).otherwise(F.struct(x["start"].alias("start"), x["end"].alias("end"), closed.alias("done")))

    start = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), empty.alias("done"))
    last = lambda s: F.when(s["end"] >= 0, F.array_append(s["done"], F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(s["done"])
    return F.aggregate(F.array_sort(spans), start, add, last)


def passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, repeated, removed): spans of words, for documents that hold a repeated passage."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, key, text)
    hits = repeated(saved(anchors(keyed, min_words, anchor), "anchors"), ["hash"])
    around = saved(contexts(keyed, hits, min_words, anchor), "suffixes")
    order = ["after", "before", *_PLACE]
    found = saved(around.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_extended(min_words, anchor), _FOUND), "matches")
    rest = found.where("one is not null").select("one", "two", "doc_id", "mark", F.col("start").alias("place"))
    twins = repeated(rest, ["one", "two"]).select("doc_id", "mark", F.col("place").alias("start"), (F.col("place") + min_words).alias("end"), (~F.col("first")).alias("removed"))
    spans = found.where("one is null").select("doc_id", "mark", "start", "end", "removed").unionByName(twins)
    gathered = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end", "removed")).alias("spans"))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return gathered.select("doc_id", "mark", _union(plain(F.col("spans"))).alias("repeated"), _union(plain(F.filter("spans", lambda x: x["removed"]))).alias("removed"))


def summary(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For every row: doc_id, n_words, n_repeated (words in repeated passages), n_removed (those not the first)."""
    total = lambda spans: F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0).cast("long"))
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = _keyed(docs, "doc_id", "text").select("doc_id", "mark", words.alias("n_words"))
    out = rows.join(passages(docs, min_words), ["doc_id", "mark"], "left")
    null_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return out.select(null_id.alias("doc_id"), "n_words", total(F.col("repeated")).alias("n_repeated"), total(F.col("removed")).alias("n_removed"))


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` whose texts lack all but the first occurrence of repeated passages.

    ``n_chars``, where there is one, follows the new text. A document of which no word is left goes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches, "_text"):
            texts, spans = batch.column("_text").to_pylist(), batch.column("_removed").to_pylist()
            keep = []
            tokens = _text.tokenize(batch.column("_text"), _text.SPACED)
            for i, gone in enumerate(spans):
                if gone:
                    first, last = int(tokens.ptr[i]), int(tokens.ptr[i + 1])
                    stay = np.ones(last - first, bool)
                    for span in gone:
                        stay[span["start"] : span["end"]] = False
                    if not stay.any():
                        continue
                    begin = np.append(tokens.start[first:last], tokens.row[i + 1])
                    pieces = [tokens.data[tokens.row[i] : begin[0]]]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], stay.view(np.int8), [0]))))
                    pieces += [tokens.data[begin[a] : begin[b]] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    texts[i] = b"".join(x.tobytes() for x in pieces).decode("utf-8").rstrip(" \t\n\v\f\r")
                keep.append(i)
            index = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(index), pa.array([texts[i] for i in keep], pa.string())], ["_row", "_text"])

    other = [F.col("_row")[c].alias(c) for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"), *_row_key("doc_id", "text"))
    joined = keyed.join(passages(docs, min_words).withColumnRenamed("removed", "_removed"), ["doc_id", "mark"], "left")
    body = joined.select(F.struct(*other).alias("_row"), "_text", "_removed")
    fixed = body.mapInArrow(cut, T.StructType([body.schema["_row"], body.schema["_text"]]))
    own = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text").cast("long"), F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return fixed.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if own.get(c) is not None else F.col("_row")[c].alias(c) for c in docs.columns])
