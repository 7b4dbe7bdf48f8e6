"""Benchmark decontamination: prefix-filtered set join of item windows against document words.

Texts are lower-cased (A-Z) words of digits, letters and characters beyond ASCII. An item's windows
are its runs of ``size`` consecutive words; an item of fewer words, but not none, is one window. A
window occurs in a document only if all its shingles (two words in a row; one word, if that is all) do, so
its necessary prefix is a single shingle: the rarest by document frequency over the whole corpus (ties by
hash). Documents meet windows through that shingle alone; its place in the window then bounds where an
occurrence starts and ends, and every surviving candidate is verified word by word, on hashes and then on
the words themselves. Candidates are drawn up and verified a part at a time, however many windows share a shingle.

The benchmark is the stated query set: it is held in blocks of about BLOCK_WORDS words, and all
documents run against one block at a time, so the size of the benchmark is not limited; with one
block, which is the usual case, documents are scanned twice and nothing is shuffled but counts. With
several, each block writes what it finds, for the documents that hold anything, and that is joined in the end.

Defined cases: null and empty texts have no words, hence no windows and no hits. Items that share an
id count as one; a null id counts as the empty string. Repeated documents are reported alike; an
empty benchmark contaminates nothing; other columns stay with their row in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import saved, small_batches

WINDOW = 10
#: Words of one block of benchmark items.
BLOCK_WORDS = 200_000
_VERIFY = 1 << 16


@dataclass
class Windows:
    """Windows of one block: word hashes, lengths, words, owners; and the entries of prefix tokens."""

    hash: np.ndarray
    length: np.ndarray
    words: list[bytes]
    owners: list[dict[str, None]]
    token: np.ndarray
    entry_ptr: np.ndarray
    entry_window: np.ndarray
    entry_offset: np.ndarray


def _vocabulary(texts: list[str | None]) -> np.ndarray:
    tokens = _text.tokenize(pa.array(texts, pa.string()), _text.ALNUM)
    pairs, alone = _shingles(tokens)
    return np.unique(np.concatenate([pairs[1], tokens.hash[alone]]))


def _shingles(tokens: _text.Tokens) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(where, hash) of two words in a row, and where a row's only word is."""
    at = np.arange(max(0, len(tokens.hash) - 1))
    inside = np.ones(len(at), bool)
    ends = tokens.ptr[1:-1]
    inside[ends[(ends > 0) & (ends <= len(at))] - 1] = False
    at = at[inside]
    return (at, _text.windows(tokens.hash, 2)[at] if len(at) else np.empty(0, np.uint64)), tokens.ptr[:-1][np.diff(tokens.ptr) == 1]


def _words(tokens: _text.Tokens, start: int, end: int) -> bytes:
    return b" ".join(_text.ALNUM.fold[tokens.data[s:e]].tobytes() for s, e in zip(tokens.start[start:end], tokens.end[start:end], strict=True))


def index(items: list[tuple[str, str | None]], frequency: dict[int, int], size: int) -> Windows:
    """Windows of the items, each entered under its rarest shingle."""
    tokens = _text.tokenize(pa.array([t for _, t in items], pa.string()), _text.ALNUM)
    known: dict[bytes, int] = {}
    hashes, lengths, words, owners = [], [], [], []
    for i, (name, _) in enumerate(items):
        first, last = int(tokens.ptr[i]), int(tokens.ptr[i + 1])
        if first == last:
            continue
        length = min(size, last - first)
        for at in range(first, last - length + 1):
            text = _words(tokens, at, at + length)
            number = known.setdefault(text, len(words))
            if number == len(words):
                row = np.zeros(size, np.uint64)
                row[:length] = tokens.hash[at : at + length]
                hashes.append(row)
                lengths.append(length)
                words.append(text)
                owners.append({})
            owners[number][name] = None
    table = np.array(hashes, np.uint64).reshape(len(words), size)
    prefix, offset = np.empty(len(words), np.uint64), np.empty(len(words), np.int64)
    for i, length in enumerate(lengths):
        shingles = _text.windows(table[i, :length], min(2, length)) if length > 1 else table[i, :1]
        at = min(range(len(shingles)), key=lambda j: (frequency.get(int(shingles[j]), 0), int(shingles[j]), j))
        prefix[i], offset[i] = shingles[at], at
    order = np.argsort(prefix, kind="stable")
    token, start = np.unique(prefix[order], return_index=True)
    return Windows(table, np.array(lengths, np.int64), words, owners, token, np.append(start, len(order)), order, offset[order])


def _met(windows: Windows, place: np.ndarray, shingle: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, window) of the candidates that shingles at places of a slice lead to, a bounded part at a time."""
    found = np.minimum(np.searchsorted(windows.token, shingle), len(windows.token) - 1)
    at = np.flatnonzero(windows.token[found] == shingle)
    found, place = found[at], place[at]
    total = np.append(0, np.cumsum(windows.entry_ptr[found + 1] - windows.entry_ptr[found]))
    for a in range(0, int(total[-1]), _VERIFY):
        number = np.arange(a, min(a + _VERIFY, int(total[-1])))
        which = np.searchsorted(total, number, "right") - 1
        entry = windows.entry_ptr[found[which]] + number - total[which]
        yield place[which] - windows.entry_offset[entry], windows.entry_window[entry]


def occurrences(tokens: _text.Tokens, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence among the words of a slice of documents."""
    starts, kinds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(windows.token) and len(tokens.hash):
        pairs, alone = _shingles(tokens)
        single = (windows.length == 1).any()
        every = np.arange(len(tokens.hash))
        steps = np.arange(windows.hash.shape[1])
        for places, shingle in (pairs, (every, tokens.hash)) if single else (pairs,):
            for start, window in _met(windows, places, shingle):
                document = np.searchsorted(tokens.ptr, start, "right") - 1
                inside = (start >= 0) & (start + windows.length[window] <= tokens.ptr[document + 1])
                s, w = start[inside], window[inside]
                place = np.minimum(s[:, None] + steps, len(tokens.hash) - 1)
                same = (tokens.hash[place] == windows.hash[w]) | (steps >= windows.length[w][:, None])
                good = [i for i in np.flatnonzero(same.all(axis=1)) if _words(tokens, int(s[i]), int(s[i] + windows.length[w[i]])) == windows.words[w[i]]]
                starts.append(s[good])
                kinds.append(w[good])
    return np.concatenate(starts), np.concatenate(kinds)


def _covered(spans: list[tuple[int, int]]) -> list[dict]:
    """The union of spans, as disjoint ones in order."""
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _frequencies(docs: DataFrame, vocabulary: np.ndarray, text: str) -> dict[int, int]:
    """Documents that hold each shingle of a block's vocabulary, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in _text.slices(batches, text):
            tokens = _text.tokenize(batch.column(text), _text.ALNUM)
            (place, shingle), _ = _shingles(tokens)
            for where, value in ((place, shingle), (np.arange(len(tokens.hash)), tokens.hash)):
                found = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
                at = np.flatnonzero(vocabulary[found] == value)
                document = np.searchsorted(tokens.ptr, where[at], "right") - 1
                total += np.bincount(np.unique(document * len(vocabulary) + found[at]) % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(_text.signed(vocabulary[some])), pa.array(total[some])], ["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word & 0xFFFFFFFFFFFFFFFF: r.n for r in rows}


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row`` (a document's own columns), n_words, spans of hit words, and the items that occur."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    mass = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("n")).first().n or 0
    blocks = max(1, -(-int(mass) // block_words))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    key = [F.xxhash64(F.coalesce(F.col("row")[text], F.lit(""))).alias("mark"), F.length(F.coalesce(F.col("row")[text], F.lit(""))).alias("size")]
    parts = []
    for block in range(blocks):
        own = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        vocabulary = _vocabulary([t for _, t in own])
        windows = index(sorted(own, key=lambda r: (r[0], r[1] or "")), _frequencies(docs, vocabulary, text) if len(vocabulary) else {}, size)
        found = rows.mapInArrow(_scan(windows, text), rows.schema)
        if blocks == 1:
            return found
        hits = found.where(F.size("spans") > 0).select(*key, "spans", "items").dropDuplicates(["mark", "size"])
        parts.append(saved(hits, "decontamination-block"))
    # what a text holds doesn't depend on whose it is, so texts are known by a hash and their length
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = every.groupBy("mark", "size").agg(_merged(ordered).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = rows.mapInArrow(_scan(index([], {}, size), text), rows.schema).select("row", "n_words", *key)
    return counted.join(merged, ["mark", "size"], "left").select("row", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(spans):
    """Sorted spans as disjoint ones: each takes in the one before it that it touches."""
    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (x["start"] <= last["end"]), grown).otherwise(F.array_append(done, x))

    return F.aggregate(spans, F.array().cast("array<struct<start:long,end:long>>"), add)


def _scan(windows: Windows, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([pc.struct_field(whole.column("row"), text), *whole.columns], ["_text", *whole.schema.names])
            for batch in _text.slices(iter([texts]), "_text"):
                tokens = _text.tokenize(batch.column("_text"), _text.ALNUM)
                start, window = occurrences(tokens, windows)
                document = np.searchsorted(tokens.ptr, start, "right") - 1
                spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                new: dict[int, list[tuple[int, int]]] = {}
                for d, s, w in zip(document.tolist(), start.tolist(), window.tolist(), strict=True):
                    s -= int(tokens.ptr[d])
                    new.setdefault(d, []).append((s, s + int(windows.length[w])))
                    items[d] = {**dict.fromkeys(items[d]), **windows.owners[w]}
                for d, more in new.items():
                    spans[d] = _covered([(x["start"], x["end"]) for x in spans[d]] + more)
                    items[d] = sorted(set(items[d]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(tokens.ptr)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return run


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from ``find``'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return find(docs, benchmark, size).where(F.size("spans") == 0).select("row.*")
