"""Token counts: unigram segmentation, with one forward pass over a trie of distinct pre-tokens.

A pre-token is a run of non-white-space with the word-start mark before it. Its best segmentation is
the one of the greatest sum of piece scores; a character that no piece covers falls back to its UTF-8
bytes. The best score of a prefix depends on that prefix alone, so all pre-tokens go into a trie and
the forward step (best score and its token count) runs once for each node: once for each prefix that
any number of pre-tokens share. Terminal nodes store the counts, which documents then add up.

The trie is built level by level from the sorted pre-tokens of a slice: nodes are the distinct
prefixes of a length, so numpy steps all nodes of a level together. Counts of pre-tokens met so far are
kept for the partition, in a table of bounded size that is started afresh when full.

The vocabulary file is a parameter and is opened where the work runs. Scores: ``"rank"`` gives a piece
of rank r in the file the score -ln(r + 1), as in Zipf's law; ``"file"`` takes the file's own scores.
Equal scores take the segmentation whose last piece is the longer.

Defined cases: null and empty texts have no tokens. No Unicode normalisation is applied; the text is
taken as it stands. Repeated rows count alike, an empty table gives an empty result, and other columns
stay with their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._spark import small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 1 << 18
#: Pre-tokens beyond this many characters run by themselves, so that levels stay wide.
LONG = 64


class Unigram:
    """Pieces by length, as sorted hashes with scores."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        self.width = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.tables = []
        for length in range(1, self.width + 1):
            own = [p for p in self.score if len(p) == length]
            chars = np.array([list(map(ord, p)) for p in own], np.uint64).reshape(len(own), length)
            total = np.zeros(len(own), np.uint64)
            for j in range(length):
                total = total * _BASE + _spread(chars[:, j])
            order = np.argsort(total)
            self.tables.append((total[order], np.array([self.score[own[i]] for i in order], np.float64)))

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (with its mark), by one forward pass over their trie."""
        out = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=words.__getitem__)
        short = [i for i in order if len(words[i]) <= LONG]
        if short:
            out[short] = self._trie([words[i] for i in short])
        for i in order:
            if len(words[i]) > LONG:
                out[i] = self._trie([words[i]])[0]
        return out

    def _trie(self, words: list[str]) -> np.ndarray:
        """Sorted words -> counts at their terminal nodes."""
        n = len(words)
        size = np.array(list(map(len, words)), np.int64)
        depth = int(size.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.zeros((n, depth), np.uint32)
        chars[np.arange(depth) < size[:, None]] = flat
        # levels[d]: for the nodes at depth d, the parent's number, the prefix hash, best score and count
        hashes, best, count, parents = [np.zeros(1, np.uint64)], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        node = np.zeros(n, np.int64)
        live = np.arange(n)
        power = [np.uint64(pow(int(_BASE), j, 1 << 64)) for j in range(self.width + 1)]
        out = np.zeros(n, np.int64)
        for d in range(1, depth + 1):
            live = live[size[live] >= d]
            c = chars[live, d - 1]
            new = np.append(True, (node[live][1:] != node[live][:-1]) | (c[1:] != c[:-1]))
            number = np.cumsum(new) - 1
            first = live[new]
            parent, char = node[first], c[new]
            node[live] = number
            h = hashes[-1][parent] * _BASE + _spread(char.astype(np.uint64))
            nbytes = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
            score = best[-1][parent] + self.unknown
            tokens = count[-1][parent] + nbytes
            above = parent
            for length in range(1, min(self.width, d) + 1):
                keys, scores = self.tables[length - 1]
                if len(keys):
                    tail = h - hashes[d - length][above] * power[length]
                    at = np.minimum(np.searchsorted(keys, tail), len(keys) - 1)
                    total = np.where(keys[at] == tail, best[d - length][above] + scores[at], -np.inf)
                    better = total >= score if length > 1 else keys[at] == tail
                    score = np.where(better, total, score)
                    tokens = np.where(better, count[d - length][above] + 1, tokens)
                if length < d:
                    above = parents[d - length][above]
            hashes.append(h)
            best.append(score)
            count.append(tokens)
            parents.append(parent)
            if d >= self.width:  # no piece reaches further back
                hashes[d - self.width] = best[d - self.width] = count[d - self.width] = parents[d - self.width] = None
            done = size[live] == d
            out[live[done]] = tokens[number[done]]
        return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    return _text.mix(x + np.uint64(1))


@lru_cache(2)
def load(path: str = VOCABULARY, scores: str = "rank") -> Unigram:
    """The vocabulary of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Unigram([(model.id_to_piece(i), -float(np.log(rank + 1)) if scores == "rank" else model.get_score(i)) for rank, i in enumerate(plain)])


def count_tokens(docs: DataFrame, path: str = VOCABULARY, scores: str = "rank", text: str = "text") -> DataFrame:
    """``row`` (a document's own columns), n_words and n_tokens. One scan, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, scores)
        keys, known = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in _text.slices(batches, "_text"):
            tokens = _text.tokenize(batch.column("_text"), _text.RAW)
            distinct, first, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
            at = np.searchsorted(keys, distinct)
            fresh = np.ones(len(distinct), bool)
            inside = at < len(keys)
            fresh[inside] = keys[at[inside]] != distinct[inside]
            counts = np.empty(len(distinct), np.int64)
            counts[~fresh] = known[at[~fresh]]
            new = np.flatnonzero(fresh)
            if len(new):
                raw = tokens.data.tobytes()
                words = [MARK + raw[s:e].decode("utf-8") for s, e in zip(tokens.start[first[new]].tolist(), tokens.end[first[new]].tolist(), strict=True)]
                counts[new] = model.counts(words)
                if len(keys) + len(new) > REMEMBERED:
                    keys, known = distinct, counts
                else:
                    keys, known = np.insert(keys, at[new], distinct[new]), np.insert(known, at[new], counts[new])
            total = np.append(0, np.cumsum(counts[inverse]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(tokens.ptr)), pa.array(np.diff(total[tokens.ptr]))], ["row", "n_words", "n_tokens"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    return row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
