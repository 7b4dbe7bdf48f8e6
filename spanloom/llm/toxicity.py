"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are A-Z lower-cased runs of digits, letters and characters beyond ASCII. Each word has three hashed
embeddings: two of the whole word (so that it is mistaken for another only if both slots collide) and one of
its first PREFIX bytes and whether it is short, middling or long, for words that share a stem and go on. Their concatenation feeds filters of widths 1, 2 and 3; a filter's greatest response over the whole text, a
rectifier and one logistic layer give the score. Training uses Adam on the log loss, on all labelled
documents that aren't held out, whole; only words are ever inputs. Rare toxic labels and
rare languages' ones weigh more. Labelled documents are dealt to parts of about PART_ROWS by a hash of their ids, in one task each. Counts of slots are
sums over all parts; in each epoch every part goes on from the common network, and what the parts changed is
averaged, a slot's embedding over the parts that saw it. One part is plain training. The driver holds one network, whatever the number of labels.
A threshold for each language is then the lowest one at which precision holds
on a slice the network was not fitted on, whether that is below the usual one or above it; all rows of the slice count, by scores rounded to GRID.

Scoring runs in one scan: each filter's response to each slot is computed once as a table, so a word
costs a few look-ups, and a text of any length is read whole, in slices that overlap by a filter's width.

Defined cases: null and empty texts have no words and score what no response at all gives. Documents
without labels, or with a null label, are not learnt from. With no labelled rows, or with one class
only, every score is that class's smoothed share. Repeated rows score alike; an empty table gives an
empty result; other columns stay with their row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ..session import released
from ._spark import give_back, saved, small_batches

#: Documents and words of one part of the fit, about.
PART_ROWS = 4_000
PART_WORDS = 1_000_000
#: Sums travel in slices of so many numbers, so that no row is large, and so many rows of a slice are added at once.
SLICE = 1 << 15
FAN = 8
#: Steps of scores that thresholds are told by.
GRID = 1e-4
#: Labelled documents in which a slot must occur to be trained.
LEAST = 3
SLOTS = 1 << 16
HASHES = 3
PREFIX = 4
#: Bytes of words up to which they are short, or of middle length.
LENGTHS = (5, 7)
DIM = 4
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 4
BATCH = 32
#: Steps of embeddings, relative to those of the other weights.
RATE = 1.0
SEED = 11
#: Documents flagged by a language's threshold are right at least this often on the calibration slice.
PRECISION = 0.9
DEFAULT_THRESHOLD = 0.7
#: A language needs so many calibration rows of each label for a threshold of its own.
MIN_CALIBRATION = 20
FLOOR = 0.3


@dataclass
class Model:
    embedding: np.ndarray  # HASHES tables of SLOTS x DIM
    kernels: list[np.ndarray]  # for each width: width x HASHES x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def tables(self) -> list[np.ndarray]:
        """For each hash, the responses of every slot to every filter at every offset."""
        return [np.concatenate([self.embedding[h] @ k[o, h] for k in self.kernels for o in range(len(k))], axis=1) for h in range(HASHES)]


def slots(tokens: _text.Tokens) -> np.ndarray:
    """HASHES slot numbers of every word."""
    word = tokens.hash
    stem = np.zeros(len(word), np.uint64)
    for j in range(PREFIX):
        at = tokens.start + j
        inside = at < tokens.end
        stem[inside] |= _text.ALNUM.fold[tokens.data[at[inside]]].astype(np.uint64) << np.uint64(8 * j)
    grown = np.searchsorted(LENGTHS, tokens.end - tokens.start).astype(np.uint64)  # a stem alone, or one with endings
    parts = (word, word >> np.uint64(32), _text.mix(stem + (grown << np.uint64(8 * PREFIX)) + np.uint64(1)))
    return np.stack([(x & np.uint64(SLOTS - 1)).astype(np.int32) for x in parts])


def _pooled(model: Model, ids: np.ndarray, ptr: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter in each text, and where; rows without a window give -inf."""
    n = len(ptr) - 1
    best = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    where = np.zeros(best.shape, np.int64)
    total = ids.shape[1]
    column = 0
    size = np.diff(ptr)
    for number, width in enumerate(WIDTHS):
        rows = np.flatnonzero(size >= width)
        if len(rows):
            reply = np.zeros((total - width + 1, FILTERS), np.float32)
            for offset in range(width):
                part = slice(column + offset * FILTERS, column + (offset + 1) * FILTERS)
                for h in range(HASHES):
                    reply += tables[h][:, part][ids[h, offset : total - width + 1 + offset]]
            for i in rows:
                block = reply[ptr[i] : ptr[i + 1] - width + 1]
                at = block.argmax(axis=0)
                best[i, number * FILTERS : (number + 1) * FILTERS] = block[at, np.arange(FILTERS)]
                where[i, number * FILTERS : (number + 1) * FILTERS] = at + ptr[i]
        column += width * FILTERS
    return best, where


def counts(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """HASHES x 2 x SLOTS: documents of each class in which a slot occurs."""
    seen = np.zeros((HASHES, 2, SLOTS), np.int64)
    for ids, y in zip(texts, labels, strict=True):
        for h in range(HASHES):
            seen[h, int(y), np.unique(ids[h])] += 1
    return seen


def _embedding(seen: np.ndarray, toxic: int, clean: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Starting embeddings, and which slots are trained: those in enough of the labelled documents.

    The first component starts from the slot's log odds between the classes, shrunk by how often it
    was seen; other slots are zero throughout, so that a document's rare words can't be learnt by heart.
    """
    embedding = np.zeros((HASHES, SLOTS, DIM), np.float32)
    trained = np.zeros((HASHES, SLOTS), bool)
    for h in range(HASHES):
        total = seen[h].sum(axis=0)
        trained[h] = total >= LEAST
        odds = np.log((seen[h, 1] + 0.5) / (toxic + 1)) - np.log((seen[h, 0] + 0.5) / (clean + 1))
        embedding[h] = rng.normal(0, 0.05, (SLOTS, DIM))
        embedding[h, :, 0] += np.clip(odds * total / (total + 10), -3, 3)
        embedding[h][~trained[h]] = 0
    return embedding, trained


@dataclass
class State:
    """A network in training: its dense weights by name, Adam's moments, the embeddings' sums of squares."""

    model: Model
    trained: np.ndarray
    dense: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    ada: np.ndarray
    step: int
    share: float  # of toxic documents

    def settled(self) -> Model:
        self.model.out_bias = float(self.dense["out_bias"][0])
        return self.model

    def vector(self) -> np.ndarray:
        """All that training changes, as one vector: embeddings and their sums of squares first."""
        return np.concatenate([x.ravel() for x in (self.model.embedding, self.ada, *self.dense.values(), *self.first.values(), *self.second.values())]).astype(np.float32)

    def take(self, vector: np.ndarray) -> None:
        at = 0
        for x in (self.model.embedding, self.ada, *self.dense.values(), *self.first.values(), *self.second.values()):
            x[...] = vector[at : at + x.size].reshape(x.shape)
            at += x.size


def start(seen: np.ndarray, toxic: int, clean: int, rng: np.random.Generator) -> State:
    embedding, trained = _embedding(seen, toxic, clean, rng)
    kernels = [rng.normal(0, 0.1, (w, HASHES, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[0, :, 0] += rng.uniform(0.2, 0.6, FILTERS).astype(np.float32)
    model = Model(embedding, kernels, np.full(len(WIDTHS) * FILTERS, -0.5, np.float32), rng.uniform(0.2, 0.6, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    share = (toxic + 1) / (toxic + clean + 2)
    model.out_bias = float(np.log(share / (1 - share)))
    if not toxic or not clean:
        model.out[:] = 0
    dense = {"bias": model.bias, "out": model.out, "out_bias": np.zeros(1, np.float32), **{f"k{i}": k for i, k in enumerate(model.kernels)}}
    dense["out_bias"][0] = model.out_bias
    first, second = {k: np.zeros_like(v) for k, v in dense.items()}, {k: np.zeros_like(v) for k, v in dense.items()}
    return State(model, trained, dense, first, second, np.zeros((HASHES, SLOTS), np.float32), 0, share)


def run_epoch(state: State, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None, order: np.ndarray, rate: float) -> None:
    """One pass over texts, in ``order``, in batches."""
    model = state.model
    weight = np.where(labels > 0, 0.5 / state.share, 0.5 / (1 - state.share)).astype(np.float32) ** 0.5
    if weights is not None:
        weight *= weights
    for a in range(0, len(order), BATCH):
        rows = order[a : a + BATCH]
        ids = np.concatenate([texts[i] for i in rows], axis=1)
        ptr = np.cumsum([0, *(texts[i].shape[1] for i in rows)])
        model.out_bias = float(state.dense["out_bias"][0])
        used = [np.unique(ids[h], return_inverse=True) for h in range(HASHES)]
        local = np.stack([u[1] for u in used])
        tables = [np.concatenate([model.embedding[h][used[h][0]] @ k[o, h] for k in model.kernels for o in range(len(k))], axis=1) for h in range(HASHES)]
        best, where = _pooled(model, local, ptr, tables)
        has = np.isfinite(best)
        active = np.where(has, best + model.bias, 0)
        hidden = np.maximum(active, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
        delta = (p - labels[rows]) * weight[rows] / len(rows)
        grad = {"out": hidden.T @ delta + 1e-4 * model.out, "out_bias": np.array([delta.sum()], np.float32)}
        back = delta[:, None] * model.out * (active > 0)
        grad["bias"] = back.sum(axis=0)
        row_grad = {}
        for number, width in enumerate(WIDTHS):
            kernel = model.kernels[number]
            gk = np.zeros_like(kernel)
            part = slice(number * FILTERS, (number + 1) * FILTERS)
            doc, flt = np.nonzero(back[:, part])
            if len(doc):
                g, at = back[:, part][doc, flt], where[:, part][doc, flt]
                for offset in range(width):
                    for h in range(HASHES):
                        word = ids[h, at + offset]
                        np.add.at(gk[offset, h].T, flt, g[:, None] * model.embedding[h][word])
                        row_grad.setdefault(h, []).append((word, g[:, None] * kernel[offset, h][:, flt].T))
            grad[f"k{number}"] = gk
        state.step += 1
        for name, value in state.dense.items():
            state.first[name] += 0.1 * (grad[name] - state.first[name])
            state.second[name] += 0.001 * (grad[name] ** 2 - state.second[name])
            value -= rate * (state.first[name] / (1 - 0.9**state.step)) / (np.sqrt(state.second[name] / (1 - 0.999**state.step)) + 1e-8)
        for h, parts in row_grad.items():
            word, g = np.concatenate([w for w, _ in parts]), np.concatenate([g for _, g in parts])
            unique, inverse = np.unique(word, return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, g)
            state.ada[h, unique] += (total**2).sum(axis=1)
            change = RATE * rate * total / (np.sqrt(state.ada[h, unique])[:, None] + 1e-6)
            model.embedding[h][unique] -= change * state.trained[h, unique][:, None]


def _rate(epoch: int, epochs: int) -> float:
    return 0.02 * (1 - epoch / epochs) + 0.002


def fit(texts: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = SEED, weights: np.ndarray | None = None) -> Model:
    """Texts of one part, as (HASHES x words slot numbers, label), with weights if they don't count alike."""
    rng = np.random.Generator(np.random.PCG64(seed))
    own, labels = [ids for ids, _ in texts], np.array([y for _, y in texts], np.float32)
    toxic = int(labels.sum())
    state = start(counts(own, labels), toxic, len(labels) - toxic, rng)
    if toxic and toxic < len(labels):
        for epoch in range(epochs):
            run_epoch(state, own, labels, weights, rng.permutation(len(own)), _rate(epoch, epochs))
    return state.settled()


def score_texts(model: Model, tables: list[np.ndarray], column: pa.Array) -> np.ndarray:
    tokens = _text.tokenize(column, _text.ALNUM)
    best = np.full((len(column), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    if len(tokens.hash):
        ids = slots(tokens)
        size = np.diff(tokens.ptr)
        for number, width in enumerate(WIDTHS):
            rows = np.flatnonzero(size >= width)
            if len(rows):
                n = ids.shape[1] - width + 1
                reply = np.zeros((n, FILTERS), np.float32)
                for offset in range(width):
                    for h in range(HASHES):
                        reply += tables[h][number][offset][ids[h, offset : n + offset]]
                for j in range(1, width):  # windows that run into the next row
                    out = tokens.ptr[1:] - j
                    reply[out[(out >= 0) & (out < n)]] = -np.inf
                starts = tokens.ptr[rows]
                best[rows, number * FILTERS : (number + 1) * FILTERS] = np.maximum.reduceat(reply, starts, axis=0)
    hidden = np.maximum(np.where(np.isfinite(best), best + model.bias, 0), 0)
    return 1 / (1 + np.exp(-np.clip((hidden @ model.out + model.out_bias).astype(np.float64), -30, 30)))


def _split_tables(model: Model) -> list[list[list[np.ndarray]]]:
    return [[[np.ascontiguousarray(model.embedding[h] @ k[o, h]) for o in range(len(k))] for k in model.kernels] for h in range(HASHES)]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 marks the rows that are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


@dataclass
class Classifier:
    model: Model
    thresholds: dict[str, float]


def _words(docs: DataFrame, toxic: DataFrame, words: int | None) -> DataFrame:
    """(doc_id, words, lang, toxic) of the documents of ``toxic(doc_id, toxic)``, one for each id: slot numbers packed by hash, all or a window of ``words``."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    found = docs.where(remainder(F.col("doc_id")) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang).join(toxic.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("x")).select("doc_id", "x.*")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            tokens = _text.tokenize(batch.column("text"), _text.ALNUM)
            every = slots(tokens).astype(np.uint16)
            kept = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = every[:, tokens.of(i)]
                spare = own.shape[1] - (own.shape[1] if words is None else words)
                first = zlib.crc32(f"window {doc_id}".encode()) % (spare + 1) if spare > 0 else 0
                kept.append((own if words is None else own[:, first : first + words]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("toxic"), pa.array(kept, pa.binary())], ["doc_id", "lang", "toxic", "words"])

    return one.mapInArrow(hashed, "doc_id long, lang string, toxic int, words binary").select("doc_id", "words", "lang", "toxic")


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from."""
    toxic = labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return toxic.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))


def sample(docs: DataFrame, labels: DataFrame, rows: int, words: int) -> list:
    """A look at the rows that ``train`` learns from, which takes all of them: at most ``rows``, in order of a hash of the id, with ``words`` words each."""
    chosen = _known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return sorted(_words(docs, chosen, words).toLocalIterator(), key=lambda r: r.doc_id)


def _sliced(part: int, vector: np.ndarray) -> pd.DataFrame:
    """A part's vector as rows (slice, part, data) of SLICE doubles each."""
    starts = range(0, len(vector), SLICE)
    return pd.DataFrame({"slice": np.arange(len(starts), dtype=np.int32), "part": np.int32(part), "data": [vector[a : a + SLICE].astype(np.float64).tobytes() for a in starts]})


_SLICES = "slice int, part int, data binary"


def _summed(parts: DataFrame, many: int, size: int) -> np.ndarray:
    """The sum of ``_sliced`` vectors of ``size`` numbers, of parts below ``many``, FAN rows at a time; the driver gets one vector."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for data in group.sort_values("part")["data"]:
            total = total + np.frombuffer(data, np.float64)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["up"].iloc[:1], "data": [total.tobytes()]})

    with released(parts.sparkSession):
        while True:
            parts = parts.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("slice", "up").applyInPandas(add, _SLICES)
            many = -(-many // FAN)
            if many == 1:
                break
        found = np.zeros(size)
        for row in parts.collect():  # one vector, in slices
            found[row.slice * SLICE : row.slice * SLICE + len(row.data) // 8] = np.frombuffer(row.data, np.float64)
    return found


def _texts(row) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Texts, labels and weights of a part's row."""
    ends = np.cumsum(np.frombuffer(row.sizes, np.int64))
    every = np.frombuffer(row.words, np.uint16)
    own = [every[HASHES * (e - n) : HASHES * e].reshape(HASHES, -1).astype(np.int32) for n, e in zip(np.diff(ends, prepend=0), ends, strict=True)]
    return own, np.frombuffer(row.labels, np.float32), np.frombuffer(row.weights, np.float32)


def _parts(fitted: DataFrame) -> tuple[DataFrame, int]:
    """(part, words, sizes, labels, weights), one row for each part, its documents by id; and how many parts there are."""
    n_words = (F.length("words") / (2 * HASHES)).cast("long")
    rows, words = fitted.agg(F.count("*"), F.coalesce(F.sum(n_words), F.lit(0))).first()
    many = max(1, -(-rows // PART_ROWS), -(-words // PART_WORDS))
    kinds = fitted.groupBy("toxic", "lang").agg(F.count("*").alias("n"))
    mean = kinds.agg((F.sum("n") / F.count("*")).alias("mean"))
    weigh = kinds.crossJoin(mean).select(F.col("toxic").alias("_toxic"), F.col("lang").alias("_lang"), F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.sqrt(F.col("mean") / F.col("n")))).alias("weight"))
    dealt = fitted.join(weigh, F.col("toxic").eqNullSafe(F.col("_toxic")) & F.col("lang").eqNullSafe(F.col("_lang"))).select(F.pmod(F.xxhash64("doc_id"), F.lit(many)).cast("int").alias("part"), "doc_id", "words", "toxic", "weight")

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        sizes = np.array([len(w) // (2 * HASHES) for w in group["words"]], np.int64)
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "words": [b"".join(group["words"])], "sizes": [sizes.tobytes()], "labels": [group["toxic"].to_numpy(np.float32).tobytes()], "weights": [group["weight"].to_numpy(np.float32).tobytes()]})

    gathered = dealt.repartition(many, "part").groupBy("part").applyInPandas(gather, "part int, words binary, sizes binary, labels binary, weights binary")
    return saved(gathered, "toxicity-parts"), many


def _fitted(parts: DataFrame, many: int, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """``fit`` over parts: each goes on from the common network in every epoch, and their changes are averaged."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own, labels, _ = _texts(row)
                tail = [labels.sum(), len(labels) - labels.sum()]
                yield _sliced(row.part, np.concatenate([counts(own, labels).ravel(), tail]))
                del own
                give_back()

    seen = _summed(parts.mapInPandas(count, _SLICES), many, HASHES * 2 * SLOTS + 2)
    toxic, clean = int(seen[-2]), int(seen[-1])
    state = start(seen[:-2].reshape(HASHES, 2, SLOTS).astype(np.int64), toxic, clean, np.random.Generator(np.random.PCG64(seed)))
    if not toxic or not clean:
        return state.settled()
    for epoch in range(epochs):
        before, slots_ = state.vector(), HASHES * SLOTS

        def learn(batches: Iterator[pd.DataFrame], state=state, epoch=epoch, before=before) -> Iterator[pd.DataFrame]:
            step = state.step
            for batch in batches:
                for row in batch.itertuples():
                    own, labels, weights = _texts(row)
                    state.take(before)
                    state.step = step
                    order = np.random.Generator(np.random.PCG64([seed, epoch, row.part])).permutation(len(own))
                    run_epoch(state, own, labels, weights, order, _rate(epoch, epochs))
                    change = state.vector().astype(np.float64) - before
                    touched = change[slots_ * DIM : slots_ * (DIM + 1)] != 0
                    yield _sliced(row.part, np.concatenate([change, touched, [1.0, state.step - step]]))
                    del own
                    give_back()

        total = _summed(parts.mapInPandas(learn, _SLICES), many, len(before) + slots_ + 2)
        change, touched, learnt, steps = total[: len(before)], np.maximum(total[len(before) : -2], 1), total[-2], total[-1]
        share = np.full(len(before), learnt)
        share[: slots_ * DIM], share[slots_ * DIM : slots_ * (DIM + 1)] = np.repeat(touched, DIM), touched
        state.take((before + change / share).astype(np.float32))
        state.step += int(round(steps / learnt))
    return state.settled()


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on four fifths of the labelled documents that aren't held out; thresholds by language from the rest."""
    small_batches(docs.sparkSession)
    known = saved(_words(docs, _known(labels), None).withColumn("toxic", (F.col("toxic") > 0).cast("int")), "toxicity-words")
    slice_ = F.pmod(F.crc32(F.concat(F.lit("calibration "), F.col("doc_id").cast("string")).cast("binary")), F.lit(5)) == 0
    model = _fitted(*_parts(known.where(~slice_)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = model.tables()
        for batch in batches:
            out = []
            for words in batch["words"]:
                ids = np.frombuffer(words, np.uint16).reshape(HASHES, -1).astype(np.int32)
                best, _ = _pooled(model, ids, np.array([0, ids.shape[1]]), tables)
                hidden = np.maximum(np.where(np.isfinite(best), best + model.bias, 0), 0)
                out.append(float(1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))[0]))
            yield pd.DataFrame({"lang": batch["lang"], "score": np.round(np.array(out) / GRID) * GRID, "toxic": batch["toxic"]})

    judged = known.where(slice_).select("lang", "toxic", "words").mapInPandas(judge, "lang string, score double, toxic int")
    steps = saved(judged.groupBy("lang", "score").agg(F.sum("toxic").alias("right"), F.count("*").alias("n")), "toxicity-scores")
    pooled = [tuple(r) for r in steps.groupBy("score").agg(F.sum("right"), F.sum("n")).collect()]  # 1 / GRID rows at most
    common = _threshold(pooled, DEFAULT_THRESHOLD, GRID / 2)

    def own(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "at": [_threshold(list(group[["score", "right", "n"]].itertuples(index=False, name=None)), common, GRID / 2)]})

    found = steps.where(F.col("lang").isNotNull()).groupBy("lang").applyInPandas(own, "lang string, at double").where(F.col("at") != common)
    thresholds = {"": common} | {r.lang: r["at"] for r in found.toLocalIterator()}
    give_back()
    return Classifier(model, thresholds)


def by_language(rows: list[tuple[int, str | None]]) -> np.ndarray:
    """Weights of (label, language) rows: rare pairs weigh more, by the root of how rare they are, up to fivefold."""
    count = Counter(rows)
    mean = len(rows) / max(1, len(count))
    return np.array([min(5.0, max(1.0, (mean / count[r]) ** 0.5)) for r in rows], np.float32)


def _threshold(steps: list[tuple[float, int, int]], default: float, half: float = 0.0) -> float:
    """The threshold by (score, toxic rows, rows); a score stands for those up to ``half`` from it.

    The lowest cut between two scores at which at least PRECISION of what lies above is toxic, be it below the
    usual one or above; never below FLOOR. Where no cut holds it, only what scores above every clean row is flagged.
    """
    toxic, every = sum(y for _, y, _ in steps), sum(n for _, _, n in steps)
    if toxic < MIN_CALIBRATION or every - toxic < MIN_CALIBRATION:
        return default
    steps = sorted(steps, reverse=True)
    clean = max(s for s, y, n in steps if y < n)
    best, right, rows = min(1.0, clean + half + 1e-6), 0, 0
    for at, (s, y, n) in enumerate(steps):
        right, rows = right + y, rows + n
        if right / rows >= PRECISION:
            best = (s + (steps[at + 1][0] if at + 1 < len(steps) else 0.0)) / 2
    return float(max(best, FLOOR))


def calibrate(scores: dict[str | None, list[tuple[float, int]]]) -> dict[str, float]:
    """Language -> threshold of (score, label) rows; the key "" holds for languages with too few rows, and for none."""

    def threshold(rows: list[tuple[float, int]], default: float) -> float:
        toxic, every = Counter(s for s, y in rows if y), Counter(s for s, _ in rows)
        return _threshold([(s, toxic[s], n) for s, n in every.items()], default)

    common = threshold(scores.get(None, []), DEFAULT_THRESHOLD)
    return {"": common} | {lang: threshold(rows, common) for lang, rows in scores.items() if lang is not None}


def score(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``row`` (a document's own columns) and its score."""
    small_batches(docs.sparkSession)
    model = classifier.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _split_tables(model)
        for batch in _text.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score_texts(model, tables, batch.column("_text")), pa.float64())], ["row", "score"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    return row.mapInArrow(run, T.StructType([row.schema["row"], T.StructField("score", T.DoubleType())]))


def threshold_of(classifier: Classifier, lang: Column) -> Column:
    """A language's threshold, by one look-up in a literal map of those that differ from the common one."""
    common = classifier.thresholds[""]
    own = {k: v for k, v in classifier.thresholds.items() if k and v != common}
    if not own:
        return F.lit(common)
    return F.coalesce(F.try_element_at(F.map_from_arrays(F.lit(list(own)), F.lit(list(own.values()))), lang), F.lit(common))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score at or above their language's threshold."""
    classifier = train(docs, labels)
    scored = score(docs, classifier)
    lang = F.col("row.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return scored.where(F.col("score") < threshold_of(classifier, lang)).select("row.*")


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    classifier = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), classifier)
    return scored.select(F.col("row.doc_id").alias("doc_id"), (remainder(F.col("row.doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
