"""op11, op12 and op13 against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import merkle, search, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [None, "", " \t\n", "one", "One  TWO", "é È ẞ straße", "a" * 300 + " b c d", "the same text here again", "the same text here again", "x\x0by\x0cz w"]


def prose(n, seed, words=60, least=1, most=120):
    rng = random.Random(seed)
    known = ["w%d" % i for i in range(words)]
    return [" ".join(rng.choices(known, weights=[1 / (i + 1) for i in range(words)], k=rng.randint(least, most))) for _ in range(n)]


# -- op11


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values, radius=2):
    """The least number of each value's component, by comparing all."""
    arr = np.array(values, np.uint64)
    root = np.arange(len(arr))
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root


def test_fingerprints_of_odd_texts():
    for text in [*ODD, *prose(20, 1), "long " * 200_000]:
        if text is None or len(text) < 10_000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)
        else:
            assert simhash.fingerprint(text) == xxhash.xxh64_intdigest(b"long long long", 42)


def test_walsh_rows_tell_all_blocks_apart():
    for width in (4, 8, 16):
        rows = simhash.distances(np.arange(1 << width, dtype=np.uint64), width)
        assert len(np.unique(rows, axis=0)) == 1 << width
        x, y = np.uint64(5), np.uint64(6)
        assert np.abs(rows[5].astype(int) - rows[6].astype(int)).max() <= np.bitwise_count(x ^ y)


def test_near_duplicates_equal_brute_force(spark, docs_of):
    base = prose(60, 2, least=30, most=80)
    rng = random.Random(3)
    near = [" ".join([*t.split()[:-1], rng.choice("pqr")]) for t in base for _ in range(3)]
    texts = ODD + base + near
    rows = list(enumerate(texts)) + [(3, "one"), (None, "one"), (None, "alone in its place here")]
    found = [tuple(r) for r in simhash.near_duplicates(docs_of(rows).withColumn("fp", F.lit("clash"))).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    least = {r: min((rows[i][0] for i in np.flatnonzero(root == r) if rows[i][0] is not None), default=None) for r in set(root)}
    expected = [(i, format(f, "016x"), least[r]) for (i, _), f, r in zip(rows, prints, root, strict=True)]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert any(root != np.arange(len(root)))


@pytest.mark.parametrize("shift", [0, 20, 52])
def test_dense_fingerprints_lose_no_link(spark, shift):
    """Nodes of thousands, which are dealt three times; ends of chains and lone ones."""
    rng = np.random.Generator(np.random.PCG64(shift))
    dense = {int(x) << shift for x in rng.choice(1 << 12, 1500, replace=False)}
    spread = {int(x) for x in rng.integers(0, 2**63, 300)}
    near = {x ^ (1 << int(b)) for x in list(spread)[:100] for b in rng.integers(0, 63, 2)}
    values = sorted(dense | spread | near)
    frame = spark.createDataFrame([(int(np.array([v], np.uint64).view(np.int64)[0]),) for v in values], "fp long")
    at = {int(np.array([v], np.uint64).view(np.int64)[0]): i for i, v in enumerate(values)}
    root = np.arange(len(values))
    for r in simhash.links(frame).collect():
        a, b = at[r.a], at[r.b]
        assert bin(values[a] ^ values[b]).count("1") <= 2
        root[root == max(root[a], root[b])] = min(root[a], root[b])
    assert (root == plain_components(values)).all()


def test_tables_discard_pairs_before_they_are_verified():
    rng = np.random.Generator(np.random.PCG64(7))
    fps = rng.integers(-(2**62), 2**62, 200)
    links, passed = simhash._linked(np.unique(fps))
    assert not links and passed < 5


def test_simhash_of_nothing(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


# -- op12


def plain_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(k, Counter(terms(t))) for k, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for k, c in held:
            m = 25 + (75 * sum(c.values()) * n) // max(total, 1)
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if score > 0:
                scores.append((-score, k is None, k if k is not None else 0))
        out += [(item, r, None if lacks else k, -s) for r, (s, lacks, k) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "w1 w50 w59 w2 w2"), (2, "nowhere to be found"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"W{i}" for i in range(0, 60, 7)) + " one two é straße same text here"), (1, "w7"), (None, "the same text here again"), (8, "_w3__w4;w5")]


@pytest.mark.parametrize("block", [1_000_000, 7])
def test_search_equals_brute_force(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)  # several blocks of items
    monkeypatch.setattr(search, "BLOCK_DOCS", 50)
    docs = list(enumerate(ODD + prose(300, 4))) + [(20, "w1 w50"), (20, "w1 w50"), (None, "w1 w50")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = search.search(docs_of(docs).withColumn("score", F.lit(1)), items.withColumn("rank", F.lit(1)))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(docs, ITEMS)


def test_search_stops_before_all_masks():
    rng = np.random.Generator(np.random.PCG64(5))
    lists = [np.sort(rng.choice(2000, int(n), replace=False)) for n in rng.integers(5, 1200, 20)]
    gains = [rng.integers(1, 1000 // (i + 1) + 2, len(x)) for i, x in enumerate(lists)]
    kept = search.Kept(np.empty(0, np.int64), np.empty(0, np.int64))
    key = np.arange(2000)
    evaluated = search._ranked(kept, lists, gains, key, 10)
    masks = search._masks(2000, lists)[0].shape[1]
    total = np.zeros(2000, np.int64)
    for x, g in zip(lists, gains, strict=True):
        total[x] += g
    best = np.lexsort((key, -total))[:10]
    assert kept.key.tolist() == best.tolist() and kept.score.tolist() == total[best].tolist()
    assert evaluated < masks / 2


def test_search_of_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.search(docs_of([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert search.search(docs_of([(1, "w1")]), none).count() == 0


# -- op13


def plain_manifest(rows, fan_out=2):
    """(doc_id, leaf, subroot, root, proof, folded_root) of (doc_id, text, lang, source, n_chars) rows."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, extra=0: h(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + extra, r[1])))

    def tree(level):
        paths, owners = [[] for _ in level], [[i] for i in range(len(level))]
        while len(level) > 1:
            runs = [range(i, min(i + fan_out, len(level))) for i in range(0, len(level), fan_out)]
            for run in runs:
                for j in run:
                    for o in owners[j]:
                        paths[o].append(("".join(level[run[0] : j]), "".join(level[j + 1 : run[-1] + 1])))
            owners = [[o for j in run for o in owners[j]] for run in runs]
            level = [h(*(level[j] for j in run)) for run in runs]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in part]) for part in parts]
    if not trees:
        return []
    root, above = tree([t[0] for t in trees])
    out = []
    for part, (subroot, paths), upper in zip(parts, trees, above, strict=True):
        for r, path in zip(part, paths, strict=True):
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for left, right in path + upper:
                node = h(left, node, right)
            out.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in path + upper)), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(n):
    rng = random.Random(n)
    rows = [(i, f"text {i} é" if i % 11 else None, rng.choice(["en", "en", "en", "de", None, "", "é", "z"]), rng.choice(["s", None, ""]), rng.choice([None, i, 2 * i])) for i in range(n)]
    return rows + [(3, "again", "en", "s", 5), (3, "again", "en", "s", 5), (None, "x", "en", "s", 1), (-7, "y", "lone", "s", 1)]


@pytest.mark.parametrize(("block", "n"), [(1024, 40), (4, 300), (2, 37)])
def test_manifest_equals_brute_force(spark, monkeypatch, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)  # several rounds
    rows = manifest_rows(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("pos", F.lit(1)).withColumn("a.b", F.lit("extra"))
    found = merkle.summary(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_manifest(rows)


def test_manifest_with_wider_runs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = manifest_rows(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(docs, fan_out=3)
    again = merkle.verified(found)
    assert again.where("not verified").isEmpty()
    own = sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in again.where("doc_id is not null").collect())
    assert own == sorted(r[:5] for r in plain_manifest(rows, 3) if r[0] is not None)


def test_manifest_of_nothing_and_of_one(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.summary(spark.createDataFrame([], kind)).count() == 0
    one = [(1, "x", None, None, None)]
    assert [tuple(r) for r in merkle.summary(spark.createDataFrame(one, kind)).collect()] == plain_manifest(one)
