"""Near-duplicates, repeated passages and decontamination against brute force, with odd rows among them."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import _components, _spark, _text, decontam, near_dedup, suffix_dedup

LOW = {i: i + 32 for i in range(65, 91)}
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
words = lambda t, rx=SPACED: re.findall(rx, (t or "").translate(LOW))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1é😀 \t\n\x0b-\x00_", max_size=30)), max_size=6))
def test_tokens(texts):
    for kind, rx in ((_text.SPACED, SPACED), (_text.ALNUM, ALNUM)):
        t = _text.tokenize(pa.array(texts, pa.string()), kind)
        seen = {}
        for i, text in enumerate(texts):
            own = words(text, rx)
            assert len(own) == t.ptr[i + 1] - t.ptr[i]
            for w, h in zip(own, t.hash[t.of(i)], strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_words_cross_pieces():
    long = "x" * (_text.PIECE * 2 + 5)
    t = _text.tokenize(pa.array(["a " + long, long + " b", "", None]), _text.SPACED)
    assert np.diff(t.ptr).tolist() == [2, 2, 0, 0] and t.hash[1] == t.hash[2]


def thue_morse(n, letters="ab"):
    """A word whose letters swapped give any polynomial hash modulo a power of two the same value, if long enough."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_hashes_of_structured_words_differ():
    for n in (1, 4, 8, 9, 16, 64, 65, 512, 1024, 2048, 1 << 16):
        h = _text.tokenize(pa.array([thue_morse(n), thue_morse(n, "ba")]), _text.SPACED).hash
        assert h[0] != h[1], n
    few = ["".join(x) for n in range(1, 5) for x in itertools.product("a\x01é", repeat=n)]
    assert len(set(_text.tokenize(pa.array(few), _text.SPACED).hash.tolist())) == len(few)


def corpus(seed=4, n=60):
    """Random texts with exact copies, near copies, shared passages, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage = text(70)
    rows = [(i, text(rng.choice((0, 1, 3, 40, 130, 300)))) for i in range(n)]
    for i in range(n, n + 30):
        own = rng.choice(rows)[1].split()
        for _ in range(rng.choice((0, 0, 1, 6))):
            if own:
                own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own).upper() if i % 5 == 0 else " ".join(own)))
    rows += [(n + 40 + i, f"{text(20)} {passage} {text(15)}") for i in range(6)]
    rows += [(n + 50, None), (n + 51, ""), (n + 52, " \n"), (n + 53, "one"), (n + 54, "ONE"), rows[5], rows[5]]
    return rows


def brute_components(rows, k, threshold):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs_of, k, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 3)  # groups of several blocks
    rows = corpus()
    got = near_dedup.near_duplicates(docs_of(rows), k).collect()
    want = brute_components(rows, k, 80)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r


def test_near_duplicates_of_large_nodes(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 3)  # every level branches, and the last passes on whole
    rng = random.Random(2)
    base = [str(rng.random()) for _ in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else str(rng.random()) for w in base)) for i in range(25)]
    rows += [(100 + i, " ".join(str(rng.random()) for _ in range(50))) for i in range(5)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(rows), 2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2, 80).items()}


def test_near_duplicates_that_only_meet_deep_in_the_trees(docs_of, monkeypatch):
    """Variants that add a fifth of their own to one base: ten trees of six levels lose about one in twenty."""
    monkeypatch.setattr(near_dedup, "NODE_LIMIT", 4)
    base = [str(n) for n in range(300)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base + [f"{i}x{n}" for n in range(74)])) for i in range(1, 401)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(rows), 2).collect()}
    assert brute_components([rows[0], rows[1]], 2, 80)[1][1] == 0
    assert [i for i, c in got.items() if c] == []


def test_trees_follow_the_depth():
    for level in range(1, near_dedup.LEVELS + 1):
        assert math.isclose(math.exp(-near_dedup.gain(level, 80)), 1 - 0.8**level)
    assert (1 - 0.8**near_dedup.LEVELS) ** near_dedup.all_trees(80) <= near_dedup.MISS
    assert 0.2**near_dedup.TREES <= near_dedup.MISS and near_dedup.all_trees(100) == near_dedup.TREES


def test_structured_words_are_no_copies(docs_of):
    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, "ba")), (3, thue_morse(2048)), (4, thue_morse(2048, "ba"))]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(rows), 2).collect()}
    assert got == {i: (i, True) for i in got} and len(got) == 4
    assert near_dedup.deduplicate(docs_of(rows)).count() == 4


def test_deduplicate_keeps_columns_and_odd_rows(docs_of):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, None), (4, ""), (1, "a b c d e f"), (None, "x y z"), (None, "x y z")]
    docs = docs_of(rows).withColumns({"set_key": F.lit(1), "_id": F.lit("own"), "minima": F.lit(2), "_row": F.lit(3), "rep_id": F.lit(4), "my col": F.lit(5)})
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, "x y z"), (1, "a b c d e f"), (2, ""), (4, "")]
    assert {(r["_id"], r["_row"], r["rep_id"], r["my col"]) for r in got.collect()} == {("own", 3, 4, 5)}
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(docs_of):
    rng = random.Random(8)
    text = lambda n: " ".join(str(rng.random()) for _ in range(n))
    one, two, three, four = text(40), text(40), text(40), text(200)
    rows = [(7, one), (7, two), (3, two), (9, three), (9, three.replace("0.", "1.")), (None, four), (None, four + " end"), (None, text(30))]
    got = near_dedup.near_duplicates(docs_of(rows), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == sorted([(7, 7, True), (7, 3, False), (3, 3, True), (9, 9, True), (9, 9, True), (0, 0, True), (0, 0, True), (0, 0, True)])
    left = sorted((r.doc_id or 0, r.text) for r in near_dedup.deduplicate(docs_of(rows), 2).collect())
    kept_four = min((four, four + " end"), key=lambda t: t in {x for _, x in left})
    assert [x for x in left if x[0]] == sorted([(7, one), (3, two), (9, three), (9, three.replace("0.", "1."))])
    assert len([x for x in left if not x[0]]) == 2 and (0, rows[-1][1]) in left and kept_four not in {x for _, x in left}


def test_a_very_long_text_and_its_near_copy(docs_of):
    long = " ".join(f"w{i % 70_001}" for i in range(400_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of([(1, long), (2, "other " + long), (3, "short text")]), 2).collect()}
    assert got == {1: (70_001, 1), 2: (70_002, 1), 3: (1, 3)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components_with_hubs(spark, pairs):
    pairs = [*pairs, *((100, n) for n in range(50, 70)), *((200 + n, 300) for n in range(20))]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.root for r in _components.components(edges).collect()} == root


def brute_passages(rows, size=50):
    docs = {(i, t): words(t) for i, t in rows}
    place = defaultdict(list)
    for d in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        for a in range(len(docs[d]) - size + 1):
            place[tuple(docs[d][a : a + size])].append((d, a))
    repeated, removed = defaultdict(set), defaultdict(set)
    for found in place.values():
        if len(found) > 1:
            for n, (d, a) in enumerate(found):
                repeated[d] |= set(range(a, a + size))
                if n:
                    removed[d] |= set(range(a, a + size))
    return docs, repeated, removed


def test_repeated_passages(docs_of):
    rows = corpus(9)
    docs, repeated, removed = brute_passages(rows)
    got = {r.doc_id: r for r in suffix_dedup.summary(docs_of(rows)).collect()}
    for d, w in docs.items():
        r = got[d[0]]
        assert (r.n_words, r.n_repeated, r.n_removed) == (len(w), len(repeated[d]), len(removed[d])), d[0]
    frame = docs_of(rows).withColumns({"mark": F.lit("own"), "my col": F.lit(1)})
    left = suffix_dedup.remove(frame)
    assert left.columns == frame.columns
    after = {r.doc_id: r for r in left.collect()}
    for d, w in docs.items():
        rest = [x for n, x in enumerate(w) if n not in removed[d]]
        if rest or not removed[d]:
            assert words(after[d[0]].text) == rest and after[d[0]].n_chars == (None if d[1] is None else len(after[d[0]].text)) and after[d[0]].mark == "own"
        else:
            assert d[0] not in after
    assert suffix_dedup.remove(frame.limit(0)).count() == 0 and suffix_dedup.summary(frame.limit(0)).count() == 0


def test_passage_repeated_inside_one_document(docs_of):
    rng = random.Random(1)
    part = " ".join(str(rng.random()) for _ in range(55))
    got = suffix_dedup.summary(docs_of([(1, f"{part} zz {part}"), (2, None)])).collect()
    assert {r.doc_id: (r.n_words, r.n_repeated, r.n_removed) for r in got} == {1: (111, 110, 55), 2: (0, 0, 0)}


@pytest.mark.parametrize("batch_rows", [512, 3])
def test_repeated_rows_are_one_document(docs_of, monkeypatch, batch_rows):
    monkeypatch.setattr(_spark, "BATCH_ROWS", batch_rows)  # equal rows on both sides of a batch's end
    rng = random.Random(3)
    text = lambda n: " ".join(str(rng.random()) for _ in range(n))
    shared = text(60)
    rows = [(1, text(130))] * 3 + [(2, f"{text(10)} {shared}")] * 2 + [(3, f"{shared} {text(5)}")] * 2 + [(None, text(70))] * 2
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeated, r.n_removed) for r in suffix_dedup.summary(docs_of(rows)).collect())
    assert got == [(0, 70, 0, 0)] * 2 + [(1, 130, 0, 0)] * 3 + [(2, 70, 60, 0)] * 2 + [(3, 65, 60, 60)] * 2
    left = sorted((r.doc_id or 0, len(words(r.text))) for r in suffix_dedup.remove(docs_of(rows)).collect())
    assert left == [(0, 70)] * 2 + [(1, 130)] * 3 + [(2, 70)] * 2 + [(3, 5)] * 2


@pytest.mark.parametrize(("chunk", "group", "partitions"), [(1 << 14, 1 << 15, 4), (7, 5, 1), (3, 1 << 15, 31)])
def test_passages_that_share_parts_of_each_other(spark, docs_of, monkeypatch, chunk, group, partitions):
    """Copies that go on alike to the left with some documents and to the right with others, few words apart."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(chunk)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        own, words_ = (lambda: [f"{i}x{rng.random()}" for _ in range(rng.randint(0, 30))]), []
        for _ in range(rng.randint(1, 4)):
            a, n = rng.randrange(0, 340, 5), rng.choice((20, 45, 49, 50, 51, 60, 90, 130))
            words_ += own() + base[a : a + n]
        rows.append((i, " ".join(words_ + own())))
    rows += [(100, rows[3][1]), (100, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), rows[7], rows[7]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in suffix_dedup.summary(docs_of(rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # among rows of one id, and of none, the hash of the text orders them
    mark = {r.text: r.m for r in docs_of(rows).select("text", F.xxhash64("text").alias("m")).collect()}
    place, repeated, removed = defaultdict(list), defaultdict(set), defaultdict(set)
    docs = sorted(set(rows), key=lambda d: (-1 if d[0] is None else d[0], mark[d[1]]))
    for d in docs:
        w = words(d[1])
        for a in range(len(w) - 49):
            place[tuple(w[a : a + 50])].append((d, a))
    for found in place.values():
        for n, (d, a) in enumerate(found if len(found) > 1 else []):
            repeated[d] |= set(range(a, a + 50))
            removed[d] |= set(range(a, a + 50)) if n else set()
    assert got == sorted((-1 if d[0] is None else d[0], len(words(d[1])), len(repeated[d]), len(removed[d])) for d in rows)


def test_a_very_long_text_that_repeats(docs_of):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.summary(docs_of([(1, long), (2, "x " + long), (3, " ".join(["a"] * 5000)), (4, "b " * 49 + "b")])).collect()}
    # one word over and over: all its windows but the first are copies
    assert got == {1: (300_000, 300_000, 0), 2: (300_001, 300_000, 300_000), 3: (5000, 5000, 4999), 4: (50, 0, 0)}


ITEMS = [(1, " ".join(f"w{i}" for i in range(25))), (2, "tiny item"), (3, None), (4, ""), (10, " ".join(f"W{i}" for i in range(5, 20))), (None, "null named"), (2, "other words of two")]


def brute_hits(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        size = min(10, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[a : a + size])].add("" if i is None else str(i))
    out = {}
    for i, t in rows:
        w, names, hit = words(t, ALNUM), set(), set()
        for a in range(len(w)):
            for size in range(1, 11):
                if found := windows.get(tuple(w[a : a + size])) if a + size <= len(w) else None:
                    names |= found
                    hit |= set(range(a, a + size))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_decontamination(spark, docs_of, block_words):
    rows = [(1, "x " + " ".join(f"w{i}" for i in range(3, 14)) + " y"), (2, " ".join(f"w{i}" for i in range(9))), (3, "a TINY, item! tiny"), (4, None), (5, ""), (6, "null named"), (7, "w1 " * 50), (8, " ".join(f"w{i}" for i in range(25)) * 2)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(rows).withColumns({"spans": F.lit("own"), "n_words": F.lit(7)})
    found = decontam.find(docs, items, block_words=block_words)
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(found).collect()}
    assert got == brute_hits(rows, ITEMS)
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, v in got.items() if not v[4]}
    assert decontam.clean(docs, items.limit(0)).count() == len(rows) and decontam.clean(docs.limit(0), items).count() == 0


def test_deduplicate_and_remove_keep_any_column(docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, passage), (4, "start " + passage), (5, None)]
    docs = docs_of(rows).withColumns({"a.b": F.lit("dot"), "x`y": F.lit(1), "maps": F.array(F.create_map(F.lit("k"), F.lit(1)))})
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    cut = suffix_dedup.remove(docs)
    assert cut.columns == docs.columns and {(r["a.b"], r["x`y"]) for r in cut.collect()} == {("dot", 1)}
    assert {r.doc_id: r.text for r in cut.collect()}[4] == "start"


def test_copies_that_cross_task_borders(spark, docs_of):
    """A passage in many documents, each with words of its own before it: its groups span tasks."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, " ".join(f"{i}x{j}" for j in range(i % 40 + 1)) + " " + passage + f" {i}end") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: (r.n_repeated, r.n_removed) for r in suffix_dedup.summary(docs_of(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: (70, 70 if i else 0) for i in range(300)}


def test_saving_a_table_gives_the_drivers_heap_back(spark, monkeypatch):
    from spanloom.llm import _spark

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(_spark, "HEAP", 1.0)
    before = full()
    assert _spark.saved(spark.range(3).toDF("n"), "heap").count() == 3 and full() == before
    monkeypatch.setattr(_spark, "HEAP", 0.0)
    assert _spark.saved(spark.range(3).toDF("n"), "heap").count() == 3 and full() > before


def test_a_half_filled_heap_is_collected():
    """The driver's heap shares its memory with what lies outside it: half of what it may have is too much already."""
    called = []
    runtime = SimpleNamespace(totalMemory=lambda: 50, maxMemory=lambda: 100, gc=lambda: called.append(1))
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime))))
    _spark.shrink(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)))
    assert called
