"""URL rules, mixing, WARC, chat, token counts, fingerprints, toxicity and the pipeline."""

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import chat, mixing, queries, token_count, toxicity, url_filter, warc, winnow
from spanloom.llm.url_filter import RULES, Automaton, Rule

# ---------------------------------------------------------------- URL rules


def brute_rule(host, path, rules):
    best = None
    for i, r in enumerate(rules):
        h, slash, p = r.glob.partition("/")
        exact, p = p.endswith("$"), slash + p.removesuffix("$")
        rx = lambda g: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
        if re.fullmatch(rf"(?s)(.*\.)?{rx(h)}", host) and re.fullmatch("(?s)" + rx(p) + ("" if exact else ".*"), path):
            best = min(best or (1, 0), (-len(r.glob), i))
    return -1 if best is None else best[1]


def test_automaton_against_regular_expressions():
    rng = random.Random(1)
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    for n in range(12):
        rules = RULES if not n else tuple(Rule("block", some("ab.*?", 1, 4) + rng.choice(("", "/" + some("ab/*?", 0, 5) + rng.choice(("", "$"))))) for _ in range(40))
        urls = [(some("ab.", 0, 6), rng.choice(("", "/" + some("ab/", 0, 40)))) for _ in range(200)]
        urls += [("example.com", "/en/77"), ("x.com", "/en/"), ("com", "/en/7"), ("evil.net", "/x.com/en/"), ("", "")]
        got = Automaton(rules).judge(urls)
        assert got.tolist() == [brute_rule(h, p, rules) for h, p in urls]


def test_rules_are_those_of_the_contract(spark):
    assert [(r.verdict, r.glob) for r in RULES] == [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    urls = ["s://a.net/de/8", "s://www.example.net/de/8x", "s://example.net/de/7", "s://example.com/en/7", "s://example.com/en/8", "s://org/es/"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("org/es/", "block")]


def test_judged_urls(spark):
    urls = [None, "", "no scheme/com/en/", "https://A.EXAMPLE.com/en/7?x=/es/", "http://b.org/es/#a", "http://b.org?/es/", "a://b.com/en/", "a://com/en/\nx", "x" * 300_000, "s://" + "h" * 100_000 + ".net/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumns({"rule": F.lit("own"), "_rule": F.lit("kept"), "number": F.lit(7), "my col": F.lit(8), "row": F.lit(9)})
    got = [(r.host if len(r.host) < 99 else "long", r.path[:9], r.rule, r.verdict) for r in url_filter.judge_urls(pages).orderBy("page_id").collect()]
    none = ("", "", None, "allow")
    assert got == [none, none, none, ("a.example.com", "/en/7", "example.com/en/7", "allow"), ("b.org", "/es/", "org/es/", "block"), ("b.org", "", None, "allow"), ("b.com", "/en/", "com/en/", "block"), ("com", "/en/\nx", "com/en/", "block"), none, ("long", "/de/", "net/de/", "block")]
    assert {(r["_rule"], r["number"], r["my col"], r["row"]) for r in url_filter.judge_urls(pages).collect()} == {("kept", 7, 8, 9)}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    twice = url_filter.judge_urls(pages.where("page_id = 5").unionAll(pages.where("page_id = 5"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert url_filter.judge_urls(pages, ()).where("verdict = 'allow'").count() == len(urls)


# ---------------------------------------------------------------- mixing


def test_targets_and_permutations():
    assert [float(t) for t in mixing.targets([100, 100, 100], [1, 2, 3])] == [50, 100, 150]
    assert [float(t) for t in mixing.targets([100, 10, 10], [1, 1, 1])] == [60, 30, 30]
    for n in (1, 2, 3, 64, 1000):
        for key in (1, 9):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))) == list(range(n))


def test_mixture(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice((0, 5, 80, 700)))), rng.choice(("b", "a", None, "é") + ("hot",) * 4)) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "only empty"), (5, rows[5][1], rows[5][2]), (None, "x y", "a")]
    docs = docs_of(rows).withColumn("bucket", F.lit("own"))
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows) and [sorted(map(str, got)), 0] == [sorted(map(str, mixing.digest(docs).collect())), 0]
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert abs(target[s] - float(t)) < 1e-6 and abs(taken[s] - target[s]) <= max(mixing.BLOCK, 0.02 * target[s]), s
    assert {r.source_size for r in got if r.source == "hot"} == {sizes["hot"]}
    assert mixing.digest(docs.limit(0)).count() == 0
    m = mixing.mix(docs)
    assert m.output().groupBy("shard", "slot").agg(F.sum("words").alias("w")).where("w > 64").count() == 0


def test_picked_subsets():
    rng = np.random.Generator(np.random.PCG64(4))
    counts = np.array([3, 0, 500, 20_000, 10**12, 4 * 10**12], np.int64)
    for n in (0, 1, 64, 65, 10_000, 10**9, int(counts.sum()) - 5, int(counts.sum())):
        got = mixing.picked(counts, n, rng)
        assert got.sum() == n and (got >= 0).all() and (got <= counts).all()
    share = mixing.picked(counts, 10**12, rng)[4] / 10**12
    assert abs(share - 0.2) < 1e-5
    # every subset is as likely: hypergeometric mean and variance of a small case, above and below FEW
    for n in (20, 150):
        draws = np.array([mixing.picked(np.array([100, 200]), n, rng)[0] for _ in range(4000)])
        assert abs(draws.mean() - n / 3) < 0.2 and abs(draws.var() / (n * (1 / 3) * (2 / 3) * (300 - n) / 299) - 1) < 0.12


def test_draws_agree_whatever_their_range():
    wanted = np.array([1000, 0, 70_000, 333], np.int64)
    whole = list(mixing.drawn(wanted, 13, 0, 13))
    assert [s for s, _, _ in whole] == list(range(13)) and (sum(c for _, c, _ in whole) == wanted).all()
    done = np.zeros(4, np.int64)
    for s, c, before in whole:
        assert (before == done).all() and c.sum() == 71_333 * (s + 1) // 13 - 71_333 * s // 13
        [(again, own, first)] = list(mixing.drawn(wanted, 13, s, s + 1))
        assert again == s and (own == c).all() and (first == before).all()
        done += c


def test_taken_words_against_brute_force(docs_of, monkeypatch):
    rng = random.Random(12)
    rows = [(rng.choice((i, i, None, 7)), " ".join(f"w{i}" for _ in range(rng.choice((0, 1, 63, 64, 65, 300)))), rng.choice(("b", "a", None) + ("hot",) * 3)) for i in range(300)]
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    monkeypatch.setattr(mixing.slots, "__defaults__", (mixing.SEED, 40))
    m = mixing.mix(docs_of(rows))
    documents, slots = m.documents.collect(), m.slots.collect()
    total = sum(s.slots for s in m.sources)
    shards = -(-total // 40)
    assert len(documents) == len(rows) and len(slots) == total and shards > 3
    assert sorted({(s.shard, s.slot) for s in slots}) == [(h, n) for h in range(shards) for n in range(total * (h + 1) // shards - total * h // shards)]
    uses = {}
    for s in slots:
        uses[s.number, s["index"]] = uses.get((s.number, s["index"]), 0) + 1
    for source in m.sources:
        own = sorted((d.begin, d.begin + d["size"]) for d in documents if d.number == source.number)
        assert own[0][0] == 0 and own[-1][1] == source.size and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        counts = {uses.get((source.number, b), 0) for b in range(source.blocks)}
        assert sum(uses.get((source.number, b), 0) for b in range(source.blocks)) == source.slots
        assert not source.blocks or counts <= {source.slots // source.blocks, -(-source.slots // source.blocks)}
    taken = lambda d: sum(n * max(0, min(d.begin + d["size"], (b + 1) * 64) - max(d.begin, b * 64)) for (k, b), n in uses.items() if k == d.number)
    key = lambda d: (d.number, d.bucket, d.place)
    assert {key(d): d.taken for d in m.taken().collect()} == {key(d): taken(d) for d in documents}
    # the packed text is, block for block, each source's stream of words
    text = {(d, mark): t for d, mark, t in docs_of(rows).select("doc_id", F.xxhash64("text"), "text").collect()}
    stream = {}
    for d in sorted(documents, key=lambda d: (d.number, d.begin)):
        stream.setdefault(d.number, []).extend(text[d.doc_id, d.mark].split())
    packed = m.packed(docs_of(rows)).collect()
    assert sorted((r.shard, r.slot) for r in packed) == sorted((s.shard, s.slot) for s in slots)
    assert all(r.words.split() == stream[r.number][r["index"] * 64 : (r["index"] + 1) * 64] for r in packed)


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (9, "u", big), (10, "u", None), (11, "u", ""), (12, "u", "q" * 999), (13, "u", "q" * 999), (None, "n", big), (14, "u", "😀\r\n\r\nWARC/1.1" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("own"))
    got = {r.page_id: tuple(r)[1:] for r in warc.digest(pages).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == big and i != 9
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None)
    index = warc.write(pages)
    assert {(r.page_id, r.url) for r in index.collect()} == {(i, u) for i, u, _ in rows}
    picked = warc.fetch(index.where("page_id in (9, 14)"), payloads=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in picked} == {9: big, 14: rows[-1][2]}
    assert warc.digest(pages.limit(0)).count() == 0


def test_warc_of_large_payloads_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 3000)
    monkeypatch.setattr(warc, "PART_BYTES", 5000)
    rng = random.Random(2)
    rows = [(i, "u", "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((10, 900, 9000))))) for i in range(60)]
    rows += [(i, "hot", "same " * 400) for i in range(100, 140)] + [(139, "hot", "same " * 400), (3, "u", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"holder": F.lit(1), "my col": F.lit(2), "key": F.lit(3)})
    index = warc.write(pages.repartition(3)).cache()
    assert warc.fetch(index).rdd.getNumPartitions() == index.selectExpr("archive", "floor(offset / 5000)").distinct().count() > 3
    got = sorted(warc.digest(pages).collect(), key=lambda r: (r.page_id, r.payload_digest))
    assert [(r.page_id, r.payload_bytes, r.payload_digest) for r in got] == sorted((i, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id >= 100} == {(i, "revisit", 139) for i in range(100, 139)} | {(139, "response", None)}


def test_hadoop_paths():
    want = {"s3a://b/x": "s3://b/x", "wasbs://c@a/x": "abfs://c@a/x", "abfss://c@a/x": "abfs://c@a/x", "viewfs://n/x": "hdfs://n/x", "dbfs:/x": "file:///dbfs/x", "file:/x y": "file:///x y", "file:///x": "file:///x", "/x/y": "file:///x/y", "hdfs://n:1/x": "hdfs://n:1/x", "gs://b/x": "gs://b/x"}
    assert {k: warc.located(k) for k in want} == want


def test_ranges_coalesce_and_records_are_verified():
    offsets, lengths = np.array([0, 10, 20, 500_000]), np.array([10, 10, 10, 10])
    assert warc.ranges(offsets, lengths) == [(0, 3), (3, 4)] and warc.ranges(offsets, lengths, most=20) == [(0, 2), (2, 3), (3, 4)]
    raw = warc.record(-3, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.parse(raw)["page_id"] == -3
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"abc", b"abd"))


# ---------------------------------------------------------------- chat


def test_layouts(spark):
    rows = [
        ('{"prompt":"p","completion":"c"}', ["user:p", "assistant:c"]),
        ('{"output":"o","input":"","instruction":"i"}', ["user:i", "assistant:o"]),
        ('{"instruction":"i","input":"x","output":null}', ["user:i", "user:x", "assistant:"]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', ["user:h", "assistant:g"]),
        ('{"messages":[{"role":"system","content":"s"}]}', ["system:s"]),
        # metadata that no layout knows, empty lists, lists within lists, texts in parts
        ('{"messages":[{"role":"user","content":"n","name":"bo","meta":{"a":[[1]]}}],"id":7,"tags":["x"]}', ["user:n"]),
        ('{"messages":[]}', []),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}', ["user:ab"]),
        # names beyond letters: nothing of such a record may pass for another layout's field
        ('{"a-b":{"prompt":"nested"},"completion":"c"}', []),
        ('{"a-b":{"question":"nested"},"answer":"c"}', []),
        ('{"a-b":[{"x y":1}],"prompt":"p","completion":"c"}', ["user:p", "assistant:c"]),
        ('{"x":{"prompt":"p"},"completion":"c"}', []),
        ('{"messages.role":"r","messages.content":"c","messages":[{"role":"user"}]}', []),
        ('{"prompt":"p","completion":"c","response":"r"}', []),
        ('{"OBJECT<":1,"`":{"prompt: ":2},"question":"q","answer":"a"}', ["user:q", "assistant:a"]),
        ('{"unknown":1}', []), ("{}", []), (None, []), ("[1]", []), ("not json", []),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string")
    got = df.select("i", chat.turns_of_record(F.col("r")).alias("t"), chat.layout_of_record(F.col("r")).alias("name")).orderBy("i").collect()
    assert [[f"{x.role}:{x.text}" for x in r.t] for r in got] == [t for _, t in rows]
    assert [r.name is not None for r in got] == [bool(t) or r == '{"messages":[]}' for r, t in rows]
    with pytest.raises(Exception, match="no layout"):
        df.select(chat.turns_of_record(F.col("r"), strict=True)).collect()
    table = spark.createDataFrame([("q", "a", 1)], "question string, answer string, `my col` int")
    assert [x.role for x in table.select(chat.turns_of_schema(table).alias("t")).first().t] == ["user", "assistant"]


def test_row_layouts(spark):
    for names in (("conv_id", "turn", "role", "text"), ("thread_id", "message_index", "author", "body")):
        table = spark.createDataFrame([(1, 0, "user", "q", "x", 2)], f"`{names[0]}` long, `{names[1]}` int, `{names[2]}` string, `{names[3]}` string, content string, `my col` int")
        assert [tuple(r) for r in chat.rows_of_table(table).collect()] == [(1, 0, "user", "q")]
    aliased = spark.createDataFrame([(1, 0, "gpt", "q")], "id long, index int, `from` string, value string")
    assert chat.rows_of_table(aliased).first().role == "assistant"
    with pytest.raises(ValueError, match="no layout of rows"):
        chat.rows_of_table(table.withColumnRenamed("body", "said"))


def test_chat_of_very_long_texts_and_clashing_columns(spark):
    long = "[INST]" + "é\\" * 200_000
    table = spark.createDataFrame([(1, 0, "user", "q", "own"), (1, 1, "assistant", long, "own")], "conv_id long, turn long, role string, text string, head string").withColumns({"formatted": F.lit(1), "before": F.lit(2), "at": F.lit(3)})
    r = chat.digest(chat.format_turns(chat.rows_of_table(table))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_chat_round_trip(spark):
    odd = ["a\\<s>[/INST]\n<|turn|>x\\", None, "", "<|tur<|turn|>n|>\\<|end|>", "😀é", "\\", "<<SYS>>\\\\"]
    rows = [(i % 3 - 5, i // 3, ("assistant", "user", None, "<|text|>\\")[i % 4], odd[i % len(odd)]) for i in range(60)]
    rows += [(None, None, "assistant", "null"), (7, 1, "user", "tie b"), (7, 1, "user", "tie a"), (7, 1, "user", "tie a")]
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for c, turns in own.items():
        turns.sort()
        lines, learnt = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[c])[1:5] == (len(turns), sha(lines), len(learnt), sha(learnt)), c
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_turns(empty)).count() == 0


# ---------------------------------------------------------------- token counts


def brute_count(model, word):
    best, count = [0.0], [0]
    for i in range(1, len(word) + 1):
        s, k = best[i - 1] + model.unknown, count[i - 1] + len(word[i - 1].encode())
        for n in range(1, min(model.width, i) + 1):
            p = model.score.get(word[i - n : i])
            if p is not None and (n == 1 or best[i - n] + p >= s):
                s, k = best[i - n] + p, count[i - n] + 1
        best.append(s)
        count.append(k)
    return count[-1]


def test_trie_counts():
    model = token_count.Unigram([(p, -float(i)) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "abab", "ba", "é"], 1)])
    rng = random.Random(2)
    own = ["▁" + "".join(rng.choice("abcé😀") for _ in range(rng.choice((0, 1, 5, 30, 90)))) for _ in range(300)]
    assert model.counts(own).tolist() == [brute_count(model, w) for w in own]


def test_counted_documents(docs_of):
    pytest.importorskip("sentencepiece")
    model = token_count.load()
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *model.score.items()], 0, False))
    rows = [(1, "the cat  sat\non the mat"), (2, None), (3, ""), (4, " \t"), (5, "the " * 3000 + "x" * 5000), (1, "the cat"), (6, "日本語 😀")]
    docs = docs_of(rows).withColumns({"n_words": F.lit("own"), "my col": F.lit(1)})
    got = token_count.count_tokens(docs).select("row.doc_id", "row.text", "row.n_words", "n_tokens").collect()
    for r in got:
        assert r.n_words == "own" and r.n_tokens == sum(brute_count(model, "▁" + w) for w in (r.text or "").split())
    plain = "the cat sat on the mat and internationalisation".split()
    assert model.counts(["▁" + w for w in plain]).tolist() == [len(library.encode("▁" + w).ids) for w in plain]


# ---------------------------------------------------------------- fingerprints


def brute_prints(text, gram=16, window=64):
    def chain(values):
        h = 42
        for v in values:
            h = xxhash.xxh64(v, seed=h).intdigest()
        return h

    fours = [chain(c.encode() for c in text[i : i + 4]) for i in range(len(text))]
    grams = [chain(f.to_bytes(8, "little") for f in fours[i : i + 13 : 4]) >> 13 & ((1 << 50) - 1) for i in range(max(1, len(text) - gram + 1))] if text else []
    out = []
    for i in range(max(1, len(grams) - window + 1)) if grams else []:
        part = grams[i : i + window]
        pick = (min(part), i + max(j for j, x in enumerate(part) if x == min(part)))
        if not out or pick[1] != out[-1][1]:
            out.append(pick)
    return out


def edits_of(rows):
    ordered = sorted((i, t or "") for i, t in rows)
    for n, (i, t) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


def alike(p, q):
    a, b = {x for x, _ in p}, {x for x, _ in q}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("piece", [1 << 12, 100])
def test_winnowing(docs_of, monkeypatch, piece):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 10)
    monkeypatch.setattr(winnow, "PIECE", piece)
    rng = random.Random(6)
    rows = [(i * 7, " ".join(rng.choice(("a", "bb", "é", "x" * 40)) + str(rng.randrange(9)) for _ in range(rng.choice((0, 1, 3, 12, 20, 26, 30, 50, 200))))) for i in range(90)]
    rows += [(n, "".join(rng.choice("ab 日") for _ in range(size))) for n, size in enumerate((1, 15, 16, 17, 77, 78, 79, 80, 156, 157, 158, 159, 160, 316, 3000), 2001)]
    rows += [(1000, None), (1001, ""), (1002, "y" * 100), (1003, "a a a " * 300), (-4, "😀é b c"), (1004, "".join(rng.choice("xyz") for _ in range(9000)))]
    shown = lambda p: " ".join(f"{x:X}@{y}" for x, y in p)
    got = {r.doc_id: tuple(r)[1:] for r in winnow.digest(docs_of(rows).withColumns({"bucket": F.lit(1), "mark": F.lit(2), "my col": F.lit(3)})).collect()}
    assert len(got) == len(rows)
    for i, t, edited, after in edits_of(rows):
        a, b, c = brute_prints(t), brute_prints(edited), brute_prints(after)
        assert got[i] == (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c)), i


def test_winnowing_of_odd_tables(docs_of, monkeypatch):
    one = winnow.digest(docs_of([(1, "ab")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and one.near_next == 1.0
    assert winnow.digest(docs_of([]).limit(0)).count() == 0
    twice = winnow.digest(docs_of([(1, "a b c d e"), (1, "a b c d e"), (None, None)])).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice if r.doc_id == 1}) == 1
    # one id, and none, for most rows: they are dealt to buckets by their texts, and each meets the next by that order
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 4)
    rows = [(5, f"text {n} of five" * n) for n in range(40)] + [(None, f"no id {n}" * n) for n in range(40)] + [(n, f"own {n}") for n in range(10)]
    marks = {(r.doc_id, r.text): r.m for r in docs_of(rows).select("doc_id", "text", F.xxhash64("text").alias("m")).collect()}
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], marks[r]))
    want = []
    for n, (i, t) in enumerate(order):
        after, half = order[(n + 1) % len(order)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in winnow.digest(docs_of(rows)).collect())


def test_winnowing_of_a_very_long_text(docs_of):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    got = {r.doc_id: r for r in winnow.digest(docs_of([(1, long), (2, "é" + long)])).collect()}
    prints = [(int(x.split("@")[0], 16), int(x.split("@")[1])) for x in got[1].fingerprint.split()]
    assert prints == brute_prints(long) and got[1].near_next > 0.99 and 0.45 < got[1].near_edited < 0.55  # its own first half, twice


def test_few_hashes_go_in_passes(docs_of):
    """One comparison leaves about an eighteenth of a text's hashes to the passes, and every choice of a window among them."""
    rng = random.Random(3)
    for size in (65, 96, 97, 128, 4159):
        values = [rng.randrange(1 << 50) << 13 | 8191 - i for i in range(size)]
        low, least = docs_of([(1, "a")]).select(winnow._low(F.lit(values)), winnow._least(F.lit(values))).first()
        want = sorted({min(values[i : i + 64]) for i in range(size - 63)}, key=values.index)
        assert least == want and set(want) <= set(low) and (size < 4000 or len(low) < size / 12)


def test_match_guarantee(docs_of):
    rng = random.Random(1)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnop日é ") for _ in range(n))
    common = fresh(winnow.SPAN)
    docs = docs_of([(i, fresh(30 + 7 * i) + common + fresh(30)) for i in range(2)])
    a, b = (set(r.h) for r in winnow.fingerprints(docs).select(winnow.hashes(F.col("prints")).alias("h")).collect())
    assert a & b


# ---------------------------------------------------------------- toxicity and the pipeline


@pytest.fixture(scope="module")
def toxic_corpus(spark, docs_of):
    rng = random.Random(5)
    bad = [f"vile{x}" for x in ("a", "bo", "cu")] + ["moron"]
    rows, marks = [], []
    for i in range(900):
        own = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice((5, 40, 90)))]
        y = int(i % 6 == 0)
        for _ in range(2 * y):
            own[rng.randrange(len(own))] = rng.choice(bad)
        rows.append((i, " ".join(own)))
        marks.append((i, 1, y))
    rows += [(2000, None), (2001, ""), (2002, "z " * 20000 + "moron"), (3, rows[3][1])]
    marks += [(2000, 0, None), (4000, 0, 1), (3, 1, marks[3][2])]
    return docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark, toxic_corpus):
    docs, labels = toxic_corpus
    got = toxicity.digest(spark, docs.withColumn("score", F.lit("own")), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[2000] == by_id[2001] < 0.5 < by_id[2002]
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and 700 < left.count() < 800
    assert toxicity.reject(docs.limit(0), labels).count() == 0
    assert toxicity.reject(docs.limit(5), labels.limit(0)).count() == 5


def plain_score(model, text):
    """The network word by word, as it is written down: embeddings, filters, the greatest response, one logistic layer."""
    words_ = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    ids = toxicity.slots(toxicity._text.tokenize(toxicity.pa.array([" ".join(words_)]), toxicity._text.ALNUM))
    hidden = []
    for number, kernel in enumerate(model.kernels):
        for f in range(toxicity.FILTERS):
            replies = [sum(float(np.dot(model.embedding[h][ids[h, at + o]], kernel[o, h, :, f])) for o in range(len(kernel)) for h in range(toxicity.HASHES)) for at in range(len(words_) - len(kernel) + 1)]
            hidden.append(max(0.0, max(replies) + model.bias[number * toxicity.FILTERS + f]) if replies else 0.0)
    return 1 / (1 + np.exp(-(np.dot(hidden, model.out) + model.out_bias)))


def test_scores_against_a_plain_convolution():
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(n))
    own = [text(n) for n in (0, 1, 2, 3, 4, 5, 40, 200)] + [None, "!?", "Ünï çödé", "a" * 300]
    column = toxicity.pa.array(own, toxicity.pa.string())
    tokens = toxicity._text.tokenize(column, toxicity._text.ALNUM)
    every = toxicity.slots(tokens)
    model = toxicity.fit([(every[:, tokens.of(i)], i % 2) for i in range(len(own))] * 6, epochs=3)
    got = toxicity.score_texts(model, toxicity._split_tables(model), column)
    assert np.allclose(got, [plain_score(model, t) for t in own], atol=1e-5) and got.std() > 0.01


def test_calibration():
    rows = lambda *parts: [(s, y) for s, y, n in parts for _ in range(n)]
    usual = toxicity.DEFAULT_THRESHOLD
    low = toxicity.calibrate({"en": rows((0.95, 1, 30), (0.5, 1, 30), (0.1, 0, 60))})
    assert 0.3 <= low["en"] <= 0.5 and low[""] == usual  # lower where that is safe; no pooled rows, so the usual one for the rest
    high = toxicity.calibrate({"en": rows((0.95, 1, 30), (0.8, 0, 30)), None: rows((0.95, 1, 30), (0.8, 0, 30))})
    assert 0.8 < high["en"] < 0.95 and high[""] == high["en"]
    few = toxicity.calibrate({"es": rows((0.9, 1, 3), (0.1, 0, 90)), None: rows((0.95, 1, 30), (0.8, 0, 30), (0.1, 0, 90))})
    assert few["es"] == few[""] > 0.8
    never = toxicity.calibrate({"en": rows((0.9, 0, 40), (0.8, 1, 40))})
    assert never["en"] > 0.9
    ties = toxicity.calibrate({"en": rows((0.9, 1, 40), (0.9, 0, 40), (0.2, 0, 40))})
    assert ties["en"] > 0.9 and toxicity.calibrate({}) == {"": usual}


def test_all_labelled_words_are_learnt_from(spark, toxic_corpus, docs_of, monkeypatch):
    """Marks beyond any sample's bounds: late in a long text, and one of many rows in one of several parts."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    docs, labels = toxic_corpus
    seen = {}
    count = toxicity.start
    monkeypatch.setattr(toxicity, "start", lambda s, toxic, clean, rng: (seen.update(s=s, n=(toxic, clean)), count(s, toxic, clean, rng))[1])
    long = docs_of([(n, "z " * 5000 + f"late{n % 2}") for n in range(5000, 5060)])
    more = spark.createDataFrame([(n, 1, n % 2) for n in range(5000, 5060)], "doc_id long, quality int, toxic int")
    classifier = toxicity.train(docs.unionByName(long), labels.unionByName(more))
    truth = {r.doc_id: r.toxic for r in labels.unionByName(more).collect() if r.toxic is not None and r.doc_id != 4000}
    fitted = [y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(f"calibration {i}".encode()) % 5]
    assert seen["n"] == (sum(fitted), len(fitted) - sum(fitted)) and len(fitted) > 400
    late = toxicity.slots(toxicity._text.tokenize(toxicity.pa.array(["late1"]), toxicity._text.ALNUM))[0, 0]
    assert seen["s"][0, 1, late] == sum(i >= 5000 and y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(f"calibration {i}".encode()) % 5)
    got = toxicity.score(docs, classifier).select("row.doc_id", "score").collect()
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97


def test_sums_travel_in_small_rows_and_leave_no_shuffle_files(spark):
    size, many, fan = 3 * toxicity.SLICE + 5, 20, toxicity.FAN
    vector = lambda part: np.arange(size) * 0.5 + part

    def own(batches):
        for batch in batches:
            for part in batch["id"]:
                yield toxicity._sliced(part, vector(part))

    files = lambda: sum("shuffle_" in f.getName() for f in list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())))
    parts = spark.range(many, numPartitions=4).mapInPandas(own, toxicity._SLICES)
    assert parts.selectExpr("max(length(data))").first()[0] == 8 * toxicity.SLICE and many > fan
    before = files()
    assert np.array_equal(toxicity._summed(parts, many, size), sum(map(vector, range(many))))
    assert len(toxicity.saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts").collect()) == 7
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_sample_is_bounded_and_spread(spark, docs_of):
    docs = docs_of([(i, " ".join(f"w{i}x{n}" for n in range(i))) for i in range(300)] + [(5, "again")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(docs, labels, rows=50, words=100)
    assert len(got) == 50 and len({r.doc_id for r in got}) == 50 and max(r.doc_id for r in got) > 250
    assert all(len(r.words) == 2 * toxicity.HASHES * min(100, r.doc_id) for r in got if r.doc_id != 5)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got)
    weights = toxicity.by_language([(1, "en")] * 90 + [(1, "es")] * 10 + [(0, "en")] * 900)
    assert weights[0] < weights[95] <= 5 and weights[-1] == 1


def test_pipeline_against_brute_force(spark, tmp_path, toxic_corpus):
    """Every stage's decision over what is left, worked out plainly; scores come from the classifier that the stage trains."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_pairs import brute_components, brute_hits, brute_passages, corpus

    docs, labels = toxic_corpus
    rows = [(10_000 + (i or 0), t) for i, t in corpus(3)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(20_000 + i, f"{' '.join(f'own{i}x{n}' for n in range(30))} {' '.join(f'q{n}' for n in range(20))}") for i in range(3)]
    extra = spark.createDataFrame([(i, t, "en", "s2" if i % 3 else "s", 1) for i, t in rows], docs.schema)
    docs.where("doc_id < 300").dropDuplicates(["doc_id"]).union(extra).withColumn("_row", F.lit("own")).withColumn("my col", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, " ".join(f"q{i}" for i in range(3, 15)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    every = spark.read.parquet(str(tmp_path / "documents.parquet"))
    classifier = toxicity.train(every, labels)
    left = {r.doc_id: (r.text, r.source) for r in every.collect() if (plain_score(classifier.model, r.text) < classifier.thresholds.get(r.lang, classifier.thresholds[""]))}
    parts = brute_components([(i, t) for i, (t, _) in left.items()], 5, 80)
    left = {i: x for i, x in left.items() if parts[i][1] == i}
    found, _, removed = brute_passages([(i, t) for i, (t, _) in left.items()])
    kept = {}
    for (i, t), w in found.items():
        rest = [x for n, x in enumerate(w) if n not in removed[i, t]]
        if rest or not removed[i, t]:
            kept[i] = (" ".join(rest), left[i][1])
    hit = brute_hits([(i, t) for i, (t, _) in kept.items()], items)
    kept = {i: (len(t.split()), source) for i, (t, source) in kept.items() if not hit[i][4]}
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: (r["size"], r.source) for i, r in got.items()} == kept
    sizes = {}
    for size, source in kept.values():
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes)
    want = dict(zip(names, mixing.targets([sizes[n] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    for name in names:
        assert all(abs(r.target - float(want[name])) < 1e-6 and r.source_size == sizes[name] for r in got.values() if r.source == name)
        assert abs(sum(r.taken for r in got.values() if r.source == name) - float(want[name])) <= 64


def test_pipeline_over_odd_rows(spark, tmp_path, toxic_corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = toxic_corpus
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda i, side: " ".join(f"own{i}{side}{n}" for n in range(40))
    extra = spark.createDataFrame([(5000 + i, f"{own(i, 'a')} {passage} {own(i, 'b')}", "en", None, 9) for i in range(3)] + [(5100, " ".join(f"q{i}" for i in range(20)), "en", "s", 9), (None, None, None, None, None)], docs.schema)
    docs.union(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(3, 15)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] and len(pipeline.STAGES) == 5
    rows = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert 5100 not in rows and None in rows and 2002 not in rows
    assert sum(rows[5000 + i]["size"] for i in range(3)) == 140 + 80 + 80
    assert rows[2000]["size"] == 0 and all(r.taken <= 3 * r["size"] for r in rows.values())


def test_pipeline_over_empty_tables(spark, tmp_path, toxic_corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = toxic_corpus
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and json.dumps(queries.ORACLE_SQL)


def test_thresholds_of_many_languages(spark):
    """A dirty language column: one look-up, not an expression for each."""
    known = {"": 0.5} | {f"l{i}": 0.5 + i / 10_000 for i in range(3000)}
    classifier = toxicity.Classifier(None, known)
    rows = spark.createDataFrame([("l7",), ("l2999",), ("l0",), ("other",), (None,)], "lang string")
    got = {r.lang: r.t for r in rows.select("lang", toxicity.threshold_of(classifier, F.col("lang")).alias("t")).collect()}
    assert got == {"l7": known["l7"], "l2999": known["l2999"], "l0": 0.5, "other": 0.5, None: 0.5}


BARE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from spanloom.llm import merkle, mixing
from spanloom.operators import cluster
docs = spark.createDataFrame([(i, "some words", "en", "s", 10) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
assert mixing.digest(docs).count() == 4 and merkle.summary(docs).count() == 4
items = spark.createDataFrame([("s", 1, [1.0]), ("s", 2, [1.0])], "s string, id long, vector array<double>")
assert cluster.discover(items, ["s"], 0.3, 2).count() == 2
print("fine")
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    """No setting anywhere: a local session takes a temporary folder."""
    import os
    import subprocess
    import sys

    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", BARE], env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("fine"), run.stderr[-2000:]
