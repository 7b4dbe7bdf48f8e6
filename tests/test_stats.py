"""Window statistics, clustering, registry, store, streaming and the whole loop."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.config import load
from spanloom.functions import vectors as V
from spanloom.operators import cluster, registry, stats, store
from spanloom.plans import export
from spanloom.plans.pipeline import Pipeline
from spanloom.schemas import ASSIGNMENT, THEME, columns
from spanloom.sources import demo
from spanloom.sources.tables import Store, StoreError
from spanloom.streaming import receiver, staging

NOW = datetime(2026, 7, 20, tzinfo=timezone.utc)


def theme(i, state="active", members=10, centroid=(1.0, 0.0), first="v1.2", last="v1.3"):
    return (i, "bot", "behavior", f"label {i}", "", state, list(centroid), members, [], NOW, NOW, first, last, None)


def add_window(rows, window, counts):
    for name, n in counts.items():
        rows += [(f"{window}-{name}-{k}", "bot", "behavior", None if name == "residual" else name, 0.9, window) for k in range(n)]


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    add_window(rows, "v1.2", {"A": 2, "B": 8, "residual": 90})
    add_window(rows, "v1.3", {"A": 11, "B": 8, "C": 4, "residual": 77})
    themes = [theme("A", "regressed", 300), theme("B", "active", 200), theme("C", "new", 41, first="v1.3"), theme("D", "active", 7)]
    return spark.createDataFrame(rows, ASSIGNMENT), spark.createDataFrame(themes, THEME)


def test_golden_delta(golden):
    a, t = golden
    rows = stats.ordered(stats.deltas(a, t, stats.latest_pair(a))).collect()
    assert [(r.theme_id, r.severity) for r in rows] == [("A", "regression"), ("C", "new"), ("B", "info")]
    assert (round(rows[0].from_share, 9), round(rows[0].to_share, 9), rows[0].sigmas) == (0.02, 0.11, 0.0)
    muted = t.withColumn("state", F.when(F.col("id") == "A", "muted").otherwise(F.col("state")))
    assert {r.theme_id for r in stats.deltas(a, muted, stats.latest_pair(a)).collect()} == {"B", "C"}
    head = stats.delta_summary(a, stats.latest_pair(a)).first()
    assert (head.from_total, head.to_total, head.from_residual_share, head.to_residual_share) == (100, 100, 0.9, 0.77)


def test_golden_report_and_alerts(spark, golden):
    a, t = golden
    rows = stats.facet_report(a, t).collect()
    assert [(r.theme_id, r.n, r.spark, r.is_new_here) for r in rows] == [("A", 11, "▂█", False), ("B", 8, "▄▄", False), ("C", 4, "▁█", True), ("D", 0, "", False)]
    log = spark.createDataFrame([], "agent_id string, theme_id string, event string, window string, sent_at timestamp")
    found = {(r.theme_id, r.event) for r in stats.pending_alerts(a, t, log).collect()}
    assert found == {("A", "regressed"), ("C", "new")}
    done = stats.pending_alerts(a, t, log).select("agent_id", "theme_id", "event", "window")
    assert stats.pending_alerts(a, t, done).count() == 0
    assert export.check_text({"failures": [], "notes": [], "uncovered": [], "passed": True}) == "check passed"


def test_sweep_needs_enough_windows(spark, golden):
    a, t = golden
    assert [r.id for r in stats.empty_windows(a, t, 1).collect()] == ["D"]
    assert stats.empty_windows(a, t, 2).count() == 0 and stats.empty_windows(a, t, 0).count() == 0
    swept = registry.sweep(a, t, 1, NOW).first()
    assert swept.state == "resolved" and "1 empty" in swept.note


def brute_upgma(vectors, threshold):
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] > threshold:
            break
        groups[best[1]] = sorted(groups[best[1]] + groups[best[2]])
        del groups[best[2]]
    return sorted(map(tuple, groups))


def test_average_linkage_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(15):
        x = rng.normal(size=(rng.integers(1, 25), 3)) + rng.integers(0, 2, (1, 3))
        assert sorted(map(tuple, cluster.agglomerate(x, 0.3))) == brute_upgma(x, 0.3)
    assert cluster.agglomerate(np.empty((0, 2))) == []
    with pytest.raises(ValueError):
        cluster.discover_vectors([[1.0], [1.0, 2.0]])


def test_distributed_discovery_equals_whole_set(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(6)[i] + rng.normal(0, 0.08, (20, 6)) for i in range(3)] + [rng.normal(size=(7, 6))])
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "scope string, id long, vector array<double>")
    got = {}
    for r in cluster.discover(rows, ["scope"], 0.35, 5).collect():
        got.setdefault(r.cluster, []).append(r.id)
    clusters, noise = cluster.discover_vectors(x.tolist(), 0.35, 5)
    assert sorted(got.pop(None, [])) == noise
    assert sorted(map(sorted, got.values())) == sorted(clusters)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster, []).append(r.id)
    return sorted(map(sorted, (v for k, v in out.items() if k is not None))), sorted(out.get(None, []))


def test_mergers_in_rounds_equal_the_matrix(spark, monkeypatch):
    """One component of unlike groups, noise at its rim, and copies; rounds down to a handful of groups."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=6) * 0.6 + rng.normal(0, 0.35, (n, 6)) + 0.5 for n in (90, 60, 40, 30, 20)] + [rng.normal(size=(20, 6)), np.zeros((1, 6))])
    clusters, noise = cluster.discover_vectors(x.tolist(), 0.2, 4)
    rows = spark.createDataFrame([("s", f"i{i:04d}", v.tolist()) for i, v in enumerate(x)], "scope string, id string, vector array<double>")
    monkeypatch.setattr(cluster, "DIRECT", 0)
    monkeypatch.setattr(cluster, "LOCAL", 180)
    monkeypatch.setattr(cluster, "BLOCK", 100)
    found, rest = grouped(cluster.discover(rows, ["scope"], 0.2, 4).collect())
    name = lambda group: [f"i{i:04d}" for i in group]
    assert len(clusters) > 4 and found == sorted(map(name, clusters)) and rest == name(noise)


def test_rounds_leave_size_estimates_as_they_are(spark, monkeypatch):
    """A checkpoint kept its plan's estimate, a product over all joins before it: its digits grew fourfold a round, until they filled the driver."""
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    rng = np.random.default_rng(17)
    x = rng.normal(size=(60, 6))
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "scope string, id long, vector array<double>")
    sizes, nearest = [], cluster._nearest
    monkeypatch.setattr(cluster, "LOCAL", 12)
    monkeypatch.setattr(cluster, "_nearest", lambda live, *a: sizes.append(size(live)) or nearest(live, *a))
    live, final, heads = cluster.merged(cluster.packed(rows, ["scope"], ["id"]), ["scope"], 0.7)
    assert len(sizes) > 3 and max(sizes) < 1 << 63
    assert live.unionByName(final).agg({"n": "sum"}).first()[0] == heads.count() == 60
    links = spark.createDataFrame([("s", i, i + 1) for i in range(59)], "scope string, a long, b long")
    found = cluster.components(rows, links, ["scope"])
    assert {r.root for r in found.collect()} == {0} and size(found) < 1 << 63


def test_copies_need_no_rounds_of_their_own(spark, monkeypatch):
    """Of m copies only two were nearest to each other, so m copies took m rounds."""
    rng = np.random.default_rng(13)
    x = np.concatenate([np.repeat(rng.normal(size=(2, 6)), 20, axis=0), rng.normal(size=(12, 6)), np.zeros((3, 6))])
    clusters, noise = cluster.discover_vectors(x.tolist(), 0.3, 2)
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "scope string, id long, vector array<double>")
    rounds, nearest = [], cluster._nearest
    monkeypatch.setattr(cluster, "LOCAL", 2)
    monkeypatch.setattr(cluster, "_nearest", lambda *a: rounds.append(1) or nearest(*a))
    live, final, heads = cluster.merged(cluster.packed(rows, ["scope"], ["id"]), ["scope"], 0.3)
    groups = {}
    for r in heads.collect():
        groups.setdefault(r.head, []).append(r.id)
    sizes = {r.id: r.n for r in live.unionByName(final).collect()}
    assert len(rounds) < 12 and sizes == {k: len(v) for k, v in groups.items()}
    assert sorted(sorted(v) for v in groups.values() if len(v) > 1) == sorted(clusters) and sorted(v[0] for v in groups.values() if len(v) == 1) == noise


def test_where_caps_rule_out_little_blocks_are_few(spark, monkeypatch):
    """64 pivots made 64 blocks at least, and each vector went to all of them."""
    monkeypatch.setattr(cluster, "BLOCK", 30)
    x = np.random.default_rng(14).normal(size=(600, 8))
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "scope string, id long, vector array<double>")
    blocks = cluster.capped(cluster.packed(rows, ["scope"], ["id"]), ["scope"])
    wide, pairs = cluster.widened(blocks, cluster.block_pairs(blocks, ["scope"], 0.35), ["scope"])
    assert blocks.select("block").distinct().count() > 2 * cluster.FEW
    assert wide.select("block").distinct().count() == cluster.FEW and pairs.count() == cluster.FEW * (cluster.FEW + 1) // 2 and wide.count() == 600
    roots = lambda links: {r.id: r.root for r in cluster.components(rows, links, ["scope"]).collect()}
    assert roots(cluster.edges(rows, ["scope"], 0.15, spanning=True)) == roots(cluster.edges(rows, ["scope"], 0.15))


def test_groups_are_linked_by_their_sums():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 5)) + 0.8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for cut in (0.05, 0.1):
        first = cluster.agglomerate(x, cut)
        sums, sizes = np.array([unit[g].sum(axis=0) for g in first]), np.array([len(g) for g in first])
        again = [sorted(i for k in g for i in first[k]) for g in cluster.agglomerate(sums, 0.25, sizes)]
        assert sorted(again) == sorted(cluster.agglomerate(x, 0.25))


def test_caps_leave_most_block_pairs_out(spark, monkeypatch):
    rng = np.random.default_rng(13)
    centers = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    x = np.concatenate([c + rng.normal(0, 0.03, (30, 24)) for c in centers])
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)] + [("t", i, v.tolist()) for i, v in enumerate(x[:50])], "scope string, id long, vector array<double>")
    plain = {(r.scope, r.a, r.b) for r in cluster.edges(rows, ["scope"], 0.35).collect()}
    monkeypatch.setattr(cluster, "BLOCK", 20)
    blocks = cluster.capped(cluster.packed(rows, ["scope"], ["id"]), ["scope"])
    n = blocks.where("scope = 's'").select("block").distinct().count()
    kept = cluster.block_pairs(blocks, ["scope"], 0.35).where("scope = 's'").count()
    assert n >= 24 and kept < n * (n + 1) / 2 / 4
    assert {(r.scope, r.a, r.b) for r in cluster.edges(rows, ["scope"], 0.35).collect()} == plain and len(plain) > 24 * 30 * 29 / 2


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0])], "k string, v array<double>")
    means = {r.k: r.centroid for r in V.mean_vectors(rows, ["k"], "v").collect()}
    assert means == {"a": [0.5, 0.5], "b": [0.0, 0.0]}
    one = rows.select(V.cosine(F.col("v"), F.lit([1.0, 0.0])).alias("c"), V.normalize(F.col("v")).alias("n")).collect()
    assert [r.c for r in one] == [1.0, 0.0, 0.0] and one[2].n == [0.0, 0.0]
    with pytest.raises(Exception, match="differ in size"):
        rows.select(V.dot(F.col("v"), F.lit([1.0]))).collect()
    tied = spark.createDataFrame([("T-2", [1.0, 0.0]), ("T-10", [1.0, 0.0])], "theme_id string, centroid array<double>")
    items = spark.createDataFrame([(1, [2.0, 0.0])], "item_id long, vector array<double>")
    assert V.nearest(items, tied).first().theme_id == "T-10"


def replay(pool, themes, threshold, activate):
    """The order-dependent rule, row by row."""
    themes = [dict(zip(columns(THEME), t, strict=True)) for t in sorted(themes)]
    out = {}
    for trace_id, _, _, v, window in sorted(pool):
        sims = [float(np.dot(t["centroid"], v) / (np.linalg.norm(t["centroid"]) * np.linalg.norm(v))) for t in themes]
        at = int(np.argmax(sims))
        if sims[at] < threshold:
            out[trace_id] = None
            continue
        t = themes[at]
        n = t["member_count"]
        t["centroid"] = ((np.array(t["centroid"]) * n + v) / (n + 1)).tolist()
        t["member_count"], t["last_seen_window"] = n + 1, window
        t["state"] = registry.next_state(t["state"], n + 1, activate)
        out[trace_id] = t["id"]
    return out, {t["id"]: t for t in themes}


def test_exact_and_frozen_assignment(spark):
    rng = np.random.default_rng(8)
    pool = [(f"t{i:02d}", "bot", "behavior", (np.eye(2)[i % 2] + rng.normal(0, 0.25, 2)).tolist(), f"w{i % 3}") for i in range(40)]
    known = [theme("A", "resolved", 3, (1.0, 0.0)), theme("B", "new", 8, (0.0, 1.0))]
    p = spark.createDataFrame(pool, "trace_id string, agent_id string, facet string, embedding array<double>, window string")
    t = spark.createDataFrame(known, THEME)
    events = registry.assign_exact(p, t, NOW, 0.9, 10).cache()
    want, after = replay(pool, known, 0.9, 10)
    assert {r.trace_id: r.theme_id for r in registry.assignments_of(events).collect()} == want
    got = {r.id: r for r in registry.themes_of(events).collect()}
    for name, w in after.items():
        assert (got[name].member_count, got[name].state, got[name].last_seen_window) == (w["member_count"], w["state"], w["last_seen_window"])
        assert np.allclose(got[name].centroid, w["centroid"])
    assert {(r.from_state, r.to_state) for r in registry.transitions_of(events).collect()} == {("resolved", "regressed"), ("new", "active")}
    frozen = registry.assign_frozen(p, t, 0.9)
    folded = {r.id: r for r in registry.fold_frozen(t, p, frozen, NOW, 10).collect()}
    for name, row in folded.items():
        mine = [v for i, _, _, v, _ in pool if {r.trace_id: r.theme_id for r in frozen.collect()}[i] == name]
        n = {"A": 3, "B": 8}[name]
        c = {"A": [1.0, 0.0], "B": [0.0, 1.0]}[name]
        assert row.member_count == n + len(mine) and np.allclose(row.centroid, (np.array(c) * n + np.sum(mine, axis=0)) / (n + len(mine)))
        assert len(row.exemplar_trace_ids) == 5


def test_store_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([theme("A"), theme("B")], THEME)
    s.insert_new("themes", rows)
    with pytest.raises(StoreError):
        s.insert_new("themes", rows.limit(1))
    a = []
    add_window(a, "v1.2", {"A": 2, "residual": 1})
    assert s.add("assignments", spark.createDataFrame(a, ASSIGNMENT)) == 3
    assert s.add("assignments", spark.createDataFrame(a, ASSIGNMENT)) == 0
    s.delete_theme("A")
    assert s.table("themes").count() == 1 and s.table("assignments").where("theme_id is null").count() == 3
    with pytest.raises(RuntimeError, match="halfway"), s.transaction():
        assert s.next_theme_number(2) == 1
        s.put("themes", registry.mute(s.table("themes"), "B", NOW))
        raise RuntimeError("halfway")
    again = Store(spark, str(tmp_path / "s"))
    assert again.table("themes").first().state == "active" and again.snapshot.theme_seq == 0
    again.set_meta("k", "v")
    again.compact("themes")
    assert again.get_meta("k") == "v" and again.table("themes").count() == 1
    with pytest.raises(KeyError):
        registry.resolve(again.table("themes"), "nope", NOW)


def test_stream_stages_and_settles(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    landing = tmp_path / "landing"
    landing.mkdir()
    spans, _ = demo.span_lines(4, 1)
    receiver.land(str(landing), spans[:5])
    receiver.land(str(landing), spans[3:])
    q = staging.run(s, str(landing), str(tmp_path / "cp"), settle=timedelta(hours=1), once=True)
    assert q.awaitTermination(120)
    assert staging.pending_count(s) == len(spans) and s.table("traces").count() == 0
    later = datetime.now(timezone.utc) + timedelta(hours=2)
    assert staging.flush(s, later) == 8 and staging.pending_count(s) == 0
    from spanloom.sources.spans import parse_lines
    import json

    late = parse_lines(spark.createDataFrame([(1, json.dumps(spans[0] | {"span_id": "late"}))], "line_no long, value string"))
    assert staging.stage(s, late, later) == 1
    assert staging.flush(s, later + timedelta(hours=2)) == 0 and s.table("traces").count() == 8


def test_receiver_statuses():
    head = {"content-type": "application/json"}
    good, rejected = receiver.accept(b'{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"a"},{"x":1}]}]}]}', head)
    assert (len(good), rejected) == (1, 1)
    for status, raw, headers, token in ((415, b"{}", {"content-type": "text/plain"}, None), (400, b"{", head, None), (401, b"{}", head, "t"), (415, b"{}", head | {"content-encoding": "br"}, None), (400, b"x", head | {"content-encoding": "gzip"}, None)):
        with pytest.raises(receiver.Refused) as e:
            receiver.accept(raw, headers, token)
        assert e.value.status == status
    with pytest.raises(receiver.Refused):
        receiver.body_of(b"x" * 10, None, 5)


def test_planted_failure_end_to_end(spark, tmp_path):
    p = Pipeline(spark, load(env={}, overrides={"table_root": str(tmp_path / "t"), "embeddings": {"dimensions": 128}}), clock=lambda: NOW)
    traces, truth = demo.demo_traces(spark, 60, 424242)
    assert p.store.add("traces", traces) == 120
    assert p.summarize()[0] == 120 and p.embed() == 480
    assert p.bootstrap() > 0 and p.pending().count() == 0
    looped = {r.trace_id for r in truth.where("scenario = 'search-retry-loop'").collect()}
    found = p.store.table("themes").where("facet = 'behavior' and label like 'tool: %(recurs)%'").orderBy(F.desc("member_count")).first()
    members = {r.trace_id for r in p.store.table("assignments").where(F.col("theme_id") == found.id).collect()}
    assert len(members & looped) / len(members) > 0.95 and len(members & looped) / len(looped) > 0.9
    delta = {r.theme_id: r for r in p.delta().collect()}
    assert delta[found.id].severity in ("notable", "new") and delta[found.id].delta > 0.1
    p.change_theme(registry.resolve, found.id, "fixed")
    assert {r.severity for r in p.delta().where(F.col("theme_id") == found.id).collect()} == {"regression"}
    assert not p.check()["passed"] and export.delta_text([r.asDict() for r in p.delta().collect()]).startswith("  regression")
    s = p.store
    out = export.export_theme(s.table("traces"), s.table("facet_summaries"), s.table("themes"), s.table("assignments"), found.id, 3)
    assert len(out["cases"]) == 3 and "(recurs)" in out["scorerPrompt"] and export.render_export(out, "jsonl").count("\n") == 3
    with pytest.raises(KeyError):
        export.export_theme(s.table("traces"), s.table("facet_summaries"), s.table("themes"), s.table("assignments"), "nope")
    api = export.Api(p)
    agent, facet, windows = api.scope(facet="behavior")
    assert len(windows) > 1 and {r["window"] for r in api.themes(agent, facet, windows[0])} == {windows[0]}
    assert {r["facet"] for r in api.delta(agent=agent, facet=facet)} == {"behavior"}
    for ask, there in ((lambda: api.themes("no one"), agent), (lambda: api.themes(facet="mood"), "behavior"), (lambda: api.themes(window="w?", facet="behavior"), windows[0]), (lambda: api.delta("w?", windows[1], facet="behavior"), windows[0])):
        with pytest.raises(export.NotFound, match=there):
            ask()


def test_views_of_written_counts_are_those_of_the_assignments(spark):
    rows = [(f"{w}{i}", "a", "f", None if i % 4 == 0 else f"T-{i % 3}", 0.5, w) for w, n in (("w1", 9), ("w2", 17), ("w3", 30)) for i in range(n)]
    a = spark.createDataFrame(rows, ASSIGNMENT)
    c = stats.counted(a)
    themes = spark.createDataFrame([("a", "f", f"T-{i}", "l", "active", 3, "w1") for i in range(3)], "agent_id string, facet string, id string, label string, state string, member_count int, first_window string")
    same = lambda f: sorted(map(str, f(a).collect())) == sorted(map(str, f(c).collect()))
    for view in (stats.windows, stats.residual_share, stats.latest_pair, stats.all_pairs, stats.grid, lambda x: stats.deltas(x, themes, stats.all_pairs(x)), lambda x: stats.facet_report(x, themes)):
        assert same(view)


def test_nearest_in_blocks_and_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=8).tolist() if i else [0.0] * 8) for i in range(60)], "item_id long, s string, vector array<double>")
    themes = spark.createDataFrame([(f"T-{i}", "ab"[i % 2], rng.normal(size=8).tolist()) for i in range(7)] + [("T-9", "a", [1.0] * 8), ("T-8", "a", [2.0] * 8)], "theme_id string, s string, centroid array<double>")
    for scope in ([], ["s"]):
        blocks = {r.item_id: r for r in V.nearest(items, themes, scope=scope).collect()}
        with monkeypatch.context() as m:
            m.setattr(V, "HELD_BYTES", 0)
            pairs = {r.item_id: r for r in V.nearest(items, themes, scope=scope).collect()}
        assert {i: r.theme_id for i, r in blocks.items()} == {i: r.theme_id for i, r in pairs.items()} and len(blocks) == 60
        assert all(abs(r.similarity - pairs[i].similarity) < 1e-12 for i, r in blocks.items())
    assert V.nearest(items.limit(0), themes).count() == 0 and V.nearest(items, themes.limit(0)).count() == 0


def test_narrow_and_wide_scopes_are_clustered_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 12))
    rows = [(s, f"{s}{i:03d}", (centers[i % 4] + rng.normal(size=12) * 0.1).tolist()) for s, n in (("x", 40), ("y", 9)) for i in range(n)]
    items = spark.createDataFrame(rows, "s string, id string, vector array<double>")
    direct = sorted(map(tuple, cluster.discover(items, ["s"], 0.3, 3).collect()), key=str)
    for limit in (0, 20):
        monkeypatch.setattr(cluster, "DIRECT", limit)
        assert sorted(map(tuple, cluster.discover(items, ["s"], 0.3, 3).collect()), key=str) == direct


def test_small_predicates(spark):
    t = spark.createDataFrame([("a", "bot", "v1", NOW), ("b", "bot", None, NOW)], "id string, agent_id string, version string, started_at timestamp")
    assert (store.window_for(t, "a"), store.window_for(t, "b"), store.window_for(t, "c")) == ("v1", NOW.strftime("%Y-%m-%d"), None)
    s = spark.createDataFrame([("a", "goal"), ("b", "goal"), ("a", "outcome")], "trace_id string, facet string")
    assert [r.facet for r in store.distinct_facets(s).collect()] == ["goal", "outcome"]
    assert (store.counts(s).first().n, store.counts(s, facet="goal", trace_id=None).first().n) == (3, 2)


def test_old_snapshots_and_compaction(spark, tmp_path):
    from spanloom.sources.tables import Snapshot, migrate

    old = migrate(Snapshot(4, 1, 7, {"assignments": ["x"], "themes": ["y"]}))
    assert (old.schema_version, old.folders, old.theme_seq) == (3, {"alert_log": [], "assignments": [], "themes": ["y"]}, 7)
    s = Store(spark, str(tmp_path / "t"))
    for i in range(5):
        s.set_meta(f"k{i % 2}", str(i))
    s.compact_beyond("meta", 5)
    assert len(s.snapshot.folders["meta"]) == 5
    s.compact_beyond("meta", 4)
    assert len(s.snapshot.folders["meta"]) == 1 and (s.get_meta("k0"), s.get_meta("k1")) == ("4", "3")


def test_deviations_leave_one_window_out(spark):
    rng = np.random.default_rng(21)
    counts = {t: rng.integers(0, 9, 7) for t in ("A", "B", "C")} | {"E": np.array([3, 0, 0, 0, 0, 0, 0])}
    counts["R"] = 40 - sum(counts.values())  # all windows hold forty
    rows = [("bot", "goal", f"w{w}", None if t == "R" else t) for t, ns in counts.items() for w, n in enumerate(ns) for _ in range(n)]
    a = spark.createDataFrame(rows, "agent_id string, facet string, window string, theme_id string")
    t = spark.createDataFrame([("bot", "goal", x, x, "active") for x in counts], "agent_id string, facet string, id string, label string, state string")
    found = stats.deltas(a, t, stats.all_pairs(a)).collect()
    for r in found:
        shares = counts[r.theme_id] / 40
        i, j = int(r.from_window[1]), int(r.to_window[1])
        assert (r.from_count, r.to_count) == (counts[r.theme_id][i], counts[r.theme_id][j]) and math.isclose(r.delta, shares[j] - shares[i], abs_tol=1e-12)
        assert math.isclose(r.deviation, np.std(np.delete(shares, j), ddof=1), abs_tol=1e-12)
    assert {r.deviation for r in found if r.theme_id == "E" and r.to_window == "w0"} == {0.0}
    assert len(found) == sum(counts[x][i] + counts[x][j] > 0 for x in "ABCE" for i in range(7) for j in range(7) if i != j)
    missing = spark.createDataFrame([("bot", "goal", "w0", "w9")], "agent_id string, facet string, from_window string, to_window string")
    assert {(r.theme_id, r.to_count) for r in stats.deltas(a, t, missing).collect()} == {(x, 0) for x in "ABCE" if counts[x][0]}


def test_traces_settle_inside_the_stream(spark, tmp_path):
    """Duplicates, a restart from the checkpoint, and a span that comes late."""
    import json
    import time

    from spanloom.sources.tables import Store
    from spanloom.streaming import settling

    landing = tmp_path / "landing"
    landing.mkdir()
    span = lambda t, i: json.dumps({"trace_id": t, "span_id": i, "name": "chat", "start_time": 1000, "attributes": {"gen_ai.prompt": f"hi {i}"}})

    def arrive(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        (tmp_path / name).rename(landing / name)

    def until(query, done):
        end = time.monotonic() + 240
        while not done() and time.monotonic() < end:
            assert query.exception() is None
            time.sleep(1)
        query.stop()

    start = lambda: (s := Store(spark, str(tmp_path / "t")), settling.run(s, str(landing), str(tmp_path / "checkpoint"), timedelta(seconds=2), poll="1 second"))
    arrive("a.jsonl", span("t1", "1"), span("t1", "1"), span("t1", "2"), span("t2", "1"), "not json")
    store_, query = start()
    until(query, lambda: store_.table("traces").count() == 2)
    arrive("b.jsonl", span("t1", "3"), span("t3", "1"))
    store_, query = start()
    until(query, lambda: store_.table("traces").count() == 3 and store_.table("late_spans").count() == 1)
    assert {r.id: r.meta.span_count for r in store_.table("traces").collect()} == {"t1": 2, "t2": 1, "t3": 1}
    assert [(r.trace_id, r.span_key) for r in store_.table("late_spans").collect()] == [("t1", "3")]
