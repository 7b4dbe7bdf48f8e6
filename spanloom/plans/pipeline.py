"""The whole loop over a store: ingest, summarize, embed, discover, assign; and the views over it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, validate
from ..functions import providers
from ..operators import registry, stats, store as predicates
from ..operators.traces import assemble
from ..session import checkpointed
from ..sources.spans import good, read_spans, rejected
from ..sources.tables import Store
from ..streaming import staging

SCOPE = ["agent_id", "facet"]


@dataclass
class Assigned:
    assigned: int = 0
    residual: int = 0
    discovered: int = 0
    resolved: int = 0
    transitions: list[tuple[str, str, str]] = field(default_factory=list)


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config, store: Store | None = None, clock=lambda: datetime.now(timezone.utc), make_summarizer=providers.make_summarizer, embedder=None, labeler=None):
        self.spark, self.config, self.clock = spark, validate(config), clock
        self.store = store or Store(spark, config.table_root)
        self.make_summarizer = make_summarizer
        self.embedder = embedder or providers.make_embedder(config)
        self.labeler = labeler or providers.make_labeler(config)
        self.facets = [f.name for f in config.active_facets()]

    # -- stages

    def ingest(self, path: str, agent_id: str = "default", strict: bool = False) -> tuple[int, DataFrame]:
        """(new traces, rejected lines) of a file or folder of span lines."""
        spans = read_spans(self.spark, path, strict)
        return self.store.add("traces", assemble(good(spans), agent_id)), rejected(spans)

    def flush(self) -> int:
        return staging.flush(self.store, self.clock())

    def pending(self, agent_id: str | None = None, since: datetime | None = None) -> DataFrame:
        return predicates.needing_summaries(self.store.table("traces"), self.store.table("facet_summaries"), self.facets, agent_id, since)

    def summarize(self, limit: int | None = None, agent_id: str | None = None, since: datetime | None = None) -> tuple[int, DataFrame]:
        """(summarized traces, failures (trace_id, error)); the result is written once, so no call is paid for twice."""
        rows = self.pending(agent_id, since)
        rows = predicates.page(rows, limit) if limit is not None else rows
        found = checkpointed(providers.summarize(rows, self.config, self.make_summarizer))
        ok = found.where("error is null").select("trace_id", "facet", "summary", F.lit(None).cast("array<double>").alias("embedding"))
        self.store.put("facet_summaries", ok)
        return ok.select("trace_id").distinct().count(), found.where("error is not null").select("trace_id", "error")

    def embed(self) -> int:
        rows = checkpointed(providers.embed_pending(self.store.table("facet_summaries"), self.embedder))
        self.store.put("facet_summaries", rows)
        return rows.count()

    def pool(self) -> DataFrame:
        return predicates.unassigned_pool(self.store.table("facet_summaries"), self.store.table("traces"), self.store.table("assignments")).where(F.col("facet").isin(self.facets))

    def discover(self, scopes: DataFrame | None = None) -> int:
        """Cluster the unassigned pool of every scope (or of some) in one job; the number of new themes."""
        pool = self.pool()
        if scopes is not None:
            pool = pool.join(scopes.select(*SCOPE), SCOPE, "left_semi")
        least = self.config.min_cluster_size
        enough = pool.groupBy(*SCOPE).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*SCOPE)
        pool = checkpointed(pool.join(enough, SCOPE, "left_semi"))
        if pool.isEmpty():
            return 0
        now = self.clock()
        with self.store.transaction():
            first = self.store.next_theme_number(0)
            found, assigned = registry.discover(pool, None, first, now, self.config.merge_threshold, least, self.config.activate_after, self.config.max_exemplars, self.facets)
            found = checkpointed(found)
            if not isinstance(self.labeler, providers.StubLabeler):
                found = self._labelled(found, pool, assigned)
            n = found.count()
            self.store.next_theme_number(n)
            self.store.insert_new("themes", found)
            self.store.put("assignments", assigned)
        return n

    def _labelled(self, themes: DataFrame, pool: DataFrame, assigned: DataFrame) -> DataFrame:
        members = pool.join(assigned.where("theme_id is not null").select("trace_id", "facet", F.col("theme_id").alias("cluster")), ["trace_id", "facet"])
        labels = providers.label_clusters(members, self.labeler, SCOPE).select(F.col("cluster").alias("id"), "label", "description")
        return checkpointed(themes.drop("label", "description").join(labels, "id", "left").select(*themes.columns))

    def bootstrap(self) -> int:
        """Discovery for agents that have no theme yet."""
        agents = self.store.table("traces").select("agent_id").distinct().join(self.store.table("themes").select("agent_id").distinct(), "agent_id", "left_anti")
        scopes = agents.crossJoin(F.broadcast(self.spark.createDataFrame([(f,) for f in self.facets], "facet string")))
        return self.discover(scopes)

    def _assign_pool(self, pool: DataFrame, out: Assigned) -> None:
        now = self.clock()
        themes = self.store.table("themes")
        c = self.config
        with self.store.transaction():
            if c.assign_mode == "exact":
                events = checkpointed(registry.assign_exact(pool, themes, now, c.assign_threshold, c.activate_after, c.max_exemplars))
                assigned, changed, moved = registry.assignments_of(events), registry.themes_of(events), registry.transitions_of(events)
            else:
                assigned = checkpointed(registry.assign_frozen(pool, themes, c.assign_threshold))
                changed = checkpointed(registry.fold_frozen(themes, pool, assigned, now, c.activate_after, c.max_exemplars).join(assigned.where("theme_id is not null").select(F.col("theme_id").alias("id")).distinct(), "id", "left_semi"))
                was = themes.select(F.col("id").alias("theme_id"), F.col("state").alias("from_state"))
                moved = changed.select(F.col("id").alias("theme_id"), F.col("state").alias("to_state")).join(was, "theme_id").where("from_state <> to_state")
            self.store.put("assignments", assigned)
            ids = moved.select(F.col("theme_id").alias("id"))
            self.store.put("themes", registry.refresh_exemplars(changed, self.store.table("assignments"), ids, c.max_exemplars))
        counts = assigned.agg(F.count_if(F.col("theme_id").isNotNull()).alias("hit"), F.count_if(F.col("theme_id").isNull()).alias("rest")).first()
        out.assigned += counts.hit
        out.residual = out.residual or counts.rest
        out.transitions += [(r.theme_id, r.from_state, r.to_state) for r in moved.select("theme_id", "from_state", "to_state").collect()]

    def assign(self) -> Assigned:
        """Assign the pool; where the latest window leaves too much over, discover once and assign again; then sweep."""
        out = Assigned()
        pool = checkpointed(self.pool())
        if not pool.isEmpty():
            self._assign_pool(pool, out)
        needed = checkpointed(stats.needs_rediscovery(self.store.table("assignments"), self.config.rediscover_residual_share).where("needed").select(*SCOPE))
        if not needed.isEmpty():
            out.discovered = self.discover(needed)
            again = checkpointed(self.pool().join(needed, SCOPE, "left_semi"))
            if out.discovered and not again.isEmpty():
                self._assign_pool(again, out)
        if self.config.auto_resolve_after_empty_windows:
            swept = checkpointed(registry.sweep(self.store.table("assignments"), self.store.table("themes"), self.config.auto_resolve_after_empty_windows, self.clock()))
            out.resolved = swept.count()
            self.store.put("themes", swept)
        return out

    def analyze(self, path: str | None = None, limit: int | None = None) -> Assigned:
        if path:
            self.ingest(path)
        self.flush()
        self.summarize(limit)
        self.embed()
        self.bootstrap()
        return self.assign()

    # -- views

    def report(self) -> DataFrame:
        return stats.facet_report(self.store.table("assignments"), self.store.table("themes"))

    def delta(self, from_window: str | None = None, to_window: str | None = None) -> DataFrame:
        a = self.store.table("assignments")
        if from_window and to_window:
            pairs = a.select(*SCOPE).distinct().select(*SCOPE, F.lit(from_window).alias("from_window"), F.lit(to_window).alias("to_window"))
        else:
            pairs = stats.latest_pair(a)
        return stats.ordered(stats.deltas(a, self.store.table("themes"), pairs, self.config.delta_sigma))

    def check(self, fail_on: tuple[str, ...] = ("regression", "new"), min_share: float = 0.0, allow_partial: bool = False, from_window: str | None = None, to_window: str | None = None) -> dict:
        """Failing findings, notes, and whether the gate passes; uncovered traces block unless allowed."""
        rows = [r.asDict() for r in stats.check(self.delta(from_window, to_window), fail_on, min_share).collect()]
        bare = [r.asDict() for r in stats.uncovered(self.store.table("traces"), self.store.table("assignments"), len(self.facets)).collect()]
        failures = [r for r in rows if r["failed"]]
        return {"failures": failures, "notes": [r for r in rows if not r["failed"]], "uncovered": bare, "passed": not failures and (allow_partial or not bare)}

    def alerts(self) -> DataFrame:
        return stats.pending_alerts(self.store.table("assignments"), self.store.table("themes"), self.store.table("alert_log"))

    def mark_alerted(self, alerts: DataFrame) -> None:
        self.store.add("alert_log", alerts.select("agent_id", "theme_id", "event", "window", F.lit(self.clock()).alias("sent_at")))

    def change_theme(self, action, theme_id: str, *args) -> None:
        """``registry.resolve``, ``mute``, ``reopen`` or ``relabel`` on one theme."""
        self.store.put("themes", action(self.store.table("themes"), theme_id, self.clock(), *args))

    def estimate(self) -> dict:
        found = predicates.pending_stats(self.pending()).first()
        return providers.estimate_cost(found.traces, found.chars, self.config)
