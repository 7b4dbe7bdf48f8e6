"""Window statistics over the assignment table: counts, shares, series, deltas, report, check, alerts.

Every view is a function of the same counts, for all agents and facets at once. The fact table is shuffled
on (agent, facet, window, theme), after partial aggregation; what follows works on the counts, whose
size is themes times windows and not the number of traces. Views take the assignments themselves or ``Counts``, what
``counted`` has made of them: that is written once, so that several views scan the assignments once. Windows are ordered by their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sparkline
from ..session import checkpointed

SCOPE = ["agent_id", "facet"]
#: No change below this share counts as exceeding a theme's history.
FLOOR = 0.01
SEVERITIES = ("regression", "new", "notable", "info")


def counts_by_window(assignments: DataFrame) -> DataFrame:
    """(agent_id, facet, window, theme_id, n, total): theme_id null for the residual, total over all."""
    counts = assignments.groupBy(*SCOPE, "window", "theme_id").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*SCOPE, "window")))


@dataclass(frozen=True)
class Counts:
    """Counts by (agent_id, facet, window, theme_id), for views in place of the assignments."""

    rows: DataFrame


def counted(assignments: DataFrame) -> Counts:
    """The counts, written and read again: what all views of one call start from."""
    return Counts(checkpointed(counts_by_window(assignments)))


def _counts(given: DataFrame | Counts) -> DataFrame:
    return given.rows if isinstance(given, Counts) else counts_by_window(given)


def windows(assignments: DataFrame) -> DataFrame:
    """Distinct windows of each scope, with their totals and residual counts."""
    residual = F.coalesce(F.sum(F.when(F.col("theme_id").isNull(), F.col("n"))), F.lit(0).cast("long"))
    return _counts(assignments).groupBy(*SCOPE, "window").agg(F.sum("n").alias("total"), residual.alias("residual"))


def residual_share(assignments: DataFrame) -> DataFrame:
    return windows(assignments).withColumn("share", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("residual") / F.col("total")))


def latest_windows(assignments: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` windows of each scope, place 1 the latest."""
    rank = Window.partitionBy(*SCOPE).orderBy(F.desc("window"))
    return windows(assignments).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= n)


def latest_pair(assignments: DataFrame) -> DataFrame:
    """(agent_id, facet, from_window, to_window) of scopes that have two windows or more."""
    last = latest_windows(assignments).groupBy(*SCOPE).agg(F.max_by("window", -F.col("place")).alias("to_window"), F.max_by("window", "place").alias("from_window"), F.count("*").alias("n"))
    return last.where("n = 2").select(*SCOPE, "from_window", "to_window")


def all_pairs(assignments: DataFrame) -> DataFrame:
    """Every ordered pair of different windows of a scope: as many as the snapshot publishes."""
    own = windows(assignments).select(*SCOPE, F.col("window"))
    left, right = own.withColumnRenamed("window", "from_window"), own.withColumnRenamed("window", "to_window")
    return left.join(right, SCOPE).where("from_window <> to_window")


def grid(assignments: DataFrame) -> DataFrame:
    """Dense: each theme seen in a scope in each of its windows, zeros included."""
    counts = _counts(assignments)
    own = counts.groupBy(*SCOPE, "window").agg(F.max("total").alias("total"))
    themes = counts.where("theme_id is not null").select(*SCOPE, "theme_id").distinct()
    dense = themes.join(own, SCOPE).join(counts.drop("total"), [*SCOPE, "window", "theme_id"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return dense.select(*SCOPE, "theme_id", "window", n.alias("n"), "total", (n / F.col("total")).alias("share"))


def theme_series(assignments: DataFrame) -> DataFrame:
    return grid(assignments)


def _others_deviation(points: Column, at: Column) -> Column:
    """Sample deviation of all shares but the one at place ``at``: 0 below two points, and exactly 0 where they are equal."""

    def more(state, share):
        n = state["n"] + 1.0
        step = share - state["mean"]
        mean = state["mean"] + step / n
        return F.struct(n.alias("n"), mean.alias("mean"), (state["square"] + step * (share - mean)).alias("square"))

    others = F.transform(F.filter(points, lambda p, i: i != at), lambda p: p["share"])
    none = F.lit(0.0)
    start = F.struct(none.alias("n"), none.alias("mean"), none.alias("square")).cast("struct<n:double,mean:double,square:double>")
    return F.aggregate(others, start, more, lambda s: F.when(s["n"] > 1, F.sqrt(s["square"] / (s["n"] - 1))).otherwise(none))


def deltas(assignments: DataFrame | Counts, themes: DataFrame, pairs: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Findings for each (scope, from_window, to_window): change of share against the theme's history.

    History holds the theme's shares in all windows but the later one, zeros included; its sample
    deviation is 0 below two points. Themes that are unknown or muted are passed over.

    A theme is one row, its points an array in order of windows. It meets the later windows that are asked for, which gives a deviation for
    each, and unfolds into their earlier windows from there: T x W rows are joined, and the T x W x W of a report of all pairs are only made.
    """
    dense = grid(assignments)
    places = windows(assignments).select(*SCOPE, "window", (F.row_number().over(Window.partitionBy(*SCOPE).orderBy("window")) - 1).alias("at"))
    side = lambda name: places.withColumnsRenamed({"window": f"{name}_window", "at": f"{name}_at"})
    asked = pairs.select(*SCOPE, "from_window", "to_window").join(side("from"), [*SCOPE, "from_window"], "left").join(side("to"), [*SCOPE, "to_window"], "left")
    later = asked.groupBy(*SCOPE, "to_window", "to_at").agg(F.collect_list(F.struct("from_window", "from_at")).alias("earlier"))
    known = themes.where("state <> 'muted'").select("agent_id", "facet", F.col("id").alias("theme_id"), "label", "state")
    series = dense.groupBy(*SCOPE, "theme_id").agg(F.array_sort(F.collect_list(F.struct("window", "n", "share"))).alias("points")).join(known, [*SCOPE, "theme_id"])
    met = series.join(later, SCOPE)
    point = lambda at, name, none: F.coalesce(F.get("points", at)[name], none)
    one = lambda e: F.struct(e["from_window"].alias("from_window"), point(e["from_at"], "n", F.lit(0).cast("long")).alias("from_count"), point(e["from_at"], "share", F.lit(0.0)).alias("from_share"))
    own = ["theme_id", "label", "state"]
    unfolded = met.select(*SCOPE, *own, "to_window", point(F.col("to_at"), "n", F.lit(0).cast("long")).alias("to_count"), point(F.col("to_at"), "share", F.lit(0.0)).alias("to_share"), _others_deviation(F.col("points"), F.coalesce("to_at", F.lit(-1))).alias("deviation"), F.explode(F.transform("earlier", one)).alias("e"))
    changed = unfolded.select(*SCOPE, "theme_id", "e.from_window", "to_window", "e.from_count", "to_count", "e.from_share", "to_share", "deviation", "label", "state")
    judged = changed.where("from_count + to_count > 0").withColumn("delta", F.col("to_share") - F.col("from_share")).withColumn("exceeded", F.abs("delta") > F.greatest(F.col("deviation") * sigma, F.lit(FLOOR)))
    sigmas = F.when(F.col("deviation") > 0, F.abs("delta") / F.col("deviation")).otherwise(F.lit(0.0))
    out = judged.withColumn("sigmas", sigmas).withColumn("severity", severity(F.col("exceeded"), F.col("delta"), F.col("state"), F.col("from_count")))
    return out.select(*SCOPE, "theme_id", "from_window", "to_window", "from_count", "to_count", "from_share", "to_share", "deviation", "delta", "label", "state", "exceeded", "sigmas", "severity")


def severity(exceeded: Column, delta: Column, state: Column, from_count: Column) -> Column:
    up = exceeded & (delta > 0)
    return F.when(up & state.isin("regressed", "resolved"), "regression").when(up & (from_count == 0), "new").when(exceeded, "notable").otherwise("info")


def severity_rank(severity_: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), severity_)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*SCOPE, severity_rank(F.col("severity")), F.abs("delta").desc(), "theme_id")


def delta_summary(assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals and residual shares of both windows of each pair."""
    share = residual_share(assignments)
    one = lambda side: share.select(*SCOPE, F.col("window").alias(f"{side}_window"), F.col("total").alias(f"{side}_total"), F.col("share").alias(f"{side}_residual_share"))
    return pairs.join(one("from"), [*SCOPE, "from_window"], "left").join(one("to"), [*SCOPE, "to_window"], "left").fillna(0, ["from_total", "to_total"]).fillna(0.0, ["from_residual_share", "to_residual_share"])


def facet_report(assignments: DataFrame, themes: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """All themes of the registry in each scope's window (the latest, unless ``at`` names one), beside that window's residual share."""
    dense = grid(assignments)
    order = Window.partitionBy(*SCOPE, "theme_id").orderBy("window")
    lagged = dense.withColumn("previous_share", F.lag("share").over(order)).withColumn("history", F.collect_list("share").over(order))
    chosen = at if at is not None else latest_windows(assignments, 1).select(*SCOPE, "window")
    current = lagged.join(chosen, [*SCOPE, "window"])
    known = themes.select("agent_id", "facet", F.col("id").alias("theme_id"), "label", "state", "member_count", "first_window")
    residual = residual_share(assignments).select(*SCOPE, "window", F.col("share").alias("residual_share"))
    named = chosen.join(residual, [*SCOPE, "window"], "left").withColumnRenamed("window", "report_window")
    rows = known.join(named, SCOPE, "left").join(current, [*SCOPE, "theme_id"], "left")
    history = F.coalesce("history", F.array().cast("array<double>"))
    share, n = F.coalesce("share", F.lit(0.0)), F.coalesce("n", F.lit(0).cast("long"))
    return rows.select(
        *SCOPE, "theme_id", "label", "state", "member_count", F.col("report_window").alias("window"), n.alias("n"), share.alias("share"), F.col("previous_share"), (share - F.col("previous_share")).alias("delta"), history.alias("history"), sparkline(history).alias("spark"), F.coalesce((F.col("first_window") == F.col("report_window")) & (n > 0), F.lit(False)).alias("is_new_here"), "residual_share"
    ).orderBy(*SCOPE, F.desc("share"), F.desc("member_count"), "theme_id")


def uncovered(traces: DataFrame, assignments: DataFrame, facets: int) -> DataFrame:
    """Traces of each agent that lack an assignment row for some of its ``facets`` facets."""
    covered = assignments.groupBy(F.col("trace_id").alias("id")).agg(F.countDistinct("facet").alias("n"))
    return traces.join(covered, "id", "left").where(F.coalesce("n", F.lit(0)) < facets).groupBy("agent_id").agg(F.count("*").alias("uncovered"))


def check(findings: DataFrame, fail_on: tuple[str, ...] = ("regression", "new"), min_share: float = 0.0) -> DataFrame:
    """Findings of the failing severities: ``failed`` where the share counts, else a note."""
    chosen = findings.where(F.col("severity").isin(*fail_on))
    return chosen.withColumn("failed", F.col("to_share") >= min_share).orderBy(F.desc("failed"), F.abs("delta").desc(), "theme_id")


def pending_alerts(assignments: DataFrame, themes: DataFrame, log: DataFrame) -> DataFrame:
    """Themes that regressed or appeared in their scope's latest window and were not announced yet."""
    latest = latest_windows(assignments, 1).select(*SCOPE, F.col("window"), "total")
    event = F.when((F.col("state") == "regressed") & (F.col("last_seen_window") == F.col("window")), "regressed").when((F.col("state") == "new") & (F.col("first_window") == F.col("window")), "new")
    found = themes.join(latest, SCOPE).withColumn("event", event).where("event is not null").withColumnRenamed("id", "theme_id")
    fresh = found.join(log.select("agent_id", "theme_id", "event", "window"), ["agent_id", "theme_id", "event", "window"], "left_anti")
    n = _counts(assignments).where("theme_id is not null").select(*SCOPE, "window", "theme_id", "n")
    counted = fresh.join(n, [*SCOPE, "window", "theme_id"], "left")
    return counted.select("agent_id", "facet", "theme_id", "label", "event", "window", "state", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"), "member_count")


def empty_windows(assignments: DataFrame, themes: DataFrame, k: int) -> DataFrame:
    """Ids of open themes without a trace in their scope's last ``k`` windows; scopes with k + 1 windows or more."""
    if k <= 0:
        return themes.select("id").limit(0)
    recent = latest_windows(assignments, k).select(*SCOPE, "window")
    enough = windows(assignments).groupBy(*SCOPE).agg(F.count("*").alias("w")).where(F.col("w") > k).select(*SCOPE)
    seen = assignments.where("theme_id is not null").join(recent, [*SCOPE, "window"], "left_semi").select(F.col("theme_id").alias("id")).distinct()
    return themes.where(F.col("state").isin("new", "active", "regressed")).join(enough, SCOPE, "left_semi").join(seen, "id", "left_anti").select("id")


def needs_rediscovery(assignments: DataFrame, share: float = 0.08) -> DataFrame:
    """Scopes whose latest window leaves more than ``share`` of its traces residual."""
    latest = latest_windows(assignments, 1)
    return latest.select(*SCOPE, "window", (F.col("residual") / F.col("total")).alias("residual_share")).withColumn("needed", F.col("residual_share") > share)


def exemplars(assignments: DataFrame, k: int = 5) -> DataFrame:
    """Each theme's ``k`` most similar traces, ties by id."""
    order = Window.partitionBy("theme_id").orderBy(F.desc("similarity"), "trace_id")
    top = assignments.where("theme_id is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.select("theme_id", "place", "trace_id", "similarity")


def exemplar_lists(assignments: DataFrame, k: int = 5) -> DataFrame:
    listed = exemplars(assignments, k).groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("place", "trace_id"))).alias("x"))
    return listed.select("theme_id", F.transform("x", lambda e: e["trace_id"]).alias("exemplar_trace_ids"))
