"""Predicates over the stored tables, shared by pages, counts and estimates so that no two disagree."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_TRACE_CHARS
from .traces import window_of

_UNIT = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def resolve_since(text: str, now: datetime) -> datetime:
    """``7d``, ``24h``, ``30m`` or ``2w`` before ``now``, or an ISO instant."""
    if m := re.fullmatch(r"(\d+)([mhdw])", text.strip().lower()):
        return now - timedelta(**{_UNIT[m[2]]: int(m[1])})
    try:
        when = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"can't read {text!r} as a time span or an instant") from e
    return when if when.tzinfo else when.replace(tzinfo=timezone.utc)


def get(table: DataFrame, **key: str) -> DataFrame:
    """Point lookup: filters that reach the scan."""
    for name, value in key.items():
        table = table.where(F.col(name) == value)
    return table


def list_traces(traces: DataFrame, agent_id: str | None = None, since: datetime | None = None, limit: int | None = None) -> DataFrame:
    out = _in_scope(traces, agent_id, since).orderBy("started_at", "id")
    return out.limit(limit) if limit is not None else out


def _in_scope(traces: DataFrame, agent_id: str | None, since: datetime | None) -> DataFrame:
    if agent_id is not None:
        traces = traces.where(F.col("agent_id") == agent_id)
    return traces.where(F.col("started_at") >= F.lit(since)) if since is not None else traces


def distinct_agents(traces: DataFrame) -> DataFrame:
    return traces.select("agent_id").distinct().orderBy("agent_id")


def distinct_facets(table: DataFrame) -> DataFrame:
    return table.select("facet").distinct().orderBy("facet")


def counts(table: DataFrame, **equal: str | None) -> DataFrame:
    """How many rows there are, of those that equal the given values where any are given."""
    for name, value in equal.items():
        if value is not None:
            table = table.where(F.col(name) == value)
    return table.agg(F.count("*").alias("n"))


def window_for(traces: DataFrame, trace_id: str) -> str | None:
    """The window that a trace belongs to; None if there is no such trace."""
    found = get(traces, id=trace_id).select(window_of(F.col("version"), F.col("started_at")).alias("window")).first()
    return found.window if found else None


def needing_summaries(traces: DataFrame, summaries: DataFrame, facets: list[str], agent_id: str | None = None, since: datetime | None = None) -> DataFrame:
    """Traces with fewer summaries than there are facets: one aggregate of the summaries, one left join."""
    have = summaries.where(F.col("facet").isin(facets)).groupBy(F.col("trace_id").alias("id")).agg(F.count("*").alias("_have"))
    return _in_scope(traces, agent_id, since).join(have, "id", "left").where(F.coalesce("_have", F.lit(0)) < len(facets)).drop("_have")


def page(rows: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """Keyset page by (started_at, id)."""
    if after is not None:
        rows = rows.where((F.col("started_at") > F.lit(after[0])) | ((F.col("started_at") == F.lit(after[0])) & (F.col("id") > after[1])))
    return rows.orderBy("started_at", "id").limit(size)


def pending_stats(pending: DataFrame, cap: int = MAX_TRACE_CHARS) -> DataFrame:
    """How many traces wait, and how many characters would be sent."""
    return pending.agg(F.count("*").alias("traces"), F.coalesce(F.sum(F.least(F.length("text"), F.lit(cap))), F.lit(0)).cast("long").alias("chars"))


def lacking_embeddings(summaries: DataFrame, limit: int | None = None) -> DataFrame:
    rows = summaries.where("embedding is null").orderBy("trace_id", "facet")
    return rows.limit(limit) if limit is not None else rows


def unassigned_pool(summaries: DataFrame, traces: DataFrame, assignments: DataFrame) -> DataFrame:
    """Embedded summaries without a theme, residuals included, with agent and window."""
    scoped = summaries.where("embedding is not null").join(traces.select(F.col("id").alias("trace_id"), "agent_id", window_of(F.col("version"), F.col("started_at")).alias("window")), "trace_id")
    settled = assignments.where("theme_id is not null").select("trace_id", "facet")
    return scoped.join(settled, ["trace_id", "facet"], "left_anti")


def themes_for(themes: DataFrame, agent_id: str | None = None, facet: str | None = None, states: list[str] | None = None) -> DataFrame:
    for name, value in (("agent_id", agent_id), ("facet", facet)):
        if value is not None:
            themes = themes.where(F.col(name) == value)
    return (themes.where(F.col("state").isin(states)) if states else themes).orderBy("id")


def all_themes(themes: DataFrame) -> DataFrame:
    return themes.orderBy(F.desc("member_count"), "id")


def traces_for_theme(traces: DataFrame, assignments: DataFrame, k: int = 50) -> DataFrame:
    """Each theme's ``k`` most similar traces."""
    order = Window.partitionBy("theme_id").orderBy(F.desc("similarity"), "trace_id", "facet")
    top = assignments.where("theme_id is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.select("theme_id", "facet", "place", "similarity", F.col("trace_id").alias("id")).join(traces, "id")


def settled_traces(pending: DataFrame, cutoff: Column | datetime, limit: int | None = 1000) -> DataFrame:
    """Traces whose last span arrived at or before ``cutoff``."""
    last = pending.groupBy("trace_id").agg(F.max("received_at").alias("last_at"), F.count("*").alias("spans"))
    rows = last.where(F.col("last_at") <= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff)))
    return rows.orderBy("trace_id").limit(limit) if limit is not None else rows
