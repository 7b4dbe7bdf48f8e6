"""Explicit schemas of every table the engine keeps."""

from __future__ import annotations

import re

EVENT = "struct<name:string,attributes:map<string,string>>"
STATUS = "struct<code:string,code_num:int,message:string>"

#: One normalized span, or one rejected input line (``error`` set, no trace).
SPAN = f"line_no bigint, trace_id string, span_id string, name string, start_ms double, end_ms double, attributes map<string,string>, events array<{EVENT}>, status {STATUS}, raw string, error string"
META = "struct<span_count:int,tools:array<string>,has_error:boolean,duration_ms:double>"
TRACE = f"id string, agent_id string, version string, started_at timestamp, ended_at timestamp, text string, meta {META}"
SUMMARY = "trace_id string, facet string, summary string, embedding array<double>"
THEME = "id string, agent_id string, facet string, label string, description string, state string, centroid array<double>, member_count int, exemplar_trace_ids array<string>, created_at timestamp, updated_at timestamp, first_window string, last_seen_window string, note string"
ASSIGNMENT = "trace_id string, agent_id string, facet string, theme_id string, similarity double, window string"
ALERT_LOG = "agent_id string, theme_id string, event string, window string, sent_at timestamp"
PENDING = "trace_id string, span_key string, received_at timestamp, span string"
META_KV = "k string, v string"

STATES = ("new", "active", "regressed", "resolved", "muted")
#: Table name -> (schema, primary key).
TABLES = {
    "traces": (TRACE, ("id",)),
    "facet_summaries": (SUMMARY, ("trace_id", "facet")),
    "themes": (THEME, ("id",)),
    "assignments": (ASSIGNMENT, ("trace_id", "facet")),
    "pending_spans": (PENDING, ("trace_id", "span_key")),
    "late_spans": (PENDING, ("trace_id", "span_key")),
    "alert_log": (ALERT_LOG, ("agent_id", "theme_id", "event", "window")),
    "meta": (META_KV, ("k",)),
}


def columns(ddl: str) -> list[str]:
    """Top-level names of a schema, without a session."""
    flat, depth = "", 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        flat += "" if depth else c
    return re.findall(r"(?:^|,)\s*(\w+) ", flat)
