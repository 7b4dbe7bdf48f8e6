"""Span lines -> normalized spans: three JSON shapes, one schema, rejected lines as rows of their own.

``json_spans`` has the columns that do so; ``spread`` and ``normalize`` are the plain form for what the receiver checks before it answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text
from . import json_spans

from .json_spans import END, RESOURCES, SCOPES, SPAN_ID, START, TRACE_ID


class SpanError(ValueError):
    pass


def _any_value(value: Any) -> Any:
    """One attribute value of the wire format; unknown objects stay objects."""
    if not isinstance(value, dict):
        return value
    for name in ("stringValue", "intValue", "doubleValue", "boolValue"):
        if name in value:
            found = value[name]
            if name == "intValue" and isinstance(found, str):
                try:
                    return int(found)
                except ValueError:
                    return None
            return found
    if "arrayValue" in value:
        items = value["arrayValue"].get("values") if isinstance(value["arrayValue"], dict) else None
        return [_any_value(x) for x in items] if isinstance(items, list) else []
    return value


def attributes(raw: Any) -> dict[str, Any]:
    if isinstance(raw, list):
        return {e["key"]: _any_value(e.get("value")) for e in raw if isinstance(e, dict) and isinstance(e.get("key"), str)}
    return dict(raw) if isinstance(raw, dict) else {}


def _text(values: dict[str, Any]) -> dict[str, str]:
    """Values as strings; an empty string stays, nulls go."""
    out = {}
    for k, v in values.items():
        s = v if isinstance(v, str) else as_text(v)
        if s is not None:
            out[k] = s
    return out


def _first(raw: dict[str, Any], names: tuple[str, ...]) -> str | None:
    return next((raw[n] for n in names if isinstance(raw.get(n), str) and raw[n]), None)


def _millis(raw: dict[str, Any], names: tuple[str, ...]) -> float | None:
    """The first usable time: numbers above 1e15 are nanoseconds, other numbers milliseconds, else a date."""
    for name in names:
        v = raw.get(name)
        if isinstance(v, bool) or v is None or v == "":
            continue
        if isinstance(v, str) and re.fullmatch(r"[0-9]+", v):
            v = float(v)
        if isinstance(v, (int, float)):
            return v / 1e6 if v > 1e15 else float(v)
        if isinstance(v, str):
            try:
                when = datetime.fromisoformat(v)
            except ValueError:
                continue
            return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000
    return None


def _nested(raw: dict[str, Any], names: tuple[str, ...]) -> list[dict[str, Any]]:
    found = next((raw[n] for n in names if isinstance(raw.get(n), list)), [])
    return [x for x in found if isinstance(x, dict)]


def spread(raw: Any) -> Iterator[dict[str, Any]]:
    """Single spans of a line: an export envelope's, with its resource's attributes as defaults, or the line itself."""
    if not isinstance(raw, dict):
        raise SpanError("not a JSON object")
    if not any(n in raw for n in RESOURCES):
        yield raw
        return
    for resource in _nested(raw, RESOURCES):
        shared = attributes((resource.get("resource") or {}).get("attributes"))
        for scope in _nested(resource, SCOPES):
            for span in _nested(scope, ("spans",)):
                yield span | {"attributes": shared | attributes(span.get("attributes"))}


def normalize(raw: dict[str, Any]) -> dict[str, Any]:
    trace_id = _first(raw, TRACE_ID)
    if trace_id is None:
        raise SpanError("span has no trace id")
    status = raw["status"] if isinstance(raw.get("status"), dict) else None
    code = status.get("code") if status else None
    numeric = isinstance(code, (int, float)) and not isinstance(code, bool)
    events = raw["events"] if isinstance(raw.get("events"), list) else []
    return {
        "trace_id": trace_id,
        "span_id": _first(raw, SPAN_ID),
        "name": _first(raw, ("name",)),
        "start_ms": _millis(raw, START) or 0.0,
        "end_ms": _millis(raw, END),
        "attributes": _text(attributes(raw.get("attributes"))),
        "events": [{"name": e["name"] if isinstance(e.get("name"), str) else None, "attributes": _text(attributes(e.get("attributes")))} for e in events if isinstance(e, dict)],
        "status": None if status is None else {"code": as_text(code), "code_num": int(code) if numeric and float(code).is_integer() else None, "message": as_text(status.get("message"))},
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> SPAN rows, rejected lines among them; blank lines give nothing."""
    return json_spans.parse(lines)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Span lines of files, numbered within each file.

    Spark numbers rows by split, so a line's number is its place in its split plus the lines of the
    file's earlier splits: one narrow pass counts lines by split.
    """
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"no such span file: {path}")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    counts = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("ahead") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def read_spans(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """All spans of a file or folder, rejected lines with ``error``; ``strict`` raises on the first one."""
    spans = parse_lines(read_lines(spark, path))
    if strict and (bad := spans.where("error is not null").orderBy("line_no").select("error").first()):
        raise SpanError(bad.error)
    return spans


def good(spans: DataFrame) -> DataFrame:
    return spans.where("error is null")


def rejected(spans: DataFrame) -> DataFrame:
    """Lines that gave no span: line number and reason."""
    return spans.where("error is not null").select("line_no", "error")
