"""Text columns: clipping, key phrases, inputs, sparklines and percentages."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TRACE_CHARS = 24_000
CLIP_MARK = "\n...[trace truncated]...\n"
BLOCKS = "▁▂▃▄▅▆▇█"


def clip(text: Column, most: int = MAX_TRACE_CHARS) -> Column:
    """At most ``most`` characters of trace: head and tail around a mark."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit(CLIP_MARK), F.right(text, F.lit(half)))).otherwise(text)


def clip_text(text: str, most: int = MAX_TRACE_CHARS) -> str:
    half = most // 2
    return text if len(text) <= most else text[:half] + CLIP_MARK + (text[-half:] if half else "")


def key_phrase(text: Column, fallback: Column | str) -> Column:
    """One line of at most 90 characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    default = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(flat == "", default).when(F.length(flat) > 90, F.concat(F.left(flat, F.lit(87)), F.lit("..."))).otherwise(flat)


def shortened(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def extract_input(text: Column, most: int = 4000) -> Column:
    """The first non-empty ``input: `` or ``user: `` line, else the text's head."""
    value = lambda line: F.trim(F.when(F.startswith(line, F.lit("input: ")), F.substring(line, 8, 1 << 30)).when(F.startswith(line, F.lit("user: ")), F.substring(line, 7, 1 << 30)).otherwise(F.lit("")))
    lines = F.filter(F.transform(F.split(text, "\n"), value), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(most)), F.trim(F.left(text, F.lit(most))))


def sparkline(history: Column) -> Column:
    """Eight block heights relative to the greatest value; the baseline if none is positive, the middle if all are equal."""
    top, low = F.array_max(history), F.array_min(history)
    block = lambda level: F.substring(F.lit(BLOCKS), level.cast("int") + 1, F.lit(1))
    flat = F.when(top <= 0, F.lit(BLOCKS[0])).when(top == low, F.lit(BLOCKS[3]))
    height = lambda x: F.floor(F.greatest(x, F.lit(0.0)) / top * 7 + 0.5)
    return F.when(F.size(history) == 0, F.lit("")).otherwise(F.array_join(F.transform(history, lambda x: F.coalesce(flat, block(height(x)))), ""))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def arrow(delta: Column, dead: float = 0.001) -> Column:
    return F.when(delta > dead, "↑").when(delta < -dead, "↓").otherwise("→")


def scorer_identifier(theme_id: str) -> str:
    plain = "".join(c for c in theme_id.lower() if c.isascii() and c.isalnum())
    return f"t{plain}" if plain[:1].isdigit() else plain or "theme"


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def as_text(value: Any) -> str | None:
    """A non-empty string for strings, numbers, booleans and JSON values; None for the rest."""
    if isinstance(value, str):
        return value or None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, (int, float)):
        return str(value)
    return compact(value) if isinstance(value, (dict, list)) else None


def render_messages(raw: Column) -> Column:
    """A JSON message, or list of messages, as ``role: content`` lines; anything else as it is. Native throughout.

    A list's elements come as JSON text each, so an object is told from a plain value by its first character; a
    message needs a role and a content, and content that is no string stays JSON.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    body = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))

    def line(x: Column) -> Column:
        said = F.from_json(x, "role string, content string")
        message = let(said, lambda m: F.when(F.coalesce(m["role"], F.lit("")) != "", F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("null")))))
        whole = F.coalesce(F.array_contains(F.json_object_keys(x), "content"), F.lit(False))
        return F.when(~F.startswith(x, F.lit("{")), x).when(whole, message)

    def shown(lines: Column) -> Column:
        several = F.concat(F.lit("\n"), F.array_join(lines, "\n"))
        return F.when((F.size(lines) == 0) | F.exists(lines, lambda x: x.isNull()), raw).when(F.size(lines) == 1, F.get(lines, F.lit(0))).otherwise(several)

    items = F.when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>")).otherwise(F.array(body))
    rendered = let(F.transform(items, lambda x: line(F.coalesce(x, F.lit("")))), shown)
    return F.when(F.coalesce(body, F.lit("")).rlike(r"^[\[{]"), F.coalesce(rendered, raw)).otherwise(raw)
