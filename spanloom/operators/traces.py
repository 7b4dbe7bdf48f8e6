"""Trace assembly: spans of a trace -> one row, natively, with rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import render_messages

# Attribute names, in order of preference.
AGENT = ("gen_ai.agent.name", "gen_ai.assistant.name", "service.name", "mastra.agent.name")
VERSION = ("service.version", "deployment.environment.version", "gen_ai.agent.version", "release.version")
PROMPT = ("gen_ai.prompt", "gen_ai.input.messages", "gen_ai.request.messages")
COMPLETION = ("gen_ai.completion", "gen_ai.output.messages", "gen_ai.response.messages")
TOOL_INPUT = ("gen_ai.tool.input", "gen_ai.tool.call.arguments", "gen_ai.tool.arguments")
TOOL_OUTPUT = ("gen_ai.tool.output", "gen_ai.tool.result", "gen_ai.tool.message")
OPERATION, MODEL, TOOL = "gen_ai.operation.name", "gen_ai.request.model", "gen_ai.tool.name"
TOKENS_IN, TOKENS_OUT = "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens"


def _attr(span: Column, name: str) -> Column:
    """A non-empty attribute of a span."""
    return F.nullif(F.try_element_at(span["attributes"], F.lit(name)), F.lit(""))


def _pick(span: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[_attr(span, n) for n in names])


def first_by_priority(spans: Column, names: tuple[str, ...]) -> Column:
    """The first non-empty value: by name first, then by span."""
    one = lambda name: F.get(F.filter(F.transform(spans, lambda s: _attr(s, name)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(*[one(n) for n in names])


def is_error(span: Column) -> Column:
    """A status code with ERROR in it or the number 2, an ``error.type``, or an exception event."""
    named = F.coalesce(span["status"]["code_num"].isNull() & F.contains(F.upper(span["status"]["code"]), F.lit("ERROR")), F.lit(False))
    numeric = F.coalesce(span["status"]["code_num"] == 2, F.lit(False))
    typed = F.map_contains_key(span["attributes"], F.lit("error.type"))
    return named | numeric | F.coalesce(typed, F.lit(False)) | _has_exception(span)


def _has_exception(span: Column) -> Column:
    return F.coalesce(F.exists(span["events"], lambda e: F.coalesce(e["name"] == "exception", F.lit(False))), F.lit(False))


def _lines(span: Column, prompt: Column, completion: Column) -> Column:
    """The lines that one span adds to its trace's text."""
    took = F.when(span["end_ms"].isNotNull(), F.concat(F.lit(" ("), F.floor(span["end_ms"] - span["start_ms"] + 0.5).cast("string"), F.lit("ms)"))).otherwise(F.lit(""))
    head = F.concat(F.lit("## "), F.coalesce(_attr(span, OPERATION), span["name"], F.lit("span")), took)
    titled = lambda title, value: F.concat(F.lit(title), value)  # noqa: E731  null where the value is
    tool = _attr(span, TOOL)
    args = F.coalesce(titled(" args: ", _pick(span, TOOL_INPUT)), F.lit(""))
    raw = lambda name: F.try_element_at(span["attributes"], F.lit(name))
    tokens = F.when(raw(TOKENS_IN).isNotNull() | raw(TOKENS_OUT).isNotNull(), F.concat(F.lit("tokens: in="), F.coalesce(raw(TOKENS_IN), F.lit("?")), F.lit(" out="), F.coalesce(raw(TOKENS_OUT), F.lit("?"))))

    def event(e: Column) -> Column:
        get = lambda name, default: F.coalesce(F.nullif(F.try_element_at(e["attributes"], F.lit(name)), F.lit("")), F.lit(default))
        error = F.concat(F.lit("ERROR: "), get("exception.type", "Exception"), F.lit(": "), get("exception.message", "unknown"))
        return F.when(e["name"] == "exception", error).when(F.coalesce(e["name"], F.lit("")) != "", F.concat(F.lit("event: "), e["name"]))

    message = F.nullif(span["status"]["message"], F.lit(""))
    status = F.when(message.isNotNull(), F.trim(F.concat(F.lit("status: "), F.coalesce(span["status"]["code"], F.lit("")), F.lit(" "), message))).when(is_error(span) & ~_has_exception(span), F.lit("status: error"))
    own = F.array(head, titled("model: ", _attr(span, MODEL)), titled("input: ", prompt), F.when(tool.isNotNull(), F.concat(F.lit("tool: "), tool, args)), F.when(tool.isNotNull(), titled("tool result: ", _pick(span, TOOL_OUTPUT))), titled("output: ", completion), tokens)
    every = F.concat(own, F.coalesce(F.transform(span["events"], event), F.array().cast("array<string>")), F.array(status))
    return F.array_join(F.filter(every, lambda x: x.isNotNull()), "\n")


def assemble(spans: DataFrame, agent_id: str = "default") -> DataFrame:
    """Good spans -> TRACE rows: one shuffle, on the trace id.

    Each span renders its own lines before the shuffle, so a trace's row is a sort and a join of strings.
    """
    span = F.struct("span_id", "name", "start_ms", "end_ms", "attributes", "events", "status")
    one = spans.select("trace_id", span.alias("s"))
    shown = one.withColumn("prompt", render_messages(_pick(F.col("s"), PROMPT))).withColumn("completion", render_messages(_pick(F.col("s"), COMPLETION)))
    wanted = sorted({*AGENT, *VERSION, TOOL})
    small = F.map_filter("s.attributes", lambda k, v: k.isin(wanted))
    row = F.struct(F.col("s.start_ms").alias("start_ms"), F.coalesce("s.span_id", F.lit("")).alias("span_id"), _lines(F.col("s"), F.col("prompt"), F.col("completion")).alias("text"), F.col("s.end_ms").alias("end_ms"), is_error(F.col("s")).alias("error"), F.to_json(small).alias("kept"))
    grouped = shown.select("trace_id", row.alias("r")).groupBy("trace_id").agg(F.array_sort(F.collect_list("r")).alias("rows"), F.min("r.start_ms").alias("start"), F.max("r.end_ms").alias("end"), F.bool_or("r.error").alias("has_error"))
    ordered = grouped.withColumn("spans", F.transform("rows", lambda r: F.struct(F.from_json(r["kept"], "map<string,string>").alias("attributes"))))
    tools = F.array_distinct(F.filter(F.transform("spans", lambda s: _attr(s, TOOL)), lambda x: x.isNotNull()))
    instant = lambda ms: F.timestamp_millis(ms.cast("long"))
    meta = F.struct(F.size("rows").alias("span_count"), tools.alias("tools"), F.col("has_error"), (F.col("end") - F.col("start")).alias("duration_ms"))
    return ordered.select(
        F.col("trace_id").alias("id"), F.coalesce(first_by_priority(F.col("spans"), AGENT), F.lit(agent_id)).alias("agent_id"), first_by_priority(F.col("spans"), VERSION).alias("version"), instant(F.col("start")).alias("started_at"), instant(F.col("end")).alias("ended_at"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"), meta.alias("meta")
    )


def window_of(version: Column, started_at: Column) -> Column:
    """A trace's window: its release, else its UTC day."""
    return F.coalesce(F.nullif(version, F.lit("")), F.date_format(started_at, "yyyy-MM-dd"))


def dedupe_key(span_id: Column, serialized: Column) -> Column:
    return F.coalesce(F.nullif(span_id, F.lit("")), F.substring(F.sha2(serialized.cast("binary"), 256), 1, 32))


def insert_or_ignore(table: DataFrame, batch: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key by ``order``, and none whose key the table has."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = batch.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return fresh.join(table.select(*keys), keys, "left_anti").select(batch.columns)


def latest_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the last by ``order``: an aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return best.select(*keys, "_v.*").select(rows.columns)
