"""Span lines as native columns: types from VARIANT, texts from the JSON itself, so nested values keep the order of their keys.

A line is one span or an export envelope. ``spread`` unfolds envelopes by their lists of resources, scopes and spans, each a list of JSON
texts, and ``normalized`` reads a span's members by name and type. What can't be read is a row with ``error``. Nothing leaves the JVM.

Defined cases: a member of another type counts as absent; nulls go; an attribute that is named twice has its last value; of nested attribute lists
three levels are read. Times are numbers (nanoseconds above 1e15, else milliseconds), the same as digits, ISO dates and times, and the usual written
dates (``1 Jul 2026 10:00:00 GMT``, ``Jul 1, 2026``, ``7/1/2026``); without a zone they are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT, STATUS

# Names under which senders give ids, times and nested lists.
TRACE_ID = ("trace_id", "traceId", "traceID")
SPAN_ID = ("span_id", "spanId", "spanID")
START = ("start_time", "startTime", "startTimeUnixNano", "start_time_unix_nano", "timestamp")
END = ("end_time", "endTime", "endTimeUnixNano", "end_time_unix_nano")
RESOURCES = ("resourceSpans", "resource_spans")
SCOPES = ("scopeSpans", "scope_spans", "instrumentationLibrarySpans")

TEXTS, TYPED, LIST = "map<string,string>", "map<string,variant>", "array<string>"
#: Written dates without weekday and zone; the ISO forms are Spark's own cast.
DATES = ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy HH:mm", "MMM d, yyyy", "MMM d yyyy HH:mm:ss", "MMM d yyyy", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss", "M/d/yyyy")
_ZONE = r"(?i)\s*(Z|GMT|UTC|[+-]\d\d:?\d\d)$"
_NUMBER = r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` written and evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_object(text: Column) -> Column:
    return F.coalesce(_kind(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def _objects(text: Column, kind: Column) -> Column:
    """The objects of a JSON list, as texts; null where it isn't a list."""
    return F.when(kind.startswith("ARRAY"), F.filter(F.from_json(text, LIST), _is_object))


class _Members:
    """Members of an object by name, from maps of their texts and of their typed values."""

    def __init__(self, texts: Column, typed: Column):
        self.texts, self.typed = texts, typed

    def get(self, name: Column | str) -> Column:
        return F.try_element_at(self.texts, F.lit(name) if isinstance(name, str) else name)

    def kind(self, name: Column | str) -> Column:
        return _kind(F.try_element_at(self.typed, F.lit(name) if isinstance(name, str) else name))

    def first(self, names: tuple[str, ...], body) -> Column:
        """The first of ``body(text, kind)`` over the names that isn't null."""
        return F.get(F.filter(F.transform(F.lit(list(names)), lambda n: body(self.get(n), self.kind(n))), lambda x: x.isNotNull()), F.lit(0))

    def string(self, *names: str) -> Column:
        """The first of the names that holds a string that isn't empty."""
        return self.first(names, lambda text, kind: F.when(kind == "STRING", F.nullif(text, F.lit(""))))

    def objects(self, *names: str) -> Column:
        return F.coalesce(self.first(names, _objects), F.array().cast(LIST))

    def number(self, name: str) -> Column:
        return F.when(self.kind(name).rlike(_NUMBER), self.get(name).try_cast("double"))

    def said(self, name: str) -> Column:
        """A value as text, numbers as they are usually written; null if it is empty."""
        return F.nullif(F.when(self.kind(name).rlike(_NUMBER), _plain(self.get(name))).otherwise(self.get(name)), F.lit(""))


def _members(text: Column, body) -> Column:
    return _let(F.struct(F.from_json(text, TEXTS).alias("texts"), F.from_json(text, TYPED).alias("typed")), lambda m: body(_Members(m["texts"], m["typed"])))


def _plain(number: Column) -> Column:
    """A JSON number as it is usually written: no fraction if that is zero, no trailing zeros."""

    def short(x: Column) -> Column:
        whole = F.when(x["d"] == F.floor(x["d"]), F.floor(x["d"]).cast("decimal(38,0)").cast("string")).when(x["s"].rlike(r"^-?\d+\.\d+$"), F.regexp_replace(x["s"], "0+$", ""))
        return F.coalesce(F.when(F.abs(x["d"]) < F.lit(1e21), whole), x["s"])

    return _let(F.struct(number.try_cast("decimal(38,10)").alias("d"), number.alias("s")), short)


def _quoted(text: Column) -> Column:
    return _let(F.to_json(F.array(text)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def _any_value(text: Column, depth: int = 3, quoted: bool = False) -> Column:
    """One wire-format value, as text or as JSON; other JSON stays as it is."""
    say = _quoted if quoted else (lambda x: x)

    def of(m: Column) -> Column:
        has = lambda name: F.map_contains_key(m, name)
        value = lambda name: F.try_element_at(m, F.lit(name))
        found = F.when(has("stringValue"), say(value("stringValue"))).when(has("intValue"), F.coalesce(value("intValue").try_cast("decimal(38,0)").cast("string"), F.lit("null") if quoted else F.lit(None))).when(has("doubleValue"), _plain(value("doubleValue"))).when(has("boolValue"), value("boolValue"))
        if depth:
            items = F.coalesce(F.from_json(F.get_json_object(value("arrayValue"), "$.values"), LIST), F.array().cast(LIST))
            found = found.when(has("arrayValue"), F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: _any_value(x, depth - 1, True)), ","), F.lit("]")))
        return found.otherwise(text)

    plain = say(text)
    return F.when(text.startswith("{"), _let(F.from_json(text, TEXTS), lambda m: F.when(m.isNull(), plain).otherwise(of(m)))).otherwise(plain)


def _last_wins(entries: Column) -> Column:
    last = lambda xs, e, i: ~F.exists(F.slice(xs, i + 2, F.greatest(F.size(xs), F.lit(1))), lambda o: o["key"] == e["key"])
    lone = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda e: e["key"]))) == F.size(xs)
    return F.map_from_entries(_let(entries, lambda xs: F.when(lone(xs), xs).otherwise(F.filter(xs, lambda e, i: last(xs, e, i)))))


_PAIRS = "array<struct<key:string,value:string>>"


def _entries(text: Column, kind: Column) -> Column:
    """array<struct<key,value>> of attributes: a list of wire-format pairs, or an object."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    pairs = F.transform(F.from_json(text, _PAIRS), lambda e: pair(e["key"], _any_value(e["value"])))
    flat = _members(text, lambda m: F.transform(F.map_keys(m.texts), lambda k: pair(k, F.when(m.kind(k).rlike(_NUMBER), _plain(m.get(k))).otherwise(m.get(k)))))
    found = F.when(kind.startswith("ARRAY"), pairs).when(kind.startswith("OBJECT"), flat)
    return F.filter(F.coalesce(found, F.array().cast(_PAIRS)), lambda e: e["key"].isNotNull() & e["value"].isNotNull())


def _millis(text: Column, kind: Column) -> Column:
    """Milliseconds of a member that is a time."""

    def date(x: Column) -> Column:
        offset = F.when(x["zone"].rlike("^[+-]"), F.concat(F.substring(x["zone"], 1, 3), F.lit(":"), F.right(x["zone"], F.lit(2)))).otherwise("+00:00")
        written = F.get(F.filter(F.transform(F.lit(list(DATES)), lambda form: F.try_to_timestamp(x["bare"], form).cast("timestamp_ntz")), lambda t: t.isNotNull()), F.lit(0))
        local = F.when(x["bare"].rlike(r"^\d{4}-\d\d"), x["bare"].try_cast("timestamp_ntz")).otherwise(written)
        return F.unix_micros(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSSSSS"), offset).try_cast("timestamp")) / 1000.0

    def of(x: Column) -> Column:
        number = F.when(x["kind"].rlike(_NUMBER) | ((x["kind"] == "STRING") & x["text"].rlike("^[0-9]+$")), x["text"].try_cast("double"))
        bare = F.regexp_replace(F.regexp_replace(x["text"], _ZONE, ""), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
        dated = F.when(x["kind"] == "STRING", _let(F.struct(bare.alias("bare"), F.regexp_extract(x["text"], _ZONE, 1).alias("zone")), date))
        return F.coalesce(_let(number, lambda n: F.when(n > 1e15, n / 1e6).otherwise(n)), dated)

    return F.when(text.isNotNull(), _let(F.struct(F.trim(text).alias("text"), kind.alias("kind")), of))


def spread(lines: DataFrame) -> DataFrame:
    """(line_no, span, shared, error): the spans of each line as JSON texts, with their resource's attributes."""
    text = F.col("value")
    filled = lines.where(F.length(F.trim(F.regexp_replace(text, r"\s", ""))) > 0).select("line_no", "value", _kind(F.try_parse_json(text)).alias("kind"))
    error = F.when(F.col("kind").isNull(), "invalid JSON").when(~F.col("kind").startswith("OBJECT"), "not a JSON object")
    envelope = F.coalesce(F.arrays_overlap(F.json_object_keys(text), F.lit(list(RESOURCES))), F.lit(False))
    rows = filled.select("line_no", "value", error.alias("error"), F.when(error.isNull(), envelope).otherwise(F.lit(False)).alias("envelope"))
    single = rows.where("not envelope").select("line_no", F.when(F.col("error").isNull(), F.get_json_object("value", "$")).alias("span"), F.lit(None).cast("string").alias("shared"), "error")
    lists = lambda text, *names: _members(F.col(text), lambda m: m.objects(*names))
    resources = rows.where("envelope").select("line_no", F.explode(lists("value", *RESOURCES)).alias("resource"))
    scopes = resources.select("line_no", F.get_json_object("resource", "$.resource.attributes").alias("shared"), F.explode(lists("resource", *SCOPES)).alias("scope"))
    inside = scopes.select("line_no", F.explode(lists("scope", "spans")).alias("span"), "shared", F.lit(None).cast("string").alias("error"))
    return single.unionByName(inside)


def normalized(spans: DataFrame) -> DataFrame:
    """``spread``'s rows as SPAN rows."""
    attributes = lambda m: _entries(m.get("attributes"), m.kind("attributes"))
    event = lambda m: F.struct(F.when(m.kind("name") == "STRING", m.get("name")).alias("name"), _last_wins(attributes(m)).alias("attributes"))
    whole = lambda n: F.when(n == F.floor(n), n.try_cast("int"))
    status = lambda m: F.struct(m.said("code").alias("code"), _let(m.number("code"), whole).alias("code_num"), m.said("message").alias("message"))

    def read(m: _Members) -> Column:
        own = {
            "trace_id": m.string(*TRACE_ID), "span_id": m.string(*SPAN_ID), "name": m.string("name"), "start_ms": F.coalesce(m.first(START, _millis), F.lit(0.0)), "end_ms": m.first(END, _millis),
            "attributes": _last_wins(F.concat(_entries(F.col("shared"), _kind(F.try_parse_json("shared"))), attributes(m))),
            "events": F.transform(m.objects("events"), lambda e: _members(e, event)).cast(f"array<{EVENT}>"), "status": F.when(m.kind("status").startswith("OBJECT"), _members(m.get("status"), status)).cast(STATUS),
        }
        return F.struct(*[c.alias(n) for n, c in own.items()])

    found = spans.select("*", F.when(F.col("error").isNull(), _members(F.col("span"), read)).alias("own"))
    # what came in an envelope goes on in one of its own, so that it reads the same again
    raw = F.when(F.col("shared").isNull(), F.col("span")).otherwise(F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":'), "shared", F.lit('},"scopeSpans":[{"spans":['), "span", F.lit("]}]}]}")))
    good = F.col("own.trace_id").isNotNull()
    error = F.coalesce("error", F.when(~good, "span has no trace id"))
    line = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), error)
    names = ("trace_id", "span_id", "name", "start_ms", "end_ms", "attributes", "events", "status")
    return found.select(F.col("line_no").cast("long").alias("line_no"), *[F.when(good, F.col("own")[n]).alias(n) for n in names], F.when(good, raw).alias("raw"), line.alias("error"))


def parse(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> SPAN rows."""
    return normalized(spread(lines.select("line_no", "value")))
