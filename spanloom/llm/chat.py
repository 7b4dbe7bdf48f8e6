"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A record's layout is known by its fingerprint: a hash of its sorted nested field paths, as far as any
layout knows them (names that no layout knows are metadata, such as ids or scores, and change nothing).
``LAYOUTS`` maps fingerprints to mappings, which say in which paths the roles and texts of the turns lie.
A table's own schema gives one fingerprint for all its rows (``rows_of_table``, for tables with a row a
turn, and ``turns_of_schema``, for those with a row a record); JSON records of mixed layouts have theirs
taken row by row (``turns_of_record``). All of it is native: expressions on the JVM, no Python on the rows.

Template: each turn is ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts get a
backslash after their first character, and backslashes are doubled, so that what is between markers can
never be a marker, and ``unescape`` restores it exactly. The loss mask is a list of spans (start, length,
in code points of the formatted string) that cover each assistant text, without its markers.

Defined cases: null texts and roles are empty; only the role ``assistant`` is learnt from. Turns are
ordered by turn (null first), ties by role and text. Rows with a null conv_id form one conversation.
Repeated rows are separate turns. A record of unknown layout has no turns, and ``layout_of_record`` is
null for it, so that such records can be counted; under ``strict`` it is an error. A table that fits no
layout is an error; further columns, whatever they are called, are ignored, as the row layout with the
most columns that are all there wins. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import read

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The template's own markers, and those of common chat templates.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
LEARNT = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where a layout's turns lie: fixed (role, path) pairs, or a list with role and text fields."""

    name: str
    paths: tuple[str, ...]
    fixed: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    parts: str = ""


#: Other names of the canonical roles, as layouts in use have them.
ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


def _list(name: str, items: str, role: str, text: str, roles: tuple[tuple[str, str], ...] = ()) -> tuple[Layout, ...]:
    """A list of turns; the same whose texts are lists of typed parts; and the empty list, which has no role or text to show."""
    own = (items, f"{items}.{role}", f"{items}.{text}")
    parts = (*own, f"{items}.{text}.text", f"{items}.{text}.type")
    return Layout(name, own, items=items, role=role, text=text, roles=roles), Layout(f"{name} in parts", parts, items=items, role=role, text=text, roles=roles, parts="text"), Layout(f"{name}, empty", (items,), items=items, role=role, text=text, roles=roles)


LAYOUTS = (
    Layout("prompt and completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("system, question and response", ("question", "response", "system_prompt"), (("system", "system_prompt"), ("user", "question"), ("assistant", "response")), optional=("system_prompt",)),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    *_list("messages", "messages", "role", "content"),
    *_list("conversation list", "conversation", "role", "content"),
    *_list("from and value", "conversations", "from", "value", ALIASES),
)


@dataclass(frozen=True)
class RowLayout:
    """A table with a row for each turn: the columns of its conversation, place, role and text."""

    name: str
    conv_id: str
    turn: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return self.conv_id, self.turn, self.role, self.text


ROW_LAYOUTS = (
    RowLayout("turns", "conv_id", "turn", "role", "text"),
    RowLayout("messages of conversations", "conversation_id", "position", "role", "content"),
    RowLayout("threaded messages", "thread_id", "message_index", "author", "body", ALIASES),
    RowLayout("from and value rows", "id", "index", "from", "value", ALIASES),
)

TURNS = "array<struct<role:string,text:string>>"


def fingerprint(paths: tuple[str, ...]) -> Column:
    """The hash of a layout's nested field paths, to compare with a record's."""
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def schema_paths(schema: T.StructType, prefix: str = "") -> tuple[str, ...]:
    """Nested field paths of a schema; arrays stand for their elements."""
    out: list[str] = []
    for field in schema.fields:
        kind = field.dataType
        out.append(prefix + field.name)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += schema_paths(kind, f"{prefix}{field.name}.")
    return tuple(sorted(out))


#: Every path that some layout of records names.
KNOWN = tuple(sorted({path for layout in LAYOUTS for path in layout.paths}))


def record_paths(record: Column) -> Column:
    """Row by row, a JSON record's nested field paths; null where it is no JSON object.

    They are read off the record's variant schema token by token: a name stands before a colon, and belongs
    to what encloses it; lists stand for their elements. A name with other characters than letters, digits
    and underscores comes in backticks and keeps them, so that it equals no layout's path by accident.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), F.lit("").alias("last"), none.alias("paths"), F.array().cast("array<boolean>").alias("opens"))
    but_last = lambda xs: F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))

    def step(state, token):
        stack, last, paths, opens = (state[k] for k in ("stack", "last", "paths", "opens"))
        opened = F.struct(F.when(last == "", stack).otherwise(F.array_append(stack, last)).alias("stack"), F.lit("").alias("last"), paths.alias("paths"), F.array_append(opens, last != "").alias("opens"))
        closed = F.struct(F.when(F.try_element_at(opens, F.lit(-1)), but_last(stack)).otherwise(stack).alias("stack"), F.lit("").alias("last"), paths.alias("paths"), but_last(opens).alias("opens"))
        named = F.struct(stack.alias("stack"), token.alias("last"), F.array_append(paths, F.array_join(F.array_append(stack, token), ".")).alias("paths"), opens.alias("opens"))
        return F.when(token.isin("OBJECT<", "ARRAY<"), opened).when(token == ">", closed).otherwise(named)

    tokens = F.regexp_extract_all(shape, F.lit(r"(?:`(?:[^`]|``)*`|\w+)(?=: )|OBJECT<|ARRAY<|>"), F.lit(0))
    return F.when(F.startswith(shape, F.lit("OBJECT<")), F.aggregate(tokens, start, step, lambda s: s["paths"]))


def record_fingerprint(record: Column) -> Column:
    """The hash of those of a JSON record's field paths that layouts know."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(record_paths(record), F.lit(list(KNOWN)))), "\n"))


def _fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _role(role: Column, layout: Layout) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, canonical in layout.roles:
        out = F.when(role == name, F.lit(canonical)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: Layout, value) -> Column:
    """A layout's turns; ``value(path)`` gives the column at a path."""
    if layout.items:
        said = lambda x: x if not layout.parts else F.array_join(F.transform(x, lambda p: F.coalesce(p[layout.parts], F.lit(""))), "")
        return F.transform(F.coalesce(value(layout.items), F.array()), lambda x: _turn(_role(x[layout.role], layout), said(x[layout.text])))
    turns = F.array(*[F.when((F.coalesce(value(path), F.lit("")) == "") & F.lit(path in layout.optional), F.lit(None)).otherwise(_turn(F.lit(role), value(path))) for role, path in layout.fixed])
    return F.filter(turns, lambda x: x.isNotNull())


def turns_of_schema(df: DataFrame, ignore: tuple[str, ...] = ()) -> Column:
    """Turns of a table with a row a record, whose layout its schema's fingerprint chooses."""
    own = schema_paths(T.StructType([f for f in df.schema.fields if f.name not in ignore]))
    by_print = {_fingerprint_of(layout.paths): layout for layout in LAYOUTS if layout.items not in layout.paths or len(layout.paths) > 1}
    layout = by_print.get(_fingerprint_of(set(own) & set(KNOWN)))
    if layout is None:
        raise ValueError(f"no layout has the field paths {own}")
    return _mapped(layout, lambda path: F.col(f"`{path}`")).cast(TURNS)


def rows_of_table(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with a row a turn, whose layout its schema's fingerprint chooses."""
    own = set(schema_paths(df.schema))
    fits = [layout for layout in ROW_LAYOUTS if _fingerprint_of(own & set(layout.paths)) == _fingerprint_of(layout.paths)]
    if not fits:
        raise ValueError(f"no layout of rows has the field paths {tuple(sorted(own))}")
    layout = fits[0]
    role = F.coalesce(F.col(f"`{layout.role}`"), F.lit(""))
    for name, canonical in layout.roles:
        role = F.when(role == name, F.lit(canonical)).otherwise(role)
    return df.select(F.col(f"`{layout.conv_id}`").cast("long").alias("conv_id"), F.col(f"`{layout.turn}`").cast("long").alias("turn"), role.alias("role"), F.col(f"`{layout.text}`").alias("text"))


def layout_of_record(record: Column) -> Column:
    """The name of the layout that a JSON record's fingerprint chooses; null where there is none."""
    mark = record_fingerprint(record)
    return F.coalesce(*[F.when(mark == fingerprint(layout.paths), F.lit(layout.name)) for layout in LAYOUTS])


def turns_of_record(record: Column, strict: bool = False) -> Column:
    """Turns of JSON records of mixed layouts, each chosen by its own fingerprint."""
    mark = record_fingerprint(record)
    unknown = F.raise_error(F.concat(F.lit("no layout fits the record "), F.coalesce(F.substring(record, 1, 200), F.lit("null")))) if strict else F.array()
    out = unknown.cast(TURNS)
    for layout in reversed(LAYOUTS):
        if layout.items:
            kind = "array<struct<text:string>>" if layout.parts else "string"
            schema = f"{layout.items} array<struct<`{layout.role}`:string,`{layout.text}`:{kind}>>"
        else:
            schema = ", ".join(f"`{path}` string" for path in layout.paths)
        parsed = F.from_json(record, schema)
        out = F.when(mark == fingerprint(layout.paths), _mapped(layout, lambda path, parsed=parsed: parsed[path]).cast(TURNS)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss): one shuffle, by conversation.

    Places are running sums within the conversation, so spans cost no more than the turns.
    """
    pieces = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    pieces = pieces.withColumn("head", head).withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = pieces.select("conv_id", "role", "head", "body", F.row_number().over(order).alias("at"), before.alias("before"))
    learnt = F.when(F.col("role") == LEARNT, F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    row = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), learnt.alias("span"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.filter(F.transform("rows", lambda x: x["span"]), lambda x: x.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    pieces = F.filter(F.split(formatted, r"\Q" + TURN + r"\E"), lambda x: x != "")
    closed = F.transform(pieces, lambda x: F.split(F.left(x, F.length(x) - len(END)), r"\Q" + TEXT + r"\E"))
    return F.transform(closed, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


#: The conversation that the contract adds, as a record in another layout than the table's.
EXTRA = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def canonical_rows(spark, sf_dir: str) -> DataFrame:
    """All rows of ``conversations`` and the turns of conversation -1."""
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(turns_of_record(F.lit(EXTRA), strict=True)).alias("turn", "x"))
    table = rows_of_table(read(spark, sf_dir, "conversations"))
    return table.unionByName(extra.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("x.role").alias("role"), F.col("x.text").alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the output."""
    turns = F.col("turns")
    lines = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join(masked(F.col("formatted"), F.col("loss")), "")
    back = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), learnt.alias("learnt"))
    return back.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
