"""Summaries by rules: what can be read off a trace's rendered text, as native columns.

A text is a sequence of events, one at most for each line: a step's title, a tool that is called, an error, a stall (a line that
tells of a timeout), a request, an answer. A facet is a row of FACETS, a way of reading and the kinds of event that
it reads; there are five ways, and none of them knows a facet:

* ``opening``: the first such event, as what comes first is what was wanted;
* ``closing``: the last such event with its kind, as what a trace ends with is how it ended, whatever went wrong before;
* ``onset``: the first such event and the tool that was called last before it;
* ``tally``: the different events of each kind, marked where they recur;
* ``balance``: whether the first kind's events outnumber the others'.

A facet of a name that has no row is an opening of any request or answer. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import key_phrase

#: Line forms of rendered traces, a pattern whose group is what the event is about.
FORMS = {
    "step": r"^## (\S.*)$",
    "tool": r"^tool: (\S+)",
    "error": r"^ERROR: (.+)$",
    "ask": r"^(?:input|user): (.*)$",
    "answer": r"^(?:output|assistant): (.*)$",
    "stall": r"(?i)^(.*(?:timeout|timed out).*)$",
}
FACETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "goal": ("opening", ("ask",)),
    "outcome": ("closing", ("answer", "error", "stall")),
    "behavior": ("tally", ("tool", "error", "stall")),
    "failure-stage": ("onset", ("error", "stall")),
    "sentiment": ("balance", ("answer", "error", "stall")),
    "resolution-path": ("tally", ("tool", "answer")),
    "files-touched": ("tally", ("tool",)),
}
OTHERS = ("opening", ("ask", "answer"))
NOTHING = "nothing to tell"


def events(text: Column) -> Column:
    """array<struct<kind, what>> of a rendered text, in order of its lines; a line is of the first form that it fits."""

    def event(line: Column) -> Column:
        kind, what = F.lit(None).cast("string"), F.lit("")
        for name, form in reversed(FORMS.items()):
            kind, what = F.when(line.rlike(form), name).otherwise(kind), F.when(line.rlike(form), F.regexp_extract(line, form, 1)).otherwise(what)
        return F.struct(kind.alias("kind"), key_phrase(what, "").alias("what"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), event), lambda e: e["kind"].isNotNull())


def _of(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda e: e["kind"].isin(*kinds))


def slowest(found: Column) -> Column:
    """The most milliseconds that a step's title names; 0 without any."""
    took = F.transform(_of(found, "step"), lambda e: F.regexp_extract(e["what"], r"\((\d+)ms\)$", 1).try_cast("long"))
    return F.coalesce(F.array_max(took), F.lit(0).cast("long"))


def _opening(found: Column, kinds: tuple[str, ...]) -> Column:
    return F.nullif(F.get(_of(found, *kinds), F.lit(0))["what"], F.lit(""))


def _closing(found: Column, kinds: tuple[str, ...]) -> Column:
    last = F.try_element_at(_of(found, *kinds), F.lit(-1))
    return F.concat(last["kind"], F.lit(": "), last["what"])


def _onset(found: Column, kinds: tuple[str, ...]) -> Column:
    at = F.array_position(F.transform(found, lambda e: e["kind"].isin(*kinds)), True).cast("int")
    tool = F.try_element_at(_of(F.slice(found, F.lit(1), at), "tool"), F.lit(-1))["what"]
    return F.when(at > 0, F.concat(F.try_element_at(found, F.nullif(at, F.lit(0)))["what"], F.lit(" after "), F.coalesce(tool, F.lit("no tool"))))


def _tally(found: Column, kinds: tuple[str, ...]) -> Column:
    def told(kind: str) -> Column:
        every = F.transform(_of(found, kind), lambda e: e["what"])
        marked = F.transform(F.array_distinct(every), lambda x: F.concat(x, F.when(F.size(F.filter(every, lambda y: y == x)) > 1, F.lit(" (recurs)")).otherwise(F.lit(""))))
        return F.when(F.size(every) > 0, F.concat(F.lit(f"{kind}: "), F.array_join(marked, ", ")))

    return F.nullif(F.concat_ws("; ", *map(told, kinds)), F.lit(""))


def _balance(found: Column, kinds: tuple[str, ...]) -> Column:
    good, bad = F.size(_of(found, kinds[0])), F.size(_of(found, *kinds[1:]))
    return F.when(bad == 0, "calm").when(good > bad, "mixed").otherwise("troubled")


_WAYS = {"opening": _opening, "closing": _closing, "onset": _onset, "tally": _tally, "balance": _balance}


def line(facet: str, found: Column) -> Column:
    """A facet's line from the events ``found``."""
    way, kinds = FACETS.get(facet, OTHERS)
    return F.coalesce(_WAYS[way](found, kinds), F.lit(NOTHING))


def summaries(text: Column, facets: list[str]) -> Column:
    """map<facet, line> of a rendered text, natively."""
    return F.get(F.transform(F.array(events(text)), lambda e: F.create_map(*[x for f in facets for x in (F.lit(f), line(f, e))])), F.lit(0))
