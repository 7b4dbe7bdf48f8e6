"""Privacy: ordered redaction rules, as native columns and for single texts.

Rules claim text in their order, so the more specific ones come first. Tokens are numbered within one text
(trace scope) or derived from a salted hash (global scope). ``redact`` is the gate as a native column, and
``redact_text`` its plain form for single texts on the driver; other columns mask, count or hash single rules.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("off", "mask", "pseudonymize")
SCOPES = ("trace", "global")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Rule name, token label and pattern, in the order in which rules claim text.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("url", "URL", r"(?i)\bhttps?://[^\s<>\"']+\?[^\s<>\"']*"),
    ("email", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("uuid", "UUID", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("token", "TOKEN", r"(?i)\b(?:sk|pk|rk|api|key)[-_][A-Za-z0-9_-]{16,}\b"),
    ("secret", "SECRET", r"(?i)\b(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("card", "CARD", r"\b\d(?:[ -]?\d){11,18}\b"),
    ("ip", "IP", rf"(?i)\b(?:{_OCTET}\.){{3}}{_OCTET}\b|\b(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}\b"),
    ("ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("phone", "PHONE", r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{2,4}[\s.-]\d{2,4}[\s.-]?\d{2,4}\b"),
)
RULE_NAMES = tuple(name for name, _, _ in PATTERNS)
_LABEL = {name: label for name, label, _ in PATTERNS}
_COMPILED = {name: re.compile(pattern, re.ASCII) for name, _, pattern in PATTERNS}
_TOKEN = re.compile(f"<(?:{'|'.join(_LABEL.values())})(?:_\\w+)?>")


def luhn_valid(text: str) -> bool:
    """The mod-10 check over the digits of ``text``; 12 to 19 digits."""
    digits = [int(c) for c in text if c in "0123456789"]
    if not 12 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _accepted(rule: str, match: str) -> bool:
    if rule == "card":
        return luhn_valid(match)
    if rule == "phone":
        return 9 <= sum(c in "0123456789" for c in match) <= 15
    return True


@dataclass(frozen=True)
class Gate:
    mode: str = "pseudonymize"
    scope: str = "trace"
    salt: str = ""
    rules: tuple[str, ...] = RULE_NAMES

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.scope not in SCOPES:
            raise ValueError(f"unknown privacy mode or scope: {self.mode}, {self.scope}")
        for name in self.rules:
            if name not in RULE_NAMES:
                raise ValueError(f"no redaction rule is called {name!r}; the rules are {', '.join(RULE_NAMES)}")


@dataclass
class Redacted:
    text: str
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.counts.values())


def redact_text(text: str, gate: Gate = Gate()) -> Redacted:  # noqa: B008
    if gate.mode == "off" or not text:
        return Redacted(text)
    out = Redacted(text)
    tokens: dict[tuple[str, str], str] = {}
    numbers: dict[str, int] = {}

    def token(rule: str, value: str) -> str:
        label = _LABEL[rule]
        if gate.mode == "mask":
            return f"<{label}>"
        if gate.scope == "global":
            return f"<{label}_{hashlib.sha256(f'{gate.salt}:{rule}:{value}'.encode()).hexdigest()[:8]}>"
        if (rule, value) not in tokens:
            numbers[label] = numbers.get(label, 0) + 1
            tokens[rule, value] = f"<{label}_{numbers[label]}>"
        return tokens[rule, value]

    for rule in gate.rules:

        def replace(m: re.Match, rule: str = rule) -> str:
            found = m.group()
            replaced = _TOKEN.fullmatch(found) or rule == "url" and found.endswith("?") and m.string.startswith("<URL", m.end())
            if not _accepted(rule, found) or replaced:
                return found
            out.counts[rule] = out.counts.get(rule, 0) + 1
            named = token(rule, found)
            return f"{found.split('?', 1)[0]}?{named}" if rule == "url" else named

        out.text = _COMPILED[rule].sub(replace, out.text)
    return out


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _holds(rule: str, match: Column) -> Column:
    """Whether a match of the rule's pattern passes its validator."""
    if rule == "card":
        return F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match))
    if rule == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _named(rule: str, gate: Gate, value: Column, known: Column) -> Column:
    """The token that stands for a value; ``known`` holds the rule's values in the order in which they came."""
    label = _LABEL[rule]
    if gate.mode == "mask":
        token = F.lit(f"<{label}>")
    elif gate.scope == "global":
        token = global_token(value, rule, gate.salt)
    else:
        token = F.concat(F.lit(f"<{label}_"), F.array_position(known, value).cast("string"), F.lit(">"))
    return F.concat(F.substring_index(value, "?", 1), F.lit("?"), token) if rule == "url" else token


def redact(text: Column, gate: Gate = Gate()) -> Column:  # noqa: B008
    """The gate over a column, natively: struct of text, counts by rule and total.

    Each rule splits the text at its matches and joins it again with their tokens, so a value is replaced
    only where it was found; the next rule sees what the one before has left.
    """
    none = F.array().cast("array<struct<key:string,value:int>>")
    state = F.struct(text.alias("text"), none.alias("counts"))

    def apply(rule: str):
        # a URL that was redacted before ends in the mark of its token, and isn't matched again
        pattern = _pattern(rule) + "+(?!<URL)" if rule == "url" else _pattern(rule)

        def step(s):
            def joined(matches):
                own = F.filter(matches, lambda x: _holds(rule, x))
                known = F.array_distinct(own)
                tokens = F.transform(matches, lambda x: F.when(_holds(rule, x), _named(rule, gate, x, known)).otherwise(x))
                whole = F.array_join(F.zip_with(F.split(s["text"], pattern, -1), tokens, lambda part, token: F.concat(part, F.coalesce(token, F.lit("")))), "")
                counted = F.struct(F.lit(rule).alias("key"), F.size(own).alias("value"))
                touched = F.struct(whole.alias("text"), F.array_append(s["counts"], counted).alias("counts"))
                return F.when(F.size(own) > 0, touched).otherwise(s)

            return _let(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), joined)

        return step

    for rule in gate.rules if gate.mode != "off" else ():
        state = _let(state, apply(rule))
    total = lambda s: F.aggregate(s["counts"], F.lit(0), lambda n, x: n + x["value"])
    out = _let(state, lambda s: F.struct(s["text"].alias("text"), F.map_from_entries(s["counts"]).alias("counts"), total(s).alias("total")))
    nothing = F.struct(text.alias("text"), F.map_from_entries(none).alias("counts"), F.lit(0).alias("total"))
    return F.when(text.isNull(), nothing).otherwise(out)


def _pattern(rule: str) -> str:
    return next(p for name, _, p in PATTERNS if name == rule)


def matches(text: Column, rule: str) -> Column:
    """All matches of one rule in a text, after its validator."""
    found = F.regexp_extract_all(text, F.lit(_pattern(rule)), F.lit(0))
    return F.filter(found, lambda x: _holds(rule, x)) if rule in ("card", "phone") else found


def count(text: Column, rule: str) -> Column:
    return F.size(matches(text, rule)).cast("long")


def mask(text: Column, rules: tuple[str, ...] = ("url", "email", "uuid", "token", "secret", "ip", "ssn")) -> Column:
    """Mask rules that need no validator, natively, in the gate's order."""
    for name in [n for n in RULE_NAMES if n in rules]:
        if name in ("card", "phone"):
            raise ValueError(f"rule {name} has a validator; use redact")
        if name == "url":
            text = F.regexp_replace(text, r"(?i)\b(https?://[^\s<>\"'?]+)\?[^\s<>\"']*", "$1?<URL>")
        else:
            text = F.regexp_replace(text, _pattern(name), f"<{_LABEL[name]}>")
    return text


def preview(df: DataFrame, text: str = "text", gate: Gate = Gate(), samples: int = 3) -> DataFrame:  # noqa: B008
    """What the gate would replace: (rule, total, texts, samples), by total; samples are a few touched texts, redacted."""
    found = df.select(redact(F.col(text), gate).alias("r")).where("r.total > 0").select(F.explode("r.counts").alias("rule", "n"), F.left("r.text", F.lit(200)).alias("sample"))
    ranked = found.groupBy("rule").agg(F.sum("n").alias("total"), F.count("*").alias("texts"))
    few = found.withColumn("p", F.row_number().over(Window.partitionBy("rule").orderBy("sample"))).where(F.col("p") <= samples)
    shown = few.groupBy("rule").agg(F.sort_array(F.collect_list("sample")).alias("samples"))
    return ranked.join(shown, "rule").orderBy(F.desc("total"), "rule")


def global_token(value: Column, rule: str, salt: str) -> Column:
    """The global-scope pseudonym of a value, natively."""
    return F.concat(F.lit(f"<{_LABEL[rule]}_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:{rule}:"), value).cast("binary"), 256), 1, 8), F.lit(">"))
