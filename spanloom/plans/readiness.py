"""Whether a run would work, before it is paid for: settings, one call to each endpoint, and the stored themes.

Each check gives findings (what, level, said): ``ok``, ``note`` for what works but should be known, ``fail``. Probes go
once, without retries, so that a wrong key or a busy endpoint shows within seconds. No check shows a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, ConfigError, validate
from ..functions import providers
from ..functions.privacy import Gate, redact_text

SECONDS = 20.0
#: A run with an address in it, so that the gate has something to do.
SAMPLE = "## chat (900ms)\ninput: my parcel didn't come, write to jo@example.org\n## tool (300ms)\ntool: tracking\noutput: it arrives tomorrow"
#: Two ways to say one thing, and something else.
TEXTS = ("a parcel was late and the agent looked it up", "the agent checked on a delayed delivery", "the person wanted a poem about rain")
#: Similarities closer than this don't tell like from unlike.
LEAST_GAP = 0.1


@dataclass(frozen=True)
class Finding:
    what: str
    level: str
    said: str


def settings(config: Config) -> Iterator[Finding]:
    parts = (("settings", validate), ("summarizer", providers.make_summarizer), ("labeler", providers.make_labeler), ("embedder", providers.make_embedder))
    for what, run in parts:
        try:
            run(config)
            yield Finding(what, "ok", "ok")
        except ConfigError as e:
            yield Finding(what, "fail", str(e))


def coherence(config: Config) -> Iterator[Finding]:
    """Settings that are right by themselves and wrong together."""
    problems = []
    maker = {"anthropic": "claude"}.get(config.llm.provider)
    if config.llm.provider != "fake":
        host = urlsplit(config.llm.base_url).hostname or ""
        known = {p for p in ("openai", "anthropic") if host.endswith(f"{p}.com")}
        if known and config.llm.provider not in known:
            problems.append(f"llm provider {config.llm.provider} with an address of {', '.join(known)}: {config.llm.base_url}")
        if maker and not config.llm.model.startswith(maker):
            problems.append(f"llm provider {config.llm.provider} doesn't serve a model called {config.llm.model}")
    if config.assign_threshold <= 1 - config.merge_threshold - 0.25:
        problems.append(f"assign_threshold {config.assign_threshold} takes in what merge_threshold {config.merge_threshold} keeps apart")
    yield Finding("coherence", "fail" if problems else "ok", "; ".join(problems) or "settings agree")


def privacy(config: Config) -> Iterator[Finding]:
    bare = config.llm.provider != "fake" and config.privacy.mode == "off"
    yield Finding("privacy", "fail" if bare else "ok", "trace text leaves unredacted" if bare else f"mode {config.privacy.mode}, scope {config.privacy.scope}")


def model_answers(config: Config, post: Callable) -> Iterator[Finding]:
    """One summary of SAMPLE, through the gate: address, key, model and reply in a single call."""
    if config.llm.provider == "fake":
        return
    facets = config.active_facets()
    told = redact_text(SAMPLE, Gate(config.privacy.mode, config.privacy.scope, config.privacy.salt or "")).text
    try:
        found = providers.HostedModel(config.llm, post).summarize(told, facets)
    except (ConfigError, RuntimeError, ValueError, LookupError) as e:
        yield Finding("model answers", "fail", f"{config.llm.model} at {config.llm.base_url}: {e}")
        return
    bare = [f.name for f in facets if not str(found.get(f.name, "")).strip()]
    yield Finding("model answers", "fail" if bare else "ok", f"no line for {', '.join(bare)}" if bare else f"{len(facets)} facets, such as {found[facets[0].name][:60]!r}")


def vectors_tell(config: Config, post: Callable) -> Iterator[Finding]:
    """Three embeddings: their width, and whether the thresholds can tell a paraphrase from something else."""
    e = config.embeddings
    if e.provider == "hash":
        yield Finding("vectors", "note", "the hash embedder compares words, not meanings")
        return
    try:
        near, like, far = providers.HostedEmbedder(e.base_url, e.model, e.api_key, e.dimensions, post).embed(list(TEXTS))
    except (ConfigError, RuntimeError, ValueError, LookupError) as error:
        yield Finding("vectors", "fail", f"{e.model} at {e.base_url}: {error}")
        return
    cosine = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    same, other = cosine(near, like), cosine(near, far)
    said = f"paraphrases {same:.2f}, others {other:.2f}"
    faults = ["they hardly differ"] if same - other < LEAST_GAP else []
    faults += [f"merge_threshold {config.merge_threshold} keeps paraphrases apart"] if 1 - same > config.merge_threshold else []
    faults += [f"assign_threshold {config.assign_threshold} lets others in"] if other >= config.assign_threshold else []
    yield Finding("vectors", "note" if faults else "ok", "; ".join([said, *faults]))


def stored(config: Config, themes: DataFrame | None, pending: DataFrame | None) -> Iterator[Finding]:
    """Themes of another width can't take new members; and what is waiting."""
    if themes is not None:
        widths = sorted(r.width for r in themes.select(F.size("centroid").alias("width")).distinct().collect())
        odd = [w for w in widths if w != config.embeddings.dimensions]
        yield Finding("themes", "fail" if odd else "ok", f"stored themes have {', '.join(map(str, odd))} dimensions, {config.embeddings.dimensions} are configured" if odd else f"of {config.embeddings.dimensions} dimensions")
    if pending is not None:
        n = pending.count()
        yield Finding("pending", "ok", f"{n} traces wait for summaries" if n else "nothing waits for summaries")


def readiness(config: Config, probe: bool = True, post: Callable = providers.post_json, themes: DataFrame | None = None, pending: DataFrame | None = None) -> list[Finding]:
    """All findings; endpoints are called only where ``probe`` says so and the settings hold."""
    found = [*settings(config), *coherence(config), *privacy(config)]
    if probe and all(f.level != "fail" for f in found if f.what != "privacy"):
        once = partial(post, attempts=1, timeout=SECONDS)
        found += [*model_answers(config, once), *vectors_tell(config, once)]
    return [*found, *stored(config, themes, pending)]
