"""Deterministic stand-ins with known geometry, for tests and demos."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..config import Facet
from .providers import UNCLEAR, Embedder

_MASK = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 2166136261
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) & _MASK
    return h


def mulberry32(seed: int) -> Callable[[], float]:
    """The 32-bit generator of that name, as numbers from 0 to 1."""
    state = seed & _MASK

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _MASK
        t = ((state ^ state >> 15) * (state | 1)) & _MASK
        t ^= (t + ((t ^ t >> 7) * (t | 61) & _MASK)) & _MASK
        return ((t ^ t >> 14) & _MASK) / 2**32

    return draw


def gaussian(draw: Callable[[], float]) -> float:
    """A standard normal number by Box and Muller."""
    u = 0.0
    while u == 0.0:
        u = draw()
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * draw())


class ScriptedSummarizer:
    """Replays lines by trace text; an unscripted text is an error."""

    def __init__(self, script: dict[str, dict[str, str]]):
        self.script = script

    def summarize(self, text: str, facets: tuple[Facet, ...]) -> dict[str, str]:
        if text not in self.script:
            raise KeyError(f"no script for the trace {text[:60]!r}")
        return {f.name: self.script[text].get(f.name, UNCLEAR) for f in facets}


class ParaphraseSummarizer:
    """Says each of an inner summarizer's lines in one of several wordings, chosen by the text."""

    def __init__(self, inner, wordings: dict[str, list[str]]):
        self.inner, self.wordings = inner, wordings

    def summarize(self, text: str, facets: tuple[Facet, ...]) -> dict[str, str]:
        def said(line: str) -> str:
            for concept, ways in self.wordings.items():
                if concept in line:
                    return ways[fnv1a(text) % len(ways)]
            return line

        return {k: said(v) for k, v in self.inner.summarize(text, facets).items()}


class ModeEmbedder:
    """Puts a text near one of several orthogonal directions, by the first mode that it names."""

    def __init__(self, dimensions: int, modes: list[str], seed: int = 1, noise: float = 0.1):
        if len(modes) > dimensions:
            raise ValueError("each mode needs a dimension of its own")
        self.dimensions, self.modes, self.seed, self.noise = dimensions, modes, seed, noise

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            at = next((i for i, m in enumerate(self.modes) if m.lower() in text.lower()), len(self.modes))
            draw = mulberry32(self.seed + fnv1a(text))
            row[at % self.dimensions] = 1
            row += [gaussian(draw) * self.noise for _ in range(self.dimensions)]
            row /= np.linalg.norm(row)
        return out


class ConceptEmbedder:
    """Stated cosines: ``within`` between texts of one concept, ``between`` for texts of two."""

    def __init__(self, dimensions: int, concept_of: Callable[[str], str], within: float = 0.80, between: float = 0.45):
        self.dimensions, self.concept_of, self.within, self.between = dimensions, concept_of, within, between

    def _direction(self, name: str) -> np.ndarray:
        x = np.random.Generator(np.random.PCG64(fnv1a(name))).normal(size=self.dimensions)
        return x / np.linalg.norm(x)

    def embed(self, texts: list[str]) -> np.ndarray:
        common = self._direction("")
        parts = [math.sqrt(self.between) * common + math.sqrt(self.within - self.between) * self._direction(f"concept {self.concept_of(t)}") + math.sqrt(1 - self.within) * self._direction(f"text {t}") for t in texts]
        return np.array(parts).reshape(len(texts), self.dimensions)


class RecordingEmbedder:
    """Remembers what it was asked to embed."""

    def __init__(self, inner: Embedder):
        self.inner, self.dimensions, self.seen, self.calls = inner, inner.dimensions, [], 0

    def embed(self, texts: list[str]) -> np.ndarray:
        self.calls += 1
        self.seen += texts
        return self.inner.embed(texts)
