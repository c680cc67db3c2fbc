"""A query as data: its text, its mode, its filters."""

from __future__ import annotations

import re
import time
import warnings
from dataclasses import dataclass, field, replace

from glintdex.functions.text import STOP_WORDS

_UNITS = {"GB": 30, "MB": 20, "KB": 10}


def split_terms(text: str | None, stop: bool = True) -> list[str]:
    """The same terms as the tokenizer's columns give, on the driver."""
    return [t for t in re.split("[^a-z0-9]+", (text or "").lower()) if t and not (stop and t in STOP_WORDS)]


@dataclass(frozen=True)
class Parsed:
    terms: list[str]
    phrase: bool


def parse(raw: str | None) -> Parsed:
    """A text in double quotes, with something between them, is a phrase and keeps its stop words."""
    text = (raw or "").strip()
    if len(text) > 2 and text[0] == text[-1] == '"':
        return Parsed(split_terms(text[1:-1], stop=False), True)
    return Parsed(split_terms(text), False)


def parse_size(text: str | None) -> int | None:
    """Bytes of ``10``, ``10KB``, ``10MB`` or ``10GB``; None, with a warning, for anything else."""
    if not text or not text.strip():
        return None
    m = re.fullmatch(r"([+-]?\d+)(GB|MB|KB)?", text.strip().upper())
    if not m:
        warnings.warn(f"not a size: {text!r}", stacklevel=2)
        return None
    return int(m[1]) << _UNITS.get(m[2], 0)


def parse_since(text: str | None, now: int | None = None) -> int | None:
    """Epoch milliseconds of ``7d`` or ``24h`` before ``now``; None, with a warning, for anything else."""
    if not text or not text.strip():
        return None
    m = re.fullmatch(r"([+-]?\d+)([dh])", text.strip().lower())
    if not m:
        warnings.warn(f"not a duration: {text!r}", stacklevel=2)
        return None
    now = int(time.time() * 1000) if now is None else now
    return now - int(m[1]) * (86_400_000 if m[2] == "d" else 3_600_000)


@dataclass(frozen=True)
class Filters:
    """All that are given must hold.  The extension is exact, with its dot, in any case."""

    extension: str | None = None
    min_size: int | None = None
    modified_after: int | None = None


@dataclass(frozen=True)
class QuerySpec:
    raw: str
    fuzzy: bool = False
    prefix: bool = False
    regex: bool = False
    filters: Filters = field(default_factory=Filters)

    def parsed(self) -> Parsed:
        return parse(self.raw)

    @property
    def mode(self) -> str:
        """Regex goes before phrase, then fuzzy, prefix and keyword."""
        if self.regex:
            return "regex"
        if self.parsed().phrase:
            return "phrase"
        return "fuzzy" if self.fuzzy else "prefix" if self.prefix else "keyword"

    def without_filters(self) -> QuerySpec:
        return replace(self, filters=Filters())
