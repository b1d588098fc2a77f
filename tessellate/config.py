"""Settings of the retrieval and limiter operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    k1: float = 1.5
    b: float = 0.75
    min_score: float = 18.0
    min_terms: int = 3
    expansion_weight: float = 0.25
    title_boost: float = 4.0
    title_boost_most: float = 16.0
    section_boost: float = 2.0
    entity_boost: float = 10.0
    entity_boost_most: float = 20.0
    structural_penalty: float = 50.0
    per_group: int = 4
    structural_per_group: int = 1


@dataclass(frozen=True)
class Limits:
    per_minute: int = 6
    per_day: int = 20
    window_ms: int = 60_000
    anchored_most: int = 40
    history: int = 12
    message_chars: int = 2000
    #: Visitors that a day's counter of a site goes up to; None: all.
    uv_most: int | None = 5000
    context_chars: int = 30_000


@dataclass(frozen=True)
class Chunks:
    least: int = 1200
    most: int = 2000
    #: Marks after which a paragraph that is too long may be cut.
    ends: str = "。！？；"
    #: What is between paragraphs, a pattern; None: a text is one paragraph.
    breaks: str | None = "\n\n+"
