"""Settings of the workspace operators.  Defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    load: float = 0.7
    unload: float = 0.55

    @classmethod
    def permissive(cls) -> "Thresholds":
        return cls(0.3, 0.2)


@dataclass(frozen=True)
class TokenBudget:
    max_total: int
    reserved_prompt: int = 0
    reserved_answer: int = 0

    @property
    def workspace(self) -> int:
        return max(0, self.max_total - (self.reserved_prompt + self.reserved_answer))


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; tokens where the name says so."""

    token_threshold: int = 500
    target: int = 1400
    cap: int = 1800
    overlap: int = 280
    max_body_tokens: int = 500
    floors: tuple[int, int, int] = (200, 300, 80)
    max_depth: int = 3

    def tightened(self) -> "Chunking":
        a, b, c = self.floors
        return Chunking(self.token_threshold, max(self.target // 2, a), max(self.cap // 2, b), max(self.overlap // 2, c), self.max_body_tokens, self.floors, self.max_depth)


@dataclass(frozen=True)
class Recall:
    max_candidates: int = 60
    max_initial: int = 4
    max_fragments: int = 50
    per_source: int = 3
    history_share: float = 0.25
    decay: float = 0.8
    refresh_margin: float = 0.2
    upgrade_stub_tokens: int = 1500
    upgrade_chars: int = 4500
    max_passes: int = 3
    min_new_tokens: int = 200
    window_tokens: int = 192
    window_every: int = 32
    thresholds: Thresholds = field(default_factory=Thresholds)


@dataclass(frozen=True)
class History:
    trigger_share: float = 0.30
    retain_recent: int = 3
    tool_tokens: int = 500
    warn_share: float = 0.8


#: BM25, fusion and expansion constants.
BM25_K1, BM25_B = 1.2, 0.75
COSINE_WEIGHT, BM25_WEIGHT = 0.6, 0.4
F32_EPSILON = 1.1920929e-7
RRF_K = 60
OVERFETCH = 3
EXPAND_DISCOUNT, EXPAND_CAP = 0.5, 8
TOPIC_TERMS, TOPIC_OVERLAP = 20, 0.3
