"""Options of a retrieval request, and settings from the environment."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

MODES = ("dense", "lexical", "hybrid")


@dataclass(frozen=True)
class Request:
    """One search; None is an option that was not given."""

    query: str
    k: int = 5
    mode: str = "hybrid"
    fusion: str | None = None
    rrf_k: int | None = None
    weights: Mapping[str, float] | None = None
    candidates: int | None = None
    rerank: bool = False
    filters: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        def refuse(if_: bool, why: str) -> None:
            if if_:
                raise ValueError(why)

        refuse(not self.query.strip() or len(self.query) > 4096, "the query must have 1 to 4096 characters, not all blank")
        refuse(not 1 <= self.k <= 100, "k must be 1 to 100")
        refuse(self.mode not in MODES, f"mode must be one of {MODES}")
        refuse(self.fusion not in (None, "rrf", "weighted"), "fusion must be rrf or weighted")
        refuse(self.mode != "hybrid" and not (self.fusion is self.rrf_k is self.weights is None), "fusion, rrf_k and weights are for hybrid searches")
        refuse(self.rrf_k is not None and (self.rrf_k < 0 or self.fusion == "weighted"), "rrf_k is for rrf, and not negative")
        refuse(self.candidates is not None and not 1 <= self.candidates <= 1000, "candidates must be 1 to 1000")
        refuse(self.candidates is not None and self.mode != "hybrid" and not self.rerank, "candidates are for hybrid searches and reranking")
        if self.weights is not None:
            values = list(self.weights.values())
            refuse(not set(self.weights) <= {"dense", "lexical"} or not values, "weights are for dense and lexical")
            refuse(any(not math.isfinite(w) or w < 0 for w in values) or not any(values), "weights must be finite, not negative and not all zero")
        refuse(len(self.filters) > 16, "at most 16 filters")
        for key, value in self.filters.items():
            many = list(value) if isinstance(value, (list, tuple)) else [value]
            refuse(not key or not many or len(many) > 100, "a filter needs a name and 1 to 100 values")
            refuse(any(isinstance(v, float) and not math.isfinite(v) for v in many), "filter values must be finite")


def parse_filters(pairs: list[str]) -> dict[str, object]:
    """KEY=VALUE strings; a key given again means any of its values; page numbers are integers."""
    out: dict[str, list] = {}
    for pair in pairs:
        key, sep, value = pair.partition("=")
        if not sep or not key:
            raise ValueError(f"a filter is KEY=VALUE, not {pair!r}")
        out.setdefault(key, []).append(int(value) if key == "page" else value)
    return {k: v if len(v) > 1 else v[0] for k, v in out.items()}


def parse_weights(pairs: list[str]) -> dict[str, float] | None:
    """NAME=NUMBER strings; None without any."""
    out = {}
    for pair in pairs:
        name, sep, value = pair.partition("=")
        if not sep:
            raise ValueError(f"a weight is NAME=NUMBER, not {pair!r}")
        out[name] = float(value)
    return out or None


@dataclass(frozen=True)
class Settings:
    strategy: str = "structure"
    size: int = 256
    overlap: int = 32
    min_tokens: int = 16
    embedder: str = "hashing"
    max_bytes: int = 20 << 20

    @classmethod
    def from_env(cls, environ: Mapping[str, str] | None = None, prefix: str = "LODESTAR_") -> Settings:
        """Settings named in the environment; blank means not set; a wrong number is a ValueError."""
        environ = os.environ if environ is None else environ
        given = {}
        for name, f in cls.__dataclass_fields__.items():
            if raw := environ.get(prefix + name.upper(), "").strip():
                given[name] = int(raw) if isinstance(f.default, int) else raw
        return cls(**given)
