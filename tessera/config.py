"""Frozen settings, read once on the driver and passed explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

# Spellings of a boolean setting.
YES = ("1", "true", "yes", "on", "si", "sì", "vero")
NO = ("0", "false", "no", "off", "falso")


@dataclass(frozen=True)
class Settings:
    # Defaults that decide results.
    chunk_tokens: int = 400
    chunk_overlap_ratio: float = 0.12
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_constant: int = 60
    top_k: int = 5
    support_threshold: float = 0.55
    cache_threshold: float = 0.92
    abstention_threshold: float = 5.5
    verbatim_min_ratio: float = 0.0
    verbatim_min_chars: int = 40
    structured_max_rows: int = 20
    phrase_min_documents: int = 10
    provenance_min_quota: float = 0.05
    router_enabled: bool = True
    verbatim_enabled: bool = True
    provenance_enabled: bool = True
    embed_batch: int = 64
    embed_dim: int = 1024
    item_retries: int = 4
    item_backoff_s: float = 20.0
    price_input: float = 0.0
    price_output: float = 0.0
    price_cached: float = 0.0
    price_embed: float = 0.0
    strict_filters: bool = False
    model: str = ""
    embed_model: str = ""

    def __post_init__(self):
        check_weights(self.vector_weight, self.keyword_weight)

    @property
    def overlap_tokens(self) -> int:
        return max(0, round(self.chunk_tokens * self.chunk_overlap_ratio))

    def with_overrides(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "TESSERA_") -> Settings:
        """Settings from variables named prefix + FIELD; blank values and values that start with # count as absent."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = (env.get(prefix + f.name.upper()) or "").strip()
            if not raw or raw.startswith("#"):
                continue
            found[f.name] = _boolean(f.name, raw) if f.type == "bool" else int(raw) if f.type == "int" else float(raw) if f.type == "float" else raw
        return cls(**found)


def _boolean(name: str, raw: str) -> bool:
    if raw.lower() in YES:
        return True
    if raw.lower() in NO:
        return False
    raise ValueError(f"{name}: {raw!r} is no boolean")


def check_weights(vector: float, keyword: float) -> None:
    if not (0 <= vector <= 1 and 0 <= keyword <= 1):
        raise ValueError("each weight must be from 0 to 1")
    if abs(vector + keyword - 1) > 0.01:
        raise ValueError("the weights must add up to 1")
