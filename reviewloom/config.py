"""Parameters of the engine, one frozen object that is passed explicitly."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are those of the product; ``from_env`` overrides them by REVIEWLOOM_<NAME>."""

    window_weeks: int = 8
    window_start: str = "2026-07-16"
    enforce_week_end: bool = False
    min_review_length: int = 10
    near_dup_threshold: float = 0.9
    shingle_words: int = 3
    embed_dim: int = 64
    embed_batch: int = 256
    retries: int = 3
    chunk_whole_tokens: int = 512
    chunk_sentence_tokens: int = 1024
    window_tokens: int = 512
    window_overlap: int = 128
    min_clusters: int = 3
    max_clusters: int = 10
    kmeans_k: int = 5
    hdbscan_min_cluster: int = 30
    hdbscan_relaxed_cluster: int = 20
    hdbscan_min_samples: int = 5
    noise_share: float = 0.20
    reduced_dim: int = 15
    label_sample: int = 20
    label_words: int = 6
    quotes_per_theme: int = 3
    report_words: int = 250
    fuzzy_threshold: int = 85
    coverage_floor: int = 30
    version_floor: int = 25
    top_quotes: int = 5
    max_validation_retries: int = 2

    @classmethod
    def from_env(cls) -> EngineConfig:
        found = {}
        for f in fields(cls):
            value = os.environ.get(f"REVIEWLOOM_{f.name.upper()}")
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**found)


DEFAULTS = EngineConfig()
