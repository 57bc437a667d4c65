"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    vector_top_k: int = 40
    bm25_top_k: int = 40
    final_top_k: int = 12
    rrf_k: int = 60
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    rerank_candidates: int = 40
    chunk_chars: int = 1600
    chunk_max_chars: int = 2600
    chunk_overlap: int = 200
    supplementary_enabled: bool = True
    tier4_share: float = 0.25
    # Okapi defaults; the scoring library's values are an assumption
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


DEFAULT = EngineConfig()
