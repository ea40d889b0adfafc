"""Settings of the engine: plain values handed from call to call."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass

PROVIDERS = ("hash",)
RERANKERS = ("none", "rules", "llm")
GROUNDING = ("off", "warn", "strict")


@dataclass(frozen=True)
class Settings:
    embedding_provider: str = "hash"
    embedding_dim: int = 1024
    embed_batch_size: int = 16
    chunk_target_chars: int = 1200
    chunk_overlap_chars: int = 200
    min_chars_per_page: int = 120
    search_top_k: int = 10
    search_candidates: int = 50
    rrf_k: int = 60
    weight_dense: float = 1.0
    weight_sparse: float = 1.0
    weight_trigram: float = 0.6
    trigram_threshold: float = 0.6
    neighbor_window: int = 1
    near_dup_similarity: float = 0.9
    section_cap: int = 3
    query_expansion: bool = True
    rerank_provider: str = "rules"
    rerank_candidates: int = 30
    grounding_mode: str = "warn"
    llm_context_size: int = 8192
    llm_max_tokens: int = 1024
    rate_limit_per_min: int = 60
    glossary_path: str = ""

    @property
    def path_weights(self) -> dict[str, float]:
        """The exact path outweighs the stronger of sparse and dense by half."""
        return {"dense": self.weight_dense, "sparse": self.weight_sparse, "exact": 1.5 * max(self.weight_sparse, self.weight_dense), "trigram": self.weight_trigram}

    @property
    def context_chars(self) -> int:
        """Characters of evidence a prompt has room for."""
        return int(max(self.llm_context_size - self.llm_max_tokens - 600, 512) * 2.2)


def from_env(env: dict[str, str] | None = None) -> Settings:
    """Settings from variables named like the fields in upper case."""
    env, values = dict(os.environ) if env is None else env, {}
    for f in dataclasses.fields(Settings):
        raw = env.get(f.name.upper())
        if raw is not None:
            kind = type(f.default)
            values[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return Settings(**values)


def problems(s: Settings) -> tuple[list[str], list[str]]:
    """(errors, warnings); with errors nothing should start."""
    errors, warnings = [], []
    if not 0 <= s.chunk_overlap_chars < s.chunk_target_chars:
        errors.append("chunk_overlap_chars must be at least 0 and below chunk_target_chars")
    if s.search_candidates < s.search_top_k:
        errors.append("search_candidates must not be below search_top_k")
    if s.embedding_dim < 1:
        errors.append("embedding_dim must be positive")
    if s.embedding_provider not in PROVIDERS:
        errors.append(f"unknown embedding provider {s.embedding_provider!r}")
    if s.rerank_provider not in (*RERANKERS, "off", ""):
        errors.append(f"unknown reranker {s.rerank_provider!r}")
    if s.grounding_mode not in GROUNDING:
        errors.append(f"unknown grounding mode {s.grounding_mode!r}")
    if s.query_expansion and not (s.glossary_path and os.path.exists(s.glossary_path)):
        warnings.append("no glossary file: questions are expanded by the built-in one")
    if s.rate_limit_per_min <= 0:
        warnings.append("rate limiting is off")
    if s.rerank_candidates < s.search_top_k:
        warnings.append("rerank_candidates is below search_top_k; search widens to search_top_k")
    return errors, warnings
