"""Settings of a run, from the environment; no secret is needed."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Unknown variables are ignored; a value that doesn't fit its type is an error."""

    store_path: str = "chunk-store"
    embedding_model: str = "text-embedding-3-small"
    rate_per_second: float = 5.0
    target_tokens: int = 900
    overlap_tokens: int = 120
    min_chunk_tokens: int = 50
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "CORPUSMILL_") -> Settings:
        env = os.environ if env is None else env
        kinds = {"str": str, "int": int, "float": float}
        given = {f.name: kinds[str(f.type)](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env}
        out = cls(**given)
        if out.rate_per_second <= 0 or not 0 < out.min_chunk_tokens <= out.target_tokens or out.overlap_tokens >= out.target_tokens:
            raise ValueError("rate and token budgets must be positive and consistent")
        return out
