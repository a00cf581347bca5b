"""Settings, passed to the operators as a frozen value; from_env() reads overrides from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    rrf_k: int = 60
    lexical_k: int = 50
    dense_k: int = 50
    fuse_top: int = 20
    rerank_top: int = 10
    keep_top: int = 5
    query_terms: int = 40
    identical: float = 0.95
    partial_span: float = 0.90
    partial_coverage: float = 0.60
    altered_span: float = 0.60
    altered_coverage: float = 0.50
    cross_paraphrase: float = 0.50
    same_paraphrase: float = 0.90
    same_overlap: float = 0.40
    low_confidence: float = 0.50
    alternative_floor: float = 0.35
    max_chars: int = 5000
    max_image_bytes: int = 5 * 1024 * 1024
    max_claims: int = 20
    max_alternatives: int = 2

    @classmethod
    def from_env(cls, prefix: str = "ATTESTOR_") -> Settings:
        """Each field may be overridden by PREFIX + its upper-case name."""
        given = {f.name: type(f.default)(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return replace(cls(), **given)
