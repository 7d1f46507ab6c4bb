"""All tunable values of the pipeline in one place; environment variables override the first group."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Options:
    ocr_enabled: bool = field(default_factory=lambda: os.environ.get("OCR_ENABLED", "true").lower() == "true")
    ocr_lang: str = field(default_factory=lambda: os.environ.get("OCR_LANG", "rus+eng"))
    min_chunk: int = 300
    max_chunk: int = 1500
    overlap: int = 150
    context_chars: int = 500
    include_references: bool = False
    retrieval_top_k: int = 70
    context_top_k: int = 3
    k_rrf: int = 60
    alpha: float = 0.6
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    link_min_score: float = 4.0
    link_per_chunk: int = 5
    kb_similarity: float = 0.88

    def as_dict(self) -> dict:
        return asdict(self)
