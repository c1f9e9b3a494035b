"""Settings of the analytics, and the closed domains of the data model (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_chunk_chars: int = 1500
    min_chunk_chars: int = 50
    overlap_chars: int = 150
    overlap_messages: int = 2
    retrieval_top_k: int = 10
    id_match_extra: int = 5
    id_match_boost: float = 0.95
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    chat_gap_minutes: int = 30
    max_file_bytes: int = 50 * 1024 * 1024
    max_commits: int = 500
    max_extraction_retries: int = 3
    min_word_overlap: float = 0.30
    high_score: float = 0.75
    no_evidence_floor: float = 0.30
    negative_score_below: float = 5.0
    confidence_weights: tuple[float, float, float, float] = (0.35, 0.30, 0.20, 0.15)


SETTINGS = Settings()

SOURCE_TYPES = ("PDF", "DOCX", "EMAIL", "WHATSAPP", "GIT", "MARKDOWN", "PYTHON")
ENTITY_TYPES = ("REQUIREMENT", "IMPLEMENTATION", "EVALUATION")
STATUSES = (
    "IMPLEMENTED_AND_VALIDATED",
    "IMPLEMENTED_WITHOUT_EVALUATION",
    "IMPLEMENTED_BUT_NEGATIVELY_EVALUATED",
    "PARTIALLY_IMPLEMENTED",
    "CLAIMED_BUT_NO_EVIDENCE",
    "EVALUATION_WITHOUT_REQUIREMENT",
    "REQUIREMENT_NOT_IMPLEMENTED",
)
STATUS_COLOURS = dict(zip(STATUSES, ("#22c55e", "#3b82f6", "#f97316", "#eab308", "#a855f7", "#6b7280", "#ef4444")))
