"""Thresholds and word lists, gathered in frozen records.

Every value in this module is a fixed value: results depend on it, so it is
stated as is. Pass a changed copy (``dataclasses.replace``) to override.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Articles:
    exact_threshold: float = 0.97
    cluster_threshold: float = 0.85
    fingerprint_ttl_seconds: int = 604_800
    supersession_gap_seconds: int = 300
    archive_after_days: int = 7
    search_min_score: float = 0.5
    gate_matches: int = 5
    entity_matches: int = 20
    body_chars: int = 5_000
    entity_chars: int = 50_000
    embed_chars: int = 1_000
    stream_batch: int = 50


@dataclass(frozen=True)
class Retrieval:
    card_top_k: int = 20
    chunk_top_k: int = 50
    rerank_top_k: int = 10
    faithfulness_threshold: float = 0.70
    chunk_size: int = 1_500
    chunk_overlap_words: int = 30
    freshness_alert_hours: int = 24
    sentence_min_chars: int = 10


@dataclass(frozen=True)
class Clinical:
    shift_salt: str = "hipaa-date-shift-salt-v1"
    max_shift_days: int = 90
    faithfulness_threshold: float = 0.65
    high_confidence: float = 0.90
    medium_confidence: float = 0.70
    similar_cases: int = 5
    evidence_top_k: int = 10
    active_drugs: int = 20
    half_life_days: int = 365
    sentence_min_chars: int = 20


@dataclass(frozen=True)
class Evaluation:
    similarity_threshold: float = 0.95
    code_gen_drop: float = 0.05
    bug_fix_drop: float = 0.10
    explanation_drop: float = 0.30
    weighted_hold: float = 5.0
    pass_rate_margin: float = 0.05
    judge_margin: float = 0.1
    default_judge_score: float = 1.5
    per_task_type: int = 100
    seed: int = 42


@dataclass(frozen=True)
class Agents:
    fingerprint_window: int = 10
    semantic_threshold: float = 0.92
    semantic_window: int = 5
    max_steps: int = 50
    max_tokens: int = 100_000
    progress_window: int = 5
    progress_threshold: float = 0.05
    cycle_length: int = 2
    checkpoint_after: int = 3
    timeout_multiplier: float = 3.0


@dataclass(frozen=True)
class Refunds:
    confidence_threshold: float = 0.85
    escalation_threshold: float = 0.60
    max_auto_amount: Decimal = Decimal("500.00")
    max_per_window: int = 5
    window_seconds: int = 86_400
    refund_days: int = 30
    key_memory_seconds: int = 604_800


@dataclass(frozen=True)
class Guard:
    unsafe_threshold: float = 0.75
    uncertain_threshold: float = 0.50
    intent_threshold: float = 0.65
    allowed_prefixes: tuple[str, ...] = ("/home/user/project", "/tmp/workspace")
    blocked_paths: tuple[str, ...] = (".ssh", ".aws", ".env", "/etc/", "/root/", "/proc/", "/sys/")
    allowed_domains: tuple[str, ...] = (
        "api.github.com", "docs.python.org", "pypi.org", "registry.npmjs.org",
    )
    allowed_tools: tuple[str, ...] = (
        "read_file", "write_file", "run_code", "search_docs", "list_directory",
    )
    network_tools: tuple[str, ...] = ("http_request", "send_email", "post_webhook")
    home: str = "/root"


ARTICLES = Articles()
RETRIEVAL = Retrieval()
CLINICAL = Clinical()
EVALUATION = Evaluation()
AGENTS = Agents()
REFUNDS = Refunds()
GUARD = Guard()
