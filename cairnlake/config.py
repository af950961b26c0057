"""Constants that are part of the semantics. All are defaults of function arguments."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    keyword_weight: float = 0.6
    semantic_weight: float = 0.4
    most_keyword_score: float = 35.0
    recency_days: float = 7.0
    recency_factor: float = 1.2
    scope_factor: float = 1.5
    exact_hit: float = 15.0
    fuzzy_most: float = 10.0
    max_results: int = 5
    token_budget: int = 4096
    overfetch: int = 4


@dataclass(frozen=True)
class Decay:
    half_life_days: float = 30.0
    boost: float = 0.1
    protection_days: float = 7.0
    permanent_recalls: int = 15
    archive_below: float = 0.02
    least_change: float = 1e-4


@dataclass(frozen=True)
class Curation:
    similarity: float = 0.9
    redundant: float = 0.95
    conflict_low: float = 0.5
    conflict_high: float = 0.8
    auto_confidence: float = 0.85
    review_confidence: float = 0.5
    max_per_pass: int = 5000


@dataclass(frozen=True)
class Graph:
    expand: int = 5
    weight: float = 0.3
    corecall_step: float = 0.1
    most_weight: float = 1.0
    monthly_decay: float = 0.95


@dataclass(frozen=True)
class Topics:
    min_cluster: int = 3
    edge_above: float = 0.6
    drift: float = 0.2
    match: float = 0.65
    page_share: float = 0.7
    backing_share: float = 0.3


@dataclass(frozen=True)
class Verification:
    ttl_seconds: float = 60.0
    trust_verified: float = 1.0
    trust_stale: float = 0.3
    trust_unverifiable: float = 0.7


@dataclass(frozen=True)
class Mining:
    least_score: float = 30.0
    most_chars: int = 500
    history: int = 20
    batch_size: int = 50
    batch_least: int = 10
    batch_hours: float = 4.0
    prompt_tokens: int = 8000
    provisional: float = 0.5


@dataclass(frozen=True)
class Team:
    local_boost: float = 1.5
    team_boost: float = 1.0
    mandatory_score: float = 999.0
    nominate_recalls: int = 3
    nominate_score: float = 70.0
    purpose_threshold: float = 0.6
    cache_rows: int = 2000
    tombstone_days: int = 90
    staging_days: int = 30
    override_days: int = 90


RETRIEVAL, DECAY, CURATION, GRAPH, TOPICS = Retrieval(), Decay(), Curation(), Graph(), Topics()
VERIFICATION, MINING, TEAM = Verification(), Mining(), Team()

# Closed vocabularies, in the order in which derived tables deal them out.
SECTIONS = ("tools", "debugging", "workflow", "architecture", "commands", "preferences", "patterns", "general")
KNOWLEDGE_TYPES = ("method", "trick", "pitfall", "preference", "knowledge")
TOOLS = ("git", "docker", "npm", "pip", "cargo")
