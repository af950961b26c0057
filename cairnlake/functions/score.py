"""Scores and weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CURATION, DECAY, MINING, RETRIEVAL, TEAM, VERIFICATION


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def age_days(created: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(created)) / F.lit(86400e6))


def exponential_decay(age: Column, half_life: float) -> Column:
    if half_life <= 0:
        return F.when(age <= 0, 1.0).otherwise(0.0)
    return F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -age / F.lit(half_life)))


def boosted(base: Column, recalls: Column, boost: float) -> Column:
    return clamp(base * (1 + F.lit(boost) * F.greatest(recalls, F.lit(0))))


def decay_weight(created: Column, recalls: Column, now: Column, cfg=DECAY) -> Column:
    """Permanent from enough recalls, protected while young, else decayed and boosted by recalls."""
    age = age_days(F.coalesce(created, now), now)
    n = F.coalesce(recalls, F.lit(0))
    decayed = boosted(exponential_decay(age, cfg.half_life_days), n, cfg.boost)
    return F.when((n >= cfg.permanent_recalls) | (age <= cfg.protection_days), 1.0).otherwise(decayed)


def decay_status(created: Column, recalls: Column, now: Column, cfg=DECAY) -> Column:
    age = age_days(F.coalesce(created, now), now)
    n = F.coalesce(recalls, F.lit(0))
    low = decay_weight(created, recalls, now, cfg) < cfg.archive_below
    return F.when(n >= cfg.permanent_recalls, "permanent").when(age <= cfg.protection_days, "protected").when(low, "archived").otherwise("decayed")


def recency(created: Column, now: Column, cfg=RETRIEVAL) -> Column:
    return F.when(created.isNotNull() & (age_days(created, now) <= cfg.recency_days), cfg.recency_factor).otherwise(1.0)


def scope_boost(scope: Column, target: str | None, cfg=RETRIEVAL) -> Column:
    return F.when(scope == target, cfg.scope_factor).otherwise(1.0) if target else F.lit(1.0)


def blend_weights(full: bool, cfg=RETRIEVAL) -> tuple[float, float]:
    """Shares of keyword and semantic score; keywords only if there are no semantic scores or no weights."""
    total = cfg.keyword_weight + cfg.semantic_weight
    return (cfg.keyword_weight / total, cfg.semantic_weight / total) if full and total > 0 else (1.0, 0.0)


def blend_columns(keyword: Column, semantic: Column, full: Column) -> tuple[Column, Column]:
    """blend_weights of columns: a row's own two weights, and whether it has semantic scores."""
    usable = full & (keyword + semantic > 0)
    return F.when(usable, keyword / (keyword + semantic)).otherwise(1.0), F.when(usable, semantic / (keyword + semantic)).otherwise(0.0)


def composite(keyword: Column, semantic: Column, decay: Column, recent: Column, scope: Column, full: bool, cfg=RETRIEVAL) -> Column:
    """Rows are ranked by this; it is shown clamped to [0, 1]."""
    kw, sem = blend_weights(full, cfg)
    return (F.least(keyword / F.lit(cfg.most_keyword_score), F.lit(1.0)) * kw + clamp(semantic) * sem) * clamp(decay) * recent * scope


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, low: float | None = -1.0, high: float | None = 1.0) -> Column:
    """0 for empty, unequal or zero vectors; clamped, if bounds are given."""
    value = dot(a, b) / (norm(a) * norm(b))
    if low is not None:
        value = clamp(value, low, high)
    able = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(able, value).otherwise(0.0)


def short_cosine(a: Column, b: Column) -> Column:
    """In [0, 1], over the length of the shorter vector."""
    n = F.least(F.size(a), F.size(b))
    return F.greatest(F.lit(0.0), cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """L2-normalised mean of the token vectors whose mask is 1."""
    kept = F.filter(tokens, lambda _, i: F.element_at(mask, i + 1) == 1)
    total = F.aggregate(kept, F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    length = F.greatest(norm(mean), F.lit(1e-12))
    return F.transform(mean, lambda x: x / length)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def drift(old: Column, new: Column) -> Column:
    union = F.size(F.array_union(old, new))
    return F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(old, new)) / union)


def adamic_adar(weight: Column, degree: Column) -> Column:
    return weight / F.log(degree + F.lit(2.0))


def vector_score(raw: Column) -> Column:
    return F.when(raw < 0, F.greatest(F.lit(0.0), (raw + 1) / 2)).when(raw > 1, 1.0).otherwise(raw)


def first_score(score: Column, similarity: Column, distance: Column) -> Column:
    return F.coalesce(score, similarity, 1 - distance, F.lit(0.0))


# Words that make a text actionable, and sections by their words (the first that fits).
ACTIONABLE = ("use", "run", "try", "avoid", "instead", "should", "must", "tip", "remember", "always", "never", "better", "best")
SECTION_WORDS = (
    ("debugging", ("debug", "error", "fix", "crash", "traceback", "exception", "bug", "stacktrace", "segfault", "panic")),
    ("workflow", ("install", "config", "env", "setup", "deploy", "build", "ci", "cd", "pipeline", "release", "migration")),
    ("tools", ("git", "docker", "npm", "pip", "cargo", "brew", "kubectl", "terraform", "ansible", "make", "cmake")),
    ("architecture", ("architect", "design", "pattern", "refactor", "structure", "module", "layer", "interface", "abstract")),
    ("commands", ("run", "exec", "command", "cli", "terminal", "shell", "bash", "script", "alias")),
    ("preferences", ("prefer", "always", "never", "default", "convention", "style", "habit", "like", "dislike")),
    ("patterns", ("pattern", "practice", "idiom", "recipe", "technique", "approach", "strategy")),
)
PATTERN_TYPES = {"error_fix": "pitfall", "retry_success": "method", "config_change": "preference", "new_tool": "trick", "repetitive_op": "method"}


def instructivity(content: Column, confidence: Column) -> Column:
    from .text import words_of

    low = F.lower(content)
    density = F.least(F.lit(1.0), F.size(words_of(content)) / F.lit(20.0))
    return confidence * 100 * density + F.when(low.rlike("|".join(ACTIONABLE)), 10.0).otherwise(0.0) + F.when(low.rlike(r"[./\\]"), 5.0).otherwise(0.0)


def section_of(content: Column) -> Column:
    from .text import words_of

    words = words_of(content)
    out = None
    for name, keys in SECTION_WORDS:
        fits = F.arrays_overlap(words, F.array(*[F.lit(k) for k in keys]))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("general")


def type_of(pattern: Column) -> Column:
    out = F.lit("knowledge")
    for name, kind in PATTERN_TYPES.items():
        out = F.when(pattern == name, kind).otherwise(out)
    return out


def purpose_adjusted(score: Column, tokens: Column, excluded, keywords) -> Column:
    """Scores of excluded topics shrink to 0.3, of keyword topics grow by 1.2; a phrase counts if all its tokens are there."""
    holds = lambda phrase: F.size(F.array_except(F.array(*[F.lit(t) for t in phrase]), tokens)) == 0
    any_of = lambda phrases: F.expr("false") if not phrases else _any([holds(p) for p in phrases])
    return F.when(any_of(excluded), score * 0.3).when(any_of(keywords), score * 1.2).otherwise(score)


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# Weight of a conflict by its kind.
CONFLICT_WEIGHTS = {"negation": 1.0, "contradiction": 0.95, "value_difference": 0.9}


def conflict_confidence(similarity: Column, kind: Column) -> Column:
    weight = F.lit(0.9)
    for name, w in CONFLICT_WEIGHTS.items():
        weight = F.when(kind == name, w).otherwise(weight)
    return F.bround(clamp(similarity) * weight, 6)


def triage(confidence: Column, cfg=CURATION) -> Column:
    return F.when(confidence >= cfg.auto_confidence, "supersede").when(confidence >= cfg.review_confidence, "review").otherwise("mark")


def effective_score(score: Column, up: Column, down: Column) -> Column:
    return clamp(score + F.coalesce(up, F.lit(0)) - F.coalesce(down, F.lit(0)), 0.0, 100.0)


# Tags that need a curator.
SENSITIVE_TAGS = ("security", "architecture", "mandatory")


def governance_tier(score: Column, tags: Column, sensitive=SENSITIVE_TAGS, auto: float = 90.0) -> Column:
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
    return F.when(F.arrays_overlap(low, F.array(*[F.lit(t.lower()) for t in sensitive])), "curator_required").when(score >= auto, "auto_approve").otherwise("p2p_review")


def trust_score(status: Column, cfg=VERIFICATION) -> Column:
    return F.when(status == "verified", cfg.trust_verified).when(status == "stale", cfg.trust_stale).otherwise(cfg.trust_unverifiable)


def layer_boost(source: Column, cfg=TEAM) -> Column:
    return F.when(source == "local", cfg.local_boost).otherwise(cfg.team_boost)


def passes(score: Column, cfg=MINING) -> Column:
    return score >= cfg.least_score
