"""Pattern mining over conversation turns: interactions, rules, scores, distilled candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KNOWLEDGE_TYPES, MINING, SECTIONS
from ..functions import privacy, score, text
from . import llmio, packing

# Vocabularies and patterns of the rules (parts of words count), and what marks a message as a correction.
ERROR_WORDS = ("error", "fail", "exception", "traceback", "crash", "bug", "broken", "doesn't work", "not working", "can't", "cannot", "issue", "problem", "wrong")
FIX_WORDS = ("try", "use", "run", "change", "fix", "solution", "instead", "should", "replace", "update", "install", "set", "add")
RETRY_ERRORS = ("error", "fail", "broken", "not working")
RETRY_SUCCESS = ("works", "success", "done", "fixed", "resolved")
CONFIG_WORDS = ("config", "setting", "env", "configure", "setup", "environment", "variable", "option", "parameter", ".env", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf")
INSTALL = r"(?i)\b((?:pip install|npm install|cargo add|brew install|apt install|conda install|gem install|go get)\s+\S+)"
CORRECTIONS = r"(?iU)\b(?:no,?\s+|actually|correction|wrong|mistake|that'?s\s+(?:not|wrong|incorrect)|don'?t\b|not\s+that|oops|sorry,?\s+(?:i\s+)?meant)\b"


def has_any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def long_words(low: Column) -> Column:
    """Distinct words of four characters or more."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\b(\w{4,})\b"), 1))


def enough(reply: Column) -> Column:
    return F.length(F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")) >= 20


def with_history(df: DataFrame, rows: int = MINING.history) -> DataFrame:
    """The earlier interactions of each conversation, oldest first, as an array of (words, low, tool)."""
    df = df.withColumn("low", F.lower("user_message")).withColumn("words", long_words(F.col("low")))
    for name in ("tool_name", "error_msg"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    w = Window.partitionBy("conv_id").orderBy("turn_offset").rowsBetween(-rows, -1)
    past = F.struct("words", "low", F.col("user_message").alias("said"), F.coalesce("tool_name", F.lit("")).alias("tool"))
    return df.withColumn("history", F.collect_list(past).over(w))


def rules(errors=ERROR_WORDS, retry_errors=RETRY_ERRORS, retry_success=RETRY_SUCCESS, config=CONFIG_WORDS) -> dict[str, tuple[Column, Column, Column]]:
    """name -> (fires, content, confidence) over the columns of with_history."""
    user, reply, low = F.col("user_message"), F.col("assistant_message"), F.col("low")
    reply_low = F.lower("assistant_message")
    fix = (has_any(low, errors) | F.col("error_msg").isNotNull()) & enough(reply) & has_any(reply_low, FIX_WORDS)
    shares = lambda h: F.size(F.array_intersect(h["words"], F.col("words"))) >= 2
    failed = F.filter("history", lambda h: shares(h) & has_any(h["low"], retry_errors))
    retry = (F.size(failed) > 0) & has_any(reply_low, retry_success)
    both = F.lower(F.concat(user, F.lit(" "), reply))
    installs = F.regexp_extract_all(F.concat(user, F.lit(" "), reply), F.lit(INSTALL), 1)
    unseen = (F.coalesce("tool_name", F.lit("")) != "") & ~F.exists("history", lambda h: h["tool"] == F.col("tool_name"))
    tools = F.when(F.size(installs) > 0, F.slice(installs, 1, 3)).when(unseen, F.array("tool_name"))
    similar = F.size(F.filter("history", shares))
    head = lambda c, n: F.substring(c, 1, n)
    return {
        "error_fix": (fix, F.concat(F.lit("Error: "), head(user, 200), F.lit("\nFix: "), head(reply, 300)), F.lit(0.8)),
        "retry_success": (retry, F.concat(F.lit("Previous issue: "), head(F.try_element_at(failed, F.lit(-1))["said"], 200), F.lit("\nResolution: "), head(reply, 300)), F.lit(0.7)),
        "config_change": (has_any(both, config) & enough(reply), F.concat(F.lit("Config: "), head(reply, 400)), F.lit(0.6)),
        "new_tool": (tools.isNotNull() & enough(reply), F.concat(F.lit("Tool: "), F.array_join(tools, ", "), F.lit("\n"), head(reply, 300)), F.lit(0.65)),
        "repetitive_op": ((F.size("words") >= 2) & (similar >= 2), F.concat(F.lit("Repeated pattern ("), (similar + 1).cast("string"), F.lit("x): "), head(user, 300)), 0.5 + F.least(F.lit(0.3), similar * 0.1)),
    }


def detect(interactions: DataFrame, history: int = MINING.history, own_rules: dict | None = None, **vocabularies) -> DataFrame:
    """One row an interaction and rule that fires: pattern_type, content, confidence. Code-heavy turns only count as history.

    own_rules: name -> (fires, content, confidence) over the columns of with_history, beside or in place of the built-in ones."""
    df = with_history(interactions, history)
    df = df.where(~text.code_heavy(F.concat(F.col("user_message"), F.lit("\n"), F.col("assistant_message"))))
    found = [F.when(fires, F.struct(F.lit(name).alias("pattern_type"), content.alias("content"), conf.alias("confidence"))) for name, (fires, content, conf) in (rules(**vocabularies) | (own_rules or {})).items()]
    out = df.withColumn("p", F.explode(F.array_compact(F.array(*found))))
    return out.select("conv_id", "turn_offset", "user_message", "assistant_message", "p.pattern_type", "p.content", "p.confidence")


def scored(patterns: DataFrame, least: float = MINING.least_score) -> DataFrame:
    """Patterns with section, type and instructivity (0 to 100); those under the least score go."""
    points = score.instructivity(F.col("content"), F.col("confidence"))
    out = patterns.withColumn("points", points).where(F.col("points") >= least)
    return out.withColumn("section", score.section_of(F.col("content"))).withColumn("knowledge_type", score.type_of(F.col("pattern_type"))).withColumn("instructivity_score", score.clamp(F.col("points"), 0.0, 100.0)).drop("points")


def sanitised(candidates: DataFrame, custom=()) -> DataFrame:
    """Candidates with redacted content; those without a result of the redaction go. custom: further patterns; invalid ones are skipped."""
    return candidates.withColumn("content", privacy.redact(F.col("content"), privacy.with_custom(custom))).where("content is not null")


def distil(candidates: DataFrame, most_chars: int = MINING.most_chars) -> DataFrame:
    """Redacted candidates: content cut at a sentence, tools, entities, and the turn that they come from."""
    turn = F.when(F.coalesce("assistant_message", F.lit("")) != "", F.col("assistant_message")).otherwise(F.col("user_message"))
    role = F.when(F.coalesce("assistant_message", F.lit("")) != "", "assistant").otherwise("user")
    return sanitised(candidates).select(
        "conv_id", "turn_offset", "pattern_type", "section", "knowledge_type", "instructivity_score",
        text.truncate_sentence(F.col("content"), most_chars).alias("content"),
        text.known_tools(F.col("content")).alias("related_tools"),
        text.entities(F.col("content")).alias("key_entities"),
        F.substring(F.sha2(turn, 256), 1, 16).alias("turn_hash"),
        role.alias("role"),
    )


def reflect(interactions: DataFrame, **vocabularies) -> DataFrame:
    """detect, score, redact, distil in one plan."""
    return distil(scored(detect(interactions, **vocabularies)))


_TURN = ["conv_id", "turn_offset"]


def evaluated(replies: DataFrame) -> DataFrame:
    """What a model says of turns: conv_id, turn_offset, learn, model_section, model_type, model_score (0 to 100), summary. replies: conv_id, turn_offset, reply.

    A null reply is a failed call and has no row here; a reply that is no JSON, or does not say ``should_record``, has learn false. Unknown
    sections and types count as general and knowledge, a missing or unreadable score as 50. Of several replies to a turn the last as text counts."""
    one = replies.where("reply is not null").groupBy(*_TURN).agg(F.max("reply").alias("reply"))
    said = llmio.parsed(one, "reply", "should_record boolean, knowledge_type string, section string, instructivity_score string, summary string")
    known = lambda c, names, other: F.when(F.lower(c).isin(*names), F.lower(c)).otherwise(other)
    points = score.clamp(F.coalesce(F.col("instructivity_score").try_cast("double"), F.lit(50.0)), 0.0, 100.0)
    return said.select(*_TURN, F.coalesce("should_record", F.lit(False)).alias("learn"), known("section", SECTIONS, "general").alias("model_section"), known("knowledge_type", KNOWLEDGE_TYPES, "knowledge").alias("model_type"), points.alias("model_score"), F.coalesce("summary", F.lit("")).alias("summary"))


def reflect_with(interactions: DataFrame, replies: DataFrame, mode: str = "hybrid", distilled: DataFrame | None = None, least: float = MINING.least_score, **vocabularies) -> DataFrame:
    """``reflect`` with a model's part; the columns of ``distil``.

    hybrid: what the rules find takes section and type from the model and the mean of both scores, or stays as it is where the model has nothing to say;
    turns in which the rules find nothing are candidates (``llm_evaluated``) if the model wants them kept at ``least`` points or more.
    llm: the model decides alone; the rules stand in for turns without a reply.
    distilled: the model's own words (conv_id, turn_offset, pattern_type, reply with content or distilled_rule), redacted like all
    other text; candidates without any are cut by rule."""
    if mode not in ("hybrid", "llm"):
        raise ValueError(f"unknown mode {mode!r}: hybrid or llm")
    said = evaluated(replies)
    found = detect(interactions, **vocabularies)
    ruled = scored(found, least)
    if mode == "llm":
        ruled = ruled.join(said.select(*_TURN), _TURN, "left_anti")
        open_turns = interactions
    else:
        kept = said.where("learn").select(*_TURN, "model_section", "model_type", "model_score")
        blend = F.coalesce((F.col("instructivity_score") + F.col("model_score")) / 2, F.col("instructivity_score"))
        ruled = ruled.join(kept, _TURN, "left").withColumns({"section": F.coalesce("model_section", "section"), "knowledge_type": F.coalesce("model_type", "knowledge_type"), "instructivity_score": blend})
        open_turns = interactions.join(found.select(*_TURN).distinct(), _TURN, "left_anti")
    columns = ["conv_id", "turn_offset", "user_message", "assistant_message", "pattern_type", "content", "section", "knowledge_type", "instructivity_score"]
    fresh = open_turns.join(said.where(F.col("learn") & (F.col("model_score") >= least)), _TURN).select(
        *columns[:4], F.lit("llm_evaluated").alias("pattern_type"), F.when(F.col("summary") != "", F.col("summary")).otherwise(F.substring("assistant_message", 1, 400)).alias("content"),
        F.col("model_section").alias("section"), F.col("model_type").alias("knowledge_type"), F.col("model_score").alias("instructivity_score"),
    )
    out = distil(ruled.select(*columns).unionByName(fresh))
    if distilled is None:
        return out
    own = llmio.parsed(distilled.where("reply is not null").groupBy(*_TURN, "pattern_type").agg(F.max("reply").alias("reply")), "reply", "content string, distilled_rule string")
    words = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("content", "distilled_rule")])
    own = own.select(*_TURN, "pattern_type", privacy.redact(words).alias("_own"))
    return out.join(own, [*_TURN, "pattern_type"], "left").withColumn("content", F.coalesce("_own", "content")).select(*out.columns)


def is_correction(message: Column, flag: Column | None = None) -> Column:
    found = F.coalesce(message.rlike(CORRECTIONS), F.lit(False))
    return F.coalesce(flag, found) if flag is not None else found


def parse_messages(df: DataFrame) -> DataFrame:
    """One interaction a conversation: user texts and assistant texts, each joined by line ends in turn order. df: conv_id, turn, role, text."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    say = lambda who: F.array_join(F.transform(F.filter("rows", lambda r: r["role"] == who), lambda r: r["text"]), "\n")
    return df.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", say("user").alias("user_message"), say("assistant").alias("assistant_message"))


def pack(entries: DataFrame, most_size: int = MINING.batch_size, budget: int = int(MINING.prompt_tokens * 0.85), group: str = "conv_id", order: str = "turn") -> DataFrame:
    """entries (with tokens) and their batch: a new one begins when the size or the token budget would be passed."""
    return packing.pack(entries, most_size, budget, group, order)


def due(entries: DataFrame, now: Column, least: int = MINING.batch_least, hours: float = MINING.batch_hours) -> DataFrame:
    """One row: whether a batch is due, by number or by age of the oldest pending entry."""
    p = entries.where("status = 'pending'").agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"))
    return p.select("n", ((F.col("n") >= least) | ((F.col("n") > 0) & (score.age_days(F.col("oldest"), now) * 24 >= hours))).alias("due"))
