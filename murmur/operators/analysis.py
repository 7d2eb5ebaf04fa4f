"""Choice of the effective classification per post, and predicates on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (model contains, prompt prefix, tier); the first match wins.
ANALYSIS_TIERS = (
    ("gpt-5.6-sol-via-codex-cli", "codex-content-review-v4:", 475),
    ("gpt-5.6-sol-via-codex-cli", "codex-content-review-v3:", 450),
    ("gpt-5.6-sol-via-codex-cli", "codex-content-review-v2:", 400),
    ("via-openai-compatible", "evidence-content-review-v3:", 460),
    ("via-openai-compatible", "evidence-content-review-v2:", 350),
    ("gpt-5.6-terra-via-codex-cli", "", 300),
    ("via-codex-cli", "", 250),
)
RULE_BASED_PREFIX, RULE_BASED_TIER, OTHER_TIER = "rule-based", 0, 200

FOMO_FLAGS = ("urgency", "fear_of_missing", "social_proof", "price_chasing", "regret")
EMOTION_FLAGS = (*FOMO_FLAGS, "panic")
CONTENT_FILTERS = ("all", "retail", "buy", "sell", "hold", "wait", "fomo", "panic", "promotion")
COMMENT_KINDS = ("comment", "answer_comment", "reply")

# Columns of an analysis row that the aggregations read.
EFFECT_COLUMNS = (
    "analysis_id", "actor_type", "investor_level", "direction", "intent",
    "spam", "promotion", "fomo_flags", "panic",
)


def analysis_tier(model: Column, prompt: Column, tiers=ANALYSIS_TIERS) -> Column:
    """Reviewer tier of a row; larger wins, ties go to the larger row id."""
    name, version = F.lower(F.coalesce(model, F.lit(""))), F.lower(F.coalesce(prompt, F.lit("")))
    rule = None
    for part, prefix, tier in tiers:
        match = name.contains(part) & version.startswith(prefix)
        rule = F.when(match, tier) if rule is None else rule.when(match, tier)
    return rule.when(name.startswith(RULE_BASED_PREFIX), RULE_BASED_TIER).otherwise(OTHER_TIER)


def fomo_flag_count(emotion: str = "emotion") -> Column:
    """How many of the five flags are set; three or more mean an active signal."""
    total = F.lit(0)
    for flag in FOMO_FLAGS:
        total = total + F.coalesce(F.col(f"{emotion}.{flag}"), F.lit(False)).cast("int")
    return total


def with_effect_columns(analysis: DataFrame) -> DataFrame:
    """Reduce an analysis row to the few values the aggregations need."""
    return analysis.select(
        "content_id", "topic_id", "analysis_id", "actor_type", "investor_level", "direction", "intent",
        "spam", "promotion",
        fomo_flag_count().alias("fomo_flags"),
        F.coalesce(F.col("emotion.panic"), F.lit(False)).alias("panic"),
        analysis_tier(F.col("model"), F.col("prompt_version")).alias("tier"),
    )


def effective_by_content(analysis: DataFrame) -> DataFrame:
    """One row per content: map topic -> best row, best topic-less row, best of all.

    Both steps are ``max_by`` aggregates with map-side combine. The map holds at
    most one entry per topic of the registry, however many versions were stored.
    """
    rank = F.struct("tier", "analysis_id")
    per_topic = (
        with_effect_columns(analysis)
        .groupBy("content_id", "topic_id")
        .agg(F.max_by(F.struct(*EFFECT_COLUMNS), rank).alias("best"), F.max(rank).alias("rank"))
    )
    scoped = F.when(F.col("topic_id").isNotNull(), F.struct(F.col("topic_id").alias("key"), F.col("best").alias("value")))
    return per_topic.groupBy("content_id").agg(
        F.map_from_entries(F.collect_list(scoped)).alias("scoped"),
        F.max_by(F.when(F.col("topic_id").isNull(), F.col("best")), F.when(F.col("topic_id").isNull(), F.col("rank"))).alias("unscoped"),
        F.max_by("best", "rank").alias("any_scope"),
    )


def pick_effective(topic: Column) -> Column:
    """The row of this topic beats a topic-less row; without a topic the tier alone decides."""
    own = F.try_element_at(F.col("scoped"), topic)
    return F.when(topic.isNull(), F.col("any_scope")).otherwise(F.coalesce(own, F.col("unscoped")))


def preferred_analyses(content_topic: DataFrame, analysis: DataFrame) -> DataFrame:
    """Every content x topic pair with its preferred analysis, if any."""
    pairs = content_topic.join(effective_by_content(analysis), "content_id", "left")
    return pairs.withColumn("analysis", pick_effective(F.col("topic_id"))).drop("scoped", "unscoped", "any_scope")


def is_retail(row: str = "analysis") -> Column:
    """A retail author, neither promotion nor spam."""
    value = (F.col(f"{row}.actor_type") == "retail") & ~F.col(f"{row}.promotion") & ~F.col(f"{row}.spam")
    return F.coalesce(value, F.lit(False))


def content_filter(name: str, row: str = "analysis") -> Column:
    """The nine named filters of the reading side."""
    if name not in CONTENT_FILTERS:
        raise ValueError(f"content filter must be one of {', '.join(CONTENT_FILTERS)}")
    if name == "all":
        return F.lit(True)
    if name == "promotion":
        return F.coalesce(F.col(f"{row}.promotion"), F.lit(False))
    if name == "retail":
        return is_retail(row)
    if name == "fomo":
        extra = F.col(f"{row}.fomo_flags") >= 3
    elif name == "panic":
        extra = F.col(f"{row}.panic")
    else:
        extra = F.col(f"{row}.intent") == name
    return is_retail(row) & F.coalesce(extra, F.lit(False))


def is_comment(kind: Column) -> Column:
    return F.lower(kind).isin(*COMMENT_KINDS)


def engagement() -> Column:
    parts = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in ("likes", "favorites", "comments", "shares", "views")]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total
