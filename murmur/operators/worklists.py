"""What still has to be analysed, reviewed or collected (J08, A17, A26, P12-P17, U04, U05, W23, X27, X32, ST2, I23)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.hashing import analysis_input_hash
from murmur.operators.analysis import EMOTION_FLAGS

TASK_KEY = ["content_id", "topic_id", "input_hash"]
# Closed value sets of the analysis contract.
ACTORS = ("retail", "kol", "media", "institutional", "commercial", "bot_or_spam", "unknown")
LEVELS = ("novice", "intermediate", "experienced", "unknown")
DIRECTIONS = ("bullish", "neutral", "bearish", "unknown")
INTENTS = ("buy", "sell", "hold", "wait", "unknown")
POSITIONS = ("not_owned", "owned", "sold", "unknown")
# Evidence bases by what they can support.
ACTION_BASES = ("explicit_self_executed", "explicit_self_planned")
TENDENCY_BASES = ("advice_or_recommendation", "market_directional_view", "risk_warning")
OTHER_BASES = ("question_or_advice", "negated", "reported_or_quoted", "market_description", "insufficient")
EXPLICIT_BASES = (*ACTION_BASES, "explicit_self_position", "explicit_wait")
ALL_BASES = (*ACTION_BASES, *TENDENCY_BASES, *OTHER_BASES, "explicit_self_position", "explicit_wait")
CONTRADICTIONS = ("非作者本人", "不是作者本人", "无本人", "给读者建议", "操作建议")
DEGRADED_NOTE = "意图证据未通过原文逐字校验，保守降级为 unknown。"
# Words in an error and the minutes to wait after it.
RETRY_MINUTES = (
    (("auth_required", "login is unavailable", "login required", "登录已过期", "安全限制", "风控", "returned http 403"), 360),
    (("429", "rate limit", "rate_limited", "identity-verification", "身份验证", "请登录"), 30),
)
OTHER_RETRY_MINUTES = 15
OVERLAP, FIRST_WINDOW = "INTERVAL 2 HOURS", "INTERVAL 24 HOURS"
PARTIAL_JOBS_TO_OPEN_CIRCUIT = 3

VALUE = "STRUCT<value: STRING, confidence: DOUBLE>"
CONTRACT_SCHEMA = (
    "actor STRUCT<type: STRING, value: STRING, confidence: DOUBLE>, investor STRUCT<level: STRING, value: STRING, confidence: DOUBLE>,"
    f" novice_signals ARRAY<STRING>, direction {VALUE}, intent {VALUE}, position {VALUE}, emotion STRUCT<{', '.join(f'{f}: BOOLEAN' for f in EMOTION_FLAGS)}>,"
    " spam STRUCT<value: BOOLEAN, confidence: DOUBLE>, promotion STRUCT<value: BOOLEAN, confidence: DOUBLE>,"
    " id BIGINT, intent_basis STRING, intent_evidence STRING, rationale STRING"
)
# Names allowed at each place of the contract.
PARTS = {
    "actor": ("type", "confidence"), "investor": ("level", "confidence"), "direction": ("value", "confidence"), "intent": ("value", "confidence"),
    "position": ("value", "confidence"), "emotion": EMOTION_FLAGS, "spam": ("value", "confidence"), "promotion": ("value", "confidence"),
}
REVIEW_FIELDS = ("id", "intent_basis", "intent_evidence", "rationale")


# --- analysis targets ----------------------------------------------------


def analysis_targets(content: DataFrame, content_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """One target per post and active topic, or one topic-less target per post."""
    linked = content_topic.join(topics.select("topic_id", "slug"), "topic_id")
    rows = content.select("content_id", "title", "body", "content_hash").join(linked, "content_id", "left")
    key = analysis_input_hash(F.col("content_hash"), F.col("title"), F.col("body"), F.col("topic_id"), F.col("slug"))
    return rows.select("content_id", "topic_id", key.alias("input_hash"))


def _matches(left: DataFrame, right: DataFrame, how: str, keys=TASK_KEY) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{k}" for k in keys]) if how in ("inner", "left") else joined


def pending_targets(targets: DataFrame, reviewed: DataFrame, analysis: DataFrame, tasks: DataFrame, *, models: tuple[str, ...], now: Column, limit: int | None = None) -> DataFrame:
    """Targets without a review of this content version, without a row of these models, and not cooling down.

    ``reviewed`` holds (content_id) whose present version has evidence; three
    anti joins replace the per-post look-ups.
    """
    open_ = targets.join(reviewed.select("content_id").distinct(), "content_id", "left_anti")
    open_ = _matches(open_, analysis.where(F.col("model").isin(*models)).select(*TASK_KEY), "left_anti")
    cooling = tasks.where(F.col("model").isin(*models) & (F.col("next_retry_at") > now)).select(*TASK_KEY)
    open_ = _matches(open_, cooling, "left_anti")
    return open_ if limit is None else open_.orderBy("content_id", "topic_id").limit(limit)


def task_summary(targets: DataFrame, tasks: DataFrame, *, now: Column) -> DataFrame:
    """Counters over targets and tasks of one model, in one row."""
    current = _matches(tasks, targets.distinct().withColumn("_t", F.lit(True)), "left")
    live = F.col("_t").isNotNull()
    retryable = live & F.col("status").isin("pending", "failed")
    ready = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    counters = current.agg(
        n(live).alias("total"), F.count("*").alias("historical_total"), n(~live).alias("superseded"),
        *[n(live & (F.col("status") == s)).alias(s) for s in ("pending", "running", "completed", "failed")],
        n(retryable & ready).alias("retry_ready"), n(retryable & ~ready).alias("retry_deferred"),
    )
    wanted = targets.distinct()
    untracked = _matches(wanted, tasks.select(*TASK_KEY).distinct(), "left_anti").agg(F.count("*").alias("n")).scalar()
    total = wanted.agg(F.count("*").alias("n")).scalar()
    return counters.select("*", untracked.alias("untracked"), total.alias("targets"))


def task_retry_at(now: Column, attempts: Column) -> Column:
    """Exponential wait after a failed batch, at most six hours."""
    seconds = F.least(F.lit(6 * 3600.0), 30 * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(8))))
    return F.timestamp_seconds(F.unix_seconds(now) + seconds.cast("long"))


def collection_retry_at(now: Column, error: Column) -> Column:
    """Wait after a failed collection, by the words in its error."""
    text = F.lower(F.coalesce(error, F.lit("")))
    rule = None
    for words, minutes in RETRY_MINUTES:
        match = reduce(or_, [text.contains(w.lower()) for w in words])
        rule = F.when(match, minutes) if rule is None else rule.when(match, minutes)
    return F.timestamp_seconds(F.unix_seconds(now) + rule.otherwise(OTHER_RETRY_MINUTES) * 60)


def source_cooldowns(jobs: DataFrame, *, now: Column) -> DataFrame:
    """Latest retry time per source; partial jobs count only from the third one on."""
    waiting = jobs.where(~F.coalesce(F.col("done"), F.lit(False)) & (F.col("next_retry_at") > now))
    partial = F.coalesce(F.col("partial"), F.lit(False))
    return waiting.groupBy("source").agg(
        F.max(F.when(~partial, F.col("next_retry_at"))).alias("_hard"), F.max(F.when(partial, F.col("next_retry_at"))).alias("_soft"),
        F.sum(partial.cast("int")).alias("partial_jobs"),
    ).select(
        "source", "partial_jobs",
        F.when(F.col("partial_jobs") >= PARTIAL_JOBS_TO_OPEN_CIRCUIT, F.col("_soft")).otherwise(F.col("_hard")).alias("retry_at"),
    ).where(F.col("retry_at").isNotNull())


def next_windows(scopes: DataFrame, checkpoints: DataFrame, *, now: Column) -> DataFrame:
    """ST2: next collection window per scope: last success minus two hours, else the last 24 hours."""
    keys = ["source", "scope_key"]
    rows = scopes.join(checkpoints.select(*keys, "last_successful_until"), keys, "left")
    start = F.coalesce(F.col("last_successful_until") - F.expr(OVERLAP), now - F.expr(FIRST_WINDOW))
    return rows.select(*scopes.columns, start.alias("window_start"), now.alias("window_end"))


def advance_checkpoints(checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """ST2: only complete automatic runs move a checkpoint."""
    keys = ["source", "scope_key"]
    good = runs.where(~F.col("explicit_window") & ~F.col("degraded") & ~F.col("partial"))
    moved = good.groupBy(*keys).agg(F.max_by("until", "run_id").alias("_until"))
    joined = checkpoints.join(moved, keys, "full_outer")
    return joined.select(*keys, F.coalesce("_until", "last_successful_until").alias("last_successful_until"))


# --- review candidates ----------------------------------------------------


def review_candidates(
    content: DataFrame, analysis: DataFrame, *, sources: tuple[str, ...] = (), since: Column | None = None, until: Column | None = None,
    min_chars: int = 0, candidate_model: str | None = None, candidate_intents: tuple[str, ...] = (), scanned: DataFrame | None = None,
    resume_models: tuple[str, ...] = (), prompt_prefix: str = "codex-content-review-v4", shard_count: int = 1, shard_index: int = 0, limit: int | None = None,
) -> DataFrame:
    """Posts to review; the window is inclusive and a reviewed content version is skipped."""
    rows = content.where(~F.col("is_deleted"))
    if shard_count > 1:
        rows = rows.where(F.pmod("content_id", F.lit(shard_count)) == shard_index)
    if since is not None:
        rows = rows.where(F.col("published_at") >= since)
    if until is not None:
        rows = rows.where(F.col("published_at") <= until)
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    if min_chars:
        rows = rows.where(F.length(F.coalesce("title", F.lit(""))) + F.length("body") >= min_chars)
    if candidate_model and candidate_intents:
        newest = analysis.where(F.col("model") == candidate_model).groupBy("content_id").agg(F.max_by("intent", "analysis_id").alias("_i"))
        rows = rows.join(newest.where(F.col("_i").isin(*candidate_intents)), "content_id", "left_semi")
    if scanned is not None:
        rows = rows.join(scanned.select("content_id"), "content_id", "left_anti")
    if resume_models:
        done = analysis.where(F.col("model").isin(*resume_models)).select("content_id", F.col("prompt_version").alias("_version")).distinct()
        version = F.concat(F.lit(prompt_prefix + ":"), F.substring("content_hash", 1, 12))
        rows = rows.withColumn("_version", version).join(done, ["content_id", "_version"], "left_anti").drop("_version")
    return rows if limit is None else rows.orderBy("content_id").limit(limit)


# --- landed analysis results ---------------------------------------------


def salvage_json(text: Column) -> Column:
    """JSON out of a model's answer: reasoning and fences removed, else the outermost braces or brackets."""
    clean = F.trim(F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think>", ""))
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r"^```(json)?\s*", ""), r"\s*```$", ""))
    braces = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(clean, r"(?s)(\[.*\])", 1)
    usable = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    named = F.when(F.get_json_object(braces, "$.items").isNotNull() | F.get_json_object(braces, "$.id").isNotNull(), usable(braces))
    return F.coalesce(usable(clean), named, usable(brackets), usable(braces))


def review_items(answers: DataFrame, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(one row per returned item, answers that hold no items)."""
    parsed = answers.withColumn("_json", salvage_json(F.col(text)))
    whole = F.col("_json")
    listed = F.when(whole.startswith("["), whole).otherwise(F.coalesce(F.get_json_object(whole, "$.items"), F.when(F.get_json_object(whole, "$.id").isNotNull(), F.concat(F.lit("["), whole, F.lit("]")))))
    items = F.from_json(listed, "array<variant>")
    rows = parsed.withColumn("_items", items)
    bad = rows.where(F.col("_items").isNull()).drop("_items", "_json")
    return rows.where(F.col("_items").isNotNull()).select("*", F.explode("_items").alias("_v")).withColumn("item", F.to_json("_v")).drop("_items", "_json", "_v"), bad


def batch_mismatches(items: DataFrame, expected: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Batches whose returned ids are not exactly the expected ones."""
    got = items.groupBy(batch, "content_id").agg(F.count("*").alias("_got"))
    both = expected.select(batch, "content_id").withColumn("_want", F.lit(1)).join(got, [batch, "content_id"], "full_outer")
    wrong = F.col("_want").isNull() | F.col("_got").isNull() | (F.col("_got") > 1)
    return both.where(wrong).groupBy(batch).agg(F.count("*").alias("mismatches"))


def parse_contract(rows: DataFrame, column: str = "item", out: str = "c") -> DataFrame:
    """Parse a contract and list what is wrong with it.

    Two narrow aliases are accepted (``actor.value``, ``investor.value``).
    Unknown names, values outside their set and confidences outside 0-1 are
    faults; promotion may be missing.
    """
    parsed = rows.withColumn(out, F.from_json(column, CONTRACT_SCHEMA))
    c = lambda p: F.col(f"{out}.{p}")
    top = F.json_object_keys(F.col(column))
    faults = [
        F.when(top.isNull(), "not_an_object"),
        F.when(F.size(F.array_except(top, F.array(*[F.lit(x) for x in (*PARTS, "novice_signals", *REVIEW_FIELDS)]))) > 0, "unknown_field"),
    ]
    for part, names in PARTS.items():
        text = F.get_json_object(F.col(column), f"$.{part}")
        allowed = [*names, "value"] if part in ("actor", "investor") else list(names)
        extra = F.size(F.array_except(F.json_object_keys(text), F.array(*[F.lit(x) for x in allowed]))) > 0
        faults.append(F.when(extra, f"unknown_field_in_{part}"))
        if part == "promotion":
            faults.append(F.when(text.isNotNull() & (c("promotion.value").isNull() | ~F.coalesce(c("promotion.confidence").between(0, 1), F.lit(False))), "bad_promotion"))
        elif part == "emotion":
            faults.append(F.when(text.isNull(), "missing_emotion"))
        else:
            faults.append(F.when(~F.coalesce(c(f"{part}.confidence").between(0, 1), F.lit(False)), f"bad_confidence_in_{part}"))
    actor = F.coalesce(c("actor.type"), c("actor.value"))
    level = F.coalesce(c("investor.level"), c("investor.value"))
    for value, name, values in ((actor, "actor", ACTORS), (level, "investor", LEVELS), (c("direction.value"), "direction", DIRECTIONS), (c("intent.value"), "intent", INTENTS), (c("position.value"), "position", POSITIONS)):
        faults.append(F.when(~F.coalesce(value.isin(*values), F.lit(False)), f"bad_value_in_{name}"))
    faults.append(F.when(c("spam.value").isNull(), "bad_value_in_spam"))
    return parsed.withColumn("faults", F.array_compact(F.array(*faults)))


def flatten_contract(rows: DataFrame, out: str = "c") -> DataFrame:
    """The columns an analysis row is stored with."""
    c = lambda p: F.col(f"{out}.{p}")
    flags = F.struct(*[F.coalesce(c(f"emotion.{f}"), F.lit(False)).alias(f) for f in EMOTION_FLAGS])
    return rows.select(
        *[x for x in rows.columns if x not in (out, "faults")],
        F.coalesce(c("actor.type"), c("actor.value")).alias("actor_type"), c("actor.confidence").alias("actor_confidence"),
        F.coalesce(c("investor.level"), c("investor.value")).alias("investor_level"), c("investor.confidence").alias("investor_confidence"),
        c("direction.value").alias("direction"), c("direction.confidence").alias("direction_confidence"), c("intent.value").alias("intent"),
        c("intent.confidence").alias("intent_confidence"), c("position.value").alias("position"), c("position.confidence").alias("position_confidence"),
        F.coalesce(c("novice_signals"), F.array().cast("array<string>")).alias("novice_signals"), flags.alias("emotion"), c("spam.value").alias("spam"),
        c("spam.confidence").alias("spam_confidence"), F.coalesce(c("promotion.value"), F.lit(False)).alias("promotion"),
        F.coalesce(c("promotion.confidence"), F.lit(0.0)).alias("promotion_confidence"),
    )


ANALYSIS_KEY = ["content_id", "topic_id", "input_hash", "model", "prompt_version", "schema_version"]


def new_analyses(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-if-absent on the six-part key."""
    return _matches(rows.dropDuplicates(ANALYSIS_KEY), stored.select(*ANALYSIS_KEY), "left_anti", ANALYSIS_KEY)


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def evidence_faults(intent: Column, direction: Column, basis: Column, evidence: Column, rationale: Column, source_text: Column) -> Column:
    """Names of the evidence rules an item breaks."""
    proof = _squeezed(evidence)
    reason = _squeezed(rationale)
    contradicted = reduce(or_, [reason.contains(t) for t in CONTRADICTIONS])
    act = basis.isin(*ACTION_BASES, *TENDENCY_BASES)
    rules = [
        F.when(~F.coalesce(basis.isin(*ALL_BASES), F.lit(False)), "invalid_basis"),
        F.when(F.trim(F.coalesce(rationale, F.lit(""))) == "", "no_rationale"),
        F.when((intent != "unknown") & basis.isin(*EXPLICIT_BASES) & contradicted, "contradicts_rationale"),
        F.when((proof != "") & ~F.contains(_squeezed(source_text), proof), "evidence_not_in_text"),
        F.when(intent.isin("buy", "sell") & (~act | (proof == "")), "no_action_evidence"),
        F.when((intent == "hold") & (~basis.isin("explicit_self_position", "advice_or_recommendation") | (proof == "")), "no_position_evidence"),
        F.when((intent == "wait") & (~basis.isin("explicit_wait", "advice_or_recommendation") | (proof == "")), "no_waiting_evidence"),
        F.when((intent == "unknown") & ~basis.isin(*OTHER_BASES), "unknown_with_action_basis"),
        F.when(
            (basis == "market_directional_view")
            & (((intent == "buy") & (direction != "bullish")) | ((intent == "sell") & (direction != "bearish")) | ~intent.isin("buy", "sell")),
            "direction_not_aligned",
        ),
        F.when((basis == "risk_warning") & ((intent != "sell") | (direction != "bearish")), "warning_not_bearish"),
    ]
    return F.array_compact(F.array(*rules))


def review(rows: DataFrame, *, intent: str = "intent", direction: str = "direction", basis: str = "intent_basis", evidence: str = "intent_evidence", rationale: str = "rationale", text: str = "source_text") -> DataFrame:
    """Check evidence; an intent that cannot be verified becomes unknown, with a note.

    Before the check an unknown intent with a tendency basis is read as
    ``insufficient``. Nothing is invented: a downgrade has no evidence.
    """
    tendency = (F.col(intent) == "unknown") & F.col(basis).isin(*TENDENCY_BASES)
    rows = rows.withColumn(basis, F.when(tendency, "insufficient").otherwise(F.col(basis)))
    faults = evidence_faults(F.col(intent), F.col(direction), F.col(basis), F.col(evidence), F.col(rationale), F.col(text))
    checked = rows.withColumn("evidence_faults", faults)
    failed = F.size("evidence_faults") > 0
    said = F.trim(F.coalesce(F.col(rationale), F.lit("")))
    note = F.when(said == "", DEGRADED_NOTE).otherwise(F.concat(said, F.lit("；" + DEGRADED_NOTE)))
    return checked.select(
        *[c for c in checked.columns if c not in (intent, basis, evidence, rationale)],
        F.when(failed, "unknown").otherwise(F.col(intent)).alias(intent), F.when(failed, "insufficient").otherwise(F.col(basis)).alias(basis),
        F.when(failed, "").otherwise(F.col(evidence)).alias(evidence), F.when(failed, note).otherwise(F.col(rationale)).alias(rationale), failed.alias("degraded"),
    )


def review_counters(rows: DataFrame) -> DataFrame:
    """Reviewed items per model and intent."""
    return rows.groupBy("model").agg(*[F.sum((F.col("intent") == i).cast("long")).alias(i) for i in INTENTS], F.count("*").alias("reviewed"))


def first_seen(rows: DataFrame, *, known: DataFrame, key: str = "note_id", token: str = "token", position: str = "position") -> DataFrame:
    """Usable rows of a page: id and token given, the first of each id, known ids removed."""
    usable = rows.where((F.coalesce(key, F.lit("")) != "") & (F.coalesce(token, F.lit("")) != ""))
    rest = [c for c in rows.columns if c != key]
    first = usable.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("_r")).select(key, "_r.*")
    return first.join(known.select(key), key, "left_anti")


def single_reviews(reviews: DataFrame) -> DataFrame:
    """At most one review row per analysis; the first one stays."""
    rest = [c for c in reviews.columns if c != "analysis_id"]
    return reviews.groupBy("analysis_id").agg(F.min_by(F.struct(*rest), "review_id").alias("_r")).select("analysis_id", "_r.*")
