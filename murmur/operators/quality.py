"""Source quality, status, timestamp audit and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.timeutil import parse_instant, shanghai_date
from murmur.operators.analysis import analysis_tier
from murmur.operators.ingest import ITEM, latest_versions
from murmur.sources.raw import is_verified, with_payload

QUALITY_NAMES = (
    "source_success_rate", "items_collected", "duplicate_ratio", "parse_failure_ratio", "analysis_failure_ratio",
    "unknown_actor_ratio", "unknown_asset_ratio", "spam_ratio", "promotion_ratio", "collection_delay",
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(F.coalesce(part, F.lit(0)) / whole)


def source_quality(sources: DataFrame, raw: DataFrame, content: DataFrame, content_asset: DataFrame, analysis: DataFrame) -> DataFrame:
    """Ten quality figures per source, one row each.

    Only the effective analysis of a post counts: the highest tier over all
    topics. Every input is reduced to one row per source before it is joined.
    """
    # Distinct items first, so that repeats of one item meet as one row.
    items = raw.groupBy("source", "source_item_id").agg(F.count("*").alias("_n"))
    stored = items.groupBy("source").agg(F.sum("_n").alias("raw_rows"), F.count("*").alias("items"))
    posts = content.groupBy("source").agg(F.count("*").alias("posts"))
    home = content.select("content_id", "source")
    with_asset = content_asset.select("content_id").distinct().join(home, "content_id").groupBy("source").agg(F.count("*").alias("asset_posts"))
    tier = F.struct(analysis_tier(F.col("model"), F.col("prompt_version")).alias("t"), F.col("analysis_id").alias("i"))
    best = analysis.groupBy("content_id").agg(F.max_by(F.struct("actor_type", "spam", "promotion"), tier).alias("a")).join(home, "content_id")
    judged = best.groupBy("source").agg(
        F.count("*").alias("analysed"), F.sum((F.col("a.actor_type") == "unknown").cast("long")).alias("unknown"),
        F.sum(F.col("a.spam").cast("long")).alias("spam"), F.sum(F.col("a.promotion").cast("long")).alias("promotion"),
    )
    rows = sources
    for part in (stored, posts, with_asset, judged):
        rows = rows.join(part, "source", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    values = {
        "source_success_rate": F.when(F.col("health_status") == "healthy", 1.0).otherwise(0.0),
        "items_collected": n("raw_rows").cast("double"),
        "duplicate_ratio": F.when(n("raw_rows") > 0, 1 - n("items") / n("raw_rows")).otherwise(0.0),
        "parse_failure_ratio": F.when((F.col("source_type") != "content") | (n("posts") > 0) | (n("raw_rows") == 0), 0.0).otherwise(1.0),
        "analysis_failure_ratio": F.when(n("posts") > 0, F.greatest(F.lit(0.0), 1 - n("analysed") / n("posts"))).otherwise(0.0),
        "unknown_actor_ratio": _share(n("unknown"), n("analysed")),
        "unknown_asset_ratio": F.when(n("posts") > 0, 1 - n("asset_posts") / n("posts")).otherwise(0.0),
        "spam_ratio": _share(n("spam"), n("analysed")),
        "promotion_ratio": _share(n("promotion"), n("analysed")),
        "collection_delay": F.lit(0.0),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric_name"), v.cast("double").alias("metric_value")) for k, v in values.items()])
    return rows.select("source", F.inline(pairs))


def publication_audit(raw: DataFrame, content: DataFrame) -> DataFrame:
    """The newest raw version of every item with its time issues."""
    rows = with_payload(latest_versions(raw), fields=("timestamp_semantics", "source_timestamp_field", "updated_at", "url")).join(
        content.select(*ITEM, F.col("published_at").alias("content_published_at"), F.lit(True).alias("_normalized")), ITEM, "left"
    )
    published, updated_text = F.col("published_at"), F.col("p.updated_at")
    updated = parse_instant(updated_text)
    verified = is_verified()
    given = published.isNotNull() & (F.coalesce(updated_text, F.lit("")) != "")
    issues = F.array_compact(
        F.array(
            F.when(published.isNull(), "missing_publication_time"),
            F.when(published > F.col("observed_at") + F.expr("INTERVAL 10 MINUTES"), "future_after_observation"),
            F.when(given & updated.isNull(), "invalid_updated_at"),
            F.when(given & (updated < published), "updated_before_published"),
            F.when(F.col("_normalized").isNull(), "normalized_missing")
            .when(verified & published.isNotNull() & ~F.col("content_published_at").eqNullSafe(published), "content_time_mismatch"),
        )
    )
    return rows.select(
        *ITEM, "raw_id", verified.alias("verified"), F.coalesce(F.when(F.col("p.timestamp_semantics") != "", F.col("p.timestamp_semantics")), F.lit("ambiguous")).alias("semantics"),
        F.coalesce(F.when(F.col("p.source_timestamp_field") != "", F.col("p.source_timestamp_field")), F.lit("unspecified")).alias("source_timestamp_field"),
        "published_at", "observed_at", "content_published_at", F.col("p.url").alias("url"), issues.alias("issues"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per source, issue counters, verified share and how often each time field was used.

    The histogram is built from counts per field name, so a source of any size
    adds one entry per field and task.
    """
    has = lambda name: F.sum(F.array_contains("issues", name).cast("long")).alias(name)
    counters = audit.groupBy("source").agg(
        F.count("*").alias("items"), F.sum(F.col("verified").cast("long")).alias("verified"),
        *[has(i) for i in ("missing_publication_time", "future_after_observation", "updated_before_published", "normalized_missing", "content_time_mismatch")],
    )
    fields = audit.groupBy("source", "source_timestamp_field").agg(F.count("*").alias("n")).groupBy("source").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_timestamp_field", "n")))).alias("timestamp_fields")
    )
    return counters.join(fields, "source").select(
        "*", (F.col("items") - F.col("verified")).alias("ambiguous"), _share(F.col("verified"), F.col("items")).alias("verified_ratio")
    )


def audit_problems(audit: DataFrame, sample_limit: int = 20) -> DataFrame:
    """A bounded sample of items with issues or unverified times."""
    named = F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.array(F.lit("ambiguous_timestamp_semantics")))
    return audit.where((F.size("issues") > 0) | ~F.col("verified")).withColumn("issues", named).orderBy("raw_id").limit(sample_limit)


def latest_quality(quality: DataFrame, per_source: int = 20) -> DataFrame:
    """The newest quality rows per source; Spark prunes to that many rows per task before the shuffle."""
    order = Window.partitionBy("source").orderBy(F.desc("metric_date"), "metric_name")
    return quality.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_source)


def source_status(sources: DataFrame, raw: DataFrame, content: DataFrame, trends: DataFrame, trend_signals: DataFrame) -> DataFrame:
    """Evidence counts per source."""
    parts = [
        raw.groupBy("source").agg(F.count("*").alias("raw_observation_count"), F.max("observed_at").alias("last_observed_at")),
        content.groupBy("source").agg(F.count("*").alias("content_count")),
        trends.groupBy("source").agg(F.count("*").alias("trend_observation_count")),
        trend_signals.join(trends.select("observation_id", "source"), "observation_id").groupBy("source").agg(F.count("*").alias("trend_signal_count")),
    ]
    rows = sources
    for part in parts:
        rows = rows.join(part, "source", "left")
    return rows.fillna(0, ["raw_observation_count", "content_count", "trend_observation_count", "trend_signal_count"])


def status_report(status: DataFrame, quality: DataFrame, archive: DataFrame, *, archive_source: str, per_source: int = 20) -> DataFrame:
    """Status rows with their newest quality figures and, at the archive source, its lookups by status."""
    newest = latest_quality(quality, per_source).groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("position", "metric_date", "metric_name", "metric_value"))).alias("quality")
    )
    lookups = archive_status(archive).agg(F.array_sort(F.collect_list(F.struct("status", "lookups", "checked"))).alias("archive")).select(F.lit(archive_source).alias("source"), "archive")
    return status.join(newest, "source", "left").join(lookups, "source", "left")


def archive_status(state: DataFrame) -> DataFrame:
    """A10: archive lookups by status."""
    return state.groupBy("status").agg(F.count("*").alias("lookups"), F.count("checked_at").alias("checked"))


def collection_summary(results: DataFrame) -> DataFrame:
    """Totals over all collection attempts, in one row.

    Topics and sources are counted from their distinct pairs, so the two
    distinct counts need no copy of every attempt.
    """
    flag = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    complete = F.coalesce(F.col("skip_reason") == "checkpoint_complete", F.lit(False))
    pairs = results.groupBy("topic_id", "source").agg(
        F.count("*").alias("attempts"), F.sum("items_collected").alias("items"), F.sum("duplicates").alias("duplicates"),
        F.sum("topic_links_added").alias("links"), flag(F.col("source_degraded")).alias("degraded"), flag(F.col("source_partial")).alias("partial"),
        flag(complete).alias("skipped"), flag(F.col("collection_skipped") & ~complete).alias("deferred"),
    )
    return pairs.agg(
        F.size(F.collect_set("topic_id")).alias("topic_count"), F.size(F.collect_set("source")).alias("source_count"),
        F.sum("attempts").alias("attempt_count"), F.sum("items").alias("items_collected"), F.sum("duplicates").alias("duplicates"),
        F.sum("links").alias("topic_links_added"), F.sum("degraded").alias("degraded"), F.sum("partial").alias("partial"),
        F.sum("skipped").alias("skipped_completed"), F.sum("deferred").alias("deferred"),
    )


def merge_diagnostics(pages: DataFrame, *, key: str = "run_id", column: str = "diagnostics", order: str = "page") -> DataFrame:
    """Page diagnostics (name -> JSON value) merged per run.

    Numbers add, booleans OR, anything else keeps the last page's value. Nested
    objects arrive as dotted names, so they merge by the same rule.
    """
    rows = pages.select(key, F.col(order).alias("_o"), F.explode(column).alias("name", "value"))
    is_bool = F.col("value").isin("true", "false")
    number = F.when(~is_bool, F.col("value").try_cast("double"))
    merged = rows.groupBy(key, "name").agg(
        F.sum(number).alias("_sum"), F.count(number).alias("_numbers"), F.max(F.when(is_bool, F.col("value") == "true")).alias("_or"),
        F.count("*").alias("_n"), F.max_by("value", "_o").alias("_last"),
    )
    value = F.when(F.col("_numbers") == F.col("_n"), F.col("_sum").cast("string")).when(F.col("_or").isNotNull() & (F.col("_numbers") == 0), F.col("_or").cast("string")).otherwise(F.col("_last"))
    return merged.select(key, "name", value.alias("value"))


def publication_histogram(rows: DataFrame, ts: str = "published_at") -> DataFrame:
    """Items per Shanghai publication day."""
    return rows.groupBy(shanghai_date(F.col(ts)).alias("day")).agg(F.count("*").alias("items"))
