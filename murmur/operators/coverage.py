"""What is present for each natural day: collection, analysis and market coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import source_name
from murmur.functions.timeutil import day_start, shanghai_date


def task_days(tasks: DataFrame) -> DataFrame:
    """Each task once per Shanghai day it overlaps, with a full-day flag.

    ``start < day_end and end > day_start`` holds exactly on the days from the
    start's date to the date just before the end, so the interval join is an
    ``explode`` followed by equi joins on the day.
    """
    last = shanghai_date(F.col("window_end") - F.expr("INTERVAL 1 MICROSECOND"))
    rows = tasks.where(F.col("window_end") > F.col("window_start")).withColumn(
        "day", F.explode(F.sequence(shanghai_date(F.col("window_start")), last))
    )
    full = (F.col("window_start") <= day_start(F.col("day"))) & (F.col("window_end") >= day_start(F.date_add("day", 1)))
    return rows.withColumn("full_day", full)


def topic_states(tasks: DataFrame) -> DataFrame:
    """Collection state of every (day, source, topic) that has a task; the first match wins."""
    any_full = lambda status: F.max(F.coalesce(F.col("full_day") & (F.col("status") == status), F.lit(False)))
    flags = task_days(tasks).groupBy("day", "source", "topic_id").agg(
        any_full("complete").alias("complete"), any_full("degraded").alias("degraded"), any_full("partial").alias("partial"),
        any_full("running").alias("running"), F.max("full_day").alias("any_full"),
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
        # The retry time of a task is read only while its topic is not complete.
        F.max("next_retry_at").alias("next_retry_at"),
    )
    state = (
        F.when(F.col("complete"), "complete").when(F.col("degraded"), "degraded").when(F.col("partial"), "partial")
        .when(F.col("running"), "running").when(F.col("any_full"), "pending").otherwise("window_partial")
    )
    return flags.select(
        "day", "source", "topic_id", state.alias("state"), "window_start", "window_end",
        F.when(~F.col("complete"), F.col("next_retry_at")).alias("next_retry_at"),
    )


def source_coverage(content: DataFrame, tasks: DataFrame, topics: DataFrame, *, expected_sources: list[str]) -> DataFrame:
    """Status of every expected or observed source on every day with evidence."""
    expected = sorted({name.lower().replace("_", "-") for name in expected_sources})
    seen = content.where(~F.col("is_deleted")).groupBy(shanghai_date(F.col("published_at")).alias("day"), "source").agg(F.count("*").alias("content_count"))
    active = topics.select("topic_id").distinct()
    states = topic_states(tasks.where(F.col("source").isin(*expected)).join(active, "topic_id", "left_semi"))
    per_source = states.groupBy("day", "source").agg(
        *[F.sum((F.col("state") == s).cast("long")).alias(f"n_{s}") for s in ("complete", "degraded", "partial", "running", "pending", "window_partial")],
        F.count("*").alias("recorded_topics"), F.min("window_start").alias("recorded_window_start"),
        F.max("window_end").alias("recorded_window_end"), F.max("next_retry_at").alias("next_retry_at"),
    )
    days = seen.select("day").unionByName(states.select("day")).distinct()
    wanted = days.select("day", F.explode(F.array(*[F.lit(s) for s in expected])).alias("source")) if expected else days.withColumn("source", F.lit("")).limit(0)
    total = active.agg(F.count("*").alias("topic_total")).scalar()
    spine = wanted.unionByName(seen.select("day", "source")).distinct().withColumn("expected", F.col("source").isin(*expected) if expected else F.lit(False))
    rows = spine.join(seen, ["day", "source"], "left").join(per_source, ["day", "source"], "left").withColumn("topic_total", total)
    counts = [c for c in rows.columns if c.startswith("n_")] + ["content_count", "recorded_topics"]
    rows = rows.fillna(0, counts)
    status = (
        F.when(~F.col("expected"), "observed")
        .when((F.col("topic_total") > 0) & (F.col("n_complete") == F.col("topic_total")), "complete")
        .when(F.col("n_degraded") > 0, "degraded").when(F.col("n_running") > 0, "running")
        .when(F.col("n_complete") + F.col("n_partial") > 0, "partial").when(F.col("n_window_partial") > 0, "window_partial")
        .when(F.col("n_pending") > 0, "pending").otherwise("not_recorded")
    )
    final = F.when((F.col("_s") == "not_recorded") & (F.col("content_count") > 0), "observed_untracked").otherwise(F.col("_s"))
    return rows.withColumn("_s", status).select(
        "day", F.col("source").alias("name"), "expected", final.alias("status"), "content_count", F.col("n_complete").alias("complete_topics"),
        "recorded_topics", F.when(F.col("expected"), F.col("topic_total")).otherwise(F.lit(0)).alias("expected_topics"),
        "recorded_window_start", "recorded_window_end", "next_retry_at",
    )


def day_coverage(content: DataFrame, content_topic: DataFrame, analysis: DataFrame, sources: DataFrame, asset_topic: DataFrame, bars: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per day: contents, index and analysis progress, assets with a bar."""
    active = topics.select("topic_id").distinct()
    indexed = content_topic.join(active, "topic_id", "left_semi").select("content_id").distinct().withColumn("_i", F.lit(1))
    analysed = analysis.select("content_id").distinct().withColumn("_a", F.lit(1))
    posts = content.where(~F.col("is_deleted")).select("content_id", shanghai_date(F.col("published_at")).alias("day"))
    days = posts.join(indexed, "content_id", "left").join(analysed, "content_id", "left").groupBy("day").agg(
        F.count("*").alias("content_count"), F.count("_i").alias("indexed_content_count"),
        F.count(F.when(F.col("_i").isNotNull(), F.col("_a"))).alias("analyzed_content_count"),
    )
    linked = asset_topic.join(active, "topic_id", "left_semi").select("asset_id").distinct()
    exact = bars.where(F.col("interval") == "1d").join(linked, "asset_id", "left_semi").groupBy(shanghai_date(F.col("ts")).alias("day")).agg(
        F.countDistinct("asset_id").alias("exact_day_asset_count")
    )
    planned = sources.groupBy("day").agg(
        F.sum(F.col("expected").cast("int")).alias("_e"), F.sum((F.col("expected") & (F.col("status") == "complete")).cast("int")).alias("_c")
    )
    linked_count = linked.agg(F.count("*").alias("n")).scalar()
    rows = days.join(planned, "day", "left").join(exact, "day", "left").withColumn("linked_asset_count", linked_count)
    rows = rows.fillna(0, ["_e", "_c", "exact_day_asset_count"])
    pending = F.col("indexed_content_count") - F.col("analyzed_content_count")
    collection = F.when(F.col("_e") == 0, "untracked").when(F.col("_e") == F.col("_c"), "complete").otherwise("partial")
    done = (F.col("indexed_content_count") > 0) & (pending == 0)
    return rows.select(
        "day", "content_count", "indexed_content_count", "analyzed_content_count", pending.alias("analysis_pending_count"),
        collection.alias("collection_status"),
        F.when(done, "complete").when(F.col("indexed_content_count") > 0, "pending").otherwise("empty").alias("analysis_status"),
        F.when((collection == "complete") & done, "complete").otherwise("partial").alias("status"),
        "linked_asset_count", "exact_day_asset_count", (F.col("linked_asset_count") - F.col("exact_day_asset_count")).alias("missing_asset_count"),
    )


def normalized_sources(df: DataFrame, column: str = "source") -> DataFrame:
    """Source names as they are compared."""
    return df.withColumn(column, source_name(F.col(column)))
