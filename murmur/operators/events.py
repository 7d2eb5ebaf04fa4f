"""Merged signal events and their spread across sources."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.timeutil import BUCKET_SECONDS, floor_bucket
from murmur.operators.analysis import analysis_tier
from murmur.operators.metrics import METRIC_NAMES
from murmur.session import checkpointed, written

# Which metric raises which kind of event.
EVENT_TYPES = {
    "post_count": "attention_spike",
    "unique_author_count": "attention_spike",
    "novice_ratio": "novice_spike",
    "fomo_ratio": "fomo_spike",
    "panic_ratio": "panic_spike",
    "buy_intent_ratio": "buy_intent_spike",
}
EVENT_GROUP = ("event_type", "source", "topic_id", "asset_id", "bucket_size")


def _label(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("-"))


def qualifying(signals: DataFrame, *, min_robust_z: float = 3.0, min_percentile: float = 0.95) -> DataFrame:
    """P20: signals strong enough to raise an event, with the event type; NULLs drop out."""
    types = F.create_map(*[F.lit(x) for x in chain(*EVENT_TYPES.items())])
    return signals.where((F.col("robust_z") >= min_robust_z) & (F.col("percentile") >= min_percentile)).withColumn(
        "event_type", F.try_element_at(types, F.col("metric_name"))
    ).where(F.col("event_type").isNotNull())


def islands(df: DataFrame, keys: list[str], order: list[str], starts_new, out: str = "island_start") -> DataFrame:
    """Label each row with the first row of its run.

    ``starts_new`` receives the window and tells whether the row opens a run.
    Input rows are event or signal rows: one per bucket, key and metric, so a
    key is bounded by the calendar, not by the number of posts.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(starts_new(window), F.lit(True)))
    label = F.last(F.when(F.col("_new"), F.col(order[0])), ignorenulls=True)
    return flagged.withColumn(out, label.over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def event_key(start: Column) -> Column:
    """Key of an event from its group and the seconds of its first bucket."""
    return F.concat_ws("|", "event_type", "source", _label(F.col("topic_id")), _label(F.col("asset_id")), "bucket_size", start.cast("string")).alias("event_key")


def detect_events(
    signals: DataFrame, *, min_robust_z: float = 3.0, min_percentile: float = 0.95,
    rule_version: str = "discovery-v1", event_date: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, event-signal links).

    Signals of one group merge while the next bucket is at most one bucket
    later. The peak is the largest (robust z, percentile); ties go to the
    earliest bucket, then to the metric listed first. ``event_date`` cuts at the end of that UTC date.
    """
    strong = qualifying(signals, min_robust_z=min_robust_z, min_percentile=min_percentile)
    if event_date is not None:
        strong = strong.where(F.col("bucket_at") < F.lit(event_date).cast("date") + F.expr("INTERVAL 1 DAY"))
    step = F.when(F.col("bucket_size") == "1h", BUCKET_SECONDS["1h"]).otherwise(BUCKET_SECONDS["1d"])
    strong = strong.withColumn("_at", F.unix_seconds("bucket_at"))
    runs = islands(
        strong, list(EVENT_GROUP), ["_at", "metric_name"], lambda w: F.col("_at") > F.lag("_at").over(w) + step, "_start"
    )
    # Few signals qualify; written once, they serve both events and links.
    runs = checkpointed(runs)
    # Of equal signals in a bucket the metric that is listed first leads.
    place = F.array_position(F.array(*[F.lit(m) for m in METRIC_NAMES]), F.col("metric_name"))
    peak_order = F.struct(F.col("robust_z"), F.col("percentile"), -F.col("_at"), -place)
    peak = F.max_by(F.struct("bucket_at", "raw_value", "robust_z", "percentile", "metric_name"), peak_order)
    started = F.timestamp_seconds("_start")
    key = event_key(F.col("_start"))
    events = (
        runs.groupBy(*EVENT_GROUP, "_start")
        .agg(peak.alias("_peak"), F.max("bucket_at").alias("ended_at"), F.count("*").alias("signal_count"))
        .select(
            key, *EVENT_GROUP, started.alias("started_at"),
            F.col("_peak.bucket_at").alias("peaked_at"), "ended_at",
            F.col("_peak.raw_value").alias("peak_value"), F.col("_peak.robust_z").alias("peak_zscore"),
            F.col("_peak.percentile").alias("peak_percentile"), F.col("_peak.metric_name").alias("peak_metric"),
            F.col("_peak.bucket_at").alias("trigger_bucket_at"), "signal_count",
            F.lit(rule_version).alias("rule_version"), F.lit("discovered").alias("status"),
        )
    )
    links = runs.select(key, *EVENT_GROUP, "bucket_at", "metric_name", "raw_value", "zscore", "robust_z", "percentile")
    return events, links


def event_signal_time(events: DataFrame) -> DataFrame:
    """The end of the trigger bucket; an event without a trigger uses its peak."""
    step = F.when(F.col("bucket_size") == "1h", F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 24 HOURS"))
    return events.withColumn("signal_at", F.coalesce(F.col("trigger_bucket_at") + step, F.col("peaked_at")))


def detect_diffusion(events: DataFrame, *, min_sources: int = 2, gap_seconds: int = 86400, rule_version: str = "discovery-v1") -> DataFrame:
    """Events of one topic and asset that follow within a day, across sources.

    The gap is measured from the end of the previous event in start order, not
    from the furthest end so far. First starts per source are aggregated before
    the sequence is built, so the sequence has one entry per source.
    """
    finish = F.coalesce("ended_at", "peaked_at")
    spikes = events.where(F.col("event_type").isin(*sorted(set(EVENT_TYPES.values())))).select(
        "topic_id", "asset_id", "source", "event_key",
        F.unix_seconds("started_at").alias("_from"), F.unix_seconds(finish).alias("_to"),
    )
    runs = islands(
        spikes, ["topic_id", "asset_id"], ["_from", "event_key"],
        lambda w: F.col("_from") > F.lag("_to").over(w) + gap_seconds, "_start",
    )
    per_source = runs.groupBy("topic_id", "asset_id", "_start", "source").agg(
        F.min(F.struct("_from", "event_key")).alias("first"), F.max("_to").alias("_to")
    )
    iso = lambda c: F.concat(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    entry = F.struct(F.col("first._from").alias("at"), F.col("first.event_key").alias("event_key"), F.col("source"))
    spread = per_source.groupBy("topic_id", "asset_id", "_start").agg(
        F.max("_to").alias("_end"), F.array_sort(F.collect_list(entry)).alias("_sequence"), F.sort_array(F.collect_list("source")).alias("_sources"),
    ).where(F.size("_sources") >= min_sources)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    signature = F.sha2(
        F.concat(
            F.lit('{"asset": '), number("asset_id"), F.lit(', "end": "'), iso(F.col("_end")),
            F.lit('", "sources": ['), F.concat_ws(", ", F.transform("_sources", lambda s: F.concat(F.lit('"'), s, F.lit('"')))),
            F.lit('], "start": "'), iso(F.col("_start")), F.lit('", "topic": '), number("topic_id"), F.lit("}"),
        ), 256,
    )
    duration = F.col("_end") - F.col("_start")
    return spread.select(
        "topic_id", "asset_id", F.timestamp_seconds("_start").alias("started_at"), F.timestamp_seconds("_end").alias("ended_at"),
        F.get("_sequence", F.lit(0))["source"].alias("first_source"),
        F.size("_sources").alias("platform_count"),
        F.transform("_sequence", lambda e: F.struct(e["source"].alias("source"), iso(e["at"]).alias("started_at"))).alias("source_sequence"),
        duration.alias("duration_seconds"),
        F.when(duration > 0, F.size("_sources") / (duration / 86400)).alias("velocity"),
        signature.alias("signature_hash"), F.lit(rule_version).alias("rule_version"),
    )


def cross_platform_events(diffusion: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One source-less event per diffusion, unless the same one is stored."""
    fresh = diffusion.select(
        F.concat_ws("|", F.lit("cross_platform_spike"), F.lit("-"), _label(F.col("topic_id")), _label(F.col("asset_id")), F.lit("1d"), F.unix_seconds("started_at").cast("string")).alias("event_key"),
        F.lit("cross_platform_spike").alias("event_type"), F.lit(None).cast("string").alias("source"), "topic_id", "asset_id",
        F.lit("1d").alias("bucket_size"), "started_at", F.col("started_at").alias("peaked_at"), "ended_at",
        F.col("platform_count").cast("double").alias("peak_value"), F.lit(None).cast("double").alias("peak_zscore"),
        F.lit(1.0).alias("peak_percentile"), F.lit(None).cast("string").alias("peak_metric"),
        F.lit(None).cast("timestamp").alias("trigger_bucket_at"), F.lit(0).cast("long").alias("signal_count"),
        "rule_version", F.lit("discovered").alias("status"),
    ).dropDuplicates(["event_key"])
    return fresh if stored is None else fresh.join(stored.select("event_key"), "event_key", "left_anti")


def event_payloads(events: DataFrame, links: DataFrame, returns: DataFrame) -> DataFrame:
    """Events with their signals and returns as nested arrays.

    An event has at most one signal per metric and bucket and one return per
    asset and horizon, so both arrays are bounded.
    """
    metrics = links.groupBy("event_key").agg(
        F.array_sort(F.collect_list(F.struct("bucket_at", "metric_name", "raw_value", "zscore", "robust_z", "percentile"))).alias("metrics")
    )
    paid = returns.groupBy("event_key").agg(
        F.array_sort(F.collect_list(F.struct("asset_id", "horizon", "raw_return", "market_return", "market_abnormal_return"))).alias("returns")
    )
    return events.join(metrics, "event_key", "left").join(paid, "event_key", "left")


def event_contents(links: DataFrame, content: DataFrame, content_topic: DataFrame, *, size: str, limit: int = 50) -> DataFrame:
    """The newest posts behind each event, each post once, at most ``limit``.

    A post lies in ``[bucket, bucket + size)`` exactly when its own bucket is
    that bucket, so the range join is an equi join. Only the ``limit`` newest
    posts of a bucket can be shown, so each bucket is cut to them before it meets
    its events; Spark applies ``row_number <= limit`` in every task first.
    """
    posts = content.select("content_id", "source", "published_at", floor_bucket(F.col("published_at"), size).alias("bucket_at"))

    def newest(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("published_at"), F.desc("content_id"))
        return rows.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= limit).drop("_i")

    buckets = links.where(F.col("bucket_size") == size).select("event_key", "source", "topic_id", "bucket_at").distinct()
    scoped = buckets.where(F.col("topic_id").isNotNull()).join(
        newest(posts.join(content_topic, "content_id"), "source", "bucket_at", "topic_id"), ["source", "bucket_at", "topic_id"]
    )
    loose = buckets.where(F.col("topic_id").isNull()).drop("topic_id").join(newest(posts, "source", "bucket_at"), ["source", "bucket_at"])
    found = scoped.select("event_key", "bucket_at", "content_id", "published_at").unionByName(
        loose.select("event_key", "bucket_at", "content_id", "published_at")
    )
    order = Window.partitionBy("event_key").orderBy("bucket_at", F.desc("published_at"), F.desc("content_id"))
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def event_histories(chosen: DataFrame, content: DataFrame, raw: DataFrame, analysis: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, raw versions, analyses) behind the rows of ``event_contents``, one row each.

    The chosen posts are few, at most ``limit`` for an event, and written first:
    Spark knows their size, broadcasts them if small, and so cuts versions and
    analyses in their scans, before any of them is shuffled. Every version of a
    chosen post is a row of its own, so a post with a long history needs no large row.
    """
    ids = written(chosen.select("content_id").distinct())
    posts = written(content.join(ids, "content_id", "left_semi"))
    items = posts.select("content_id", "source", "source_item_id")
    versions = raw.join(items, ["source", "source_item_id"])
    return posts, versions, analysis.join(ids, "content_id", "left_semi")


def event_details(events: DataFrame, chosen: DataFrame, content: DataFrame, raw: DataFrame, analysis: DataFrame) -> DataFrame:
    """Events with ``raw_drilldown``: their posts in order, each with its effective analysis,
    all analyses and all raw versions, newest first; an event without posts has an empty one.

    Histories are nested once per post and then meet the events that show it. Rows hold
    whole histories, as a page needs them; to pass on many, take ``event_histories``.
    """
    chosen = written(chosen)
    posts, versions, analyses = event_histories(chosen, content, raw, analysis)

    def newest_first(rows: DataFrame, ident: str) -> Column:
        return F.sort_array(F.collect_list(F.struct(ident, *[c for c in rows.columns if c not in (ident, "content_id")])), asc=False)

    best = F.struct(analysis_tier(F.col("model"), F.col("prompt_version")), "analysis_id")
    whole = F.struct("analysis_id", *[c for c in analyses.columns if c not in ("analysis_id", "content_id")])
    judged = analyses.groupBy("content_id").agg(F.max_by(whole, best).alias("analysis"), newest_first(analyses, "analysis_id").alias("analyses"))
    landed = versions.groupBy("content_id").agg(newest_first(versions, "raw_id").alias("raw_observations"))
    told = posts.select("content_id", F.struct(*posts.columns).alias("content")).join(judged, "content_id", "left").join(landed, "content_id", "left")
    empty = lambda name: F.coalesce(name, F.array().cast(told.schema[name].dataType)).alias(name)
    shown = chosen.select("event_key", "content_id", "position").join(told, "content_id")
    entry = F.struct("position", "content", "analysis", empty("analyses"), empty("raw_observations"))
    drilldown = shown.groupBy("event_key").agg(F.array_sort(F.collect_list(entry)).alias("raw_drilldown"))
    return events.join(drilldown, "event_key", "left").withColumn(
        "raw_drilldown", F.coalesce("raw_drilldown", F.array().cast(drilldown.schema["raw_drilldown"].dataType))
    )
