"""Bucketed platform metrics and their rolling baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.timeutil import floor_bucket
from murmur.operators.analysis import (
    effective_by_content, engagement, is_comment, is_retail, pick_effective,
)

METRIC_KEYS = ("source", "topic_id", "asset_id")
METRIC_NAMES = (
    "post_count", "unique_author_count", "retail_ratio", "novice_ratio", "fomo_ratio",
    "panic_ratio", "buy_intent_ratio", "sell_intent_ratio", "engagement",
)


def entity_keys(content: DataFrame, content_topic: DataFrame, content_asset: DataFrame, asset_topic: DataFrame) -> DataFrame:
    """Arrays of topics and assets per content, ready to be exploded.

    Topics and assets cross within a content; with assets only, all topics
    linked to any of its assets are used. Arrays are bounded by the registry.
    """
    topics = content_topic.groupBy("content_id").agg(F.collect_set("topic_id").alias("_topics"))
    linked = content_asset.join(asset_topic.select("asset_id", F.col("topic_id").alias("_linked")), "asset_id", "left")
    assets = linked.groupBy("content_id").agg(
        F.collect_set("asset_id").alias("assets"), F.collect_set("_linked").alias("_linked")
    )
    own = F.when(F.size("_topics") > 0, F.col("_topics"))
    via_assets = F.when(F.size("_linked") > 0, F.col("_linked"))
    return (
        content.join(topics, "content_id", "left")
        .join(assets, "content_id", "left")
        .withColumn("topics", F.coalesce(own, via_assets))
        .drop("_topics", "_linked")
    )


def counters() -> dict[str, Column]:
    """The counters of a bucket but for its authors, as sums over rows with ``analysis`` and ``_engagement``.

    Promotion and spam leave the sentiment counters but stay in exposure; bullish
    and bearish do not ask for retail.
    """
    retail = is_retail()
    clean = F.coalesce(~F.col("analysis.promotion") & ~F.col("analysis.spam"), F.lit(False))
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return {
        "post_count": count(~is_comment(F.col("kind"))),
        "comment_count": count(is_comment(F.col("kind"))),
        "retail_count": count(retail),
        "novice_count": count(retail & (F.col("analysis.investor_level") == "novice")),
        "bullish_count": count(clean & (F.col("analysis.direction") == "bullish")),
        "bearish_count": count(clean & (F.col("analysis.direction") == "bearish")),
        "buy_intent_count": count(retail & (F.col("analysis.intent") == "buy")),
        "sell_intent_count": count(retail & (F.col("analysis.intent") == "sell")),
        "fomo_count": count(retail & (F.col("analysis.fomo_flags") >= 3)),
        "panic_count": count(retail & F.col("analysis.panic")),
        "engagement_sum": F.sum("_engagement"),
    }


def platform_metrics(
    content: DataFrame, content_topic: DataFrame, content_asset: DataFrame, asset_topic: DataFrame,
    analysis: DataFrame, *, size: str = "1h", since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Twelve counters per (bucket, source, topic, asset); ``until`` is inclusive.

    Deleted posts stay in (P21).
    """
    if since is not None:
        content = content.where(F.col("published_at") >= since)
    if until is not None:
        content = content.where(F.col("published_at") <= until)
    pruned = content.select(
        "content_id", "source", "kind", "author_id",
        floor_bucket(F.col("published_at"), size).alias("bucket_at"), engagement().alias("_engagement"),
    )
    keyed = entity_keys(pruned, content_topic, content_asset, asset_topic).join(
        effective_by_content(analysis), "content_id", "left"
    )
    pairs = keyed.withColumn("topic_id", F.explode_outer("topics")).withColumn("asset_id", F.explode_outer("assets"))
    rows = pairs.withColumn("analysis", pick_effective(F.col("topic_id")))
    return rows.groupBy("bucket_at", *METRIC_KEYS).agg(
        F.countDistinct("author_id").alias("unique_author_count"), *[value.alias(name) for name, value in counters().items()],
    ).withColumn("bucket_size", F.lit(size))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.try_divide(numerator.cast("double"), denominator))


def metric_values() -> dict[str, Column]:
    """The nine raw values, each with its own denominator; a zero denominator gives 0."""
    shown = F.col("post_count") + F.col("comment_count")
    retail = F.col("retail_count")
    return {
        "post_count": F.col("post_count").cast("double"),
        "unique_author_count": F.col("unique_author_count").cast("double"),
        "retail_ratio": ratio(retail, shown),
        "novice_ratio": ratio(F.col("novice_count"), shown),
        "fomo_ratio": ratio(F.col("fomo_count"), shown),
        "panic_ratio": ratio(F.col("panic_count"), shown),
        "buy_intent_ratio": ratio(F.col("buy_intent_count"), retail),
        "sell_intent_ratio": ratio(F.col("sell_intent_count"), retail),
        "engagement": F.col("engagement_sum").cast("double"),
    }


def metrics_long(metrics: DataFrame) -> DataFrame:
    """Wide counters to one row per metric name."""
    values = F.array(*[F.struct(F.lit(n).alias("metric_name"), v.alias("raw_value")) for n, v in metric_values().items()])
    keep = ["bucket_at", "bucket_size", *METRIC_KEYS]
    return metrics.select(*keep, F.inline(values))


def metric_snapshot(metrics: DataFrame) -> DataFrame:
    """The counters and ratios shown for one bucket."""
    v = metric_values()
    return metrics.select(
        "bucket_at", "bucket_size", *METRIC_KEYS, "post_count", "comment_count", "unique_author_count",
        *[v[n].alias(n) for n in ("novice_ratio", "fomo_ratio", "panic_ratio", "buy_intent_ratio", "sell_intent_ratio", "engagement")],
    )


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression named twice inside a higher-order function is evaluated for
    every element; binding it as a lambda variable keeps the cost linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(ordered: Column) -> Column:
    """Median of an array that is already sorted."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def with_baseline(rows: DataFrame, *, min_samples: int = 14) -> DataFrame:
    """Z, robust z and percentile of ``raw_value`` against the values in ``_frame``.

    Reads ``raw_value``, ``_frame``, ``_mean`` and ``_std``. Constant frames have
    no spread: z and robust z stay NULL, and nothing is sorted for them. The
    robust z uses the median and 1.4826 times the median absolute deviation. Each
    step is a column of its own, so arrays are sorted as primitive doubles in
    generated code and never twice; ``array_position`` in the descending array
    counts the larger values.
    """
    current, n = F.col("raw_value"), F.size("_frame")
    enough = n >= min_samples
    low = F.array_min("_frame")
    varied = enough & (low < F.array_max("_frame"))
    ordered = rows.withColumn("_varied", varied).withColumn("_sorted", F.when(F.col("_varied"), F.sort_array("_frame")))
    above = F.array_position(F.sort_array(F.array_append("_frame", current), asc=False), current) - 1
    level = F.when(low > current, n).otherwise(0)
    medians = ordered.select("*", array_median(F.col("_sorted")).alias("_med"), F.when(F.col("_varied"), above).when(enough, level).alias("_above"))
    distance = lambda v: F.coalesce(F.abs(v - F.col("_med")), F.lit(0.0))
    spread = medians.withColumn("_dev", F.sort_array(F.transform("_sorted", distance))).withColumn("_mad", array_median(F.col("_dev")))
    varied = F.col("_varied")
    signal = F.struct(
        F.when(enough & varied & (F.col("_std") > 0), (current - F.col("_mean")) / F.col("_std")).alias("zscore"),
        F.when(F.col("_mad") > 0, (current - F.col("_med")) / (1.4826 * F.col("_mad"))).alias("robust_z"),
        ((n - F.col("_above") + 1) / (n + 1)).alias("percentile"),
    )
    # A generator of one row: a filter on the result must not be pushed below the
    # arrays, where it would repeat their sorting for every element.
    return spread.select(*[c for c in rows.columns if c not in ("_frame", "_mean", "_std")], F.inline(F.array(signal)))


def spread_evenly(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash by key into the configured number of shuffle partitions.

    The number is stated, so adaptive execution does not merge partitions that
    look small on input: every row here fans out to a whole frame of values.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def metric_signals(
    metrics: DataFrame, *, baseline_days: int = 30, min_samples: int = 14, version: str = "metric-v1",
) -> DataFrame:
    """One signal per metric row and name, against the 30 days before it.

    The frame holds only buckets that have rows (no zero fill). One shuffle on
    (key, metric) serves all figures, and the nine metrics of a busy key go to
    different tasks. A window holds one row per bucket, so a ten-year hourly key
    is under 90,000 rows whatever the number of posts behind it.
    """
    keys = ["bucket_size", *METRIC_KEYS, "metric_name"]
    long = spread_evenly(metrics_long(metrics).withColumn("_t", F.unix_seconds("bucket_at")), *keys)
    window = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-baseline_days * 86400, -1)
    framed = long.select(
        "*", F.collect_list("raw_value").over(window).alias("_frame"),
        F.avg("raw_value").over(window).alias("_mean"), F.stddev_pop("raw_value").over(window).alias("_std"),
    )
    return with_baseline(framed, min_samples=min_samples).select(
        "bucket_at", *keys, "raw_value", "zscore", "robust_z", "percentile",
        F.lit(f"{baseline_days}d").alias("baseline_window"), F.lit(version).alias("metric_version"),
    )


def metrics_with_percentiles(metrics: DataFrame, signals: DataFrame, *, size: str, limit: int = 200) -> DataFrame:
    """The newest metric rows with three of their percentiles."""
    keys = ["bucket_at", "bucket_size", *METRIC_KEYS]
    at = lambda name: F.max(F.when(F.col("metric_name") == name, F.col("percentile")))
    wanted = signals.where(F.col("metric_name").isin("novice_ratio", "fomo_ratio", "post_count"))
    pivoted = wanted.groupBy(*keys).agg(
        at("novice_ratio").alias("novice_percentile"),
        at("fomo_ratio").alias("fomo_percentile"),
        at("post_count").alias("attention_percentile"),
    )
    newest = (
        metrics.where(F.col("bucket_size") == size)
        .orderBy(F.desc("bucket_at"), *[F.asc_nulls_first(k) for k in METRIC_KEYS])
        .limit(limit)
    )
    right = pivoted.select(*[F.col(k).alias(f"_{k}") for k in keys], "novice_percentile", "fomo_percentile", "attention_percentile")
    condition = newest["bucket_at"] == right["_bucket_at"]
    for key in keys[1:]:
        condition = condition & newest[key].eqNullSafe(right[f"_{key}"])
    return newest.join(right, condition, "left").drop(*[f"_{k}" for k in keys])
