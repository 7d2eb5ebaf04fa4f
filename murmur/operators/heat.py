"""Topic and market heat: daily statistics, index, history and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.timeutil import bucket_seconds, floor_bucket
from murmur.operators.analysis import effective_by_content, engagement, is_comment, is_retail, pick_effective
from murmur.operators.metrics import bind, ratio

# Weights of the index parts and the volume at half saturation.
HEAT_WEIGHTS = {
    "retail_share": 0.35,
    "retail_volume": 0.25,
    "intent_expression": 0.20,
    "emotion_activation": 0.15,
    "directional_conviction": 0.05,
}
HALF_SATURATION = 20.0
MIN_HISTORY = 5
# Fixed values: (window, weight, least samples on both sides) of the trend score.
TREND_PARTS = (("day", 0.5, 1), ("week", 0.3, 2), ("month", 0.2, 5))


def _aggregates() -> list[Column]:
    retail = is_retail()
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return [
        count(~is_comment(F.col("kind"))).alias("post_count"),
        count(is_comment(F.col("kind"))).alias("comment_count"),
        F.countDistinct("author_id").alias("unique_author_count"),
        F.sort_array(F.collect_set("source")).alias("source_names"),
        F.sum("_engagement").alias("engagement_sum"),
        count(F.col("analysis").isNotNull()).alias("analyzed_count"),
        count(retail).alias("retail_count"),
        count(retail & (F.col("analysis.investor_level") == "novice")).alias("novice_count"),
        count(retail & (F.col("analysis.intent") == "buy")).alias("buy_intent_count"),
        count(retail & (F.col("analysis.intent") == "sell")).alias("sell_intent_count"),
        count(retail & (F.col("analysis.fomo_flags") >= 3)).alias("fomo_count"),
        count(retail & F.col("analysis.panic")).alias("panic_count"),
    ]


def _with_ratios(stats: DataFrame) -> DataFrame:
    shown = F.col("post_count") + F.col("comment_count")
    retail = F.col("retail_count")
    return stats.select(
        "*", shown.alias("attention"), F.size("source_names").alias("source_count"),
        ratio(F.col("analyzed_count"), shown).alias("analysis_coverage"),
        ratio(retail, shown).alias("retail_ratio"),
        ratio(F.col("novice_count"), shown).alias("novice_ratio"),
        ratio(F.col("buy_intent_count"), retail).alias("buy_intent_ratio"),
        ratio(F.col("sell_intent_count"), retail).alias("sell_intent_ratio"),
        ratio(F.col("fomo_count"), shown).alias("fomo_ratio"),
        ratio(F.col("panic_count"), shown).alias("panic_ratio"),
    )


def _visible(content: DataFrame, size: str) -> DataFrame:
    return content.where(~F.col("is_deleted")).select(
        "content_id", "source", "kind", "author_id", floor_bucket(F.col("published_at"), size).alias("bucket_at"),
        engagement().alias("_engagement"),
    )


def topic_stats(content: DataFrame, content_topic: DataFrame, analysis: DataFrame, *, size: str = "1d") -> DataFrame:
    """Counters and ratios per topic and bucket, over posts that are not deleted."""
    pairs = _visible(content, size).join(content_topic, "content_id")
    rows = pairs.join(effective_by_content(analysis), "content_id", "left").withColumn("analysis", pick_effective(F.col("topic_id")))
    return _with_ratios(rows.groupBy("topic_id", "bucket_at").agg(*_aggregates()))


def market_stats(content: DataFrame, content_topic: DataFrame, analysis: DataFrame, *, size: str = "1d") -> DataFrame:
    """The same per bucket over all topics, each post once, seen through its lowest topic."""
    lowest = content_topic.groupBy("content_id").agg(F.min("topic_id").alias("topic_id"))
    pairs = _visible(content, size).join(lowest, "content_id")
    rows = pairs.join(effective_by_content(analysis), "content_id", "left").withColumn("analysis", pick_effective(F.col("topic_id")))
    return _with_ratios(rows.groupBy("bucket_at").agg(*_aggregates()))


def round1(value: Column) -> Column:
    """One decimal, half up; noise below the sixth place cannot tip a tie."""
    return F.round(F.round(value, 6), 1)


def heat_index() -> Column:
    """0-100 index of one bucket, one decimal; NULL without analysed posts."""
    retail = F.col("retail_count")
    base = F.greatest(retail, F.lit(1))
    parts = {
        "retail_share": F.least(F.lit(1.0), F.try_divide(retail, F.col("attention"))),
        "retail_volume": retail / (retail + HALF_SATURATION),
        "intent_expression": F.least(F.lit(1.0), (F.col("buy_intent_count") + F.col("sell_intent_count")) / base),
        "emotion_activation": F.least(F.lit(1.0), (F.col("fomo_count") + F.col("panic_count")) / base),
        "directional_conviction": F.least(F.lit(1.0), F.abs(F.col("buy_intent_count") - F.col("sell_intent_count")) / base),
    }
    score = None
    for name, weight in HEAT_WEIGHTS.items():
        term = parts[name] * weight
        score = term if score is None else score + term
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score * 100))
    return F.when((F.col("analyzed_count") > 0) & (F.col("attention") > 0), F.round(bounded, 1))


def index_confidence() -> Column:
    """How much the index of a bucket rests on."""
    analyzed, coverage = F.col("analyzed_count"), F.col("analysis_coverage")
    return (
        F.when((analyzed >= 30) & (coverage >= 0.8), "high")
        .when((analyzed >= 10) & (coverage >= 0.5), "medium")
        .when(analyzed > 0, "low")
        .otherwise("insufficient")
    )


def midrank_percentile(prior: Column, current: Column) -> Column:
    """Mid-rank share of earlier values, in percent; needs five of them."""
    below = F.size(F.filter(prior, lambda v: v < current))
    equal = F.size(F.filter(prior, lambda v: v == current))
    n = F.size(prior)
    return F.when(current.isNotNull() & (n >= MIN_HISTORY), F.round((below + equal / 2) / n * 100, 1))


def trend_word(attention: Column, previous: Column) -> Column:
    """Attention against the previous calendar bucket."""
    change = F.try_divide(attention - previous, previous)
    return (
        F.when((attention == 0) & (previous == 0), "no_data")
        .when(previous == 0, "new")
        .when(change >= 0.1, "rising")
        .when(change <= -0.1, "falling")
        .otherwise("stable")
    )


def trend_direction(score: Column) -> Column:
    """Word for the weighted trend score."""
    return (
        F.when(score.isNull(), "insufficient").when(score >= 12, "accelerating").when(score >= 4, "rising")
        .when(score <= -12, "cooling_fast").when(score <= -4, "cooling").otherwise("stable")
    )


def _trend_columns(df: DataFrame) -> DataFrame:
    """Deltas, weighted score over the deltas present, direction and confidence."""

    def delta(current: str, previous: str, least: int) -> Column:
        enough = (F.col(f"{current}_index_days") >= least) & (F.col(f"{previous}_index_days") >= least)
        return F.when(enough, F.round(F.col(f"{current}_index") - F.col(f"{previous}_index"), 1))

    rows = df.select(
        "*",
        F.round(F.col("heat_index") - F.col("previous_heat_index"), 1).alias("day_delta"),
        delta("week", "previous_week", 2).alias("week_delta"),
        delta("month", "previous_month", 5).alias("month_delta"),
    )
    total, weights, present = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, weight, _ in TREND_PARTS:
        value = F.col(f"{name}_delta")
        total = total + F.coalesce(value * weight, F.lit(0.0))
        weights = weights + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
        present = present + value.isNotNull().cast("int")
    rows = rows.withColumn("_score", F.when(present > 0, total / weights)).withColumn("_present", present)
    return rows.select(
        "*", round1(F.col("_score")).alias("trend_score"), trend_direction(F.col("_score")).alias("trend_direction"),
        F.element_at(F.array(*[F.lit(x) for x in ("insufficient", "low", "medium", "high")]), F.col("_present") + 1).alias("trend_confidence"),
    ).drop("_score", "_present")


# First and last offset, in buckets, of the four trailing windows.
TRAILING = {"week": (-6, 0), "previous_week": (-13, -7), "month": (-29, 0), "previous_month": (-59, -30)}


def history(stats: DataFrame, keys: list[str], *, size: str = "1d") -> DataFrame:
    """Index, percentile, trailing windows and trend as of every bucket.

    Rows are one per key and bucket, so a key is as long as the calendar. All
    frames share one partitioning and order, hence one shuffle.
    """
    step = bucket_seconds(size)
    rows = stats.where(F.col("attention") > 0).select(
        "*", heat_index().alias("heat_index"), index_confidence().alias("index_confidence"), F.unix_seconds("bucket_at").alias("_t")
    )
    ordered = Window.partitionBy(*keys).orderBy("_t") if keys else Window.partitionBy(F.lit("market")).orderBy("_t")
    used = F.col("analyzed_count") > 0
    previous = ordered.rangeBetween(-step, -step)
    columns = [
        F.collect_list("heat_index").over(ordered.rangeBetween(-30 * step, -1)).alias("_prior"),
        F.max("heat_index").over(previous).alias("previous_heat_index"),
        F.coalesce(F.max("attention").over(previous), F.lit(0)).alias("previous_attention"),
    ]
    for name, (first, last) in TRAILING.items():
        frame = ordered.rangeBetween(first * step, last * step)
        columns += [
            round1(F.avg(F.when(used, F.col("heat_index"))).over(frame)).alias(f"{name}_index"),
            round1(F.avg(F.when(used, F.col("retail_count"))).over(frame)).alias(f"{name}_retail_average"),
            F.count(F.when(used, 1)).over(frame).alias(f"{name}_days"),
            F.count(F.when(used, F.col("heat_index"))).over(frame).alias(f"{name}_index_days"),
        ]
    framed = rows.select("*", *columns)
    profiled = framed.select(
        "*", midrank_percentile(F.col("_prior"), F.col("heat_index")).alias("historical_percentile"),
        F.size("_prior").alias("baseline_days"),
        F.try_divide(F.col("attention") - F.col("previous_attention"), F.col("previous_attention")).alias("change_ratio"),
        trend_word(F.col("attention"), F.col("previous_attention")).alias("trend"),
    )
    status = (
        F.when(F.col("historical_percentile").isNotNull(), "ready").when(F.col("heat_index").isNotNull(), "warming_up").otherwise("unanalyzed")
    )
    return _trend_columns(profiled.withColumn("heat_status", status)).drop("_prior", "_t")


def overview_at(stats: DataFrame, keys: list[str], spine: DataFrame | None, current: Column, *, size: str = "1d", display_buckets: int = 30) -> DataFrame:
    """One row per key for a chosen bucket, also where that bucket is empty.

    Look-back is at least 89 buckets, and 30 more than the displayed ones; index
    history is restricted to it. Every figure is a conditional aggregate over the
    bucket rows, so one shuffle on the key is enough.
    """
    step = bucket_seconds(size)
    offset = ((F.unix_seconds("bucket_at") - F.unix_seconds(current)) / step).cast("int")
    reach = max(89, display_buckets - 1 + 30)
    rows = stats.where((F.col("attention") > 0) & (offset <= 0) & (offset >= -reach)).select("*", offset.alias("_o"))
    past = history(rows, keys, size=size).select("*")
    used = F.col("analyzed_count") > 0
    shown = F.col("_o") > -display_buckets
    at = lambda o, c: F.max(F.when(F.col("_o") == o, F.col(c)))
    n = lambda cond: F.sum(cond.cast("long"))
    aggregates = [
        at(0, "heat_index").alias("heat_index"), at(-1, "heat_index").alias("previous_heat_index"),
        at(0, "historical_percentile").alias("historical_percentile"),
        F.coalesce(at(0, "index_confidence"), F.lit("insufficient")).alias("index_confidence"),
        F.coalesce(at(0, "baseline_days"), F.lit(0)).alias("current_baseline_days"),
        F.coalesce(at(0, "attention"), F.lit(0)).alias("attention"), F.coalesce(at(-1, "attention"), F.lit(0)).alias("previous_attention"),
        F.coalesce(at(0, "retail_count"), F.lit(0)).alias("retail_count"),
        n(shown).alias("observed_days"), n(shown & used).alias("analyzed_days"),
        n(shown & F.col("heat_index").isNotNull()).alias("index_days"),
        n(shown & F.col("historical_percentile").isNotNull()).alias("percentile_days"),
        n(shown & F.col("heat_index").isNotNull() & F.col("historical_percentile").isNull()).alias("warming_up_days"),
    ]
    for name, (first, last) in TRAILING.items():
        inside = F.col("_o").between(first, last) & used
        aggregates += [
            round1(F.avg(F.when(inside, F.col("heat_index")))).alias(f"{name}_index"),
            round1(F.avg(F.when(inside, F.col("retail_count")))).alias(f"{name}_retail_average"),
            n(inside).alias(f"{name}_days"), n(inside & F.col("heat_index").isNotNull()).alias(f"{name}_index_days"),
        ]
    summary = past.groupBy(*keys).agg(*aggregates)
    if spine is not None:
        summary = spine.join(summary, keys, "left").fillna(0, [c for c in summary.columns if c.endswith("_days") or c in ("attention", "previous_attention", "retail_count")]).fillna("insufficient", ["index_confidence"])
    coverage = (
        F.when(F.col("observed_days") == 0, "empty").when(F.col("percentile_days") == 0, "warming_up")
        .when(F.col("percentile_days") < display_buckets, "partial").otherwise("complete")
    )
    return _trend_columns(
        summary.withColumn("trend", trend_word(F.col("attention"), F.col("previous_attention")))
        .withColumn("coverage_status", coverage)
        .withColumn("missing_days", F.greatest(F.lit(display_buckets) - F.col("observed_days"), F.lit(0)))
    )


def latest_activity(content: DataFrame, content_topic: DataFrame) -> DataFrame:
    """Newest visible post per topic."""
    visible = content.where(~F.col("is_deleted")).select("content_id", "published_at")
    return visible.join(content_topic, "content_id").groupBy("topic_id").agg(F.max("published_at").alias("latest_activity_at"))
