"""Traceable post pages, facets and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.timeutil import bucket_seconds, day_start, floor_bucket, shanghai_date, shift
from murmur.operators.analysis import CONTENT_FILTERS, content_filter, effective_by_content, engagement, pick_effective, preferred_analyses
from murmur.operators.ordering import running_total

# How many buckets each named period reaches back.
PERIOD_BUCKETS = {"24h": 1, "7d": 7, "30d": 30}
PERIODS = ("latest", *PERIOD_BUCKETS, "all", "custom")


def period_bounds(latest_at: Column, period: str, size: str, from_at: Column | None = None, to_at: Column | None = None) -> tuple[Column | None, Column]:
    """(start or None, inclusive end). Period units are buckets: with 1h buckets ``24h`` is one hour."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    end = latest_at if to_at is None else to_at
    if from_at is not None:
        return from_at, end
    if period == "latest":
        return floor_bucket(latest_at, size), end
    if period in PERIOD_BUCKETS:
        return F.timestamp_micros(F.unix_micros(end) - PERIOD_BUCKETS[period] * bucket_seconds(size) * 1_000_000), end
    return None, end


def scoped_posts(
    content: DataFrame, content_topic: DataFrame, analysis: DataFrame, *, topic_id: int | None, size: str = "1d",
    period: str = "latest", from_at: Column | None = None, to_at: Column | None = None, active_topics: DataFrame | None = None,
) -> DataFrame:
    """Visible posts of a topic and period, each with its preferred analysis.

    The newest post of any active topic (of any topic at all without
    ``active_topics``, which holds topic_id) sets the clock, as a scalar subquery: it is
    computed once on the cluster and never read back to the driver.
    """
    visible = content.where(~F.col("is_deleted"))
    clocked = content_topic if active_topics is None else content_topic.join(active_topics.select("topic_id"), "topic_id", "left_semi")
    clock_rows = visible if topic_id is None else visible.join(clocked.select("content_id").distinct(), "content_id", "left_semi")
    latest_at = clock_rows.agg(F.max("published_at").alias("latest_at")).scalar()
    start, end = period_bounds(latest_at, period, size, from_at, to_at)
    rows = visible.where(F.col("published_at") <= end)
    if start is not None:
        rows = rows.where(F.col("published_at") >= start)
    if topic_id is not None:
        rows = rows.join(content_topic.where(F.col("topic_id") == topic_id).select("content_id").distinct(), "content_id", "left_semi")
    best = effective_by_content(analysis if topic_id is None else analysis.where(F.col("topic_id").isNull() | (F.col("topic_id") == topic_id)))
    picked = rows.join(best, "content_id", "left").withColumn("analysis", pick_effective(F.lit(topic_id).cast("long")))
    return picked.drop("scoped", "unscoped", "any_scope")


def of_source(posts: DataFrame, name: str = "all") -> DataFrame:
    """One source; an unknown name gives no rows, not an error."""
    return posts if name == "all" else posts.where(F.col("source") == name)


def filter_facets(posts: DataFrame) -> DataFrame:
    """The nine filter counts in one scan."""
    return posts.agg(*[F.coalesce(F.sum(content_filter(f).cast("long")), F.lit(0)).alias(f) for f in CONTENT_FILTERS])


def source_facets(posts: DataFrame) -> DataFrame:
    """Posts per source, before the source filter."""
    return posts.groupBy("source").agg(F.count("*").alias("posts"))


def post_page(posts: DataFrame, *, name: str = "all", limit: int = 30, offset: int = 0, after: tuple[Column, Column] | None = None) -> DataFrame:
    """One page, newest first; a page holds at most 100 posts.

    ``after`` is the (published_at, content_id) of the last post shown: the scan starts
    there and the work does not grow with the pages before. A far ``offset`` belongs to
    ``deep_page``.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be between 1 and 100 and offset not negative")
    rows = posts.where(content_filter(name))
    if after is not None:
        at, content_id = after
        rows = rows.where((F.col("published_at") <= at) & ((F.col("published_at") < at) | (F.col("content_id") < content_id)))
    return _shown(rows.orderBy(F.desc("published_at"), F.desc("content_id")).offset(offset).limit(limit))


def _shown(page: DataFrame) -> DataFrame:
    reference = F.col("kind") == "reference_answer"
    return page.select(
        "*", engagement().alias("engagement_sum"), F.when(reference, "market_session_reference").otherwise("published").alias("time_semantics"),
        F.when(reference, shanghai_date(F.col("published_at"))).alias("reference_date"),
    )


def page_days(posts: DataFrame, *, name: str = "all") -> DataFrame:
    """Posts of every Shanghai day and of the days after it; one row a day, to be kept beside the posts."""
    days = posts.where(content_filter(name) & F.col("published_at").isNotNull()).groupBy(shanghai_date(F.col("published_at")).alias("day")).agg(F.count("*").alias("posts"))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("newer", F.coalesce(F.sum("posts").over(later), F.lit(0)))


def deep_page(posts: DataFrame, days: DataFrame, *, name: str = "all", limit: int = 30, offset: int = 0) -> DataFrame:
    """The page behind ``offset`` posts with a publication time, found through ``page_days``.

    The counts name the days that the page touches, and only these are scanned. Inside
    them positions are taken in parts over ids and times alone, so a day that holds most
    posts is not sorted in one task; whole posts are read for the page only.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be between 1 and 100 and offset not negative")
    touched = days.where((F.col("newer") < offset + limit) & (F.col("newer") + F.col("posts") > offset))
    first, last, newer = (touched.agg(x).scalar() for x in (F.min("day"), F.max("day"), F.min("newer")))
    at = F.col("published_at")
    rows = posts.where(content_filter(name) & (at >= day_start(first)) & (at < shift(day_start(last), 86400)))
    keys = rows.select("content_id", "published_at", (-F.unix_micros(at)).alias("_at"), (-F.col("content_id")).alias("_id"))
    placed = running_total(keys, [], ["_at", "_id"], before="_b", total="_t").withColumn("_place", F.col("_b") + newer)
    wanted = placed.where((F.col("_place") >= offset) & (F.col("_place") < offset + limit)).select("content_id", "published_at")
    return _shown(rows.join(wanted, ["content_id", "published_at"], "left_semi").select(*posts.columns)).orderBy(F.desc("published_at"), F.desc("content_id"))


def topic_series(stats: DataFrame, topic_id: int, limit: int = 500) -> DataFrame:
    """The newest days of one topic."""
    return stats.where(F.col("topic_id") == topic_id).orderBy(F.desc("bucket_at")).limit(limit)


def diffusion_list(diffusion: DataFrame, limit: int = 200) -> DataFrame:
    """The newest diffusions, those without topic or asset first among equals."""
    return diffusion.orderBy(F.desc("started_at"), F.asc_nulls_first("topic_id"), F.asc_nulls_first("asset_id")).limit(limit)


def topic_ranking(content_topic: DataFrame, analysis: DataFrame, name: str = "buy") -> DataFrame:
    """Topics by the posts a filter keeps; only one row per topic is ordered."""
    kept = F.sum(content_filter(name).cast("long")).alias("posts")
    counts = preferred_analyses(content_topic, analysis).groupBy("topic_id").agg(kept)
    ranked = running_total(counts.withColumn("_order", -F.coalesce("posts", F.lit(0))), [], ["_order", "topic_id"], before="_b", total="_t")
    return ranked.select("topic_id", "posts", (F.col("_b") + 1).alias("position"))


def listing(rows: DataFrame, order: list[str]) -> DataFrame:
    """A dimension in listing order; positions are taken in parts."""
    placed = running_total(rows, [], order, before="_b", total="_t")
    return placed.withColumn("position", F.col("_b") + 1).drop("_b", "_t")


def bounded_evidence(posts: DataFrame, *, name: str = "all", limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(evidence rows, total / returned / truncated) for a bundle."""
    wanted = posts.where(content_filter(name))
    rows = wanted.orderBy(F.desc("published_at"), F.desc("content_id")).limit(limit)
    total = wanted.agg(F.count("*").alias("total"))
    return rows, total.select("total", F.least("total", F.lit(limit)).alias("returned"), (F.col("total") > limit).alias("truncated"))


def asset_prices(asset_topic: DataFrame, assets: DataFrame, bars: DataFrame, *, start: Column, end: Column, order: DataFrame | None = None) -> DataFrame:
    """Linked assets per topic with their price history; one bar per instant, largest id wins.

    ``order`` gives the configured position of an asset in a topic; unlisted
    assets follow by link id. A history is one row per trading day.
    """
    window = bars.where((F.col("interval") == "1d") & (F.col("ts") >= start) & (F.col("ts") < end))
    one = window.groupBy("asset_id", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "provider"), "bar_id").alias("b"))
    prices = one.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("ts", "b.open", "b.high", "b.low", "b.close", "b.provider"))).alias("price_history"))
    rows = asset_topic.join(assets, "asset_id").join(prices, "asset_id", "left")
    if order is None:
        rows = rows.withColumn("position", F.lit(None).cast("int"))
    else:
        rows = rows.join(order.select("topic_id", "asset_id", "position"), ["topic_id", "asset_id"], "left")
    rank = Window.partitionBy("topic_id").orderBy(F.asc_nulls_last("position"), "link_id")
    return rows.withColumn("rank", F.row_number().over(rank)).withColumn("is_primary", F.col("rank") == 1).withColumn(
        "has_price_data", F.coalesce(F.size("price_history") > 0, F.lit(False))
    )


def even_sample(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Evenly spaced positions of a ranked list, first and last included; short lists stay whole.

    Positions are ``round(i * (n - 1) / (limit - 1))`` with halves to even.
    """
    placed = running_total(rows, keys, order, before="_b", total="_t")
    if limit <= 1:
        return placed.where((F.col("_t") <= limit) | (F.col("_b") == 0)).drop("_b", "_t")
    step = (F.col("_t") - 1) / (limit - 1)
    near = F.round(F.col("_b") / step).cast("long")
    # The row is taken when one of the neighbouring sample numbers lands on it.
    lands = lambda i: (i >= 0) & (i < limit) & (F.bround(i * (F.col("_t") - 1) / (limit - 1)).cast("long") == F.col("_b"))
    taken = lands(near) | lands(near - 1) | lands(near + 1)
    return placed.where((F.col("_t") <= limit) | taken).drop("_b", "_t")


def round_robin(jobs: DataFrame, group: str, order: str) -> DataFrame:
    """First job of every group, then every second one, and so on.

    The place inside a group comes from parted ordering, so one large group does
    not meet in one task.
    """
    placed = running_total(jobs, [group], [order], before="_b", total="_t")
    return placed.withColumn("turn", F.col("_b") + 1).drop("_b", "_t").orderBy("turn", group)
