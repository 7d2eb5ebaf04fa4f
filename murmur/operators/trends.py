"""External attention series: page views, their signals and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.timeutil import shanghai_date
from murmur.operators.metrics import array_median, bind


def pageview_series(items: DataFrame, availability: DataFrame, *, first_day: str, last_day: str) -> tuple[DataFrame, DataFrame]:
    """(observations, pending days) of every target over a range of UTC days.

    A published day without a row counts zero views; a day the provider has not
    published yet stays absent and is reported as pending.
    """
    spine = F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day")
    targets = items.select("project", "article").distinct().select("project", "article", spine)
    published = availability.select("project", "day").distinct().withColumn("_published", F.lit(True))
    rows = items.groupBy("project", "article", "day").agg(F.max("views").alias("views"))
    calendar = targets.join(published, ["project", "day"], "left").join(rows, ["project", "article", "day"], "left")
    observed = calendar.where(F.col("_published")).select(
        "project", "article", "day", F.coalesce(F.col("views").cast("double"), F.lit(0.0)).alias("value"),
        F.col("views").isNull().alias("missing_as_zero"),
    )
    pending = calendar.where(F.col("_published").isNull()).select("project", "article", "day")
    return observed, pending


def trend_signals(
    observations: DataFrame, *, since: Column | None = None, until: Column | None = None,
    baseline_days: int = 30, min_samples: int = 14, version: str = "metric-v1",
) -> DataFrame:
    """Change ratio and baseline of each point against earlier points within 30 days.

    Points at the same instant count as earlier when they come first in id
    order. A series is cut into spans as long as the baseline; each point works
    in its own span and serves as past in the next one, so a task holds two
    spans of a series and never its whole history.
    """
    reach = baseline_days * 86400
    rows = observations.select(
        "observation_id", "topic_id", "keyword", "observed_at", F.col("value").cast("double").alias("value"),
        F.unix_seconds("observed_at").alias("_t"),
    )
    own = F.floor(F.col("_t") / reach)
    rows = rows.withColumn("_own", own).withColumn("_span", F.explode(F.array(own, own + 1)))
    window = Window.partitionBy("topic_id", "keyword", "_span").orderBy("_t").rangeBetween(-reach, 0)
    point = F.struct(F.col("_t").alias("t"), F.col("observation_id").alias("id"), F.col("value").alias("v"))
    framed = rows.select("*", F.collect_list(point).over(window).alias("_frame")).where(F.col("_span") == F.col("_own"))
    if since is not None:
        framed = framed.where(F.col("observed_at") >= since)
    if until is not None:
        framed = framed.where(F.col("observed_at") < until)
    earlier = F.filter("_frame", lambda p: (p["t"] < F.col("_t")) | ((p["t"] == F.col("_t")) & (p["id"] < F.col("observation_id"))))

    def stats(points: Column) -> Column:
        current = F.col("value")
        previous = F.array_max(points)["v"]
        n = F.size(points)

        def spread(ordered: Column) -> Column:
            mean = F.aggregate(ordered, F.lit(0.0), lambda a, v: a + v) / n

            def with_mean(m: Column) -> Column:
                std = F.sqrt(F.aggregate(ordered, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n)
                varied = F.get(ordered, F.lit(0)) < F.get(ordered, n - 1)
                return bind(std, lambda s: F.when(varied & (s > 0), (current - m) / s))

            def with_median(med: Column) -> Column:
                mad = array_median(F.sort_array(F.transform(ordered, lambda v: F.abs(v - med))))
                return bind(mad, lambda d: F.when(d > 0, (current - med) / (1.4826 * d)))

            return F.struct(
                bind(mean, with_mean).alias("zscore"), bind(array_median(ordered), with_median).alias("robust_z"),
                ((F.size(F.filter(ordered, lambda v: v <= current)) + 1) / (n + 1)).alias("percentile"),
            )

        return F.struct(
            F.when(previous != 0, (current - previous) / previous).alias("change_ratio"),
            F.when(n >= min_samples, bind(F.sort_array(F.transform(points, lambda p: p["v"])), spread)).alias("signal"),
        )

    return framed.withColumn("_s", bind(earlier, stats)).select(
        "observation_id", "topic_id", "keyword", "observed_at", F.col("value").alias("raw_value"),
        "_s.change_ratio", "_s.signal.zscore", "_s.signal.robust_z", "_s.signal.percentile",
        F.lit(f"{baseline_days}d").alias("baseline_window"), F.lit(version).alias("metric_version"),
    )


def _latest_points(signals: DataFrame) -> DataFrame:
    newest = F.struct("observed_at", "observation_id")
    return (
        signals.where(F.col("topic_id").isNotNull())
        .groupBy("topic_id", "keyword", F.to_date("observed_at").alias("day"))
        .agg(F.max_by(F.struct("raw_value", "percentile", "change_ratio"), newest).alias("p"))
        .select("topic_id", "keyword", "day", "p.*")
    )


def _change(total: Column, order) -> Column:
    previous = F.lag("value").over(order)
    return F.when(previous != 0, (total - previous) / previous)


def topic_attention(signals: DataFrame) -> DataFrame:
    """Per topic and day, the keywords' total, mean percentile and change ratio.

    Keywords per topic come from the registry, so the arrays stay short; the
    window runs on one row per topic and day.
    """
    point = F.struct("keyword", F.col("raw_value").alias("value"), "change_ratio", "percentile")
    days = _latest_points(signals).groupBy("topic_id", "day").agg(
        F.sum("raw_value").alias("value"), F.avg("percentile").alias("percentile"), F.sort_array(F.collect_list(point)).alias("keywords")
    )
    order = Window.partitionBy("topic_id").orderBy("day")
    return days.withColumn("change_ratio", _change(F.col("value"), order)).withColumn(
        "keyword", F.array_join(F.transform("keywords", lambda p: p["keyword"]), " / ")
    )


def market_attention(signals: DataFrame) -> DataFrame:
    """The same over all topics; one row per calendar day enters the window."""
    days = _latest_points(signals).groupBy("day").agg(
        F.sum("raw_value").alias("value"), F.avg("percentile").alias("percentile"),
        F.countDistinct("topic_id").alias("topic_count"), F.count("*").alias("keyword_count"),
    )
    return days.withColumn("change_ratio", _change(F.col("value"), Window.partitionBy(F.lit("market")).orderBy("day")))


def trend_snapshot(observations: DataFrame, signals: DataFrame, *, topic_id: int | None = None, keyword: str | None = None, limit: int = 200, all_topics: bool = False) -> DataFrame:
    """Newest points with their signals; without a topic, only topic-less points."""
    points = observations.select("observation_id", "source", "unit").join(signals, "observation_id")
    if topic_id is not None:
        points = points.where(F.col("topic_id") == topic_id)
    elif not all_topics:
        points = points.where(F.col("topic_id").isNull())
    if keyword:
        points = points.where(F.col("keyword") == keyword)
    return points.orderBy(F.desc("observed_at"), F.desc("observation_id")).limit(limit)


def chart_points(heat: DataFrame, attention: DataFrame, bars: DataFrame) -> DataFrame:
    """Heat, page views and prices of a topic side by side, by Shanghai date."""
    left = heat.select("topic_id", shanghai_date(F.col("bucket_at")).alias("day"), "heat_index", "historical_percentile")
    views = attention.select("topic_id", "day", F.col("value").alias("views"), F.col("percentile").alias("views_percentile"))
    price = bars.where(F.col("close").isNotNull()).select("topic_id", shanghai_date(F.col("ts")).alias("day"), "close")
    return left.join(views, ["topic_id", "day"], "full_outer").join(price, ["topic_id", "day"], "full_outer")


def attention_agreement(external: Column, crowd: Column) -> Column:
    """How the external percentile (0-1) and the crowd percentile (0-100) compare."""
    outside = external * 100
    return (
        F.when(outside.isNull() | crowd.isNull(), "awaiting_both").when((outside >= 80) & (crowd >= 80), "resonance")
        .when((outside >= 80) & (crowd < 50), "external_leads").when((outside < 40) & (crowd >= 70), "crowd_leads").otherwise("in_step")
    )
