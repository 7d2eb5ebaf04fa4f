"""The daily index, its percentile and its trend."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from murmur.operators import heat as ht

STATS = (
    "topic_id long, bucket_at timestamp, attention long, analyzed_count long, retail_count long, buy_intent_count long, sell_intent_count long, fomo_count long, panic_count long, analysis_coverage double"
)


def stats(spark, counts):
    first = datetime(2026, 1, 1, 16, tzinfo=timezone.utc)
    return spark.createDataFrame([(1, first + timedelta(days=i), c, c, c, 0, 0, 0, 0, 1.0) for i, c in enumerate(counts) if c], STATS)


def test_index_of_one_expressive_post(spark, at):
    row = spark.createDataFrame([(1, at("2026-07-01"), 2, 1, 1, 1, 0, 1, 0, 0.5)], STATS).select(ht.heat_index().alias("h"), ht.index_confidence().alias("c")).first()
    assert (row.h, row.c) == (58.7, "low")


def test_index_is_null_without_analysed_posts(spark, at):
    assert spark.createDataFrame([(1, at("2026-07-01"), 2, 0, 0, 0, 0, 0, 0, 0.0)], STATS).select(ht.heat_index()).first()[0] is None


def test_ninety_day_history(spark):
    counts = [100] * 30 + [10] * 30 + list(range(20, 50))
    got = ht.history(stats(spark, counts), ["topic_id"]).orderBy(F.desc("bucket_at")).first()
    assert (got.heat_index, got.historical_percentile, got.trend_direction, got.trend_confidence) == (52.8, 100.0, "stable", "high")


def test_percentile_needs_five_earlier_days(spark):
    rows = ht.history(stats(spark, [1, 2, 3, 4, 5, 6]), ["topic_id"]).orderBy("bucket_at").collect()
    assert [r.historical_percentile is None for r in rows] == [True] * 5 + [False]
    assert rows[0].trend == "new" and rows[1].trend == "rising"


def test_previous_bucket_is_the_calendar_one(spark):
    rows = ht.history(stats(spark, [4, None, 4]), ["topic_id"]).orderBy("bucket_at").collect()
    assert rows[1].previous_attention == 0 and rows[1].trend == "new" and rows[1].day_delta is None


def test_overview_names_topics_without_posts(spark, at):
    counts = [100] * 30 + [10] * 30 + list(range(20, 50))
    spine = spark.createDataFrame([(1,), (2,)], "topic_id long")
    current = F.lit("2026-03-31 16:00:00").cast("timestamp")
    got = {r.topic_id: r for r in ht.overview_at(stats(spark, counts), ["topic_id"], spine, current).collect()}
    assert got[1].heat_index == 52.8 and got[1].historical_percentile == 100.0 and got[1].coverage_status == "complete"
    assert got[2].coverage_status == "empty" and got[2].trend == "no_data" and got[2].missing_days == 30 and got[2].index_confidence == "insufficient"
