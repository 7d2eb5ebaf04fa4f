"""Merged events, diffusion, the trading calendar, bars and returns."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from murmur.functions import timeutil as tu
from murmur.operators import events as ev
from murmur.operators import market as mk

SIGNAL = "bucket_at timestamp, bucket_size string, source string, topic_id long, asset_id long, metric_name string, raw_value double, zscore double, robust_z double, percentile double"


def signal(at, day, source="s", z=4.0, name="post_count", size="1d"):
    return (at(day), size, source, 1, None, name, 10.0 + z, 1.0, z, 0.99)


def test_contiguous_days_are_one_event(spark, at):
    rows = [signal(at, "2026-07-01"), signal(at, "2026-07-02", z=6.0), signal(at, "2026-07-03"), signal(at, "2026-07-05"), signal(at, "2026-07-06", z=2.9)]
    events, links = ev.detect_events(spark.createDataFrame(rows, SIGNAL))
    got = events.orderBy("started_at").collect()
    assert len(got) == 2 and got[0].ended_at - got[0].started_at == timedelta(days=2)
    assert got[0].peaked_at == at("2026-07-02").replace(tzinfo=None) and links.count() == 4


def test_both_attention_metrics_share_an_event_and_the_cut_is_a_utc_day(spark, at):
    rows = [signal(at, "2026-07-01"), signal(at, "2026-07-01", name="unique_author_count"), signal(at, "2026-07-02", name="engagement"), signal(at, "2026-07-03T16:00:00")]
    frame = spark.createDataFrame(rows, SIGNAL)
    assert ev.detect_events(frame)[0].count() == 2
    assert ev.detect_events(frame, event_date="2026-07-02")[0].count() == 1


def test_diffusion_compares_with_the_previous_event(spark, at):
    def event(key, source, start, end):
        return ("attention_spike", source, 1, None, key, at(start), at(start), at(end))

    schema = "event_type string, source string, topic_id long, asset_id long, event_key string, started_at timestamp, peaked_at timestamp, ended_at timestamp"
    rows = [event("a", "x", "2026-07-01", "2026-07-10"), event("b", "y", "2026-07-02", "2026-07-02"), event("c", "z", "2026-07-05", "2026-07-05")]
    got = ev.detect_diffusion(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and [s.source for s in got[0].source_sequence] == ["x", "y"]
    assert got[0].platform_count == 2 and got[0].velocity == pytest.approx(2 / 9)


@pytest.mark.parametrize(
    "signal_at, entry",
    [
        ("2024-07-01T01:00:00", "2024-07-01T01:30:00"), ("2024-07-01T02:00:00", "2024-07-02T01:30:00"), ("2024-07-01T04:00:00", "2024-07-02T01:30:00"),
        ("2024-07-06T04:00:00", "2024-07-08T01:30:00"), ("2024-09-30T08:00:00", "2024-10-08T01:30:00"),
    ],
)
def test_entries_never_look_back(spark, at, signal_at, entry):
    sessions = tu.trading_sessions(spark, "2024-06-01", "2024-11-01")
    got = tu.next_safe_entry(spark.createDataFrame([(at(signal_at),)], "signal_at timestamp"), sessions).first()
    assert got.entry_at == at(entry).replace(tzinfo=None)


def test_bar_of_today_is_kept_only_after_the_close(spark, at):
    bar = spark.createDataFrame([("CN", "Asia/Shanghai", at("2026-07-01T01:30:00"))], "market string, timezone string, ts timestamp")
    kept = lambda moment: mk.closed_bars(bar, F.lit(moment).cast("timestamp")).count()
    assert kept("2026-07-01 02:00:00") == 0 and kept("2026-07-01 07:01:00") == 1


def test_next_bar_matches_brute_force(spark):
    import random

    random.seed(3)
    first = datetime(2024, 1, 1, tzinfo=timezone.utc)
    bars = [(a, first + timedelta(days=d, minutes=random.choice([0, 90, 600]))) for a in (1, 2) for d in range(60) if random.random() < 0.6]
    signals = [(i, random.choice((1, 2)), first + timedelta(minutes=random.randrange(-3000, 90000))) for i in range(400)] + [(1000 + i, a, t) for i, (a, t) in enumerate(bars)]
    got = mk.next_bar(spark.createDataFrame(signals, "id long, asset_id long, signal_at timestamp"), spark.createDataFrame(bars, "asset_id long, ts timestamp"))
    found = {r.id: r.bar.ts.replace(tzinfo=timezone.utc) for r in got.collect()}
    for i, asset, moment in signals:
        later = [t for a, t in bars if a == asset and t > moment]
        assert found.get(i) == (min(later) if later else None)


def test_returns_count_bars_and_need_exact_benchmarks(spark, at):
    def day(n):
        return datetime(2024, 1, n, 1, 30, tzinfo=timezone.utc)

    bars = [(2, day(n), 10.0 + n, 11.0 + n) for n in (2, 3, 4, 5)] + [(1, day(n), 100.0, 100.0 + n) for n in (2, 3, 5)]
    frame = spark.createDataFrame(bars, "asset_id long, ts timestamp, open double, close double")
    assets = spark.createDataFrame([(1, None, None), (2, 1, None)], "asset_id long, benchmark_asset_id long, sector_benchmark_asset_id long")
    got = {(r.entry_at.day, r.horizon): r for r in mk.bar_horizons(frame, assets).where("asset_id = 2").collect()}
    assert got[(2, "1d")].raw_return == pytest.approx(13 / 12 - 1) and got[(2, "1d")].market_return == pytest.approx(0.02)
    assert got[(2, "3d")].exit_at.day == 4 and got[(2, "3d")].market_return is None and got[(2, "5d")].raw_return is None


def test_daily_buckets_are_shanghai_days(spark, at):
    df = spark.createDataFrame([(at("2026-07-01T15:59:00"),), (at("2026-07-01T16:00:00"),)], "t timestamp").select(tu.floor_bucket(F.col("t"), "1d").alias("b"))
    assert [r.b for r in df.collect()] == [at("2026-06-30T16:00:00").replace(tzinfo=None), at("2026-07-01T16:00:00").replace(tzinfo=None)]


def test_bounds_and_question_dates(spark):
    row = spark.range(1).select(
        tu.collection_bound(F.lit("2026-07-01")).cast("string"), tu.collection_bound(F.lit("2026-07-01"), end=True).cast("string"),
        tu.question_session_date(F.lit("如何看待2026年7月3日A股市场行情走势？"), F.lit("2025-01-01").cast("timestamp")),
        tu.question_session_date(F.lit("如何看待7月3日A股市场"), F.lit("2025-01-01").cast("timestamp")),
    ).first()
    assert list(row) == ["2026-06-30 16:00:00", "2026-07-01 16:00:00", date(2026, 7, 3), date(2025, 7, 3)]


def test_details_hold_posts_versions_and_analyses(spark, at):
    events = spark.createDataFrame([("e1",), ("e2",), ("none",)], "event_key string")
    chosen = spark.createDataFrame([("e1", 2, 1), ("e1", 1, 2), ("e2", 1, 1), ("e2", 3, 2)], "event_key string, content_id long, position int")
    content = spark.createDataFrame([(i, "s", f"p{i}", f"body {i}") for i in range(1, 5)], "content_id long, source string, source_item_id string, body string")
    raw = spark.createDataFrame(
        [(10, "s", "p1", "a"), (11, "s", "p1", None), (12, "other", "p1", "c"), (13, "s", "p2", "d"), (14, "s", "p4", "e")],
        "raw_id long, source string, source_item_id string, payload string",
    )
    analysis = spark.createDataFrame(
        [(1, 1, None, "rule-based-v0", "x", "buy"), (2, 1, 7, "m-via-openai-compatible", "evidence-content-review-v3:h", "sell"), (3, 1, 8, "other", None, "hold"), (4, 2, None, None, None, "wait"), (5, 4, None, "other", "x", "buy")],
        "analysis_id long, content_id long, topic_id long, model string, prompt_version string, intent string",
    )
    got = {r.event_key: r.raw_drilldown for r in ev.event_details(events, chosen, content, raw, analysis).collect()}
    assert [(p.position, p.content.content_id, p.content.body) for p in got["e1"]] == [(1, 2, "body 2"), (2, 1, "body 1")] and got["none"] == []
    first = got["e2"][0]
    assert first.analysis.analysis_id == 2 and [a.analysis_id for a in first.analyses] == [3, 2, 1] and first.analyses[1].intent == "sell"
    assert [(r.raw_id, r.payload) for r in first.raw_observations] == [(11, None), (10, "a")] and first == got["e1"][1].__class__(1, *got["e1"][1][1:])
    bare = got["e2"][1]
    assert bare.content.content_id == 3 and bare.analysis is None and bare.analyses == [] and bare.raw_observations == []
    posts, versions, analyses = ev.event_histories(chosen, content, raw, analysis)
    assert (posts.count(), versions.count(), analyses.count()) == (3, 3, 4)


def test_histories_are_cut_before_they_are_shuffled(spark, tmp_path):
    chosen = spark.createDataFrame([("e1", 2, 1)], "event_key string, content_id long, position int")
    content = spark.range(2000).select(F.col("id").alias("content_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("source_item_id"))
    raw = spark.range(4000).select(F.col("id").alias("raw_id"), F.lit("s").alias("source"), (F.col("id") % 2000).cast("string").alias("source_item_id"))
    analysis = spark.range(4000).select(F.col("id").alias("analysis_id"), (F.col("id") % 2000).alias("content_id"))
    for rows, count in zip(ev.event_histories(chosen, content, raw, analysis)[1:], (2, 2)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert rows.count() == count
