"""The evidence bundle: every file against the reads it is made of."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import reads as rd
from murmur.plans.bundle import evidence_bundle
from tests.test_metrics import ANALYSIS, CONTENT, post, row


@pytest.fixture(scope="module")
def tables(spark, at):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    moments = [at("2026-07-01T02:00:00") - timedelta(hours=7 * i) for i in range(12)]
    return {
        "content": make([post(i, m, i) for i, m in enumerate(moments)], CONTENT).withColumn("body", F.repeat(F.lit("x"), F.col("content_id").cast("int"))),
        "content_topic": make([(i, 1 if i % 4 else 2) for i in range(12)], "content_id long, topic_id long"),
        "content_analysis": make([row(1, 0, emotion=(True, True, True, False, False, False))], ANALYSIS),
        "topic": make([(1, "active"), (2, "active")], "topic_id long, status string"),
        "trend_observation": make([(i, "s", "n") for i in range(4)], "observation_id long, source string, unit string"),
        "trend_signal": make([(i, 1 + i % 2, "k", at("2026-06-29T00:00:00") + timedelta(days=i - 1), 5.0, 0.5, None) for i in range(4)], "observation_id long, topic_id long, keyword string, observed_at timestamp, raw_value double, percentile double, change_ratio double"),
        "asset_topic": make([(1, 5, 1)], "link_id long, asset_id long, topic_id long"), "asset": make([(5, "S")], "asset_id long, symbol string"),
        "market_bar": make([(1, 5, "1d", at("2026-07-01T01:30:00"), 1.0, 1.0, 1.0, 1.0, "p")], "bar_id long, asset_id long, interval string, ts timestamp, open double, high double, low double, close double, provider string"),
        "collection_task": make([], "source string, topic_id long, window_start timestamp, window_end timestamp, status string, next_retry_at timestamp"),
        "source": make([("s", True, "degraded"), ("t", True, "healthy"), ("u", False, "degraded"), ("v", True, None)], "source string, enabled boolean, health_status string"),
        "raw_observation": make([("s", at("2026-07-01"))], "source string, observed_at timestamp"),
        "signal_event": make([(f"e{i}", 1 + i % 2, at("2026-06-29T00:00:00") + timedelta(days=i)) for i in range(3)], "event_key string, topic_id long, started_at timestamp"),
        "event_metric_link": make([("e0", at("2026-06-29"), "m", 1.0, 2.0, 3.0, 0.9)], "event_key string, bucket_at timestamp, metric_name string, raw_value double, zscore double, robust_z double, percentile double"),
        "event_return": make([("e2", 5, "1d", 0.1, 0.0, 0.1)], "event_key string, asset_id long, horizon string, raw_return double, market_return double, market_abnormal_return double"),
    }


def test_every_file_of_a_topic(spark, tables, tmp_path):
    got = evidence_bundle(spark, tables, str(tmp_path), first=date(2026, 6, 29), last=date(2026, 7, 1), topic_id=1, expected_sources=["s"], post_limit=4, max_body=3)
    read = lambda part: [r.asDict(recursive=True) for r in spark.read.json(str(tmp_path / part)).collect()]
    # By hand: the range begins 58 hours before post 0, so posts 1, 2, 3, 5, 6, 7 of the topic lie in it, the newest four are kept.
    posts = {r["content_id"]: r for r in read("posts")}
    assert set(posts) == {1, 2, 3, 5} and posts[5]["body"] == "xxx" and posts[5]["body_cut"] and not posts[3]["body_cut"]
    meta = read("meta")[0]
    assert (meta["total"], meta["returned"], meta["truncated"], meta["first_day"], meta["topic_id"]) == (6, 4, True, "2026-06-29", 1)
    assert {r["observation_id"] for r in read("attention")} == {2}
    events = {r["event_key"]: r for r in read("events")}
    assert set(events) == {"e0", "e2"} and events["e0"]["metrics"][0]["raw_value"] == 1.0 and events["e2"]["returns"][0]["raw_return"] == 0.1
    assert {r["source"]: r["content_count"] for r in read("source_status")}.keys() == {"s", "t", "u", "v"}
    assert {r["topic_id"] for r in read("overview/topics")} == {1} and len(read("overview/coverage")) == 1
    assert all((tmp_path / "overview" / p).exists() for p in ("market", "attention", "market_attention", "prices", "sources"))
    day = read("overview/coverage")[0]
    want = [f"{day['analysis_pending_count']} posts of the last day still wait for analysis"] if day["analysis_pending_count"] else []
    want += [f"collection of the last day is {day['collection_status']}", "source is not healthy: s", "evidence holds 4 of 6 posts"]
    assert got == want and [r["warning"] for r in read("warnings")] == want


def test_an_empty_range_of_all_topics(spark, tables, tmp_path):
    got = evidence_bundle(spark, tables, str(tmp_path), first=date(2020, 1, 1), last=date(2020, 1, 2), expected_sources=["s"])
    assert "source is not healthy: s" in got and not any("evidence" in w for w in got)
    assert spark.read.json(str(tmp_path / "meta")).first().total == 0 and spark.read.text(str(tmp_path / "posts")).count() == 0
    with pytest.raises(ValueError):
        evidence_bundle(spark, tables, str(tmp_path / "c"), first=date(2026, 7, 2), last=date(2026, 7, 1), expected_sources=["s"])


def test_deep_pages_are_slices_of_the_whole_order(spark, at):
    base = at("2026-03-01T00:00:00")
    rows = [(i, base + timedelta(hours=(i * 7) % 300 if i % 3 else 5), "post", i, None, None, None, None) for i in range(600)]
    posts = spark.createDataFrame(rows, "content_id long, published_at timestamp, kind string, likes long, favorites long, comments long, shares long, views long")
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    days = rd.page_days(posts)
    assert days.agg(F.sum("posts")).first()[0] == 600
    for offset in (0, 95, 371, 590, 600, 5000):
        assert [r.content_id for r in rd.deep_page(posts, days, limit=40, offset=offset).collect()] == order[offset : offset + 40], offset
    seen, after = [], None
    for _ in range(8):
        page = rd.post_page(posts, limit=90, after=after).collect()
        seen += [r.content_id for r in page]
        if page:
            after = (F.lit(page[-1].published_at), F.lit(page[-1].content_id))
    assert seen == order
    cursor = (F.lit(base).cast("timestamp"), F.lit(3))
    plan = rd.post_page(posts, limit=10, after=cursor)._jdf.queryExecution().optimizedPlan().toString()
    assert "published_at" in plan.split("Filter", 1)[1]
