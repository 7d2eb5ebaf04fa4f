"""The whole chain on a small store, and the jobs around it."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from murmur.operators import rebuild as rb
from murmur.plans import pipeline as pp
from murmur.sources import bars as br
from murmur.sources.raw import RAW_SCHEMA


def build(spark, folder, at):
    import hashlib

    store, rows, links, raw_id = pp.Store(spark, str(folder)), [], [], 0
    start = at("2026-03-01T02:00:00")
    for day in range(24):
        for i in range(40 if day == 23 else 2 + day % 3):
            raw_id += 1
            moment = start + timedelta(days=day, minutes=i)
            payload = {"title": f"黄金 股票 {day}", "body": f"现在上车 {day} {i} {hashlib.md5(str(raw_id).encode()).hexdigest()}", "author_id": i, "timestamp_semantics": "published", "likes": i}
            text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            rows.append((raw_id, "guba", f"p{raw_id}", "forum_post", moment, moment, moment, text, hashlib.sha256(text.encode()).hexdigest()))
            links.append((raw_id, 1, "gold"))
    rows.append((999, "zhihu", "z1", "zhihu_answer_snapshot", None, start, start, '{"title":"x"}', "h"))
    store.write("raw_observation", spark.createDataFrame(rows, RAW_SCHEMA))
    store.write("raw_observation_topic", spark.createDataFrame(links, "raw_id long, topic_id long, collection_query string"))
    store.write("topic", spark.createDataFrame([(1, "gold", "active"), (2, "off", "paused")], "topic_id long, slug string, status string"))
    store.write("topic_term", spark.createDataFrame([(1, "黄金"), (2, "现在")], "topic_id long, term string"))
    store.write("asset", spark.createDataFrame([(1, "CN", "000300", "index", "Asia/Shanghai", None, None), (2, "CN", "518880", "etf", "Asia/Shanghai", 1, None)], "asset_id long, market string, symbol string, asset_type string, timezone string, benchmark_asset_id long, sector_benchmark_asset_id long"))
    store.write("asset_alias", spark.createDataFrame([("黄金ETF", 2, 10)], "alias string, asset_id long, priority int"))
    store.write("asset_topic", spark.createDataFrame([(1, 2, 1)], "link_id long, asset_id long, topic_id long"))
    store.write("source", spark.createDataFrame([("guba", "content", "healthy")], "source string, source_type string, health_status string"))
    bars = [(a, at("2026-03-20T01:30:00") + timedelta(days=d), 10.0 + d, 11.0 + d) for a in (1, 2) for d in range(12)]
    store.write("market_bar", spark.createDataFrame(bars, "asset_id long, ts timestamp, open double, close double"))
    return store


def test_core_chain_and_repairs(spark, tmp_path, at):
    store = build(spark, tmp_path / "store", at)
    out = pp.run_core(store, secret="k", bucket_sizes=("1d",))
    assert out["content"].where("kind = 'forum_post'").count() == out["content"].count() == store.read("raw_observation").count() - 1
    events = out["signal_event"].where("event_type = 'attention_spike'").collect()
    assert len(events) == 1 and events[0].topic_id == 1 and events[0].peak_value == 40.0
    returns = {r.horizon: r for r in out["event_return"].where(F.col("event_key") == events[0].event_key).collect()}
    assert set(returns) == {"1d", "3d", "5d", "10d", "20d"} and returns["1d"].raw_return is not None and returns["20d"].raw_return is None
    assert out["content_analysis"].select("intent").distinct().first().intent == "buy"
    signals = out["metric_signal"].count()
    again, counts = pp.rebuild(store, secret="k", bucket_sizes=("1d",))
    assert again["metric_signal"].count() == signals and counts.agg(F.sum("removed")).first()[0] == 0
    tables = {name: store.read(name) for name in ("content", "content_entity", "platform_metric", "metric_signal", "signal_event", "event_metric_link", "event_return", "diffusion_event", "trend_observation", "trend_signal", "asset_topic")}
    cut = F.lit("2026-03-10").cast("timestamp")
    kept, counts = rb.clear_topic_history(tables, [1], cut)
    removed = {r.table: r.removed for r in counts.collect()}
    assert removed["platform_metric"] == 10 and removed["metric_signal"] == 90 and removed["signal_event"] == 0
    assert kept["platform_metric"].where(F.col("bucket_at") < cut).count() == 0 and kept["content"].count() == tables["content"].count()
    _, counts = rb.reset_derivatives(tables)
    assert {r.table: r.removed for r in counts.collect()}["signal_event"] == tables["signal_event"].count()


def same_tables(left, right, but=()):
    """Whether two stores hold equal rows in every table of the chain, doubles to nine places."""
    for name in pp.CORE_TABLES:
        if name in but:
            continue
        one, other = left.read(name), right.read(name)
        doubles = {f.name for f in one.schema.fields if f.dataType.simpleString() == "double"}
        flat = lambda df: df.select(*[F.round(c, 9).alias(c) if c in doubles else F.col(c) for c in sorted(one.columns)])  # noqa: B023, E731
        one, other = flat(one).collect(), flat(other).collect()
        assert sorted(map(repr, one)) == sorted(map(repr, other)), name


def edited(spark, raw):
    """A later version of an early post: more likes, so its day changes."""
    row = raw.where("raw_id = 5").first().asDict()
    payload = {**json.loads(row["payload"]), "likes": 900}
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    later = {**row, "raw_id": 2001, "payload": text, "payload_hash": "edited", "observed_at": row["observed_at"] + timedelta(days=40), "collected_at": row["collected_at"] + timedelta(days=40)}
    return spark.createDataFrame([tuple(later[c] for c in raw.columns)], raw.schema)


def test_growing_runs_equal_one_full_run_and_touch_only_days_they_reach(spark, tmp_path, at):
    whole, grown = build(spark, tmp_path / "whole", at), build(spark, tmp_path / "grown", at)
    raw = whole.read("raw_observation")
    whole.append("raw_observation", edited(spark, raw))
    grown.write("raw_observation", raw.where("raw_id <= 30"))
    pp.run_core(grown, secret="k", bucket_sizes=("1d",))
    grown.append("raw_observation", raw.where("raw_id > 30"))
    pp.run_core(grown, secret="k", bucket_sizes=("1d",))
    before = pp.Run(grown)
    grown.append("raw_observation", edited(spark, raw))
    pp.run_core(grown, secret="k", bucket_sizes=("1d",))
    after = pp.Run(grown)
    for name, reach in (("platform_metric", 0), ("metric_signal", 30)):
        old, new = before.folders(name), after.folders(name)
        moved = {p for p in new if new[p] != old.get(p)}
        day = after.read("content").where("content_id = 5").select(pp._bucket_part("1d", pp.floor_bucket(F.col("published_at"), "1d"))).first()[0]
        assert day in moved and moved == set(new) & {*pp._shifted([day], 0, reach)} and (reach or len(moved) == 1 < len(new))
    # A run without anything new changes no sum and no signal.
    pp.run_core(grown, secret="k", bucket_sizes=("1d",))
    assert all(pp.Run(grown).folders(name) == after.folders(name) for name in ("content", "platform_metric", "metric_signal"))
    pp.run_core(whole, secret="k", bucket_sizes=("1d",))
    # The edited post was analysed before and after its edit; every other table is the same.
    same_tables(grown, whole, but=("content_analysis",))
    kept = lambda store: sorted(map(repr, store.read("content_analysis").drop("analysis_id").where("content_id <> 5").collect()))
    assert kept(grown) == kept(whole) and grown.read("content_analysis").where("content_id = 5").count() == 2
    files = pp.Run(grown).read("platform_metric", [day]).inputFiles()
    assert files and all(f"{pp.PART}={day}" in f or "/columns/" in f for f in files)


def test_a_run_stopped_anywhere_leaves_no_trace_and_loses_nothing(spark, tmp_path, at, monkeypatch):
    whole, broken = build(spark, tmp_path / "whole", at), build(spark, tmp_path / "broken", at)
    pp.run_core(whole, secret="k", bucket_sizes=("1d",))
    state = broken.folders()

    def stopping(name, real):
        def write(self, table, *args, **kwargs):
            out = real(self, table, *args, **kwargs)
            if table == name:
                raise KeyboardInterrupt(name)
            return out

        return write

    for name in ("content", "content_entity", "content_analysis", "platform_metric", "event_return"):
        with monkeypatch.context() as patch:
            for method in ("write", "append", "write_parts"):
                patch.setattr(pp.Run, method, stopping(name, getattr(pp.Run, method)))
            with pytest.raises(KeyboardInterrupt):
                pp.run_core(broken, secret="k", bucket_sizes=("1d",))
        assert broken.folders() == state and broken.stored("content") is None
    with monkeypatch.context() as patch:
        patch.setattr(pp.Store, "commit", lambda self, changes: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            pp.run_core(broken, secret="k", bucket_sizes=("1d",))
    assert broken.folders() == state
    pp.run_core(broken, secret="k", bucket_sizes=("1d",))
    assert broken.read("content_entity").count() > 0 and broken.read("content_cluster_member").count() > 0
    same_tables(broken, whole)


def test_later_runs_equal_one_full_run_and_keep_analyses(spark, tmp_path, at):
    whole, grown = build(spark, tmp_path / "whole", at), build(spark, tmp_path / "grown", at)
    raw = whole.read("raw_observation")
    grown.write("raw_observation", raw.where("raw_id <= 30"))
    pp.run_core(grown, secret="k", bucket_sizes=("1d",))
    reviewed = grown.read("content_analysis").where("content_id = 1").limit(1)
    better = reviewed.withColumns({"analysis_id": F.lit(5000).cast("long"), "model": F.lit("reviewed"), "intent": F.lit("sell")})
    grown.append("content_analysis", spark.createDataFrame(better.collect(), better.schema))
    grown.write("raw_observation", raw)
    second = pp.run_core(grown, secret="k", bucket_sizes=("1d",))
    once = pp.run_core(whole, secret="k", bucket_sizes=("1d",))
    for name, columns in (("content", "*"), ("content_entity", "*"), ("trend_observation", "*"), ("platform_metric", "bucket_at, source, topic_id, post_count, engagement_sum")):
        left, right = (t[name].selectExpr(*(columns.split(", ") if columns != "*" else once[name].columns)) for t in (second, once))
        assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0, name
    kept = second["content_analysis"]
    assert [r.intent for r in kept.where("analysis_id = 5000").collect()] == ["sell"]
    assert kept.count() == once["content_analysis"].count() + 1 and kept.select("analysis_id").distinct().count() == kept.count()
    bad = second["content"].limit(1).withColumns({"content_id": F.lit(777).cast("long"), "source": F.lit("zhihu"), "source_item_id": F.lit("z1")})
    grown.append("content", spark.createDataFrame(bad.collect(), bad.schema))
    again, counts = pp.rebuild(grown, secret="k", bucket_sizes=("1d",))
    assert {r.table: r.removed for r in counts.collect()}["content"] == 1 and again["content"].where("content_id = 777").count() == 0
    assert again["content_analysis"].where("analysis_id = 5000").count() == 1


def test_market_sync_isolates_broken_assets(spark, at):
    def landed(asset, *lines):
        return (asset, "CN", "stock", "Asia/Shanghai", json.dumps({"data": {"klines": list(lines)}}))

    rows = [landed(1, "2026-07-01,1,2,3,1,5,5", "2026-07-02,1,2,3,1,5,5"), landed(2, "2026-07-01,1,2,3,1,5,5", "2026-07-02,1,900,3,1,5,5")]
    frame = spark.createDataFrame(rows, "asset_id long, market string, asset_type string, timezone string, response string")
    stored = spark.createDataFrame([(1, at("2026-07-01T01:30:00"), "1d", "eastmoney")], "asset_id long, ts timestamp, interval string, provider string")
    new, bad = pp.sync_market([(frame, br.delimited_bars)], stored, None, as_of=F.lit("2026-07-02 08:00:00").cast("timestamp"))
    assert [(r.asset_id, r.ts.day) for r in new.collect()] == [(1, 2)] and [r.asset_id for r in bad.collect()] == [2]


def test_review_job(spark):
    contract = {
        "actor": {"type": "retail", "confidence": 0.9}, "investor": {"level": "unknown", "confidence": 0.5}, "novice_signals": [], "direction": {"value": "bullish", "confidence": 0.5}, "intent": {"value": "buy", "confidence": 0.5},
        "position": {"value": "owned", "confidence": 0.5}, "emotion": {}, "spam": {"value": False, "confidence": 0.0}, "intent_basis": "explicit_self_executed", "rationale": "ok",
    }
    answer = json.dumps({"items": [{**contract, "id": 1, "intent_evidence": "买了"}, {**contract, "id": 2, "intent_evidence": "nowhere"}, {**contract, "id": 3, "mood": 1}]}, ensure_ascii=False)
    posts = spark.createDataFrame([(1, "我买了一点"), (2, "text"), (3, "t")], "content_id long, source_text string")
    done, invalid, unreadable = pp.review_results(spark.createDataFrame([(answer,), ("no",)], "answer string"), posts)
    assert {r.content_id: (r.intent, r.degraded) for r in done.collect()} == {1: ("buy", False), 2: ("unknown", True)}
    assert invalid.count() == 1 and unreadable.count() == 1


def test_archive_job(spark, at):
    content = spark.createDataFrame([(1, "http://a", at("2026-07-01"), ""), (2, "http://b", at("2026-07-01"), "x" * 100), (3, "http://c", at("2026-07-01"), "")], "content_id long, url string, published_at timestamp, body string")
    state = spark.createDataFrame([], "content_id long, last_crawl_id string, status string, next_retry_at timestamp")
    captures = spark.createDataFrame([("http://a", at("2026-07-02")), ("http://b", at("2026-07-02"))], "url string, captured_at timestamp")
    pages = spark.createDataFrame([("http://a", "<p>archived"), ("http://b", "<p>other")], "url string, html string")
    t = lambda v: F.lit(v).cast("timestamp")
    filled, states = pp.enrich_from_archive(content, state, captures, pages, crawl_id="c", since=t("2026-06-01"), until=t("2026-08-01"), now=t("2026-08-01"), limit=10)
    assert {r.content_id: r.body for r in filled.collect()} == {1: "archived", 2: "x" * 100, 3: ""}
    assert {r.content_id: r.status for r in states.collect()} == {1: "complete", 2: "complete", 3: "no_capture"}


def test_bundle(spark, tmp_path):
    day = spark.createDataFrame([(3, "partial")], "analysis_pending_count long, collection_status string")
    sources = spark.createDataFrame([("a", True, "degraded"), ("b", False, "degraded")], "source string, enabled boolean, health_status string")
    evidence = spark.createDataFrame([(9, 5, True)], "total long, returned long, truncated boolean")
    warnings = pp.bundle_warnings(day, sources, evidence)
    pp.write_bundle({"warnings": warnings, "sources": sources}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "warnings")).count() == 4


def test_overview_of_a_day(spark, at):
    from datetime import date

    from murmur.plans.overview import topic_overview
    from tests.test_metrics import ANALYSIS, CONTENT, post, row

    moments = [at("2026-07-01T02:00:00"), at("2026-07-01T03:00:00"), at("2026-06-30T02:00:00")]
    tables = {
        "content": spark.createDataFrame([post(i, m, i) for i, m in enumerate(moments)], CONTENT), "content_topic": spark.createDataFrame([(0, 1), (1, 1), (2, 1), (0, 3)], "content_id long, topic_id long"),
        "content_analysis": spark.createDataFrame([row(1, 0, emotion=(True, True, True, False, False, False))], ANALYSIS), "topic": spark.createDataFrame([(1, "active"), (2, "active"), (3, "off")], "topic_id long, status string"),
        "trend_signal": spark.createDataFrame([(1, 1, "k", at("2026-07-01"), 5.0, 0.5, None)], "observation_id long, topic_id long, keyword string, observed_at timestamp, raw_value double, percentile double, change_ratio double"),
        "asset_topic": spark.createDataFrame([(1, 5, 1)], "link_id long, asset_id long, topic_id long"), "asset": spark.createDataFrame([(5, "S")], "asset_id long, symbol string"),
        "market_bar": spark.createDataFrame([(1, 5, "1d", at("2026-07-01T01:30:00"), 1.0, 1.0, 1.0, 1.0, "p")], "bar_id long, asset_id long, interval string, ts timestamp, open double, high double, low double, close double, provider string"),
        "collection_task": spark.createDataFrame([], "source string, topic_id long, window_start timestamp, window_end timestamp, status string, next_retry_at timestamp"),
    }
    got = topic_overview(tables, selected=date(2026, 7, 1), expected_sources=["s"])
    rows = {r.topic_id: r for r in got["topics"].collect()}
    assert set(rows) == {1, 2} and rows[1].heat_index == 58.7 and rows[1].trend == "rising" and rows[2].trend == "no_data"
    assert rows[1].latest_activity_at == at("2026-07-01T03:00:00").replace(tzinfo=None)
    assert got["market"].first().attention == 2 and got["attention"].first().value == 5.0 and got["prices"].first().has_price_data
    assert got["sources"].first().status == "observed_untracked"
    day = got["coverage"].first()
    assert (day.content_count, day.analysis_pending_count, day.exact_day_asset_count, day.collection_status) == (2, 1, 1, "partial")
