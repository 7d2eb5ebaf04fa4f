"""Work lists, contracts, evidence, cooldowns, studies, coverage, registry and repair."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from murmur.operators import coverage as cv
from murmur.operators import quality as ql
from murmur.operators import reads as rd
from murmur.operators import rebuild as rb
from murmur.operators import studies as st
from murmur.operators import trends as tr
from murmur.operators import worklists as wl
from murmur.sources import registry as rg
from murmur.sources import tables

CONTRACT = {
    "actor": {"type": "retail", "confidence": 0.9}, "investor": {"level": "novice", "confidence": 0.5}, "novice_signals": ["x"], "direction": {"value": "bullish", "confidence": 0.5},
    "intent": {"value": "buy", "confidence": 0.5}, "position": {"value": "owned", "confidence": 0.5}, "emotion": {"urgency": True}, "spam": {"value": False, "confidence": 0.0},
}


def contracts(spark, *items):
    frame = spark.createDataFrame([(i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(items)], "n long, item string")
    return {r.n: r.faults for r in wl.parse_contract(frame).collect()}


def test_contract_is_closed_and_bounded(spark):
    got = contracts(
        spark, CONTRACT, {**CONTRACT, "actor": {"value": "kol", "confidence": 1}}, {**CONTRACT, "mood": 1}, {**CONTRACT, "spam": {"value": False, "confidence": 2}},
        {**CONTRACT, "intent": {"value": "dance", "confidence": 0.1}}, {**CONTRACT, "emotion": {"joy": True}}, {k: v for k, v in CONTRACT.items() if k != "position"},
    )
    assert got == {0: [], 1: [], 2: ["unknown_field"], 3: ["bad_confidence_in_spam"], 4: ["bad_value_in_intent"], 5: ["unknown_field_in_emotion"], 6: ["bad_confidence_in_position", "bad_value_in_position"]}


def test_salvaged_answers(spark):
    answers = spark.createDataFrame(
        [(1, '<think>{"id": 9}</think>```json\n{"items": [{"id": 1}, {"id": 2}]}\n```'), (2, 'Here: {"items": [{"id": 3}]} done'), (3, '[{"id": 4}]'), (4, "sorry"), (5, '{"id": 6}')], "n long, answer string"
    )
    items, bad = wl.review_items(answers)
    assert sorted((r.n, json.loads(r.item)["id"]) for r in items.collect()) == [(1, 1), (1, 2), (2, 3), (3, 4), (5, 6)]
    assert [r.n for r in bad.collect()] == [4]


def test_batches_must_return_the_expected_ids(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 9), (3, 5), (3, 5)], "batch_id long, content_id long")
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 5)], "batch_id long, content_id long")
    assert sorted(r.batch_id for r in wl.batch_mismatches(items, expected).collect()) == [2, 3]


@pytest.mark.parametrize(
    "intent, direction, basis, evidence, rationale, fault",
    [
        ("buy", "bullish", "explicit_self_executed", "买 了", "ok", None), ("buy", "bullish", "explicit_self_executed", "没有", "ok", "evidence_not_in_text"), ("buy", "bullish", "negated", "买了", "ok", "no_action_evidence"),
        ("sell", "bullish", "risk_warning", "买了", "ok", "warning_not_bearish"), ("buy", "bearish", "market_directional_view", "买了", "ok", "direction_not_aligned"), ("hold", "neutral", "explicit_self_position", "", "ok", "no_position_evidence"),
        ("unknown", "neutral", "explicit_wait", "", "ok", "unknown_with_action_basis"), ("unknown", "neutral", "risk_warning", "", "ok", None), ("buy", "bullish", "explicit_self_planned", "买了", "并非本人，非作者 本人", "contradicts_rationale"),
        ("wait", "neutral", "explicit_wait", "买了", " ", "no_rationale"), ("buy", "bullish", "whatever", "买了", "ok", "invalid_basis"),
    ],
)
def test_evidence_rules(spark, intent, direction, basis, evidence, rationale, fault):
    row = spark.createDataFrame([(intent, direction, basis, evidence, rationale, "今天 买 了一点")], "intent string, direction string, intent_basis string, intent_evidence string, rationale string, source_text string")
    got = wl.review(row).first()
    if fault is None:
        assert got.evidence_faults == [] and got.intent == intent and not got.degraded
    else:
        assert fault in got.evidence_faults and (got.intent, got.intent_basis, got.intent_evidence) == ("unknown", "insufficient", "") and got.rationale.endswith(wl.DEGRADED_NOTE)


def test_windows_overlap_two_hours(spark, at):
    scopes = spark.createDataFrame([("a", "k"), ("b", "k")], "source string, scope_key string")
    marks = spark.createDataFrame([("a", "k", at("2026-07-01T10:00:00"))], "source string, scope_key string, last_successful_until timestamp")
    got = {r.source: r.window_start.hour for r in wl.next_windows(scopes, marks, now=F.lit("2026-07-01 12:00:00").cast("timestamp")).collect()}
    assert got == {"a": 8, "b": 12}
    runs = spark.createDataFrame([("a", "k", 1, at("2026-07-02"), False, True, False), ("a", "k", 2, at("2026-07-03"), True, False, False), ("b", "k", 3, at("2026-07-04"), False, False, False)], "source string, scope_key string, run_id long, until timestamp, explicit_window boolean, degraded boolean, partial boolean")
    moved = {r.source: r.last_successful_until.day for r in wl.advance_checkpoints(marks, runs).collect()}
    assert moved == {"a": 1, "b": 4}


def test_three_partial_jobs_open_the_circuit(spark, at):
    rows = [("a", True, False, at("2026-07-05"))] * 2 + [("b", True, False, at(f"2026-07-0{d}")) for d in (4, 5, 6)] + [("c", False, False, at("2026-07-04")), ("d", False, True, at("2026-07-09"))]
    got = wl.source_cooldowns(spark.createDataFrame(rows, "source string, partial boolean, done boolean, next_retry_at timestamp"), now=F.lit("2026-07-02").cast("timestamp"))
    assert {r.source: r.retry_at.day for r in got.collect()} == {"b": 6, "c": 4}


def test_study_readiness(spark, at):
    events = spark.createDataFrame([("e1", 1, "fomo_spike", at("2026-07-01"), at("2026-07-02"), None)], "event_key string, topic_id long, event_type string, started_at timestamp, peaked_at timestamp, ended_at timestamp")
    schema = "event_key string, asset_id long, horizon string, raw_return double, market_abnormal_return double, sector_abnormal_return double"
    reference = spark.createDataFrame([(1, 5)], "topic_id long, reference_asset_id long")
    paid = spark.createDataFrame([("e1", 5, "1d", 0.02, 0.01, None), ("e1", 5, "3d", None, None, None), ("e1", 6, "1d", 9.0, 9.0, None)], schema)
    summaries, ready = st.event_study(events, paid, reference)
    assert ready.first().status == "partially_mature" and (ready.first().return_rows, ready.first().mature_return_rows) == (2, 1)
    row = summaries.where("horizon = '1d' AND return_kind = 'market_abnormal_return'").first()
    assert (row.N, row["mean"], row["median"], row["std"], row.ci_low) == (1, 0.01, 0.01, 0.0, 0.01)
    assert summaries.where("horizon = '3d' AND return_kind = 'raw_return'").first().N == 0
    assert st.event_study(events, paid.limit(0), reference)[1].first().status == "awaiting_entry"
    links = spark.createDataFrame([("e1", at("2026-07-01"), "fomo_ratio", 0.5), ("e1", at("2026-07-02"), "fomo_ratio", 0.6)], "event_key string, bucket_at timestamp, metric_name string, raw_value double")
    states = [st.quantile_study(st.quantile_rows(events, links, paid, reference, h))[1].first() for h in ("1d", "3d", "5d")]
    assert [s.status for s in states] == ["ready", "awaiting_maturity", "awaiting_entry"] and states[0].spearman == 0.0 and states[0].abnormal_mature == 2


def test_quintiles_are_not_ntile(spark):
    rows = spark.createDataFrame([("k", float(i), i) for i in range(7)], "g string, v double, id long")
    assert [r.quintile for r in st.quintiles(rows, ["g"], ["v", "id"]).orderBy("v").collect()] == [1, 1, 2, 3, 3, 4, 5]


def test_rank_correlation_edges(spark):
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("up", 1.0, 1.0), ("up", 2.0, 2.0), ("up", 2.0, 2.0), ("up", 3.0, 9.0), ("none", None, 1.0)]
    got = {r.g: r.spearman for r in st.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["one"] is None and got["flat"] == 0.0 and got["up"] == pytest.approx(1.0) and "none" not in got


def test_summary_ignores_what_is_not_finite(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("a", -3.0), ("a", 5.0), ("b", None)]
    got = {r.g: r for r in st.summarize(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert (got["a"].N, got["a"]["mean"], got["a"]["median"]) == (3, 1.0, 1.0) and got["a"].hit_rate == pytest.approx(2 / 3)
    assert got["b"].N == 0 and got["b"]["mean"] is None and got["b"].ci_low is None


def test_half_day_task_is_window_partial(spark, at):
    content = spark.createDataFrame([("a", at("2026-07-01T01:00:00"), False)], "source string, published_at timestamp, is_deleted boolean")
    topics = spark.createDataFrame([(1,)], "topic_id long")
    task = lambda end, status: spark.createDataFrame([("a", 1, at("2026-06-30T16:00:00"), at(end), status, None)], "source string, topic_id long, window_start timestamp, window_end timestamp, status string, next_retry_at timestamp")
    half = cv.source_coverage(content, task("2026-07-01T04:00:00", "complete"), topics, expected_sources=["a", "New_Source"])
    assert {r.name: r.status for r in half.collect()} == {"a": "window_partial", "new-source": "not_recorded"}
    full = cv.source_coverage(content, task("2026-07-01T16:00:00", "complete"), topics, expected_sources=["a"])
    assert full.first().status == "complete" and full.first().complete_topics == 1
    none = cv.source_coverage(content, task("2026-07-01T16:00:00", "complete").limit(0), topics, expected_sources=["a"])
    assert none.first().status == "observed_untracked"
    running = cv.source_coverage(content, task("2026-07-01T16:00:00", "running"), topics, expected_sources=["b"])
    assert {r.name: r.status for r in running.collect()} == {"a": "observed", "b": "not_recorded"}


def test_period_units_are_buckets(spark, at):
    def start(period, size):
        first, _ = rd.period_bounds(F.lit("2026-07-09 10:30:00").cast("timestamp"), period, size)
        return spark.range(1).select(first.cast("string")).first()[0]

    assert start("7d", "1h") == "2026-07-09 03:30:00" and start("24h", "1d") == "2026-07-08 10:30:00" and start("latest", "1d") == "2026-07-08 16:00:00"


def test_even_sample_keeps_head_and_tail(spark):
    rows = spark.createDataFrame([("g", i) for i in range(23)] + [("h", i) for i in range(3)], "g string, i long")
    got = rd.even_sample(rows, ["g"], ["i"], 6)
    want = [round(i * 22 / 5) for i in range(6)]
    assert sorted(r.i for r in got.where("g = 'g'").collect()) == want and got.where("g = 'h'").count() == 3


def test_trend_points_at_one_instant_count_in_id_order(spark, at):
    rows = [(i, 1, "k", at("2026-07-01"), float(i)) for i in range(1, 4)] + [(9, 1, "k", at("2026-07-02"), 6.0), (10, 1, "k", at("2026-09-02"), 6.0)]
    got = {r.observation_id: r.change_ratio for r in tr.trend_signals(spark.createDataFrame(rows, "observation_id long, topic_id long, keyword string, observed_at timestamp, value double")).collect()}
    assert got == {1: None, 2: 1.0, 3: 0.5, 9: 1.0, 10: None}


def test_two_keywords_of_a_topic_add_up(spark, at):
    from datetime import timedelta

    first = at("2026-07-01")
    rows = [(k * 100 + i, 1, f"k{k}", first + timedelta(days=i), float(v)) for i in range(16) for k, v in ((1, 100 + 10 * i), (2, 50 + i))]
    signals = tr.trend_signals(spark.createDataFrame(rows, "observation_id long, topic_id long, keyword string, observed_at timestamp, value double"))
    assert signals.count() == 32
    assert tr.topic_attention(signals).orderBy(F.desc("day")).first().value == 315.0
    last = tr.market_attention(signals).orderBy(F.desc("day")).first()
    assert (last.keyword_count, last.topic_count) == (2, 1)


def test_source_quality_without_posts(spark, at):
    sources = spark.createDataFrame([("a", "content", "healthy"), ("w", "trend", "degraded")], "source string, source_type string, health_status string")
    raw = spark.createDataFrame([("a", "1"), ("a", "1"), ("w", "2")], "source string, source_item_id string")
    content = spark.createDataFrame([], "content_id long, source string")
    analysis = spark.createDataFrame([], "analysis_id long, content_id long, model string, prompt_version string, actor_type string, spam boolean, promotion boolean")
    got = {(r.source, r.metric_name): r.metric_value for r in ql.source_quality(sources, raw, content, spark.createDataFrame([], "content_id long, asset_id long"), analysis).collect()}
    assert got[("a", "duplicate_ratio")] == 0.5 and got[("a", "parse_failure_ratio")] == 1.0 and got[("w", "parse_failure_ratio")] == 0.0 and got[("w", "source_success_rate")] == 0.0


def _stored(spark):
    return {
        "topic": spark.createDataFrame([("old", "Old", "active", 1)], "slug string, name string, status string, topic_id long"),
        "topic_alias": spark.createDataFrame([(1, "gone"), (1, "Kept")], "topic_id long, alias string"),
        "asset": spark.createDataFrame([("CN", "1", "A", "stock", "CNY", "Asia/Shanghai", 7, None, None)], "market string, symbol string, name string, asset_type string, currency string, timezone string, asset_id long, benchmark_asset_id long, sector_benchmark_asset_id long"),
        "asset_alias": spark.createDataFrame([], "asset_id long, alias string, alias_type string, priority int"),
        "asset_topic": spark.createDataFrame([(3, 7, 1)], "link_id long, asset_id long, topic_id long"),
    }


def test_registry_sync(spark):
    topics = spark.createDataFrame([("old", "Old2", None, ["kept", "new", "NEW"], ["gone"], ["2"]), ("fresh", "F", None, [], None, None)], rg.TOPIC_SCHEMA)
    assets = spark.createDataFrame(
        [("CN", "1", "A2", "stock", "CNY", "Asia/Shanghai", "2", None, [("al", None, None)], None, ["fresh"]), ("CN", "2", "B", "index", "CNY", "Asia/Shanghai", None, None, None, None, ["old"])], rg.ASSET_SCHEMA
    )
    new, counts = rg.sync(topics, assets, _stored(spark))
    assert {r.change: r.n for r in counts.collect()} == {"topics": 1, "assets": 1, "aliases": 2, "aliases_removed": 1, "links": 2, "links_removed": 1}
    assert {r.slug: (r.topic_id, r.name) for r in new["topic"].collect()} == {"old": (1, "Old2"), "fresh": (2, "F")}
    assert sorted(r.alias for r in new["topic_alias"].collect()) == ["Kept", "new"]
    assert {r.symbol: (r.asset_id, r.benchmark_asset_id) for r in new["asset"].collect()} == {"1": (7, 8), "2": (8, None)}
    assert {(r.asset_id, r.topic_id) for r in new["asset_topic"].collect()} == {(7, 2), (8, 1)}
    assert rg.registry_errors(topics, assets).count() == 0
    broken = spark.createDataFrame([("old", "O", None, [], None, ["1", "1"])], rg.TOPIC_SCHEMA)
    assert sorted(r.problem for r in rg.registry_errors(broken, assets).collect()) == ["duplicate_reference", "reference_not_linked"]


def test_snapshot_repair(spark):
    item = "source string, source_item_id string"
    store = {
        "raw_observation": spark.createDataFrame([("z", "1", "zhihu_answer_snapshot"), ("z", "2", "forum_post")], f"{item}, observation_kind string"),
        "content": spark.createDataFrame([(1, "z", "1"), (2, "z", "2")], f"content_id long, {item}"),
        "content_analysis": spark.createDataFrame([(10, 1), (11, 2)], "analysis_id long, content_id long"), "content_analysis_review": spark.createDataFrame([(10,), (11,)], "analysis_id long"),
        "content_cluster_member": spark.createDataFrame([(1, 5), (2, 6)], "content_id long, cluster_id long"), "content_cluster": spark.createDataFrame([(5,), (6,)], "cluster_id long"),
    }
    kept, counts = rb.remove_snapshot_content(store)
    assert {r.table: r.removed for r in counts.collect()} == {"content": 1, "content_analysis": 1, "content_cluster_member": 1}
    assert [r.cluster_id for r in kept["content_cluster"].collect()] == [6] and [r.analysis_id for r in kept["content_analysis_review"].collect()] == [11]
    assert kept["raw_observation"].count() == 2


def test_upserts_and_partition_overwrite(spark, tmp_path, at):
    schema = "k long, part string, v long"
    old, new = spark.createDataFrame([(1, None, 1), (2, "a", 2)], schema), spark.createDataFrame([(1, None, 9), (3, "b", 3)], schema)
    assert sorted((r.k, r.v) for r in tables.upsert(new, old, ["k", "part"]).collect()) == [(1, 9), (2, 2), (3, 3)]
    assert [r.k for r in tables.insert_absent(new, old, ["k", "part"]).collect()] == [3]
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "at timestamp, v long")
    tables.overwrite_days(frame([(at("2026-07-01"), 1), (at("2026-07-02"), 2)]), path, day_from="at")
    tables.overwrite_days(frame([(at("2026-07-02"), 5)]), path, day_from="at")
    assert sorted(r.v for r in tables.read(spark, path).collect()) == [1, 5]
    tables.append(frame([(at("2026-07-02"), 6)]), path, day_from="at")
    assert sorted(r.v for r in tables.read(spark, path).collect()) == [1, 5, 6]
    tables.export_json(frame([(at("2026-07-02"), 6)]), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == 6
