"""Evidence review from requests to stored analyses and reviews."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from murmur.operators.analysis import EMOTION_FLAGS
from murmur.plans import review as rv
from murmur.sources.store import Run, Store

CONTRACT = {
    "actor": {"type": "retail", "confidence": 0.9}, "investor": {"level": "unknown", "confidence": 0.5}, "novice_signals": [], "direction": {"value": "bullish", "confidence": 0.5},
    "intent": {"value": "buy", "confidence": 0.5}, "position": {"value": "owned", "confidence": 0.5}, "emotion": {}, "spam": {"value": False, "confidence": 0.0},
    "intent_basis": "explicit_self_executed", "rationale": "ok",
}
VALUE = "{0} string, {0}_confidence double"
ANALYSIS = (
    "analysis_id long, content_id long, topic_id long, input_hash string, model string, prompt_version string, schema_version string, actor_type string, actor_confidence double,"
    " investor_level string, investor_confidence double, novice_signals array<string>, direction string, direction_confidence double, intent string, intent_confidence double,"
    f" position string, position_confidence double, emotion struct<{', '.join(f'{x}: boolean' for x in EMOTION_FLAGS)}>, spam boolean, spam_confidence double, promotion boolean, promotion_confidence double"
)
CONTENT = "content_id long, source string, kind string, published_at timestamp, title string, body string, content_hash string, is_deleted boolean"
ANSWER = "answer_id long, batch long, model string, answer string"
MODEL = "m-via-codex-cli"


def posts(at, *ids, version="a"):
    return [(i, "s", "post", at("2026-03-01"), None if i % 2 else "标题", f"我 买了\n{i} 手", f"{i:03d}{version}" * 16, i == 9) for i in ids]


def build(spark, folder, at):
    store = Store(spark, str(folder))
    store.write("content", spark.createDataFrame(posts(at, *range(1, 10)), CONTENT))
    store.write("content_analysis", spark.createDataFrame([], ANALYSIS))
    return store


def land(spark, store, *answers):
    rows = [(i, batch, MODEL, text if isinstance(text, str) else json.dumps({"items": text}, ensure_ascii=False)) for i, batch, text in answers]
    store.append(rv.ANSWERS, spark.createDataFrame(rows, ANSWER))


def item(i, evidence="我买了", **more):
    return {**CONTRACT, "id": i, "intent_evidence": evidence, **more}


def ask(store, **options):
    return {r.content_id: r.batch for r in rv.request_reviews(store, batch_size=3, resume_models=(MODEL,), **options).collect()}


def test_review_from_request_to_store_and_again(spark, tmp_path, at):
    store = build(spark, tmp_path / "s", at)
    assert ask(store) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3}
    assert ask(store) == {}
    land(spark, store, (1, 1, [item(1), item(2, "nowhere"), item(3, mood=1), item(7)]), (2, 2, [item(4), item(4), item(5)]), (3, 3, "no json"))
    counts = rv.take_in_reviews(store, reviewer="r").collect()
    assert [(c.model, c.buy, c.unknown, c.reviewed, c.rejected) for c in counts] == [(MODEL, 2, 1, 3, 5)]
    got = {r.content_id: r for r in store.read("content_analysis").join(store.read(rv.REVIEWS).drop("input_hash"), "analysis_id").collect()}
    assert sorted(got) == [1, 2, 5] and sorted(r.analysis_id for r in got.values()) == [1, 2, 3]
    assert (got[1].intent, got[1].degraded, got[1].intent_evidence) == ("buy", False, "我买了") and (got[2].intent, got[2].degraded, got[2].intent_evidence) == ("unknown", True, "")
    assert got[1].prompt_version == "codex-content-review-v4:001a001a001a" and got[1].topic_id is None and json.loads(got[5].payload)["id"] == 5
    reasons = {(r.answer_id, r.content_id): r.reason for r in store.read(rv.REJECTED).collect()}
    assert reasons == {(1, 3): "unknown_field", (1, 7): "not_asked", (2, 4): "returned_twice", (3, None): "unreadable"}
    # Answered batches leave their rejected and missing posts open; reviewed ones stay away.
    assert ask(store) == {3: 4, 4: 4, 6: 4, 7: 5, 8: 5}
    # Nothing new has landed: nothing changes.
    before = [store.read(t).count() for t in ("content_analysis", rv.REVIEWS, rv.REJECTED)]
    assert rv.take_in_reviews(store, reviewer="r").collect() == []
    assert [store.read(t).count() for t in ("content_analysis", rv.REVIEWS, rv.REJECTED)] == before
    # The same answers once more, in a new folder: analyses and reviews are kept as they are.
    land(spark, store, (11, 1, [item(1, "手", intent_basis="explicit_self_planned")]))
    assert rv.take_in_reviews(store, reviewer="other").collect() == []
    assert store.read(rv.REVIEWS).where("reviewer = 'other'").count() == 0 and store.read("content_analysis").count() == 3
    # Changed text: the post comes up again although an answer to its old text is stored.
    store.write("content", spark.createDataFrame([*posts(at, 1, version="b"), *posts(at, 2)], CONTENT))
    assert ask(store) == {1: 6}


def test_answers_are_judged_by_the_text_that_was_read(spark, tmp_path, at):
    store = build(spark, tmp_path / "s", at)
    ask(store)
    store.write("content", spark.createDataFrame(posts(at, 1, version="b"), CONTENT))
    land(spark, store, (1, 1, [item(1)]))
    rv.take_in_reviews(store, reviewer="r")
    assert [r.prompt_version for r in store.read("content_analysis").collect()] == ["codex-content-review-v4:001a001a001a"]
    assert ask(store) == {1: 4}


def test_first_of_several_answers_stays_and_stored_analyses_get_a_review(spark, tmp_path, at):
    store = build(spark, tmp_path / "s", at)
    ask(store)
    land(spark, store, (1, 1, [item(1)]))
    rv.take_in_reviews(store, reviewer="r")
    held = store.read("content_analysis")
    requests = store.read(rv.REQUESTS)
    rows = [(5, 1, MODEL, json.dumps([item(1, "手"), item(2, "手")])), (4, 1, MODEL, json.dumps([item(2, "买了")], ensure_ascii=False))]
    accepted, rejected = rv.judge_answers(spark.createDataFrame(rows, ANSWER), requests)
    assert {r.content_id: r.intent_evidence for r in accepted.collect()} == {1: "手", 2: "买了"} and rejected.count() == 0
    fresh, said = rv.review_rows(accepted, held, None, reviewer="r2")
    assert [(r.analysis_id, r.content_id) for r in fresh.collect()] == [(2, 2)] and sorted(r.analysis_id for r in said.collect()) == [1, 2]


def test_a_call_that_stops_leaves_no_trace(spark, tmp_path, at, monkeypatch):
    store = build(spark, tmp_path / "s", at)
    ask(store)
    land(spark, store, (1, 1, [item(1), item(2)]))
    real = Run.append

    def stopped(self, name, df):
        if name == rv.REVIEWS:
            raise RuntimeError("lost")
        return real(self, name, df)

    with monkeypatch.context() as patch:
        patch.setattr(Run, "append", stopped)
        with pytest.raises(RuntimeError):
            rv.take_in_reviews(store, reviewer="r")
    assert store.read("content_analysis").count() == 0 and store.stored(rv.REVIEWS) is None
    assert rv.take_in_reviews(store, reviewer="r").first().reviewed == 2
    assert store.read("content_analysis").where(F.col("intent") == "buy").count() == store.read(rv.REVIEWS).count() == 2


def test_answers_of_one_part_are_parsed_in_many_tasks(spark, at, monkeypatch):
    requests = spark.createDataFrame(posts(at, 1), CONTENT).select(
        "content_id", F.lit(1).cast("long").alias("batch"), F.lit("p").alias("prompt_version"), F.lit("t").alias("target_hash"), F.lit("i").alias("input_hash"), "title", "body"
    )
    answers = spark.createDataFrame([(k, 1, MODEL, json.dumps({"items": [CONTRACT | {"id": k, "intent_evidence": ""}]})) for k in range(40)], ANSWER).coalesce(1)
    parts, whole = [], rv.wl.review_items

    def seen(answers):
        parts.append(answers.select(F.spark_partition_id().alias("p")).distinct().count())
        return whole(answers)

    monkeypatch.setattr(rv.wl, "review_items", seen)
    accepted, rejected = rv.judge_answers(answers, requests)
    assert (accepted.count(), rejected.where("reason = 'not_asked'").count()) == (1, 39)
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
