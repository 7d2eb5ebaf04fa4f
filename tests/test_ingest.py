"""Versions: append, links, folds, windows and eligibility."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from murmur.operators import ingest as ig
from murmur.sources.raw import RAW_SCHEMA, source_user_id, with_payload


def raw(spark, at, rows):
    import hashlib

    out = []
    for i, item, payload, published, observed, *kind in rows:
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out.append((i, "s", item, kind[0] if kind else "forum_post", published and at(published), at(observed), at(observed), text, hashlib.sha256(text.encode()).hexdigest()))
    return spark.createDataFrame(out, RAW_SCHEMA)


def test_append_is_idempotent_and_versioned(spark, at):
    first = raw(spark, at, [(1, "a", {"body": "x"}, "2026-07-01", "2026-07-02"), (2, "a", {"body": "x"}, "2026-07-01", "2026-07-02"), (3, "a", {"body": "y"}, "2026-07-01", "2026-07-02")])
    kept, _ = ig.append_new(first, first.limit(0))
    assert sorted(r.raw_id for r in kept.collect()) == [1, 3]
    assert ig.append_new(first, kept)[0].count() == 0


def test_cut_off_recrawl_does_not_replace_a_complete_version(spark, at):
    stored = raw(spark, at, [(1, "a", {"body": "whole text"}, "2026-07-01", "2026-07-02"), (2, "b", {"body": "cut", "body_truncated": True}, "2026-07-01", "2026-07-02")])
    again = raw(spark, at, [(3, "a", {"body": "who", "body_truncated": True}, "2026-07-01", "2026-07-03"), (4, "b", {"body": "cut2", "body_truncated": True}, "2026-07-01", "2026-07-03")])
    assert [r.raw_id for r in ig.append_new(again, stored)[0].collect()] == [4]


def test_invalid_times_are_quarantined(spark, at):
    rows = raw(spark, at, [
        (1, "a", {"timestamp_semantics": "published"}, None, "2026-07-02"), (2, "b", {}, "2026-07-03", "2026-07-02"), (3, "c", {"updated_at": "2026-06-01T00:00:00Z"}, "2026-07-01", "2026-07-02"),
        (4, "d", {"updated_at": "soon"}, "2026-07-01", "2026-07-02"), (5, "e", {}, None, "2026-07-02"),
    ])
    kept, bad = ig.append_new(rows, rows.limit(0))
    assert {r.raw_id: r.issue for r in bad.collect()} == {1: "missing_publication_time", 2: "future_after_observation", 3: "updated_before_published", 4: "invalid_updated_at"}
    assert [r.raw_id for r in kept.collect()] == [5]


def test_fold_rules(spark, at):
    rows = raw(spark, at, [
        (1, "a", {"body": "first", "title": "t1", "likes": 3, "author_id": 7}, "2026-07-05", "2026-07-06"),
        (2, "a", {"body": "a longer body", "likes": "x", "url": "u"}, "2026-07-03", "2026-07-07"),
        (3, "a", {"body": "short", "title": "t3", "timestamp_semantics": "published"}, "2026-07-04", "2026-07-05"),
        (4, "a", {"body": "", "likes": "4.9", "author_id": 8}, "2026-07-04T12:00:00", "2026-07-08"),
    ])
    got = ig.fold_versions(rows).first()
    assert (got.body, got.title, got.likes, got.url, got.versions) == ("a longer body", "t3", 4, "u", 4)
    assert got.published_at == at("2026-07-04").replace(tzinfo=None) and got.last_seen_at == at("2026-07-08").replace(tzinfo=None)
    only = ig.authors(rows).orderBy("first_seen_at").collect()
    assert len(only) == 2 and got.author_hash == only[0].author_hash


def test_known_items_only_earn_links(spark, at):
    stored = raw(spark, at, [(1, "a", {"body": "x"}, "2026-07-01", "2026-07-02")])
    batch = raw(spark, at, [(2, "a", {"body": "new"}, "2026-07-01", "2026-07-03"), (3, "b", {"body": "n"}, "2026-07-01", "2026-07-03"), (4, "b", {"body": "m"}, "2026-07-01", "2026-07-03"), (5, "a", {"market_session_date": "2026-07-01"}, None, "2026-07-03", "zhihu_answer_snapshot")])
    fresh, repeats = ig.split_known(batch, stored)
    assert sorted(r.raw_id for r in fresh.collect()) == [3, 5]
    assert {r.raw_id: r.known_raw_id for r in repeats.collect()} == {2: 1, 4: 3}


def test_session_snapshots(spark, at):
    def answer(i, title, **more):
        return (i, f"a{i}", {"title": title, "market_session_date": "2026-07-03", **more}, None, "2026-07-10", "zhihu_answer_snapshot")

    rows = raw(spark, at, [
        answer(1, "如何看待2026年7月3日A股市场"), answer(2, "如何看待2025年7月3日A股市场"), answer(3, "如何看待7月3日", answer_edit_time="2026-07-05T00:00:00+08:00"), answer(4, "如何看待7月3日"),
        answer(5, "如何看待17月3日"), answer(6, "7月3日 2026-7-3 和 2025/07/03"),
    ])
    parsed = with_payload(rows).select("raw_id", ig.session_reference().alias("v"), ig.in_window(F.lit("2026-07-02 16:00:00").cast("timestamp"), F.lit("2026-07-03 16:00:00").cast("timestamp")).alias("w"))
    got = {r.raw_id: r.v.reason for r in parsed.collect()}
    assert got == {1: "explicit_market_session_date", 2: "conflicting_market_session_year", 3: "recent_edit_matches_market_session", 4: "market_session_year_unverified", 5: "market_session_day_not_mentioned", 6: "conflicting_market_session_year"}
    assert all(r.w for r in parsed.collect())
    routed = {r.raw_id: r for r in ig.route(rows).collect()}
    assert routed[1].target == "content" and routed[1].item_id == "a1@2026-07-03" and routed[1].content_kind == "reference_answer"
    assert routed[1].effective_observed_at == at("2026-07-03T07:00:00").replace(tzinfo=None) and routed[2].target == "raw_only"


def test_user_id_aliases(spark, at):
    rows = raw(spark, at, [(1, "a", {"author": {"uid": "u9"}}, None, "2026-07-02"), (2, "b", {"user_id": 5}, None, "2026-07-02"), (3, "c", {"author_id": "", "user": {"id": "z"}}, None, "2026-07-02"), (4, "d", {}, None, "2026-07-02")])
    got = with_payload(rows).orderBy("raw_id").select(source_user_id().alias("u")).collect()
    assert [r.u for r in got] == ["u9", "5", "z", None]


def test_pseudonym_is_a_keyed_hash(spark):
    import hashlib
    import hmac

    from murmur.functions.hashing import author_hash

    for secret in ("k", "s" * 100):
        got = spark.range(1).select(author_hash(secret, F.lit("guba"), F.lit("用户42"))).first()[0]
        assert got == hmac.new(secret.encode(), "guba:用户42".encode(), hashlib.sha256).hexdigest()


def test_answers_rank_by_votes_then_input_order(spark):
    rows = spark.createDataFrame([("q", 5, 1, 1, 0), ("q", 5, 2, 0, 1), ("q", 9, 0, 0, 2), ("q", 5, 1, 1, 3), ("q", None, 0, 0, 4)], "q string, votes long, favorites long, comments long, position int")
    got = ig.session_answer_rank(rows, ["q"]).orderBy("answer_rank").collect()
    assert [r.position for r in got] == [2, 1, 0, 3, 4]
