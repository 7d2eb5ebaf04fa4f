"""Landed payloads and bars."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from murmur.operators import market as mk
from murmur.operators import trends as tr
from murmur.sources import archive as ar
from murmur.sources import bars as br
from murmur.sources import payloads as pl


def responses(spark, *texts, **more):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t, ensure_ascii=False),) for t in texts], "response string").select("response", *[F.lit(v).alias(k) for k, v in more.items()])


def items(spark, *objects):
    return spark.createDataFrame([(json.dumps(o, ensure_ascii=False),) for o in objects], "item string")


def payload(row):
    return json.loads(row.payload)


def test_paged_shapes(spark):
    pages = responses(spark, [{"id": 1}, "x", 3], {"items": [{"id": 2}], "next_cursor": "n"}, {"data": {"results": [{"id": 3}]}, "has_more": True}, {"results": None}, {"items": {"id": 4}}, {"data": "no"}, "nope", 5)
    found, bad, states = pl.paged_items(pages)
    assert sorted(json.loads(r.item)["id"] for r in found.collect()) == [1, 2, 3]
    assert sorted(r.issue for r in bad.collect()) == ["items_not_a_list", "not_an_object_or_list", "not_json"]
    assert sorted((r.next_cursor or "", r.exhausted) for r in states.collect()) == [("", False), ("", True), ("", True), ("", True), ("n", False)]


def test_observations_keep_the_payload(spark, at):
    rows = items(spark, {"post_id": 7, "created_at": "2026-07-01 08:00:00", "z": 1, "a": {"y": 2, "b": 1}}, {"title": "no id"}, {"id": "k", "observation_kind": "news", "time": "never"})
    good, bad = pl.observations(rows, observed_at=F.lit("2026-07-02").cast("timestamp"))
    got = good.first()
    assert (got.source_item_id, got.observation_kind, got.published_at) == ("7", "forum_post", at("2026-07-01").replace(tzinfo=None))
    assert got.payload == '{"a":{"b":1,"y":2},"created_at":"2026-07-01 08:00:00","observation_kind":"forum_post","post_id":7,"z":1}'
    assert sorted(r.issue for r in bad.collect()) == ["invalid_time", "no_stable_id"]


def test_board_posts(spark, at):
    rows = items(
        spark,
        {"post_id": 9, "post_publish_time": "2026-07-01 09:30:00", "post_title": "<b>T</b>", "post_content": "", "post_abstract": "cut off...", "post_user": {"user_id": "u", "user_nickname": "n"}, "post_guba": {"stockbar_code": "600519"}, "post_click_count": 5, "post_type": 0},
        {"post_id": 10, "post_publish_time": "2026-07-01 09:30:00", "post_title": "T2", "post_type": 20, "post_source_id": "s/1"}, {"post_id": "", "post_publish_time": "2026-07-01"}, {"post_id": 11, "post_publish_time": "x"},
    )
    good, bad = pl.board_posts(rows)
    first, second = [payload(r) for r in good.orderBy("source_item_id").collect()][::-1]
    assert first["published_at"] == "2026-07-01T01:30:00+00:00" and first["body"] == "cut off..." and first["body_truncated"] is True and first["author_id"] == "u" and first["views"] == 5
    assert first["url"].endswith("/news,600519,9.html") and second["url"].endswith("/news/s%2F1") and second["body"] == "T2" and second["body_truncated"] is False
    assert sorted(r.issue for r in bad.collect()) == ["invalid_time", "no_stable_id"]


def test_forum_qa_and_notes(spark):
    topic = payload(pl.forum_topics(items(spark, {"topicID": 3, "postDate": 1751328000000, "subject": "S", "userID": 4, "totalViewNum": 8, "stockCode": "sh1"}))[0].first())
    assert topic["published_at"] == "2025-07-01T00:00:00+00:00" and topic["body"] == "S" and topic["author_id"] == "4" and topic["views"] == 8
    qa = items(spark, {"ContentID": "5", "ContentType": "Answer", "Title": "Q", "ContentText": "<p>x</p>", "CreateTime": 1751328000, "VoteUpCount": 3, "CollectionCount": 2, "CommentInfoList": [{"Content": "<b>c1</b>"}, {"Content": " "}, {}]}).withColumn("query", F.lit("gold"))
    row = pl.qa_items(qa)[0].first()
    got = payload(row)
    assert row.observation_kind == "zhihu_answer" and got["id"] == "answer:5" and got["featured_comments"] == ["c1"] and (got["likes"], got["favorites"], got["query"]) == (3, 2, "gold")
    note = {"noteId": "n1", "time": 1751328000000, "title": "", "desc": "body", "user": {"userId": "u"}, "interactInfo": {"likedCount": "1.2万"}}
    pages = responses(spark, {"data": {"data": {"note": note, "comments": {"list": [{"content": f"c{i}"} for i in range(12)]}}}}, {"success": False, "code": "rate_limited"}, {"data": {"x": 1}}, query="q")
    good, bad = pl.note_details(pages)
    got = payload(good.first())
    assert got["likes"] == 12000 and got["body"] == "body" and len(got["sample_comments"]) == 12 and got["url"].endswith("/explore/n1")
    assert sorted(r.issue for r in bad.collect()) == ["no_note", "upstream:rate_limited"]
    renamed = pl.renamed_note(items(spark, {"note_id": "n2", "time": 1751328000, "title": "T", "user": {"user_id": "v"}, "interact_info": {"share_count": "3千"}})).withColumn("query", F.lit("q"))
    got = payload(pl.note_details(renamed)[0].first())
    assert (got["id"], got["shares"], got["author_id"]) == ("n2", 3000, "v")


def test_script_values(spark):
    pages = spark.createDataFrame(
        [(1, '<script>var article_list = {"re": [{"post_id": 1, "t": "a};b"}], "n": 1};</script>'), (2, "fd_guba_validate"), (3, "<p>none</p>"), (4, "<script>var article_list = {oops</script>"), (5, '<script>var article_list={"re": 1}</script>')],
        "page_id long, html string",
    )
    values, bad = pl.script_values(pages, "article_list")
    assert {r.page_id: r.issue for r in bad.collect()} == {2: "verification_page", 3: "missing_value", 4: "malformed_value"}
    found, wrong = pl.board_items(values)
    assert json.loads(found.first().item)["t"] == "a};b" and [r.page_id for r in wrong.collect()] == [5]


def test_view_targets_and_series(spark):
    cases = {'{"project": "en.wikipedia.org", "article": "Gold"}': ("en.wikipedia.org", "Gold"), "en.w|Gold": ("en.w", "Gold"), "|Gold": ("zh.wikipedia.org", "Gold"), "黄金": ("zh.wikipedia.org", "黄金"), "a|": ("zh.wikipedia.org", "a|")}
    for query, want in cases.items():
        got = spark.range(1).select(pl.view_target(F.lit(query)).alias("t")).first().t
        assert tuple(got) == want
    landed = responses(spark, {"items": [{"timestamp": "2026070100", "views": 5}, {"timestamp": "2026070300", "views": 7}, {"timestamp": "bad"}]}, query="p|a")
    have = spark.createDataFrame([("p", "2026-07-01"), ("p", "2026-07-02"), ("p", "2026-07-03")], "project string, day string").withColumn("day", F.col("day").cast("date"))
    observed, pending = tr.pageview_series(pl.pageview_items(landed), have, first_day="2026-07-01", last_day="2026-07-05")
    assert [(r.value, r.missing_as_zero) for r in observed.orderBy("day").collect()] == [(5.0, False), (0.0, True), (7.0, False)]
    assert pending.count() == 2


ASSET = {"asset_id": 1, "market": "CN", "symbol": "600519", "asset_type": "stock", "timezone": "Asia/Shanghai"}


def test_bar_formats(spark, at):
    generic, wrong, broken = br.generic_bars(responses(spark, {"bars": [{"date": "2026-07-01", "o": "1", "h": 2, "l": 0.5, "c": 1.5}, {"ts": "2026-07-02", "open": 1}]}, {"bars": 3}, **ASSET))
    assert (generic.first().close, generic.first().volume, generic.first().adjustment) == (1.5, 0.0, "none") and wrong.count() == 1 and broken.first().issue == "items_not_a_list"
    lines, _ = br.delimited_bars(responses(spark, {"data": {"klines": ["2026-07-01,1,2,3,0.5,10,20", "2026-07-02,1,2"]}}, **ASSET))
    got = lines.collect()
    assert len(got) == 1 and got[0].ts == at("2026-07-01T01:30:00").replace(tzinfo=None) and (got[0].close, got[0].high, got[0].adjustment) == (2.0, 3.0, "forward")
    bounds = {"start": F.lit("2026-07-01").cast("date"), "end": F.lit("2026-07-02").cast("date")}
    rows, _ = br.array_bars(responses(spark, {"data": {"sh600519": {"day": [["2026-06-30", "1", "1", "1", "1", "1"], ["2026-07-01", "1", "2", "3", "0.5", "10"], ["2026-07-02", "1"]]}}}, **ASSET), **bounds)
    assert [(r.close, r.adjustment) for r in rows.collect()] == [(2.0, "none")]
    us = {**ASSET, "market": "US", "timezone": "America/New_York"}
    table, bad = br.table_bars(responses(spark, {"data": {"tradesTable": {"rows": [{"date": "07/01/2026", "open": "$1,000.5", "high": "2000", "low": "900", "close": "$1,500", "volume": "N/A"}, {"date": "07/02/2026", "open": "N/A", "high": "1", "low": "1", "close": "1", "volume": "2"}]}}}, **us), **bounds)
    row = table.first()
    assert (row.open, row.close, row.volume) == (1000.5, 1500.0, 0.0) and row.ts == at("2026-07-01T13:30:00").replace(tzinfo=None) and bad.count() == 1


def test_later_tail_wins_and_stored_bars_stay(spark, at):
    schema = "asset_id long, ts timestamp, interval string, provider string, close double"
    old = spark.createDataFrame([(1, at("2026-07-01"), "1d", "p", 1.0)], schema)
    new = spark.createDataFrame([(1, at("2026-07-01"), "1d", "p", 2.0), (1, at("2026-07-02"), "1d", "p", 3.0)], schema)
    assert [r.close for r in mk.merge_tail(old, new).orderBy("ts").collect()] == [2.0, 3.0]
    assert [r.close for r in mk.new_bars(new, old).collect()] == [3.0]


def test_discontinuous_series(spark, at):
    rows = [(1, "etf", at("2026-07-01"), 1.0), (1, "etf", at("2026-07-02"), 1.6), (2, "stock", at("2026-07-01"), 1.0), (2, "stock", at("2026-07-02"), 1.6), (3, "stock", at("2026-07-01"), 1.0), (3, "stock", at("2026-07-02"), 0.0)]
    got = mk.discontinuous_assets(spark.createDataFrame(rows, "asset_id long, asset_type string, ts timestamp, close double"))
    assert sorted(r.asset_id for r in got.collect()) == [1, 3]


def test_capture_files(spark, tmp_path):
    line = {"url": "http://a", "timestamp": "20260701000000", "filename": "f", "offset": 1, "length": 2}
    (tmp_path / "a.json").write_text("\n".join(json.dumps({**line, "timestamp": t}) for t in ("20260701000000", "20260702000000")))
    (tmp_path / "b.json").write_text(json.dumps({**line, "url": "http://b"}) + "\n{broken\n")
    good, bad = ar.read_captures(spark, str(tmp_path))
    newest = ar.newest_capture(good).collect()
    assert len(newest) == 1 and newest[0].timestamp == "20260702000000" and bad.count() == 1


def test_archived_bodies_fill_only_poor_ones(spark):
    content = spark.createDataFrame([(1, ""), (2, "short"), (3, "x" * 90), (4, "short"), (5, None)], "content_id long, body string")
    captures = spark.createDataFrame([(i, f"archive {i}", i == 4) for i in (1, 2, 3, 4)], "content_id long, body string, body_truncated boolean")
    got = {r.content_id: r.body for r in ar.fill_bodies(content, captures).collect()}
    assert got[1] == "archive 1" and got[2] == "archive 2" and got[3] == "x" * 90 and got[4] == "short" and got[5] is None


def test_a_response_is_parsed_once_in_either_half(spark):
    rows = spark.createDataFrame([('{"data":{"note":{"noteId":"7","time":"1700000000","title":"t"},"comments":{"list":[{"content":"c"}]}}}',), ('{"success":false,"error_code":"E1"}',), ("no",)], "response string")
    good, bad = pl.note_details(rows.withColumn("query", F.lit("q")))
    for half in (good, bad):
        plan = half._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and not any("from_json(" in line for line in plan.split("\n") if "Filter" in line)
    assert [r.source_item_id for r in good.collect()] == ["7"] and sorted(r.issue for r in bad.collect()) == ["not_json", "upstream:E1"]
