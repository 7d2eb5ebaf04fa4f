"""Counters, ratios, preferred analyses and baselines on hand-made posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import analysis as an
from murmur.operators import metrics as mt

ANALYSIS = (
    "analysis_id long, content_id long, topic_id long, model string, prompt_version string, actor_type string, investor_level string, direction string, intent string,"
    " emotion struct<urgency:boolean,fear_of_missing:boolean,social_proof:boolean,price_chasing:boolean,regret:boolean,panic:boolean>, spam boolean, promotion boolean"
)
CONTENT = (
    "content_id long, source string, kind string, author_id long, published_at timestamp, likes long, favorites long, comments long, shares long, views long, is_deleted boolean"
)
FOMO = (True, True, True, False, False, False)
CALM = (False,) * 6


def post(i, at, author=1, kind="post", likes=0):
    return (i, "s", kind, author, at, likes, None, None, None, None, False)


def row(i, content, actor="retail", intent="buy", topic=None, model="m", prompt="p", emotion=CALM, spam=False, promotion=False, direction="neutral", level="unknown"):
    return (i, content, topic, model, prompt, actor, level, direction, intent, emotion, spam, promotion)


def frames(spark, posts, analyses, topics=(), assets=(), links=()):
    return (
        spark.createDataFrame(posts, CONTENT), spark.createDataFrame(list(topics), "content_id long, topic_id long"),
        spark.createDataFrame(list(assets), "content_id long, asset_id long"), spark.createDataFrame(list(links), "asset_id long, topic_id long"),
        spark.createDataFrame(analyses, ANALYSIS),
    )


def test_retail_and_media_count_apart(spark, at):
    when = at("2026-07-01T01:00:00")
    f = frames(spark, [post(1, when, 1), post(2, when, 2)], [row(1, 1), row(2, 2, actor="media")])
    got = mt.platform_metrics(*f, size="1d").first()
    assert (got.post_count, got.retail_count, got.buy_intent_count, got.unique_author_count) == (2, 1, 1, 2)


def test_promotion_leaves_all_retail_counters(spark, at):
    f = frames(spark, [post(1, at("2026-07-01T01:00:00"))], [row(1, 1, emotion=FOMO, promotion=True, direction="bullish")])
    got = mt.platform_metrics(*f).first()
    assert (got.post_count, got.retail_count, got.buy_intent_count, got.fomo_count, got.bullish_count) == (1, 0, 0, 0, 0)


def test_bullish_does_not_need_a_retail_author(spark, at):
    f = frames(spark, [post(1, at("2026-07-01T01:00:00"))], [row(1, 1, actor="kol", direction="bullish")])
    got = mt.platform_metrics(*f).first()
    assert (got.retail_count, got.bullish_count) == (0, 1)


def test_until_is_inclusive(spark, at):
    f = frames(spark, [post(1, at("2026-07-01T01:00:00")), post(2, at("2026-07-01T02:00:00"))], [row(1, 1)])
    bound = F.lit("2026-07-01 01:00:00").cast("timestamp")
    assert mt.platform_metrics(*f, until=bound).agg(F.sum("post_count")).first()[0] == 1


def test_entity_keys_cross_and_fall_back(spark, at):
    when = at("2026-07-01T01:00:00")
    f = frames(
        spark, [post(i, when) for i in (1, 2, 3, 4, 5)], [row(1, 1)], topics=[(1, 1), (1, 2), (2, 1)], assets=[(1, 7), (3, 7), (3, 8), (4, 9)], links=[(7, 5), (8, 6)],
    )
    keyed = mt.entity_keys(f[0].select("content_id"), *f[1:4]).withColumn("t", F.explode_outer("topics")).withColumn("a", F.explode_outer("assets"))
    pairs = {}
    for r in keyed.collect():
        pairs.setdefault(r.content_id, set()).add((r.t, r.a))
    assert pairs[1] == {(1, 7), (2, 7)} and pairs[2] == {(1, None)} and pairs[5] == {(None, None)}
    assert pairs[3] == {(5, 7), (6, 7), (5, 8), (6, 8)}
    assert pairs[4] == {(None, 9)}


def test_ratio_denominators(spark):
    columns = "post_count long, comment_count long, unique_author_count long, retail_count long, novice_count long, fomo_count long, panic_count long, buy_intent_count long, sell_intent_count long, engagement_sum double"
    df = spark.createDataFrame([(20, 0, 5, 10, 6, 4, 0, 4, 2, 1.0), (1, 0, 1, 0, 0, 0, 0, 0, 0, 0.0)], columns)
    got = df.select(*[v.alias(k) for k, v in mt.metric_values().items()]).collect()
    assert [round(got[0][n], 6) for n in ("novice_ratio", "fomo_ratio", "buy_intent_ratio", "sell_intent_ratio")] == [0.3, 0.2, 0.4, 0.2]
    assert got[1].buy_intent_ratio == 0.0


def test_tiers_in_order(spark):
    rows = [
        ("gpt-5.6-sol-via-codex-cli", "codex-content-review-v4:a"), ("x-via-openai-compatible", "evidence-content-review-v3:a"), ("GPT-5.6-sol-via-codex-cli", "codex-content-review-v3:a"),
        ("gpt-5.6-sol-via-codex-cli", "codex-content-review-v2:a"), ("x-via-openai-compatible", "evidence-content-review-v2:a"), ("gpt-5.6-terra-via-codex-cli", "q"),
        ("other-via-codex-cli", "q"), ("plain", "q"), ("rule-based-v0", "q"),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, p string").select(an.analysis_tier(F.col("m"), F.col("p"))).collect()]
    assert got == [475, 460, 450, 400, 350, 300, 250, 200, 0]


def test_own_topic_beats_tier_and_no_topic_takes_the_best(spark):
    analyses = spark.createDataFrame(
        [row(1, 1, intent="sell", model="x-via-openai-compatible", prompt="evidence-content-review-v3:a"), row(2, 1, intent="hold", topic=4, model="rule-based-v0"), row(3, 2, intent="wait", topic=9)], ANALYSIS
    )
    pairs = spark.createDataFrame([(1, 4), (1, 5), (2, 4)], "content_id long, topic_id long")
    got = {(r.content_id, r.topic_id): r.analysis.intent if r.analysis else None for r in an.preferred_analyses(pairs, analyses).collect()}
    assert got == {(1, 4): "hold", (1, 5): "sell", (2, 4): None}
    best = an.effective_by_content(analyses).select("content_id", an.pick_effective(F.lit(None).cast("long")).alias("a"))
    assert {r.content_id: r.a.intent for r in best.collect()} == {1: "sell", 2: "wait"}


def series(spark, values, start="2026-01-01"):
    from datetime import datetime, timedelta, timezone

    first = datetime.fromisoformat(start).replace(tzinfo=timezone.utc)
    columns = "bucket_at timestamp, bucket_size string, source string, topic_id long, asset_id long, post_count long, comment_count long, unique_author_count long, retail_count long, novice_count long, fomo_count long, panic_count long, buy_intent_count long, sell_intent_count long, engagement_sum double"
    return spark.createDataFrame([(first + timedelta(days=i), "1d", "s", 1, None, v, 0, 1, 0, 0, 0, 0, 0, 0, 0.0) for i, v in enumerate(values) if v is not None], columns)


def test_baseline_excludes_the_current_bucket(spark):
    got = mt.metric_signals(series(spark, [1] * 14 + [100])).where("metric_name = 'post_count'").orderBy(F.desc("bucket_at")).first()
    assert got.percentile == 1.0 and got.robust_z is None and got.zscore is None


def test_baseline_needs_fourteen_rows_inside_thirty_days(spark):
    rows = mt.metric_signals(series(spark, [1, 2] * 7 + [3])).where("metric_name = 'post_count'").orderBy("bucket_at").collect()
    assert [r.percentile is not None for r in rows] == [False] * 14 + [True]
    gap = mt.metric_signals(series(spark, [1, 2] * 7 + [None] * 20 + [3])).where("metric_name = 'post_count'").orderBy(F.desc("bucket_at")).first()
    assert gap.percentile is None
