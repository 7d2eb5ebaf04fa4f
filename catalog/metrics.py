"""Queries over posts, their analyses, bucket metrics and baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import n, query, r6, secs
from catalog.standins import DAILY, HOURLY, daily, hourly, metrics_cte, signals_cte
from murmur.operators import analysis as an
from murmur.operators import metrics as mt
from murmur.plans.pipeline import refresh_sums
from murmur.session import ensure_checkpoint_dir
from murmur.sources.store import PART, Run, Store

COUNTERS = (
    "post_count", "comment_count", "unique_author_count", "retail_count", "novice_count", "bullish_count",
    "bearish_count", "buy_intent_count", "sell_intent_count", "fomo_count", "panic_count",
)


def metrics_of(domain, **kwargs):
    d = domain
    return mt.platform_metrics(d.content, d.content_topic, d.content_asset, d.asset_topic, d.analysis, size=d.size, **kwargs)


def _keys():
    return [secs("bucket_at"), "source", n("topic_id"), n("asset_id")]


@query(
    "w01_preferred_analysis",
    f"WITH {HOURLY} SELECT ct.content_id, ct.topic_id, p.analysis_id, p.actor_type, p.intent, p.fomo_flags, p.panic"
    " FROM content_topic ct LEFT JOIN preferred p ON p.content_id = ct.content_id AND p.pair_topic = ct.topic_id",
)
def w01(spark, sf):
    d = hourly(spark, sf)
    return an.preferred_analyses(d.content_topic, d.analysis).select(
        "content_id", "topic_id", "analysis.analysis_id", "analysis.actor_type", "analysis.intent",
        n("analysis.fomo_flags", "fomo_flags"), "analysis.panic",
    )


@query(
    "j05_entity_keys",
    f"WITH {HOURLY}, {metrics_cte()} SELECT topic_id, asset_id, count(*) AS pairs, count(DISTINCT content_id) AS contents FROM keys GROUP BY ALL",
)
def j05(spark, sf):
    d = hourly(spark, sf)
    keyed = mt.entity_keys(d.content.select("content_id"), d.content_topic, d.content_asset, d.asset_topic)
    pairs = keyed.withColumn("topic_id", F.explode_outer("topics")).withColumn("asset_id", F.explode_outer("assets"))
    return pairs.groupBy("topic_id", "asset_id").agg(
        F.count("*").alias("pairs"), F.countDistinct("content_id").alias("contents")
    )


_METRICS_SQL = "SELECT CAST(epoch(bucket_at) AS BIGINT) AS bucket_at, source, topic_id, asset_id, " + ", ".join(COUNTERS) + ", round(engagement_sum, 6) AS engagement_sum FROM metrics"


@query("a01_platform_metrics", f"WITH {HOURLY}, {metrics_cte()} {_METRICS_SQL}")
def a01(spark, sf):
    return metrics_of(hourly(spark, sf)).select(*_keys(), *[n(c) for c in COUNTERS], r6("engagement_sum"))


@query("a01_platform_metrics_daily", f"WITH {DAILY}, {metrics_cte()} {_METRICS_SQL}")
def a01_daily(spark, sf):
    return metrics_of(daily(spark, sf)).select(*_keys(), *[n(c) for c in COUNTERS], r6("engagement_sum"))


@query(
    "a02_metric_values",
    f"WITH {HOURLY}, {metrics_cte()}, {signals_cte()} SELECT CAST(epoch(bucket_at) AS BIGINT) AS bucket_at, source, topic_id, asset_id,"
    " metric_name, round(raw_value, 6) AS raw_value FROM long",
)
def a02(spark, sf):
    return mt.metrics_long(metrics_of(hourly(spark, sf))).select(*_keys(), "metric_name", r6("raw_value"))


_SIGNAL_SQL = (
    "SELECT CAST(epoch(bucket_at) AS BIGINT) AS bucket_at, source, topic_id, asset_id, metric_name, round(raw_value, 6) AS raw_value,"
    " round(zscore, 6) AS zscore, round(robust_z, 6) AS robust_z, round(percentile, 6) AS percentile FROM signals"
)


def _signal_columns(df):
    return df.select(*_keys(), "metric_name", r6("raw_value"), r6("zscore"), r6("robust_z"), r6("percentile"))


@query("w02_signal_baseline", f"WITH {HOURLY}, {metrics_cte()}, {signals_cte()} {_SIGNAL_SQL}")
def w02(spark, sf):
    return _signal_columns(mt.metric_signals(metrics_of(hourly(spark, sf))))


@query("w02_signal_baseline_daily", f"WITH {DAILY}, {metrics_cte()}, {signals_cte()} {_SIGNAL_SQL}")
def w02_daily(spark, sf):
    return _signal_columns(mt.metric_signals(metrics_of(daily(spark, sf))))


def _store_after_two_runs(spark, sf):
    """Posts arrive in two runs, late ones among the second; only the days they reach are summed again."""
    ensure_checkpoint_dir(spark)
    d, store = hourly(spark, sf), Store(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    day = F.to_date("published_at").cast("string")
    tags = lambda df, kind, entity: df.select("content_id", F.lit(kind).alias("entity_type"), F.col(entity).alias("entity_id"))
    entity = tags(d.content_topic, "topic", "topic_id").unionByName(tags(d.content_asset, "asset", "asset_id"))
    entity = entity.join(d.content.select("content_id", day.alias(PART)), "content_id")
    late = d.content.select(F.percentile_approx("published_at", 0.8).alias("cut"), F.percentile_approx("published_at", 0.5).alias("half"), F.percentile_approx("published_at", 0.52).alias("end"))
    cut, half, end = (F.lit(v) for v in late.first())
    second = (F.col("published_at") > cut) | F.col("published_at").between(half, end)
    store.write("content_analysis", d.analysis)
    store.write("asset_topic", d.asset_topic)
    run = Run(store)
    run.write_parts("content", d.content.where(~second).withColumn(PART, day))
    run.write_parts("content_entity", entity)
    refresh_sums(run, (d.size,))
    run.commit()
    run, arrived = Run(store), d.content.where(second)
    days = [r[0] for r in arrived.select(day).distinct().collect()]
    run.write_parts("content", run.read("content", days).unionByName(arrived).withColumn(PART, day), days)
    refresh_sums(run, (d.size,), arrived.select("published_at"))
    run.commit()
    return store


@query("a01_metrics_after_two_runs", f"WITH {HOURLY}, {metrics_cte()} {_METRICS_SQL}")
def a01_two_runs(spark, sf):
    return _store_after_two_runs(spark, sf).read("platform_metric").select(*_keys(), *[n(c) for c in COUNTERS], r6("engagement_sum"))


@query("f01_signals_after_two_runs", f"WITH {HOURLY}, {metrics_cte()}, {signals_cte()} {_SIGNAL_SQL}")
def f01_signals(spark, sf):
    return _signal_columns(_store_after_two_runs(spark, sf).read("metric_signal"))


_P = "SELECT CAST(epoch(m.bucket_at) AS BIGINT) AS bucket_at, m.source, m.topic_id, m.asset_id, m.post_count, m.retail_count"


@query(
    "j23_metrics_with_percentiles",
    f"""WITH {HOURLY}, {metrics_cte()}, {signals_cte()},
    newest AS (SELECT * FROM metrics ORDER BY bucket_at DESC, source NULLS FIRST, topic_id NULLS FIRST, asset_id NULLS FIRST LIMIT 200)
    {_P}, round(max(s.percentile) FILTER (metric_name = 'novice_ratio'), 6) AS novice_percentile,
      round(max(s.percentile) FILTER (metric_name = 'fomo_ratio'), 6) AS fomo_percentile,
      round(max(s.percentile) FILTER (metric_name = 'post_count'), 6) AS attention_percentile
    FROM newest m LEFT JOIN signals s ON s.bucket_at = m.bucket_at AND s.source = m.source
      AND s.topic_id IS NOT DISTINCT FROM m.topic_id AND s.asset_id IS NOT DISTINCT FROM m.asset_id
    GROUP BY m.bucket_at, m.source, m.topic_id, m.asset_id, m.post_count, m.retail_count""",
)
def j23(spark, sf):
    metrics = metrics_of(hourly(spark, sf))
    page = mt.metrics_with_percentiles(metrics, mt.metric_signals(metrics), size="1h", limit=200)
    return page.select(
        *_keys(), n("post_count"), n("retail_count"),
        r6("novice_percentile"), r6("fomo_percentile"), r6("attention_percentile"),
    )


_FACETS = ", ".join(
    f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS \"{name}\""
    for name, cond in {
        "all": "true", "retail": "retail", "buy": "retail AND intent = 'buy'", "sell": "retail AND intent = 'sell'",
        "hold": "retail AND intent = 'hold'", "wait": "retail AND intent = 'wait'", "fomo": "retail AND fomo_flags >= 3",
        "panic": "retail AND panic", "promotion": "promotion",
    }.items()
)


@query(
    "p07_content_filters",
    f"""WITH {HOURLY} SELECT ct.topic_id, {_FACETS} FROM content_topic ct
    LEFT JOIN preferred p ON p.content_id = ct.content_id AND p.pair_topic = ct.topic_id GROUP BY ct.topic_id""",
)
def p07(spark, sf):
    d = hourly(spark, sf)
    rows = an.preferred_analyses(d.content_topic, d.analysis)
    return rows.groupBy("topic_id").agg(*[F.sum(an.content_filter(f).cast("long")).alias(f) for f in an.CONTENT_FILTERS])
