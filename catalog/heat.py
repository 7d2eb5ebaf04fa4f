"""Queries over topic and market heat and external attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, r6, secs, table
from catalog.standins import BARS, DAILY, HOURLY, TRENDS, asset_topic, daily, heat_cte, hourly, market_bars, trend_observations
from murmur.functions.timeutil import shanghai_date
from murmur.operators import heat as ht
from murmur.operators import reads as rd
from murmur.operators import trends as tr

_STATS = ("attention", "post_count", "comment_count", "unique_author_count", "source_count", "analyzed_count", "retail_count",
          "novice_count", "buy_intent_count", "sell_intent_count", "fomo_count", "panic_count")
_HISTORY_COUNTS = ("attention", "previous_attention", "retail_count", "baseline_days", "week_days", "previous_week_days", "month_days", "previous_month_days")
_HISTORY_VALUES = ("heat_index", "historical_percentile", "change_ratio", "week_index", "previous_week_index", "month_index", "previous_month_index",
                   "week_retail_average", "day_delta", "week_delta", "month_delta")
_AT = "CAST(epoch(bucket_at) AS BIGINT) AS bucket_at"
_HISTORY_SQL = (
    ", ".join(_HISTORY_COUNTS) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _HISTORY_VALUES)
    + ", round(round(score, 6), 1) AS trend_score, index_confidence, trend,"
    " CASE WHEN score IS NULL THEN 'insufficient' WHEN score >= 12 THEN 'accelerating' WHEN score >= 4 THEN 'rising' WHEN score <= -12 THEN 'cooling_fast' WHEN score <= -4 THEN 'cooling' ELSE 'stable' END AS trend_direction FROM heat"
)


def _stats(spark, sf):
    d = daily(spark, sf)
    return ht.topic_stats(d.content, d.content_topic, d.analysis)


def _history_columns(df, *keys):
    return df.select(
        *[n(k) for k in keys], secs("bucket_at"), *[n(c) for c in _HISTORY_COUNTS], *[r6(c) for c in _HISTORY_VALUES],
        "trend_score", "index_confidence", "trend", "trend_direction",
    )


@query("a03_topic_day_stats", f"WITH {DAILY}, {heat_cte()} SELECT topic_id, {_AT}, {', '.join(_STATS)}, round(engagement_sum, 6) AS engagement_sum, round(analysis_coverage, 6) AS analysis_coverage FROM indexed")
def a03(spark, sf):
    return _stats(spark, sf).select("topic_id", secs("bucket_at"), *[n(c) for c in _STATS], r6("engagement_sum"), r6("analysis_coverage"))


@query("a04_market_day_stats", f"WITH {DAILY}, {heat_cte('market')} SELECT {_AT}, {', '.join(_STATS)}, round(engagement_sum, 6) AS engagement_sum FROM indexed")
def a04(spark, sf):
    d = daily(spark, sf)
    stats = ht.market_stats(d.content, d.content_topic, d.analysis)
    return stats.select(secs("bucket_at"), *[n(c) for c in _STATS], r6("engagement_sum"))


@query("a05_topic_series", f"WITH {DAILY}, {heat_cte()} SELECT {_AT}, {', '.join(_STATS)} FROM indexed WHERE topic_id = 3 ORDER BY bucket_at DESC LIMIT 500")
def a05(spark, sf):
    return rd.topic_series(_stats(spark, sf), 3).select(secs("bucket_at"), *[n(c) for c in _STATS])


@query("x17_daily_heat", f"WITH {DAILY}, {heat_cte()} SELECT topic_id, {_AT}, heat_index, index_confidence FROM heat")
def x17(spark, sf):
    rows = _stats(spark, sf)
    return rows.select("topic_id", secs("bucket_at"), ht.heat_index().alias("heat_index"), ht.index_confidence().alias("index_confidence"))


@query("w14_heat_history", f"WITH {DAILY}, {heat_cte()} SELECT topic_id, {_AT}, {_HISTORY_SQL}")
def w14(spark, sf):
    return _history_columns(ht.history(_stats(spark, sf), ["topic_id"]), "topic_id")


@query("w14_market_heat_history", f"WITH {DAILY}, {heat_cte('market')} SELECT {_AT}, {_HISTORY_SQL}")
def w14_market(spark, sf):
    d = daily(spark, sf)
    return _history_columns(ht.history(ht.market_stats(d.content, d.content_topic, d.analysis), []))


_DAY = "1998-06-15"


@query(
    "r01_topic_overview",
    f"""WITH {DAILY}, {heat_cte()}, cut AS (SELECT TIMESTAMP '{_DAY}' - INTERVAL 8 HOUR AS cut_at),
    inside AS (SELECT i.* FROM indexed i, cut WHERE bucket_at <= cut_at AND bucket_at >= cut_at - INTERVAL 89 DAY),
    ranked AS (SELECT i.*, list(heat_index) FILTER (heat_index IS NOT NULL) OVER (PARTITION BY topic_id ORDER BY bucket_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS prior, date_diff('day', bucket_at, cut_at) AS o FROM inside i, cut),
    pct AS (SELECT *, CASE WHEN heat_index IS NOT NULL AND len(prior) >= 5 THEN round((len(list_filter(prior, lambda v: v < heat_index)) + len(list_filter(prior, lambda v: v = heat_index)) / 2) / len(prior) * 100, 1) END AS p FROM ranked),
    flat AS (SELECT topic_id, max(heat_index) FILTER (o = 0) AS heat_index, max(heat_index) FILTER (o = 1) AS y, max(p) FILTER (o = 0) AS historical_percentile,
      coalesce(max(attention) FILTER (o = 0), 0) AS attention, coalesce(max(attention) FILTER (o = 1), 0) AS previous_attention, coalesce(max(retail_count) FILTER (o = 0), 0) AS retail_count,
      count(*) FILTER (o < 30) AS observed_days, count(*) FILTER (o < 30 AND analyzed_count > 0) AS analyzed_days, count(*) FILTER (o < 30 AND p IS NOT NULL) AS percentile_days,
      count(*) FILTER (o < 30 AND p IS NULL AND heat_index IS NOT NULL) AS warming_up_days,
      round(round(avg(heat_index) FILTER (o BETWEEN 0 AND 6), 6), 1) AS week_index, round(round(avg(heat_index) FILTER (o BETWEEN 7 AND 13), 6), 1) AS previous_week_index,
      count(heat_index) FILTER (o BETWEEN 0 AND 6) AS wn, count(heat_index) FILTER (o BETWEEN 7 AND 13) AS pwn,
      round(round(avg(heat_index) FILTER (o BETWEEN 0 AND 29), 6), 1) AS month_index, round(round(avg(heat_index) FILTER (o BETWEEN 30 AND 59), 6), 1) AS previous_month_index,
      count(heat_index) FILTER (o BETWEEN 0 AND 29) AS mn, count(heat_index) FILTER (o BETWEEN 30 AND 59) AS pmn
      FROM pct GROUP BY 1)
    SELECT t.topic_id, heat_index, historical_percentile, coalesce(attention, 0) AS attention, coalesce(previous_attention, 0) AS previous_attention, coalesce(retail_count, 0) AS retail_count,
      coalesce(observed_days, 0) AS observed_days, coalesce(analyzed_days, 0) AS analyzed_days, coalesce(percentile_days, 0) AS percentile_days, coalesce(warming_up_days, 0) AS warming_up_days,
      week_index, previous_week_index, month_index, previous_month_index, round(heat_index - y, 1) AS day_delta,
      CASE WHEN wn >= 2 AND pwn >= 2 THEN round(week_index - previous_week_index, 1) END AS week_delta, CASE WHEN mn >= 5 AND pmn >= 5 THEN round(month_index - previous_month_index, 1) END AS month_delta,
      CASE WHEN coalesce(observed_days, 0) = 0 THEN 'empty' WHEN percentile_days = 0 THEN 'warming_up' WHEN percentile_days < 30 THEN 'partial' ELSE 'complete' END AS coverage_status
    FROM (SELECT range AS topic_id FROM range(1, 10)) t LEFT JOIN flat USING (topic_id)""",
)
def r01(spark, sf):
    """Nine registered topics, of which the ninth has no posts at all."""
    d = daily(spark, sf)
    stats = ht.topic_stats(d.content, d.content_topic, d.analysis)
    at = F.to_utc_timestamp(F.lit(_DAY).cast("timestamp"), "Asia/Shanghai")
    spine = spark.range(1, 10).withColumnRenamed("id", "topic_id")
    return ht.overview_at(stats, ["topic_id"], spine, at).select(
        "topic_id", "heat_index", "historical_percentile", n("attention"), n("previous_attention"), n("retail_count"), n("observed_days"),
        n("analyzed_days"), n("percentile_days"), n("warming_up_days"), "week_index", "previous_week_index", "month_index", "previous_month_index",
        "day_delta", "week_delta", "month_delta", "coverage_status",
    )


@query("a23_latest_activity", f"WITH {HOURLY} SELECT topic_id, CAST(floor(epoch(max(published_at))) AS BIGINT) AS latest_activity_at FROM content_topic JOIN content USING (content_id) GROUP BY 1")
def a23(spark, sf):
    d = hourly(spark, sf)
    return ht.latest_activity(d.content, d.content_topic).select("topic_id", secs("latest_activity_at"))


@query(
    "o07_topic_ranking",
    f"WITH {HOURLY} SELECT topic_id, count(*) FILTER (retail AND intent = 'buy') AS buy_intent_count, row_number() OVER (ORDER BY count(*) FILTER (retail AND intent = 'buy') DESC, topic_id) AS position"
    " FROM preferred JOIN content_topic ct ON ct.content_id = preferred.content_id AND ct.topic_id = pair_topic GROUP BY 1",
)
def o07(spark, sf):
    d = hourly(spark, sf)
    return rd.topic_ranking(d.content_topic, d.analysis).select("topic_id", F.col("posts").alias("buy_intent_count"), n("position"))


_TREND_SQL = (
    "SELECT observation_id, topic_id, keyword, CAST(epoch(observed_at) AS BIGINT) AS observed_at, raw_value, round(change_ratio, 6) AS change_ratio,"
    " round(zscore, 6) AS zscore, round(robust_z, 6) AS robust_z, round(percentile, 6) AS percentile FROM trend"
)


def _trend_columns(df):
    return df.select("observation_id", "topic_id", "keyword", secs("observed_at"), "raw_value", r6("change_ratio"), r6("zscore"), r6("robust_z"), r6("percentile"))


@query("w06_trend_signals", f"WITH {TRENDS} {_TREND_SQL}")
def w06(spark, sf):
    return _trend_columns(tr.trend_signals(trend_observations(spark, sf)))


@query("j25_trend_snapshot", f"WITH {TRENDS} {_TREND_SQL} ORDER BY observed_at DESC, observation_id DESC LIMIT 200")
def j25(spark, sf):
    obs = trend_observations(spark, sf)
    return _trend_columns(tr.trend_snapshot(obs, tr.trend_signals(obs), all_topics=True))


@query(
    "a11_topic_attention",
    f"""WITH {TRENDS}, days AS (SELECT topic_id, CAST(observed_at AS DATE) AS day, sum(raw_value) AS value, avg(percentile) AS percentile, string_agg(keyword, ' / ' ORDER BY keyword) AS keyword FROM trend GROUP BY ALL)
    SELECT topic_id, day, value, round(percentile, 6) AS percentile, keyword, round(CASE WHEN lag(value) OVER g <> 0 THEN (value - lag(value) OVER g) / lag(value) OVER g END, 6) AS change_ratio
    FROM days WINDOW g AS (PARTITION BY topic_id ORDER BY day)""",
)
def a11(spark, sf):
    return tr.topic_attention(tr.trend_signals(trend_observations(spark, sf))).select("topic_id", "day", "value", r6("percentile"), "keyword", r6("change_ratio"))


@query(
    "a11_market_attention",
    f"""WITH {TRENDS}, days AS (SELECT CAST(observed_at AS DATE) AS day, sum(raw_value) AS value, avg(percentile) AS percentile, count(DISTINCT topic_id) AS topic_count, count(*) AS keyword_count FROM trend GROUP BY ALL)
    SELECT day, value, round(percentile, 6) AS percentile, topic_count, keyword_count, round((value - lag(value) OVER g) / lag(value) OVER g, 6) AS change_ratio FROM days WINDOW g AS (ORDER BY day)""",
)
def a11_market(spark, sf):
    return tr.market_attention(tr.trend_signals(trend_observations(spark, sf))).select("day", "value", r6("percentile"), n("topic_count"), n("keyword_count"), r6("change_ratio"))


@query(
    "i07_pageview_series",
    """WITH items AS (SELECT o_orderstatus AS project, o_orderpriority AS article, CAST(o_orderdate AS DATE) AS day, count(*) AS views FROM orders WHERE o_totalprice > 200000 GROUP BY ALL),
    avail AS (SELECT DISTINCT o_orderstatus AS project, CAST(o_orderdate AS DATE) AS day FROM orders),
    spine AS (SELECT project, article, CAST(d AS DATE) AS day FROM (SELECT DISTINCT project, article FROM items), range(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 1 DAY) r(d))
    SELECT s.project, s.article, s.day, CASE WHEN a.day IS NOT NULL THEN CAST(coalesce(i.views, 0) AS DOUBLE) END AS value, a.day IS NULL AS pending
    FROM spine s LEFT JOIN avail a USING (project, day) LEFT JOIN items i USING (project, article, day)""",
)
def i07(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("project"), F.col("o_orderpriority").alias("article"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    items = orders.where(F.col("o_totalprice") > 200000).groupBy("project", "article", "day").agg(F.count("*").alias("views"))
    observed, pending = tr.pageview_series(items, orders, first_day="1995-01-01", last_day="2001-08-01")
    return observed.select("project", "article", "day", "value", F.lit(False).alias("pending")).unionByName(
        pending.select("project", "article", "day", F.lit(None).cast("double").alias("value"), F.lit(True).alias("pending"))
    )


@query(
    "j24_chart_points",
    f"""WITH {DAILY}, {heat_cte()}, {TRENDS}, {BARS},
    views AS (SELECT topic_id, CAST(observed_at AS DATE) AS day, sum(raw_value) AS views, avg(percentile) AS vp FROM trend GROUP BY ALL),
    price AS (SELECT asset_id AS topic_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, close FROM bars),
    h AS (SELECT topic_id, CAST(bucket_at + INTERVAL 8 HOUR AS DATE) AS day, heat_index, historical_percentile FROM heat)
    SELECT topic_id, day, heat_index, historical_percentile, views, round(close, 8) AS close,
      CASE WHEN vp IS NULL OR historical_percentile IS NULL THEN 'awaiting_both' WHEN vp * 100 >= 80 AND historical_percentile >= 80 THEN 'resonance'
        WHEN vp * 100 >= 80 AND historical_percentile < 50 THEN 'external_leads' WHEN vp * 100 < 40 AND historical_percentile >= 70 THEN 'crowd_leads' ELSE 'in_step' END AS agreement
    FROM h FULL JOIN views USING (topic_id, day) FULL JOIN price USING (topic_id, day)""",
)
def j24(spark, sf):
    """Bars of asset n stand for topic n."""
    heat = ht.history(_stats(spark, sf), ["topic_id"])
    attention = tr.topic_attention(tr.trend_signals(trend_observations(spark, sf)))
    points = tr.chart_points(heat, attention, market_bars(spark, sf).withColumnRenamed("asset_id", "topic_id"))
    return points.select(
        "topic_id", "day", "heat_index", "historical_percentile", "views", F.round("close", 8).alias("close"),
        tr.attention_agreement(F.col("views_percentile"), F.col("historical_percentile")).alias("agreement"),
    )
