"""Queries over statistics, rank correlation and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, r6, secs, table
from catalog.events import _DAILY_EVENTS, daily_returns
from catalog.standins import BARS, RETURNS, asset_topic
from murmur.operators import studies as st

_STAT = (
    "count(x) AS \"N\", round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, round(avg(CASE WHEN x > 0 THEN 1.0 WHEN x <= 0 THEN 0.0 END), 6) AS hit_rate,"
    " round(avg(x) - CASE WHEN count(x) = 1 THEN 0 ELSE 1.96 * stddev_pop(x) / sqrt(count(x)) END, 6) AS ci_low, round(avg(x) + CASE WHEN count(x) = 1 THEN 0 ELSE 1.96 * stddev_pop(x) / sqrt(count(x)) END, 6) AS ci_high"
)


def _stat_columns():
    return [n("N"), *[r6(c) for c in ("mean", "median", "std", "hit_rate", "ci_low", "ci_high")]]


@query("a12_summaries", f"WITH v AS (SELECT l_returnflag, l_discount - l_tax AS x FROM lineitem) SELECT l_returnflag, {_STAT} FROM v GROUP BY 1")
def a12(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") - F.col("l_tax")).alias("x"))
    return st.summarize(rows, ["l_returnflag"], "x").select("l_returnflag", *_stat_columns())


@query(
    "a13_spearman",
    """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem)
    SELECT l_returnflag, count(*) AS pairs, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
)
def a13(spark, sf):
    return st.spearman(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "pairs", r6("spearman"))


@query(
    "w10_average_rank",
    "SELECT o_orderstatus, o_totalprice, round(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2, 6) AS mid_rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_totalprice) = 1",
)
def w10(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_totalprice").agg(F.count("*").alias("w"))
    return st.average_rank(counts, ["o_orderstatus"], "o_totalprice", "w", "mid_rank").select("o_orderstatus", "o_totalprice", r6("mid_rank"))


@query(
    "w11_quintiles",
    "SELECT o_orderkey, least(4, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1) * 5 // count(*) OVER (PARTITION BY o_orderstatus)) + 1 AS quintile FROM orders",
)
def w11(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return st.quintiles(rows, ["o_orderstatus"], ["o_totalprice", "o_orderkey"]).select("o_orderkey", n("quintile"))


def _reference(spark):
    """Topic 2 names its reference asset; the others take their lowest link."""
    configured = spark.createDataFrame([(2, 2, 0)], "topic_id long, asset_id long, position int")
    return st.reference_assets(spark.range(1, 9).withColumnRenamed("id", "topic_id"), asset_topic(spark), configured)


_REFERENCE = ", ref AS (SELECT topic_id, CASE WHEN topic_id = 2 THEN 2 ELSE arg_min(asset_id, link_id) END AS reference FROM asset_topic GROUP BY 1)"


@query("r15_reference_assets", "WITH l AS (SELECT a * 2 AS link_id, a AS asset_id, a AS topic_id FROM range(1, 7) r(a) UNION ALL SELECT a * 2 + 1, a, a % 8 + 1 FROM range(1, 7) r(a)),"
       " o AS (SELECT DISTINCT o_orderkey % 8 + 1 AS topic_id FROM orders) SELECT topic_id, arg_min(asset_id, link_id) AS reference_asset_id FROM o LEFT JOIN l USING (topic_id) GROUP BY 1")
def r15(spark, sf):
    topics = table(spark, sf, "orders").select((F.col("o_orderkey") % 8 + 1).alias("topic_id")).distinct()
    return st.reference_assets(topics, asset_topic(spark))


@query(
    "r10_event_study",
    _DAILY_EVENTS + f", {BARS}, {RETURNS}{_REFERENCE}" + f""",
    rows AS (SELECT e.topic_id, e.event_type, p.horizon, unnest(['raw_return', 'market_abnormal_return', 'sector_abnormal_return']) AS return_kind,
      unnest([p.raw_return, p.raw_return - p.market_return, p.raw_return - p.sector_return]) AS x FROM sig_events e JOIN ref USING (topic_id) JOIN paid p ON p.event_key = e.event_key AND p.asset_id = ref.reference)
    SELECT topic_id, event_type, horizon, return_kind, {_STAT} FROM rows GROUP BY ALL""",
)
def r10(spark, sf):
    events, _, returns = daily_returns(spark, sf)
    summaries, _ = st.event_study(events, returns, _reference(spark))
    return summaries.select(n("topic_id"), "event_type", "horizon", "return_kind", *_stat_columns())


@query(
    "a21_study_readiness",
    _DAILY_EVENTS + f", {BARS}, {RETURNS}{_REFERENCE}" + """,
    f AS (SELECT topic_id, event_type, count(*) AS event_count, min(started_at) AS s, max(ended_at) AS u FROM sig_events WHERE topic_id IS NOT NULL GROUP BY ALL),
    g AS (SELECT e.topic_id, e.event_type, count(DISTINCT e.event_key) AS entry_event_count, count(*) AS return_rows, count(p.raw_return) AS mature_return_rows
      FROM sig_events e JOIN ref USING (topic_id) JOIN paid p ON p.event_key = e.event_key AND p.asset_id = ref.reference GROUP BY ALL)
    SELECT topic_id, event_type, event_count, CAST(epoch(s) AS BIGINT) AS period_from, CAST(epoch(u) AS BIGINT) AS period_until, coalesce(entry_event_count, 0) AS entry_event_count, coalesce(return_rows, 0) AS return_rows,
      coalesce(mature_return_rows, 0) AS mature_return_rows, CASE WHEN coalesce(return_rows, 0) = 0 THEN 'awaiting_entry' WHEN mature_return_rows = 0 THEN 'awaiting_maturity'
        WHEN event_count > entry_event_count OR return_rows > mature_return_rows THEN 'partially_mature' ELSE 'ready' END AS status
    FROM f LEFT JOIN g USING (topic_id, event_type)""",
)
def a21(spark, sf):
    events, _, returns = daily_returns(spark, sf)
    _, ready = st.event_study(events, returns, _reference(spark))
    return ready.select(
        n("topic_id"), "event_type", n("event_count"), secs("period_from"), secs("period_until"), n("entry_event_count"), n("return_rows"), n("mature_return_rows"), "status"
    )


_QUANTILE = """,
sig AS (SELECT e.topic_id, r.metric_name, e.event_key, r.bucket_at, r.raw_value FROM runs r JOIN sig_events e ON e.event_type = r.event_type AND e.source = r.source AND e.run = r.run
  AND e.topic_id IS NOT DISTINCT FROM r.topic_id AND e.asset_id IS NOT DISTINCT FROM r.asset_id WHERE e.topic_id IS NOT NULL),
q AS (SELECT s.*, p.event_key IS NOT NULL AS has_return, p.raw_return, p.raw_return - p.market_return AS abnormal FROM sig s JOIN ref USING (topic_id)
  LEFT JOIN paid p ON p.event_key = s.event_key AND p.asset_id = ref.reference AND p.horizon = '5d')
"""


@query(
    "r11_quantile_study",
    _DAILY_EVENTS + f", {BARS}, {RETURNS}{_REFERENCE}{_QUANTILE}" + f""",
    b AS (SELECT topic_id, metric_name, abnormal AS x, least(4, (row_number() OVER (PARTITION BY topic_id, metric_name ORDER BY raw_value, event_key, bucket_at) - 1) * 5 // count(*) OVER (PARTITION BY topic_id, metric_name)) + 1 AS quintile FROM q WHERE abnormal IS NOT NULL)
    SELECT topic_id, metric_name, quintile, {_STAT} FROM b GROUP BY ALL""",
)
def r11(spark, sf):
    events, links, returns = daily_returns(spark, sf)
    buckets, _ = st.quantile_study(st.quantile_rows(events, links, returns, _reference(spark)))
    return buckets.select(n("topic_id"), "metric_name", n("quintile"), *_stat_columns())


@query(
    "r11_quantile_overall",
    _DAILY_EVENTS + f", {BARS}, {RETURNS}{_REFERENCE}{_QUANTILE}" + """,
    k AS (SELECT topic_id, metric_name, rank() OVER (PARTITION BY topic_id, metric_name ORDER BY raw_value) + (count(*) OVER (PARTITION BY topic_id, metric_name, raw_value) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY topic_id, metric_name ORDER BY abnormal) + (count(*) OVER (PARTITION BY topic_id, metric_name, abnormal) - 1) / 2 AS ry FROM q WHERE abnormal IS NOT NULL),
    c AS (SELECT topic_id, metric_name, CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(rx) = 0 OR var_pop(ry) = 0 THEN 0.0 ELSE covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS rho FROM k GROUP BY ALL)
    SELECT topic_id, metric_name, count(DISTINCT event_key) AS linked_events, count(*) FILTER (has_return) AS return_rows, count(raw_return) AS raw_mature, count(abnormal) AS abnormal_mature, round(any_value(rho), 6) AS spearman,
      CASE WHEN count(*) FILTER (has_return) = 0 THEN 'awaiting_entry' WHEN count(raw_return) = 0 THEN 'awaiting_maturity' WHEN count(abnormal) = 0 THEN 'benchmark_unavailable' ELSE 'ready' END AS status
    FROM q LEFT JOIN c USING (topic_id, metric_name) GROUP BY ALL""",
)
def r11_overall(spark, sf):
    events, links, returns = daily_returns(spark, sf)
    _, overall = st.quantile_study(st.quantile_rows(events, links, returns, _reference(spark)))
    return overall.select(n("topic_id"), "metric_name", n("linked_events"), n("return_rows"), n("raw_mature"), n("abnormal_mature"), r6("spearman"), "status")
