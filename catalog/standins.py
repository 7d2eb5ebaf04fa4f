"""How the driver tables stand in for posts, analyses, bars and tasks (FIXTURES.md section 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import table
from murmur.operators.metrics import METRIC_NAMES


@dataclass
class Domain:
    content: DataFrame
    content_topic: DataFrame
    content_asset: DataFrame
    asset_topic: DataFrame
    analysis: DataFrame
    size: str


def asset_topic(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT CAST(id * 2 + t AS BIGINT) AS link_id, CAST(id AS BIGINT) AS asset_id,"
        " CAST(IF(t = 0, id, id % 8 + 1) AS BIGINT) AS topic_id"
        " FROM range(1, 7) LATERAL VIEW explode(array(0, 1)) AS t"
    )


def _domain(spark: SparkSession, content: DataFrame, size: str, dense: bool = False) -> Domain:
    first = F.col("k") % 8 + 1
    topics = F.when(
        F.col("k") < 96,
        F.when(F.col("k") % 3 == 0, F.array(first, first % 8 + 1)).otherwise(F.array(first)),
    )
    versions = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v")
    rows = content.select("content_id", "author_id", "k", versions).where(
        ((F.col("v") == 0) & (F.col("content_id") % 10 < 8))
        | ((F.col("v") == 1) & (F.col("content_id") % 3 == 0))
        | ((F.col("v") == 2) & (F.col("content_id") % 7 == 0))
    )
    h = (F.col("content_id") * 7919 + F.col("author_id") * 104729 + F.col("v") * 31) % 1009
    rows = rows.withColumn("h", h)

    def bit(i: int) -> Column:
        return (F.shiftright(F.col("h"), i) % 2) == 1

    def choose(modulus: int, *names: str) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("h") % modulus + 1).cast("int"))

    analysis = rows.select(
        (F.col("content_id") * 3 + F.col("v")).alias("analysis_id"),
        "content_id",
        F.when((F.col("v") == 2) & (F.col("k") < 96), F.col("k") % 8 + 1).alias("topic_id"),
        F.when(F.col("v") == 0, "rule-based-v0").when(F.col("v") == 1, "m-via-openai-compatible").otherwise("m2").alias("model"),
        F.when(F.col("v") == 1, "evidence-content-review-v3:x").otherwise("content-analysis-v1").alias("prompt_version"),
        F.when(F.col("h") < 700, "retail").when(F.col("h") < 800, "media").when(F.col("h") < 900, "kol").otherwise("unknown").alias("actor_type"),
        F.when(F.col("h") % 4 == 0, "novice").otherwise("unknown").alias("investor_level"),
        choose(3, "bullish", "bearish", "neutral").alias("direction"),
        choose(5, "buy", "sell", "hold", "wait", "unknown").alias("intent"),
        F.struct(
            bit(0).alias("urgency"), bit(1).alias("fear_of_missing"), bit(2).alias("social_proof"),
            bit(3).alias("price_chasing"), bit(4).alias("regret"), (bit(5) & bit(6)).alias("panic"),
        ).alias("emotion"),
        (F.col("h") % 29 == 0).alias("spam"),
        (F.col("h") % 23 == 0).alias("promotion"),
    )
    if dense:
        topics = F.array(F.col("k") % 2 + 1)
    return Domain(
        content=content,
        content_topic=content.select("content_id", F.explode(topics).alias("topic_id")),
        content_asset=content.where(F.col("k") == 24 if dense else F.col("k") % 4 == 0).select("content_id", (F.col("k") % 6 + 1).alias("asset_id")),
        asset_topic=asset_topic(spark),
        analysis=analysis,
        size=size,
    )


def _empty(name: str) -> Column:
    return F.lit(None).cast("long").alias(name)


def hourly(spark: SparkSession, sf_dir: str, dense: bool = False) -> Domain:
    """Posts from ``events``: one post per event. ``dense`` uses two topics, so that events occur."""
    k = F.get_json_object("props", "$.k").cast("long")
    content = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("content_id"),
        F.col("event_type").alias("source"),
        F.col("event_id").cast("string").alias("source_item_id"),
        F.when(k % 5 == 0, "comment").otherwise("post").alias("kind"),
        F.col("user_id").alias("author_id"),
        F.col("ts").alias("published_at"),
        F.floor("value").cast("long").alias("likes"), _empty("favorites"), (k % 10).alias("comments"),
        _empty("shares"), _empty("views"), F.lit(False).alias("is_deleted"), k.alias("k"),
    )
    return _domain(spark, content, "1h", dense)


def daily(spark: SparkSession, sf_dir: str, dense: bool = False) -> Domain:
    """Posts from ``orders``: one post per order, over about 2,400 days."""
    content = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("content_id"),
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderkey").cast("string").alias("source_item_id"),
        F.lit("post").alias("kind"),
        F.col("o_custkey").alias("author_id"),
        F.col("o_orderdate").alias("published_at"),
        F.floor("o_totalprice").cast("long").alias("likes"), _empty("favorites"), _empty("comments"),
        _empty("shares"), _empty("views"), F.lit(False).alias("is_deleted"), (F.col("o_orderkey") % 100).alias("k"),
    )
    return _domain(spark, content, "1d", dense)


_SHARED = """
content_topic AS (
  SELECT content_id, k % 8 + 1 AS topic_id FROM content WHERE k < 96
  UNION ALL SELECT content_id, (k % 8 + 1) % 8 + 1 FROM content WHERE k < 96 AND k % 3 = 0),
content_asset AS (SELECT content_id, k % 6 + 1 AS asset_id FROM content WHERE k % 4 = 0),
asset_topic AS (
  SELECT a * 2 AS link_id, a AS asset_id, a AS topic_id FROM range(1, 7) r(a)
  UNION ALL SELECT a * 2 + 1, a, a % 8 + 1 FROM range(1, 7) r(a)),
analysis0 AS (
  SELECT content_id, author_id, k, v, (content_id * 7919 + author_id * 104729 + v * 31) % 1009 AS h
  FROM content CROSS JOIN (VALUES (0), (1), (2)) t(v)
  WHERE (v = 0 AND content_id % 10 < 8) OR (v = 1 AND content_id % 3 = 0) OR (v = 2 AND content_id % 7 = 0)),
analysis AS (
  SELECT content_id * 3 + v AS analysis_id, content_id, CASE WHEN v = 2 AND k < 96 THEN k % 8 + 1 END AS topic_id,
    CASE v WHEN 0 THEN 0 WHEN 1 THEN 460 ELSE 200 END AS tier,
    CASE v WHEN 0 THEN 'rule-based-v0' WHEN 1 THEN 'm-via-openai-compatible' ELSE 'm2' END AS model,
    CASE v WHEN 1 THEN 'evidence-content-review-v3:x' ELSE 'content-analysis-v1' END AS prompt_version,
    CASE WHEN h < 700 THEN 'retail' WHEN h < 800 THEN 'media' WHEN h < 900 THEN 'kol' ELSE 'unknown' END AS actor_type,
    CASE WHEN h % 4 = 0 THEN 'novice' ELSE 'unknown' END AS investor_level,
    ['bullish', 'bearish', 'neutral'][h % 3 + 1] AS direction,
    ['buy', 'sell', 'hold', 'wait', 'unknown'][h % 5 + 1] AS intent,
    (h % 2) + (h // 2 % 2) + (h // 4 % 2) + (h // 8 % 2) + (h // 16 % 2) AS fomo_flags,
    (h // 32 % 2 = 1 AND h // 64 % 2 = 1) AS panic,
    h % 29 = 0 AS spam, h % 23 = 0 AS promotion
  FROM analysis0),
pair_rank AS (
  SELECT ct.content_id, ct.topic_id, a.analysis_id,
    row_number() OVER (PARTITION BY ct.content_id, ct.topic_id
      ORDER BY (a.topic_id IS NOT NULL) DESC, a.tier DESC, a.analysis_id DESC) AS rn
  FROM content_topic ct JOIN analysis a ON a.content_id = ct.content_id AND (a.topic_id = ct.topic_id OR a.topic_id IS NULL)),
preferred AS (
  SELECT p.content_id, p.topic_id AS pair_topic, a.* EXCLUDE (content_id, topic_id),
    (a.actor_type = 'retail' AND NOT a.spam AND NOT a.promotion) AS retail
  FROM pair_rank p JOIN analysis a USING (analysis_id) WHERE rn = 1),
preferred_any AS (
  SELECT *, (actor_type = 'retail' AND NOT spam AND NOT promotion) AS retail FROM analysis
  QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY tier DESC, analysis_id DESC) = 1)
"""

HOURLY = """
content AS (
  SELECT event_id AS content_id, event_type AS source, CASE WHEN k % 5 = 0 THEN 'comment' ELSE 'post' END AS kind,
    user_id AS author_id, ts AS published_at, CAST(floor(value) AS BIGINT) AS likes, k % 10 AS comments,
    date_trunc('hour', ts) AS bucket_at, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
""" + _SHARED

DENSE_TOPICS = """
content_topic AS (SELECT content_id, k % 2 + 1 AS topic_id FROM content),
content_asset AS (SELECT content_id, k % 6 + 1 AS asset_id FROM content WHERE k = 24),
asset_topic AS ("""
_DENSE = DENSE_TOPICS + _SHARED.split("asset_topic AS (", 1)[1]

DAILY = """
content AS (
  SELECT o_orderkey AS content_id, o_orderstatus AS source, 'post' AS kind, o_custkey AS author_id,
    CAST(o_orderdate AS TIMESTAMP) AS published_at, CAST(floor(o_totalprice) AS BIGINT) AS likes, 0 AS comments,
    date_trunc('day', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 8 HOUR) - INTERVAL 8 HOUR AS bucket_at,
    o_orderkey % 100 AS k
  FROM orders),
""" + _SHARED

HOURLY_DENSE = HOURLY.replace(_SHARED, _DENSE)
DAILY_DENSE = DAILY.replace(_SHARED, _DENSE)


def metrics_cte(name: str = "metrics") -> str:
    """A01 in SQL, over whichever domain CTEs come before it."""
    return f"""
tarr AS (SELECT content_id, list(DISTINCT topic_id) AS topics FROM content_topic GROUP BY 1),
aarr AS (SELECT content_id, list(DISTINCT asset_id) AS assets, list(DISTINCT topic_id) FILTER (topic_id IS NOT NULL) AS linked
         FROM content_asset LEFT JOIN asset_topic USING (asset_id) GROUP BY 1),
keyed AS (SELECT content_id, unnest(coalesce(topics, linked, [NULL])) AS topic_id, coalesce(assets, [NULL]) AS assets
          FROM content LEFT JOIN tarr USING (content_id) LEFT JOIN aarr USING (content_id)),
keys AS (SELECT content_id, topic_id, unnest(assets) AS asset_id FROM keyed),
chosen AS (
  SELECT k.*, a.analysis_id,
    row_number() OVER (PARTITION BY k.content_id, k.topic_id, k.asset_id
      ORDER BY (k.topic_id IS NOT NULL AND a.topic_id IS NOT NULL) DESC, a.tier DESC, a.analysis_id DESC NULLS LAST) AS rn
  FROM keys k LEFT JOIN analysis a ON a.content_id = k.content_id
    AND (k.topic_id IS NULL OR a.topic_id IS NULL OR a.topic_id = k.topic_id)),
fact AS (
  SELECT c.*, x.topic_id, x.asset_id, a.investor_level, a.direction, a.intent, a.fomo_flags, a.panic,
    coalesce(a.actor_type = 'retail' AND NOT a.spam AND NOT a.promotion, false) AS retail,
    coalesce(NOT a.spam AND NOT a.promotion, false) AS clean
  FROM chosen x JOIN content c USING (content_id) LEFT JOIN analysis a ON a.analysis_id = x.analysis_id WHERE x.rn = 1),
{name} AS (
  SELECT bucket_at, source, topic_id, asset_id,
    count(*) FILTER (kind <> 'comment') AS post_count, count(*) FILTER (kind = 'comment') AS comment_count,
    count(DISTINCT author_id) AS unique_author_count, count(*) FILTER (retail) AS retail_count,
    count(*) FILTER (retail AND investor_level = 'novice') AS novice_count,
    count(*) FILTER (clean AND direction = 'bullish') AS bullish_count,
    count(*) FILTER (clean AND direction = 'bearish') AS bearish_count,
    count(*) FILTER (retail AND intent = 'buy') AS buy_intent_count,
    count(*) FILTER (retail AND intent = 'sell') AS sell_intent_count,
    count(*) FILTER (retail AND fomo_flags >= 3) AS fomo_count,
    count(*) FILTER (retail AND panic) AS panic_count,
    CAST(sum(likes + comments) AS DOUBLE) AS engagement_sum
  FROM fact GROUP BY ALL)
"""


def signals_cte(metrics: str = "metrics", name: str = "signals") -> str:
    """A02 and W02-W05 in SQL."""
    return f"""
wide AS (
  SELECT bucket_at, source, topic_id, asset_id, CAST(post_count AS DOUBLE) AS post_count,
    CAST(unique_author_count AS DOUBLE) AS unique_author_count,
    retail_count / (post_count + comment_count) AS retail_ratio, novice_count / (post_count + comment_count) AS novice_ratio,
    fomo_count / (post_count + comment_count) AS fomo_ratio, panic_count / (post_count + comment_count) AS panic_ratio,
    CASE WHEN retail_count = 0 THEN 0.0 ELSE buy_intent_count / retail_count END AS buy_intent_ratio,
    CASE WHEN retail_count = 0 THEN 0.0 ELSE sell_intent_count / retail_count END AS sell_intent_ratio,
    engagement_sum AS engagement
  FROM {metrics}),
long AS (UNPIVOT wide ON post_count, unique_author_count, retail_ratio, novice_ratio, fomo_ratio, panic_ratio,
  buy_intent_ratio, sell_intent_ratio, engagement INTO NAME metric_name VALUE raw_value),
framed AS (
  SELECT *, count(*) OVER w AS n, avg(raw_value) OVER w AS mean, stddev_pop(raw_value) OVER w AS std,
    median(raw_value) OVER w AS med, mad(raw_value) OVER w AS dev, min(raw_value) OVER w AS lo, max(raw_value) OVER w AS hi,
    list(raw_value) OVER w AS frame
  FROM long
  WINDOW w AS (PARTITION BY source, topic_id, asset_id, metric_name ORDER BY bucket_at
    RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
{name} AS (
  SELECT bucket_at, source, topic_id, asset_id, metric_name, raw_value,
    CASE WHEN n >= 14 AND lo < hi AND std > 0 THEN (raw_value - mean) / std END AS zscore,
    CASE WHEN n >= 14 AND dev > 0 THEN (raw_value - med) / (1.4826 * dev) END AS robust_z,
    CASE WHEN n >= 14 THEN (len(list_filter(frame, lambda v: v <= raw_value)) + 1) / (n + 1) END AS percentile
  FROM framed)
"""


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from ``lineitem``: an asset per supplier group, a bar per shipping day."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 6 + 1).alias("asset_id"), F.to_date("l_shipdate").alias("day"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price.alias("price")).alias("seq"),
        price.alias("price"), "l_quantity", "l_extendedprice",
    )
    bars = rows.groupBy("asset_id", "day").agg(
        F.min("seq")["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max("seq")["price"].alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )
    opened = F.col("day").cast("timestamp") + F.expr("INTERVAL 90 MINUTES")
    return bars.select(
        "asset_id", F.lit("1d").alias("interval"), opened.alias("ts"), "open", "high", "low", "close", "volume", "amount",
        F.lit("none").alias("adjustment"), F.lit("synthetic-a-share").alias("provider"),
    )


def assets(spark: SparkSession) -> DataFrame:
    """Six assets; asset 1 is the benchmark of the others."""
    return spark.sql(
        "SELECT id AS asset_id, 'CN' AS market, concat('60000', id) AS symbol, concat('Asset ', id) AS name,"
        " IF(id = 1, 'index', 'stock') AS asset_type, 'CNY' AS currency, 'Asia/Shanghai' AS timezone,"
        " IF(id = 1, NULL, 1L) AS benchmark_asset_id, IF(id IN (4, 5), 2L, NULL) AS sector_benchmark_asset_id FROM range(1, 7)"
    )


BARS = """
bars AS (
  SELECT asset_id, day + INTERVAL 90 MINUTE AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, seq) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT l_suppkey % 6 + 1 AS asset_id, date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS day,
      l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
      row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS seq FROM lineitem)
  GROUP BY ALL),
assets AS (SELECT a AS asset_id, CASE WHEN a = 1 THEN NULL ELSE 1 END AS benchmark, CASE WHEN a IN (4, 5) THEN 2 END AS sector FROM range(1, 7) r(a))
"""


def events_cte(threshold: float = 3.0, size: str = "1h") -> str:
    """P20, W08, A16 in SQL, after ``signals``."""
    step = "INTERVAL 1 HOUR" if size == "1h" else "INTERVAL 24 HOUR"
    metrics = ", ".join(f"'{m}'" for m in METRIC_NAMES)
    return f"""
strong AS (
  SELECT *, CASE metric_name WHEN 'post_count' THEN 'attention_spike' WHEN 'unique_author_count' THEN 'attention_spike'
    WHEN 'novice_ratio' THEN 'novice_spike' WHEN 'fomo_ratio' THEN 'fomo_spike' WHEN 'panic_ratio' THEN 'panic_spike'
    WHEN 'buy_intent_ratio' THEN 'buy_intent_spike' END AS event_type
  FROM signals WHERE robust_z >= {threshold} AND percentile >= 0.95),
flagged AS (
  SELECT *, CASE WHEN bucket_at <= lag(bucket_at) OVER g + {step} THEN 0 ELSE 1 END AS opens FROM strong WHERE event_type IS NOT NULL
  WINDOW g AS (PARTITION BY event_type, source, topic_id, asset_id ORDER BY bucket_at, metric_name)),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY event_type, source, topic_id, asset_id ORDER BY bucket_at, metric_name) AS run FROM flagged),
events_out AS (
  SELECT event_type, source, topic_id, asset_id, run, min(bucket_at) AS started_at, max(bucket_at) AS ended_at, count(*) AS signal_count,
    arg_max(row(bucket_at, raw_value, robust_z, percentile, metric_name), row(robust_z, percentile, -epoch(bucket_at), -list_position([{metrics}], metric_name))) AS peak
  FROM runs GROUP BY ALL),
sig_events AS (
  SELECT concat_ws('|', event_type, source, coalesce(topic_id::VARCHAR, '-'), coalesce(asset_id::VARCHAR, '-'), '{size}', CAST(epoch(started_at) AS BIGINT)) AS event_key,
    event_type, source, topic_id, asset_id, run, started_at, ended_at, signal_count, peak[1] AS peaked_at, peak[2] AS peak_value,
    peak[3] AS peak_zscore, peak[4] AS peak_percentile, peak[1] + {step} AS signal_at FROM events_out)
"""


RETURNS = """
targets AS (
  SELECT DISTINCT e.event_key, e.signal_at, l.asset_id FROM sig_events e JOIN asset_topic l USING (topic_id)
  UNION SELECT event_key, signal_at, asset_id FROM sig_events WHERE asset_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts) AS i FROM bars),
entry AS (
  SELECT t.event_key, t.asset_id, b.ts AS entry_at, b.open AS entry_price, b.i FROM targets t
  ASOF JOIN numbered b ON t.asset_id = b.asset_id AND t.signal_at < b.ts),
paid AS (
  SELECT e.event_key, e.asset_id, h || 'd' AS horizon, e.entry_at, e.entry_price, x.ts AS exit_at, x.close AS exit_price,
    x.close / e.entry_price - 1 AS raw_return, bx.close / nullif(be.open, 0) - 1 AS market_return, sx.close / nullif(se.open, 0) - 1 AS sector_return
  FROM entry e CROSS JOIN (VALUES (1), (3), (5), (10), (20)) hs(h) JOIN assets a USING (asset_id)
  LEFT JOIN numbered x ON x.asset_id = e.asset_id AND x.i = e.i + h - 1
  LEFT JOIN bars be ON be.asset_id = a.benchmark AND be.ts = e.entry_at LEFT JOIN bars bx ON bx.asset_id = a.benchmark AND bx.ts = x.ts
  LEFT JOIN bars se ON se.asset_id = a.sector AND se.ts = e.entry_at LEFT JOIN bars sx ON sx.asset_id = a.sector AND sx.ts = x.ts)
"""


def trend_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts per order priority as page views; the topic is the rank of the name."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("value")).select(
        (F.unix_date("day").cast("long") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("observation_id"),
        F.when(F.col("value") > 0, "wikimedia-pageviews").alias("source"), F.col("o_orderpriority").alias("keyword"),
        (F.substring("o_orderpriority", 1, 1).cast("long") % 3 + 1).alias("topic_id"),
        F.col("day").cast("timestamp").alias("observed_at"), F.col("value").cast("double").alias("value"), F.lit("views").alias("unit"),
    )


TRENDS = """
obs AS (
  SELECT (date_diff('day', DATE '1970-01-01', day) * 10 + substr(keyword, 1, 1)::BIGINT) AS observation_id, keyword,
    substr(keyword, 1, 1)::BIGINT % 3 + 1 AS topic_id, CAST(day AS TIMESTAMP) AS observed_at, CAST(n AS DOUBLE) AS value
  FROM (SELECT o_orderpriority AS keyword, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)),
obs_framed AS (
  SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, median(value) OVER w AS med,
    mad(value) OVER w AS dev, min(value) OVER w AS lo, max(value) OVER w AS hi, list(value) OVER w AS frame, last(value) OVER w AS prev
  FROM obs WINDOW w AS (PARTITION BY topic_id, keyword ORDER BY observed_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
trend AS (
  SELECT observation_id, topic_id, keyword, observed_at, value AS raw_value, CASE WHEN prev <> 0 THEN (value - prev) / prev END AS change_ratio,
    CASE WHEN n >= 14 AND lo < hi THEN (value - mean) / std END AS zscore, CASE WHEN n >= 14 AND dev > 0 THEN (value - med) / (1.4826 * dev) END AS robust_z,
    CASE WHEN n >= 14 THEN (len(list_filter(frame, lambda v: v <= value)) + 1) / (n + 1) END AS percentile
  FROM obs_framed)
"""


def heat_cte(level: str = "topic") -> str:
    """A03/A04, X17, X18, W14-W16, W18 in SQL, after a domain."""
    if level == "topic":
        pairs, key = "SELECT ct.content_id, ct.topic_id FROM content_topic ct", "topic_id, "
    else:
        pairs, key = "SELECT ct.content_id, min(ct.topic_id) AS topic_id FROM content_topic ct GROUP BY 1", ""
    part = "PARTITION BY topic_id" if level == "topic" else ""
    frames, columns = [], []
    for name, (first, last) in {"week": (6, 0), "previous_week": (13, 7), "month": (29, 0), "previous_month": (59, 30)}.items():
        end = "CURRENT ROW" if last == 0 else f"INTERVAL {last} DAY PRECEDING"
        frames.append(f"{name} AS ({part} ORDER BY bucket_at RANGE BETWEEN INTERVAL {first} DAY PRECEDING AND {end})")
        columns.append(
            f"round(round(avg(heat_index) FILTER (analyzed_count > 0) OVER {name}, 6), 1) AS {name}_index,"
            f" round(round(avg(retail_count) FILTER (analyzed_count > 0) OVER {name}, 6), 1) AS {name}_retail_average,"
            f" count(*) FILTER (analyzed_count > 0) OVER {name} AS {name}_days,"
            f" count(heat_index) FILTER (analyzed_count > 0) OVER {name} AS {name}_index_days"
        )
    return f"""
seen AS ({pairs}),
day_stats AS (
  SELECT {key}c.bucket_at, count(*) FILTER (kind <> 'comment') AS post_count, count(*) FILTER (kind = 'comment') AS comment_count, count(*) AS attention,
    count(DISTINCT author_id) AS unique_author_count, count(DISTINCT source) AS source_count, CAST(sum(likes + comments) AS DOUBLE) AS engagement_sum,
    count(p.analysis_id) AS analyzed_count, count(*) FILTER (retail) AS retail_count, count(*) FILTER (retail AND investor_level = 'novice') AS novice_count,
    count(*) FILTER (retail AND intent = 'buy') AS buy_intent_count, count(*) FILTER (retail AND intent = 'sell') AS sell_intent_count,
    count(*) FILTER (retail AND fomo_flags >= 3) AS fomo_count, count(*) FILTER (retail AND panic) AS panic_count
  FROM seen s JOIN content c USING (content_id) LEFT JOIN preferred p ON p.content_id = s.content_id AND p.pair_topic = s.topic_id GROUP BY ALL),
indexed AS (
  SELECT *, analyzed_count / attention AS analysis_coverage, CASE WHEN analyzed_count > 0 THEN round(greatest(0.0, least(100.0, 100 * (
      least(1.0, retail_count / attention) * 0.35 + retail_count / (retail_count + 20.0) * 0.25
      + least(1.0, (buy_intent_count + sell_intent_count) / greatest(retail_count, 1)) * 0.20
      + least(1.0, (fomo_count + panic_count) / greatest(retail_count, 1)) * 0.15
      + least(1.0, abs(buy_intent_count - sell_intent_count) / greatest(retail_count, 1)) * 0.05))), 1) END AS heat_index
  FROM day_stats),
framed_heat AS (
  SELECT *, list(heat_index) FILTER (heat_index IS NOT NULL) OVER prior AS prior, max(heat_index) OVER yesterday AS previous_heat_index,
    coalesce(max(attention) OVER yesterday, 0) AS previous_attention, {', '.join(columns)}
  FROM indexed WINDOW prior AS ({part} ORDER BY bucket_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING),
    yesterday AS ({part} ORDER BY bucket_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), {', '.join(frames)}),
deltas AS (
  SELECT *, coalesce(len(prior), 0) AS baseline_days, round(heat_index - previous_heat_index, 1) AS day_delta,
    CASE WHEN week_index_days >= 2 AND previous_week_index_days >= 2 THEN round(week_index - previous_week_index, 1) END AS week_delta,
    CASE WHEN month_index_days >= 5 AND previous_month_index_days >= 5 THEN round(month_index - previous_month_index, 1) END AS month_delta,
    CASE WHEN heat_index IS NOT NULL AND len(prior) >= 5 THEN round((len(list_filter(prior, lambda v: v < heat_index)) + len(list_filter(prior, lambda v: v = heat_index)) / 2) / len(prior) * 100, 1) END AS historical_percentile,
    CASE WHEN previous_attention > 0 THEN (attention - previous_attention) / previous_attention END AS change_ratio
  FROM framed_heat),
heat AS (
  SELECT *, (coalesce(day_delta * 0.5, 0) + coalesce(week_delta * 0.3, 0) + coalesce(month_delta * 0.2, 0))
      / nullif(0.0 + CASE WHEN day_delta IS NULL THEN 0.0 ELSE 0.5 END + CASE WHEN week_delta IS NULL THEN 0.0 ELSE 0.3 END + CASE WHEN month_delta IS NULL THEN 0.0 ELSE 0.2 END, 0) AS score,
    CASE WHEN analyzed_count >= 30 AND analysis_coverage >= 0.8 THEN 'high' WHEN analyzed_count >= 10 AND analysis_coverage >= 0.5 THEN 'medium'
      WHEN analyzed_count > 0 THEN 'low' ELSE 'insufficient' END AS index_confidence,
    CASE WHEN previous_attention = 0 THEN 'new' WHEN change_ratio >= 0.1 THEN 'rising' WHEN change_ratio <= -0.1 THEN 'falling' ELSE 'stable' END AS trend
  FROM deltas)
"""


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three raw versions per event, some cut off, ambiguous, late or repeated."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = events.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 3)))
    shape = F.when((F.col("v") == 2) & (F.col("k") % 5 == 0), 0).otherwise(F.col("v"))
    rows = rows.withColumn("w", shape)
    ident = F.col("event_id").cast("string")
    cut = (F.col("w") == 1) & (F.col("k") % 2 == 0)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    updated = F.when(F.col("k") % 10 == 7, iso(F.col("ts") - F.expr("INTERVAL 1 DAY"))).otherwise(iso(F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    payload = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("author_id"),
            F.when(cut, F.concat(F.lit("body "), ident)).otherwise(F.concat(F.lit("body of post "), ident, F.lit(" version "), F.col("w").cast("string"))).alias("body"),
            cut.alias("body_truncated"),
            F.when(F.col("w") < 2, F.col("k") % 10).alias("comments"),
            (F.floor("value").cast("long") + F.col("w")).alias("likes"),
            F.when(F.col("k") % 4 == 0, "edit_time").otherwise("publish_time").alias("source_timestamp_field"),
            F.when(F.col("k") % 4 == 0, "ambiguous").otherwise("published").alias("timestamp_semantics"),
            F.when(F.col("w") != 1, F.concat(F.lit("title "), ident)).alias("title"),
            updated.alias("updated_at"),
        )
    )
    late = F.when(F.col("k") == 95, F.expr("ts - INTERVAL 1 HOUR")).otherwise(F.timestamp_seconds(F.unix_seconds("ts") + (F.col("v") + 1) * 3600))
    return rows.select(
        (F.col("event_id") * 3 + F.col("v")).alias("raw_id"), F.col("event_type").alias("source"), ident.alias("source_item_id"),
        F.when(F.col("k") == 98, "archived_snapshot").when(F.col("k") == 97, "pageviews").otherwise("forum_post").alias("observation_kind"),
        F.when(F.col("k") != 99, F.col("ts")).alias("published_at"), late.alias("observed_at"), late.alias("collected_at"),
        payload.alias("payload"), F.sha2(payload, 256).alias("payload_hash"),
    )


def raw_links(raw: DataFrame) -> DataFrame:
    """Topics whose query found each raw row."""
    topic = F.col("raw_id") % 5 + 1
    topics = F.when(F.col("raw_id") % 2 == 0, F.array(topic)).otherwise(F.array(topic, topic % 5 + 1))
    return raw.select("raw_id", F.explode(topics).alias("topic_id")).withColumn("collection_query", F.concat(F.lit("q"), F.col("topic_id").cast("string")))


RAW = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ver AS (SELECT *, CASE WHEN v = 2 AND k % 5 = 0 THEN 0 ELSE v END AS w FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS v FROM ev)),
raw AS (
  SELECT event_id * 3 + v AS raw_id, event_type AS source, event_id::VARCHAR AS source_item_id, k, v, w, user_id, value,
    CASE WHEN k = 98 THEN 'archived_snapshot' WHEN k = 97 THEN 'pageviews' ELSE 'forum_post' END AS observation_kind,
    CASE WHEN k <> 99 THEN ts END AS published_at,
    CASE WHEN k = 95 THEN ts - INTERVAL 1 HOUR ELSE date_trunc('second', ts) + INTERVAL 1 HOUR * (v + 1) END AS observed_at,
    CASE WHEN w = 1 AND k % 2 = 0 THEN 'body ' || event_id ELSE 'body of post ' || event_id || ' version ' || w END AS body,
    (w = 1 AND k % 2 = 0) AS cut, k % 4 <> 0 AS verified, CASE WHEN w <> 1 THEN 'title ' || event_id END AS title,
    CAST(floor(value) AS BIGINT) + w AS likes, CASE WHEN w < 2 THEN k % 10 END AS comments,
    date_trunc('second', CASE WHEN k % 10 = 7 THEN ts - INTERVAL 1 DAY ELSE ts + INTERVAL 1 HOUR END) AS updated_at
  FROM ver),
hashed AS (
  SELECT *, sha256('{"author_id":"' || user_id || '","body":"' || body || '","body_truncated":' || cut::VARCHAR
      || coalesce(',"comments":' || comments, '') || ',"likes":' || likes || ',"source_timestamp_field":"' || CASE WHEN verified THEN 'publish_time' ELSE 'edit_time' END
      || '","timestamp_semantics":"' || CASE WHEN verified THEN 'published' ELSE 'ambiguous' END || '"' || coalesce(',"title":"' || title || '"', '')
      || ',"updated_at":"' || strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') || '"}') AS payload_hash,
    CASE WHEN verified AND published_at IS NULL THEN 'missing_publication_time' WHEN published_at > observed_at + INTERVAL 10 MINUTE THEN 'future_after_observation'
      WHEN updated_at < published_at THEN 'updated_before_published' END AS issue FROM raw),
links AS (
  SELECT raw_id, raw_id % 5 + 1 AS topic_id FROM raw UNION ALL SELECT raw_id, (raw_id % 5 + 1) % 5 + 1 FROM raw WHERE raw_id % 2 = 1)
"""
