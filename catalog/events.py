"""Queries over merged events, diffusion, bars and event returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, r6, secs, table
from catalog.metrics import metrics_of
from catalog.standins import BARS, DAILY_DENSE, HOURLY_DENSE, RETURNS, asset_topic, assets, daily, events_cte, hourly, market_bars, metrics_cte, signals_cte
from murmur.functions import timeutil as tu
from murmur.operators import events as ev
from murmur.operators import market as mk
from murmur.operators import reads as rd
from murmur.operators.metrics import metric_signals

_HOURLY_EVENTS = f"WITH {HOURLY_DENSE}, {metrics_cte()}, {signals_cte()}, {events_cte(3.0, '1h')}"
_DAILY_EVENTS = f"WITH {DAILY_DENSE}, {metrics_cte()}, {signals_cte()}, {events_cte(2.0, '1d')}"


def hourly_events(spark, sf):
    return ev.detect_events(metric_signals(metrics_of(hourly(spark, sf, dense=True))))


def daily_events(spark, sf):
    """The daily stand-in is smoother, so its events use the lower threshold of 2."""
    return ev.detect_events(metric_signals(metrics_of(daily(spark, sf, dense=True))), min_robust_z=2.0)


def daily_returns(spark, sf):
    events, links = daily_events(spark, sf)
    timed = ev.event_signal_time(events)
    return timed, links, mk.event_returns(timed, asset_topic(spark), market_bars(spark, sf), assets(spark))


@query(
    "p20_qualifying_signals",
    _HOURLY_EVENTS + " SELECT CAST(epoch(bucket_at) AS BIGINT) AS bucket_at, event_type, source, topic_id, asset_id, metric_name,"
    " round(robust_z, 6) AS robust_z FROM strong WHERE event_type IS NOT NULL",
)
def p20(spark, sf):
    strong = ev.qualifying(metric_signals(metrics_of(hourly(spark, sf, dense=True))))
    return strong.select(secs("bucket_at"), "event_type", "source", n("topic_id"), n("asset_id"), "metric_name", r6("robust_z"))


_EVENT_SQL = (
    " SELECT event_key, event_type, source, topic_id, asset_id, CAST(epoch(started_at) AS BIGINT) AS started_at,"
    " CAST(epoch(peaked_at) AS BIGINT) AS peaked_at, CAST(epoch(ended_at) AS BIGINT) AS ended_at, round(peak_value, 6) AS peak_value,"
    " round(peak_zscore, 6) AS peak_zscore, round(peak_percentile, 6) AS peak_percentile, signal_count FROM sig_events"
)


def _event_columns(df):
    return df.select(
        "event_key", "event_type", "source", n("topic_id"), n("asset_id"), secs("started_at"), secs("peaked_at"), secs("ended_at"),
        r6("peak_value"), r6("peak_zscore"), r6("peak_percentile"), n("signal_count"),
    )


@query("w08_event_islands", _HOURLY_EVENTS + _EVENT_SQL)
def w08(spark, sf):
    return _event_columns(hourly_events(spark, sf)[0])


@query("w08_event_islands_daily", _DAILY_EVENTS + _EVENT_SQL)
def w08_daily(spark, sf):
    return _event_columns(daily_events(spark, sf)[0])


_DIFFUSION = """,
spike AS (SELECT topic_id, asset_id, source, event_key, started_at, ended_at,
    CASE WHEN started_at <= lag(ended_at) OVER g + INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM sig_events
  WINDOW g AS (PARTITION BY topic_id, asset_id ORDER BY started_at, event_key)),
chain AS (SELECT *, sum(opens) OVER (PARTITION BY topic_id, asset_id ORDER BY started_at, event_key) AS run FROM spike),
firsts AS (SELECT topic_id, asset_id, run, source, min(row(started_at, event_key)) AS f, max(ended_at) AS fin, min(started_at) AS st FROM chain GROUP BY ALL),
diffusion AS (
  SELECT topic_id, asset_id, min(st) AS started_at, max(fin) AS ended_at, count(*) AS platform_count, arg_min(source, f) AS first_source,
    string_agg(source, '>' ORDER BY f) AS sequence, list_sort(list(source)) AS sources
  FROM firsts GROUP BY topic_id, asset_id, run HAVING count(*) >= 2)
"""


@query(
    "a14_diffusion",
    _DAILY_EVENTS + _DIFFUSION + """
    SELECT topic_id, asset_id, CAST(epoch(started_at) AS BIGINT) AS started_at, CAST(epoch(ended_at) AS BIGINT) AS ended_at, first_source,
      platform_count, sequence, CAST(epoch(ended_at) - epoch(started_at) AS BIGINT) AS duration_seconds,
      CASE WHEN ended_at > started_at THEN round(platform_count / ((epoch(ended_at) - epoch(started_at)) / 86400), 6) END AS velocity,
      sha256('{"asset": ' || coalesce(asset_id::VARCHAR, 'null') || ', "end": "' || strftime(ended_at, '%Y-%m-%dT%H:%M:%S') || '+00:00", "sources": ['
        || list_aggregate(list_transform(sources, lambda s: '"' || s || '"'), 'string_agg', ', ') || '], "start": "' || strftime(started_at, '%Y-%m-%dT%H:%M:%S')
        || '+00:00", "topic": ' || coalesce(topic_id::VARCHAR, 'null') || '}') AS signature_hash
    FROM diffusion""",
)
def a14(spark, sf):
    d = ev.detect_diffusion(daily_events(spark, sf)[0])
    return d.select(
        n("topic_id"), n("asset_id"), secs("started_at"), secs("ended_at"), "first_source", n("platform_count"),
        F.concat_ws(">", F.transform("source_sequence", lambda s: s["source"])).alias("sequence"),
        n("duration_seconds"), r6("velocity"), "signature_hash",
    )


@query(
    "u07_cross_platform_events",
    _DAILY_EVENTS + _DIFFUSION + """
    SELECT event_key, event_type, source, topic_id, asset_id, CAST(epoch(started_at) AS BIGINT) AS started_at, round(peak_value, 6) AS peak_value FROM sig_events
    UNION ALL SELECT DISTINCT concat_ws('|', 'cross_platform_spike', '-', coalesce(topic_id::VARCHAR, '-'), coalesce(asset_id::VARCHAR, '-'), '1d', CAST(epoch(started_at) AS BIGINT)),
      'cross_platform_spike', NULL, topic_id, asset_id, CAST(epoch(started_at) AS BIGINT), CAST(platform_count AS DOUBLE) FROM diffusion""",
)
def u07(spark, sf):
    events, _ = daily_events(spark, sf)
    every = events.unionByName(ev.cross_platform_events(ev.detect_diffusion(events), events))
    return every.select("event_key", "event_type", "source", n("topic_id"), n("asset_id"), secs("started_at"), r6("peak_value"))


@query(
    "r09_diffusion_list",
    _DAILY_EVENTS + _DIFFUSION + """
    SELECT topic_id, asset_id, CAST(epoch(started_at) AS BIGINT) AS started_at, platform_count FROM diffusion
    ORDER BY started_at DESC, topic_id NULLS FIRST, asset_id NULLS FIRST LIMIT 200""",
)
def r09(spark, sf):
    d = ev.detect_diffusion(daily_events(spark, sf)[0])
    return rd.diffusion_list(d).select(n("topic_id"), n("asset_id"), secs("started_at"), n("platform_count"))


@query(
    "i_market_bars",
    f"WITH {BARS} SELECT asset_id, CAST(epoch(ts) AS BIGINT) AS ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low,"
    " round(close, 8) AS close, round(volume, 2) AS volume FROM bars",
)
def bars(spark, sf):
    return market_bars(spark, sf).select(
        "asset_id", secs("ts"), *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], F.round("volume", 2).alias("volume")
    )


@query(
    "j13_asof_entry",
    f"""WITH {BARS}, posts AS (SELECT o_orderkey AS content_id, o_orderkey % 6 + 1 AS asset_id,
      CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MINUTE * (o_orderkey % 180) AS signal_at FROM orders)
    SELECT content_id, p.asset_id, CAST(epoch(signal_at) AS BIGINT) AS signal_at, CAST(epoch(b.ts) AS BIGINT) AS entry_at, round(b.open, 8) AS entry_price
    FROM posts p ASOF JOIN bars b ON p.asset_id = b.asset_id AND p.signal_at < b.ts""",
)
def j13(spark, sf):
    key = F.col("o_orderkey")
    signals = table(spark, sf, "orders").select(
        key.alias("content_id"), (key % 6 + 1).alias("asset_id"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + key % 180 * 60).alias("signal_at"),
    )
    hits = mk.next_bar(signals, market_bars(spark, sf), columns=("open",))
    return hits.select("content_id", "asset_id", secs("signal_at"), secs("bar.ts", "entry_at"), F.round("bar.open", 8).alias("entry_price"))


@query(
    "w17_event_returns",
    _DAILY_EVENTS + f", {BARS}, {RETURNS}" + """
    SELECT event_key, asset_id, horizon, CAST(epoch(entry_at) AS BIGINT) AS entry_at, CAST(epoch(exit_at) AS BIGINT) AS exit_at,
      round(raw_return, 6) AS raw_return, round(market_return, 6) AS market_return, round(raw_return - market_return, 6) AS market_abnormal_return,
      round(raw_return - sector_return, 6) AS sector_abnormal_return FROM paid""",
)
def w17(spark, sf):
    _, _, returns = daily_returns(spark, sf)
    return returns.select(
        "event_key", n("asset_id"), "horizon", secs("entry_at"), secs("exit_at"),
        r6("raw_return"), r6("market_return"), r6("market_abnormal_return"), r6("sector_abnormal_return"),
    )


@query(
    "j16_event_assets",
    _DAILY_EVENTS + f", {BARS}, {RETURNS} SELECT event_key, CAST(epoch(signal_at) AS BIGINT) AS signal_at, asset_id FROM targets",
)
def j16(spark, sf):
    events = ev.event_signal_time(daily_events(spark, sf)[0])
    return mk.event_assets(events, asset_topic(spark)).select("event_key", secs("signal_at"), n("asset_id"))


@query(
    "j20_event_contents",
    _HOURLY_EVENTS + """,
    hit AS (SELECT DISTINCT e.event_key, r.bucket_at, c.content_id, c.published_at FROM runs r
      JOIN sig_events e ON e.event_type = r.event_type AND e.source = r.source AND e.run = r.run
        AND e.topic_id IS NOT DISTINCT FROM r.topic_id AND e.asset_id IS NOT DISTINCT FROM r.asset_id
      JOIN content c ON c.source = r.source AND c.published_at >= r.bucket_at AND c.published_at < r.bucket_at + INTERVAL 1 HOUR
      WHERE r.topic_id IS NULL OR EXISTS (SELECT 1 FROM content_topic t WHERE t.content_id = c.content_id AND t.topic_id = r.topic_id))
    SELECT event_key, content_id, position FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY bucket_at, published_at DESC, content_id DESC) AS position FROM hit)
    WHERE position <= 50""",
)
def j20(spark, sf):
    d = hourly(spark, sf, dense=True)
    _, links = hourly_events(spark, sf)
    return ev.event_contents(links, d.content, d.content_topic, size="1h").select("event_key", "content_id", n("position"))


def raw_versions(spark, sf):
    """One to three landed versions of every post."""
    versions = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("v")
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", versions).select(
        (F.col("event_id") * 3 + F.col("v")).alias("raw_id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_item_id"),
        F.concat_ws(":", "event_id", "user_id", "v").alias("payload_hash"),
    )


@query(
    "r07_event_provenance",
    _HOURLY_EVENTS + """,
    hit AS (SELECT DISTINCT e.event_key, r.bucket_at, c.content_id, c.published_at, c.author_id FROM runs r
      JOIN sig_events e ON e.event_type = r.event_type AND e.source = r.source AND e.run = r.run
        AND e.topic_id IS NOT DISTINCT FROM r.topic_id AND e.asset_id IS NOT DISTINCT FROM r.asset_id
      JOIN content c ON c.source = r.source AND c.published_at >= r.bucket_at AND c.published_at < r.bucket_at + INTERVAL 1 HOUR
      WHERE r.topic_id IS NULL OR EXISTS (SELECT 1 FROM content_topic t WHERE t.content_id = c.content_id AND t.topic_id = r.topic_id)),
    picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY bucket_at, published_at DESC, content_id DESC) AS position FROM hit) WHERE position <= 50),
    best AS (SELECT content_id, arg_max(analysis_id || '/' || model || '/' || intent, tier * 10000000000 + analysis_id) AS effective,
      string_agg(analysis_id || '/' || intent, ';' ORDER BY analysis_id DESC) AS analyses FROM analysis GROUP BY 1),
    version AS (SELECT content_id, string_agg((content_id * 3 + v) || '=' || content_id || ':' || author_id || ':' || v, ';' ORDER BY v DESC) AS versions
      FROM (SELECT content_id, author_id, unnest(range(content_id % 3 + 1)) AS v FROM content) GROUP BY 1)
    SELECT e.event_key, coalesce(p.position, 0) AS position, p.content_id, effective, coalesce(analyses, '') AS analyses, coalesce(versions, '') AS versions
    FROM sig_events e LEFT JOIN picked p USING (event_key) LEFT JOIN best USING (content_id) LEFT JOIN version USING (content_id)""",
)
def r07_provenance(spark, sf):
    d = hourly(spark, sf, dense=True)
    events, links = hourly_events(spark, sf)
    chosen = ev.event_contents(links, d.content, d.content_topic, size="1h")
    shown = ev.event_details(events, chosen, d.content, raw_versions(spark, sf), d.analysis)
    part = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    return shown.select("event_key", F.explode_outer("raw_drilldown").alias("d")).select(
        "event_key", n(F.coalesce("d.position", F.lit(0)), "position"), n("d.content.content_id", "content_id"),
        F.when(F.col("d.analysis").isNotNull(), part(F.col("d.analysis.analysis_id"), F.col("d.analysis.model"), F.col("d.analysis.intent"))).alias("effective"),
        F.coalesce(F.array_join(F.transform("d.analyses", lambda a: part(a["analysis_id"], a["intent"])), ";"), F.lit("")).alias("analyses"),
        F.coalesce(F.array_join(F.transform("d.raw_observations", lambda r: F.concat_ws("=", r["raw_id"].cast("string"), r["payload_hash"])), ";"), F.lit("")).alias("versions"),
    )


@query(
    "r07_event_payloads",
    _DAILY_EVENTS + f", {BARS}, {RETURNS}" + """
    , shown AS (SELECT e.event_key, string_agg(CAST(epoch(r.bucket_at) AS BIGINT) || '/' || metric_name || '/' || CAST(floor(raw_value * 1000 + 0.37) AS BIGINT), ';' ORDER BY r.bucket_at, metric_name) AS metrics
      FROM sig_events e JOIN runs r ON e.event_type = r.event_type AND e.source = r.source AND e.run = r.run AND e.topic_id IS NOT DISTINCT FROM r.topic_id AND e.asset_id IS NOT DISTINCT FROM r.asset_id GROUP BY 1)
    SELECT e.event_key, any_value(s.metrics) AS metrics,
      coalesce(string_agg(p.asset_id || '/' || horizon || '/' || coalesce(CAST(floor(raw_return * 1000000 + 0.37) AS BIGINT)::VARCHAR, '-'), ';' ORDER BY p.asset_id, horizon) FILTER (p.event_key IS NOT NULL), '') AS returns
    FROM sig_events e JOIN shown s USING (event_key) LEFT JOIN (SELECT event_key, asset_id, horizon, raw_return FROM paid) p USING (event_key) GROUP BY 1""",
)
def r07(spark, sf):
    events, links, returns = daily_returns(spark, sf)
    number = lambda c, scale: F.floor(c * scale + 0.37).cast("string")
    metric = lambda m: F.concat_ws("/", F.unix_seconds(m["bucket_at"]).cast("string"), m["metric_name"], number(m["raw_value"], 1000))
    paid = lambda r: F.concat_ws("/", r["asset_id"].cast("string"), r["horizon"], F.coalesce(number(r["raw_return"], 1000000), F.lit("-")))
    shown = ev.event_payloads(events, links, returns)
    return shown.select("event_key", F.array_join(F.transform("metrics", metric), ";").alias("metrics"), F.coalesce(F.array_join(F.transform("returns", paid), ";"), F.lit("")).alias("returns"))


@query(
    "w22_discontinuous_assets",
    f"""WITH {BARS}, step AS (SELECT asset_id, close, lag(close) OVER (PARTITION BY asset_id ORDER BY ts) AS prev FROM bars),
    bad AS (SELECT asset_id, close / prev AS ratio FROM step WHERE prev IS NOT NULL AND (close <= 0 OR prev <= 0
      OR close / prev < CASE WHEN asset_id = 1 THEN 0.5 ELSE 0.1 END OR close / prev > CASE WHEN asset_id = 1 THEN 1.5 ELSE 10.0 END))
    SELECT asset_id, count(*) AS breaks, round(min(ratio), 6) AS min_ratio, round(max(ratio), 6) AS max_ratio FROM bad GROUP BY 1""",
)
def w22(spark, sf):
    typed = market_bars(spark, sf).join(assets(spark).select("asset_id", "asset_type"), "asset_id")
    return mk.discontinuous_assets(typed).select(n("asset_id"), n("breaks"), r6("min_ratio"), r6("max_ratio"))


@query(
    "x22_next_safe_entry",
    """WITH cal AS (SELECT d, (dayofweek(d) BETWEEN 1 AND 5 AND strftime(d, '%Y-%m-%d') NOT IN (""" + ", ".join(f"'{d}'" for d in tu.CN_HOLIDAYS) + """)) AS is_open
      FROM (SELECT CAST(x AS DATE) AS d FROM range(TIMESTAMP '2023-12-30', TIMESTAMP '2024-03-02', INTERVAL 1 DAY) t(x))),
    opens AS (SELECT CAST(d AS TIMESTAMP) + INTERVAL 90 MINUTE AS open_at FROM cal WHERE is_open)
    SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS signal_at, CAST(epoch(o.open_at) AS BIGINT) AS entry_at
    FROM events e ASOF LEFT JOIN opens o ON e.ts < o.open_at""",
)
def x22(spark, sf):
    signals = table(spark, sf, "events").select("event_id", F.col("ts").alias("signal_at"))
    sessions = tu.trading_sessions(spark, "2023-12-30", "2024-03-01")
    return tu.next_safe_entry(signals, sessions).select("event_id", F.unix_seconds("signal_at").alias("signal_at"), secs("entry_at"))


@query(
    "p18_closed_bars",
    f"WITH {BARS} SELECT asset_id, count(*) AS kept, CAST(epoch(max(ts)) AS BIGINT) AS last_ts FROM bars"
    " WHERE date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR + INTERVAL 15 HOUR <= TIMESTAMP '1999-06-15 07:00:00' GROUP BY 1",
)
def p18(spark, sf):
    located = market_bars(spark, sf).join(assets(spark).select("asset_id", "market", "timezone"), "asset_id")
    kept = mk.closed_bars(located, F.lit("1999-06-15 07:00:00").cast("timestamp"))
    return kept.groupBy("asset_id").agg(F.count("*").alias("kept"), secs(F.max("ts"), "last_ts"))
