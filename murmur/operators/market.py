"""Price bars, tradable entries and event returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 5, 10, 20)
# Local close by market; every other market closes at day end.
CLOSE_SECONDS = {"CN": 15 * 3600, "HK": 16 * 3600, "US": 16 * 3600}
OTHER_CLOSE_SECONDS = 86399
# Configured route -> stored provider name.
PROVIDER_NAMES = {"qq": "tencent", "fixture": "synthetic-a-share", "demo": "synthetic-a-share", "real": "http-json"}


def provider_for_asset(route: Column, market: Column) -> Column:
    """The provider name kept on a bar."""
    name = F.lower(route)
    rule = F.when(name == "public", F.when(F.upper(market) == "US", "nasdaq").otherwise("tencent"))
    for alias, stored in PROVIDER_NAMES.items():
        rule = rule.when(name == alias, stored)
    return rule.otherwise(name)


def exchange_code(market: Column, symbol: Column, asset_type: Column, style: str) -> Column:
    """Exchange-prefixed code in the dotted (``secid``) or plain (``code``) style."""
    m, s = F.upper(market), F.upper(symbol)
    shanghai = ((asset_type == "index") & s.startswith("000")) | F.substring(s, 1, 1).isin("5", "6", "9")
    if style == "secid":
        us = F.concat(F.when(asset_type == "index", "100").otherwise("105"), F.lit("."), s)
        bare = F.ltrim(s, F.lit("0"))
        hk = F.concat(F.lit("116."), F.when(bare == "", "0").otherwise(bare))
        cn = F.concat(F.when(shanghai, "1.").otherwise("0."), s)
    else:
        us = F.concat(F.lit("us."), s)
        hk = F.concat(F.lit("hk"), F.when(F.length(s) < 5, F.lpad(s, 5, "0")).otherwise(s))
        cn = F.concat(F.when(shanghai, "sh").otherwise("sz"), s)
    return F.when(m == "US", us).when(m == "HK", hk).when(m == "CN", cn)


def closed_bars(bars: DataFrame, as_of: Column) -> DataFrame:
    """Drop bars whose local session has not closed by ``as_of``."""
    zone = F.coalesce("timezone", F.lit("UTC"))
    rule = None
    for market, seconds in CLOSE_SECONDS.items():
        match = F.upper(F.col("market")) == market
        rule = F.when(match, seconds) if rule is None else rule.when(match, seconds)
    seconds = rule.otherwise(OTHER_CLOSE_SECONDS)
    day = F.to_date(F.from_utc_timestamp("ts", zone)).cast("timestamp")
    close_at = F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day) + seconds), zone)
    return bars.where(as_of >= close_at)


def discontinuous_assets(bars: DataFrame) -> DataFrame:
    """Assets with a non-positive close or a close ratio outside the allowed band.

    Bars are one row per asset and trading day, so a window per asset is short.
    """
    order = Window.partitionBy("asset_id").orderBy("ts")
    ratio = F.try_divide(F.col("close"), F.lag("close").over(order))
    previous = F.lag("close").over(order)
    narrow = F.col("asset_type").isin("index", "etf")
    low, high = F.when(narrow, 0.5).otherwise(0.1), F.when(narrow, 1.5).otherwise(10.0)
    marked = bars.select(
        "asset_id", F.when(previous.isNotNull() & ((F.col("close") <= 0) | (previous <= 0)), "non_positive")
        .when((ratio < low) | (ratio > high), "discontinuous").alias("problem"), ratio.alias("ratio"),
    )
    return marked.where(F.col("problem").isNotNull()).groupBy("asset_id").agg(
        F.count("*").alias("breaks"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio")
    )


def merge_tail(bars: DataFrame, tail: DataFrame, keys: tuple[str, ...] = ("asset_id", "ts")) -> DataFrame:
    """Later rows win per timestamp."""
    values = [c for c in bars.columns if c not in keys]
    ranked = bars.withColumn("_pass", F.lit(0)).unionByName(tail.withColumn("_pass", F.lit(1)))
    return ranked.groupBy(*keys).agg(F.max_by(F.struct(*values), "_pass").alias("_v")).select(*keys, "_v.*")


def new_bars(bars: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-only sink; a stored (asset, interval, ts, provider) is kept as it is."""
    key = ["asset_id", "interval", "ts", "provider"]
    return bars.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def next_bar(signals: DataFrame, bars: DataFrame, *, ts: str = "signal_at", key: str = "asset_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """The first bar with a timestamp strictly after the signal.

    Each bar answers the signals in ``[previous bar, this bar)``. That interval
    is cut into calendar days, so the as-of join is an equi join on (key, day).
    The lookup side has one row per key and day; the signal side never meets in
    a window, so a hot asset is split freely by skew handling.
    """
    order = Window.partitionBy(key).orderBy("ts")
    spans = bars.select(key, F.col("ts").alias("_bar"), F.struct("ts", *columns).alias("bar"), F.lag("ts").over(order).alias("_after"))
    first_day = F.to_date(F.coalesce("_after", "_bar"))
    lookup = spans.withColumn("_day", F.explode(F.sequence(first_day, F.to_date("_bar"))))
    opening = spans.where(F.col("_after").isNull()).select(key, F.to_date("_bar").alias("_first"))
    probe = signals.join(opening, key).withColumn("_day", F.greatest(F.to_date(ts), F.col("_first")))
    on_time = (F.col(ts) < F.col("_bar")) & (F.col("_after").isNull() | (F.col(ts) >= F.col("_after")))
    return probe.join(lookup, [key, "_day"]).where(on_time).drop("_day", "_first", "_bar", "_after")


def bar_horizons(bars: DataFrame, assets: DataFrame, horizons=HORIZONS) -> DataFrame:
    """For every bar as an entry, the exit and returns at each horizon.

    Horizons count bars: one means the entry bar's own close. Benchmarks need a
    bar at exactly the entry and the exit instant, and a non-zero open.
    """
    order = Window.partitionBy("asset_id").orderBy("ts")
    exits = F.array(
        *[F.struct(F.lit(f"{h}d").alias("horizon"), F.lead("ts", h - 1).over(order).alias("exit_at"), F.lead("close", h - 1).over(order).alias("exit_price")) for h in horizons]
    )
    rows = bars.select("asset_id", F.col("ts").alias("entry_at"), F.col("open").alias("entry_price"), exits.alias("_exits"))
    rows = rows.select("asset_id", "entry_at", "entry_price", F.inline("_exits"))
    rows = rows.join(assets.select("asset_id", "benchmark_asset_id", "sector_benchmark_asset_id"), "asset_id", "left")

    def with_benchmark(df: DataFrame, link: str, out: str) -> DataFrame:
        opens = bars.select(F.col("asset_id").alias(link), F.col("ts").alias("entry_at"), F.col("open").alias("_open"))
        closes = bars.select(F.col("asset_id").alias(link), F.col("ts").alias("exit_at"), F.col("close").alias("_close"))
        joined = df.join(opens, [link, "entry_at"], "left").join(closes, [link, "exit_at"], "left")
        return joined.withColumn(out, F.when(F.col("_open") != 0, F.col("_close") / F.col("_open") - 1)).drop("_open", "_close")

    rows = with_benchmark(rows, "benchmark_asset_id", "market_return")
    rows = with_benchmark(rows, "sector_benchmark_asset_id", "sector_return")
    raw = F.when(F.col("entry_price") != 0, F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1)
    return (
        rows.withColumn("raw_return", raw)
        .withColumn("market_abnormal_return", F.col("raw_return") - F.col("market_return"))
        .withColumn("sector_abnormal_return", F.col("raw_return") - F.col("sector_return"))
        .drop("benchmark_asset_id", "sector_benchmark_asset_id")
    )


def event_assets(events: DataFrame, asset_topic: DataFrame) -> DataFrame:
    """Assets linked to the event's topic, plus the asset it names, each once."""
    linked = events.join(asset_topic.select("topic_id", F.col("asset_id").alias("_linked")), "topic_id")
    named = events.where(F.col("asset_id").isNotNull())
    return (
        linked.select("event_key", "signal_at", F.col("_linked").alias("asset_id"))
        .unionByName(named.select("event_key", "signal_at", "asset_id"))
        .distinct()
    )


def event_returns(events: DataFrame, asset_topic: DataFrame, bars: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per event, asset and horizon; no entry bar means no row at all."""
    targets = event_assets(events, asset_topic)
    entries = next_bar(targets, bars.select("asset_id", "ts")).withColumn("entry_at", F.col("bar.ts")).drop("bar")
    return entries.join(bar_horizons(bars, assets), ["asset_id", "entry_at"])
