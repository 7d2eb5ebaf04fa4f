"""The topic overview of one day, put together from its parts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.timeutil import day_start, shift
from murmur.operators import coverage as cv
from murmur.operators import heat as ht
from murmur.operators import reads as rd
from murmur.operators import trends as tr

MAX_DAYS = 366


def topic_overview(
    tables: dict[str, DataFrame], *, selected: date, history_start: date | None = None, expected_sources: list[str], reference_order: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Topics, market, attention, prices and coverage of a Shanghai day.

    History reaches back 89 days, and 30 days before the first displayed one.
    Each part is a table of its own; nothing is gathered on the driver.
    """
    days = 30 if history_start is None else (selected - history_start).days + 1
    if not 1 <= days <= MAX_DAYS:
        raise ValueError("the history must start on or before the day and span at most 366 days")
    content, pairs, analysis = tables["content"], tables["content_topic"], tables["content_analysis"]
    topics = tables["topic"].where(F.col("status") == "active").select("topic_id")
    pairs = pairs.join(topics, "topic_id", "left_semi").select(*pairs.columns)
    start = day_start(F.lit(selected.isoformat()).cast("date"))
    end = shift(start, 86400)
    first = shift(start, -86400 * (days - 1))
    reach = max(89, days - 1 + 30)
    # The scan is cut to the days that any figure can touch.
    visible = content.where((F.col("published_at") >= shift(start, -86400 * reach)) & (F.col("published_at") < end))
    today = visible.where(F.col("published_at") >= start)
    rows = ht.overview_at(ht.topic_stats(visible, pairs, analysis), ["topic_id"], topics, start, display_buckets=days)
    market = ht.overview_at(ht.market_stats(visible, pairs, analysis), [], None, start, display_buckets=days)
    signals = tables["trend_signal"].where((F.col("observed_at") >= first) & (F.col("observed_at") < end)).join(topics, "topic_id", "left_semi")
    links = tables["asset_topic"].join(topics, "topic_id", "left_semi").select(*tables["asset_topic"].columns)
    sources = cv.source_coverage(today, tables["collection_task"], topics, expected_sources=expected_sources)
    picked = F.col("day") == F.lit(selected.isoformat()).cast("date")
    return {
        "topics": rows.join(ht.latest_activity(today, pairs), "topic_id", "left"),
        "market": market,
        "attention": tr.topic_attention(signals),
        "market_attention": tr.market_attention(signals),
        "prices": rd.asset_prices(links, tables["asset"], tables["market_bar"], start=first, end=end, order=reference_order),
        "sources": sources.where(picked),
        "coverage": cv.day_coverage(today, pairs, analysis, sources, links, tables["market_bar"], topics).where(picked),
    }
