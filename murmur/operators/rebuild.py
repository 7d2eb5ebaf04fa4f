"""Purge and repair of derived tables; raw rows are never touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.neardup import live_clusters
from murmur.sources.raw import SNAPSHOT_KIND

DERIVED = ("platform_metric", "metric_signal", "signal_event", "event_metric_link", "event_return", "diffusion_event")


def _count(removed: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed") for name, df in removed.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    right = gone.select(*[F.col(k).alias(f"_g_{k}") for k in keys]).distinct()
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(right[f"_g_{k}"])
    return df.join(right, condition, "left_anti")


def _within(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    right = gone.select(*[F.col(k).alias(f"_g_{k}") for k in keys]).distinct()
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(right[f"_g_{k}"])
    return df.join(right, condition, "left_semi")


METRIC_KEY = ["bucket_at", "bucket_size", "source", "topic_id", "asset_id"]


def clear_topic_history(tables: dict[str, DataFrame], topic_ids: list[int], keep_from: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, removed counts) for topics before a cut-off.

    Tags of old posts, metrics and their signals, events with links and
    returns, diffusions and trend points go; content and raw rows stay.
    """
    assets = tables["asset_topic"].where(F.col("topic_id").isin(*topic_ids)).select("asset_id").distinct()
    old = tables["content"].where(F.col("published_at") < keep_from).select("content_id")
    entity = tables["content_entity"]
    hit_topic = (F.col("entity_type") == "topic") & F.col("entity_id").isin(*topic_ids)
    of_assets = entity.where(F.col("entity_type") == "asset").join(assets.withColumnRenamed("asset_id", "entity_id"), "entity_id", "left_semi").select(*entity.columns)
    tags = entity.where(hit_topic).unionByName(of_assets).join(old, "content_id", "left_semi").select(*entity.columns)
    metrics = tables["platform_metric"].where(F.col("topic_id").isin(*topic_ids) & (F.col("bucket_at") < keep_from))
    signals = _within(tables["metric_signal"], metrics, METRIC_KEY)

    def early(df: DataFrame) -> DataFrame:
        before = df.where(F.col("started_at") < keep_from)
        by_topic = before.where(F.col("topic_id").isin(*topic_ids))
        by_asset = before.where(~F.coalesce(F.col("topic_id").isin(*topic_ids), F.lit(False))).join(assets, "asset_id", "left_semi").select(*df.columns)
        return by_topic.unionByName(by_asset)

    events, diffusion = early(tables["signal_event"]), early(tables["diffusion_event"])
    returns = tables["event_return"].join(events.select("event_key"), "event_key", "left_semi")
    links = tables["event_metric_link"]
    link_keys = ["source", "topic_id", "asset_id", "bucket_size", "bucket_at", "metric_name"]
    by_event = links.join(events.select("event_key"), "event_key", "left_semi")
    loose = links.join(events.select("event_key"), "event_key", "left_anti")
    gone_links = by_event.select(*links.columns).unionByName(_within(loose, signals, link_keys).select(*links.columns))
    trends = tables["trend_observation"].where(F.col("topic_id").isin(*topic_ids) & (F.col("observed_at") < keep_from))
    trend_signals = tables["trend_signal"].join(trends.select("observation_id"), "observation_id", "left_semi")
    removed = {
        "content_entity": tags, "event_return": returns, "event_metric_link": gone_links, "signal_event": events, "diffusion_event": diffusion,
        "metric_signal": signals, "platform_metric": metrics, "trend_signal": trend_signals, "trend_observation": trends,
    }
    keys = {
        "content_entity": ["content_id", "entity_type", "entity_id"], "event_return": ["event_key", "asset_id", "horizon"], "event_metric_link": ["event_key", "bucket_at", "metric_name"],
        "signal_event": ["event_key"], "diffusion_event": ["signature_hash"], "metric_signal": [*METRIC_KEY, "metric_name"], "platform_metric": METRIC_KEY,
        "trend_signal": ["observation_id"], "trend_observation": ["observation_id"],
    }
    kept = {name: _without(tables[name], gone, keys[name]) for name, gone in removed.items()}
    return {**tables, **kept}, _count(removed)


def reset_derivatives(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty every table that can be recomputed from posts and analyses."""
    removed = {name: tables[name] for name in DERIVED if name in tables}
    return {**tables, **{name: df.limit(0) for name, df in removed.items()}}, _count(removed)


def remove_snapshot_content(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop posts made from raw-only session snapshots, with everything that hangs on them.

    Clusters left without a member go too; raw snapshots stay.
    """
    item = ["source", "source_item_id"]
    snapshots = tables["raw_observation"].where(F.col("observation_kind") == SNAPSHOT_KIND).select(*item).distinct()
    bad = tables["content"].join(snapshots, item, "left_semi").select("content_id")
    removed = {name: tables[name].join(bad, "content_id", "left_semi") for name in ("content", "content_analysis", "analysis_task", "content_entity", "content_cluster_member") if name in tables}
    kept = {name: tables[name].join(bad, "content_id", "left_anti") for name in removed}
    if "content_analysis_review" in tables:
        kept["content_analysis_review"] = tables["content_analysis_review"].join(removed["content_analysis"].select("analysis_id"), "analysis_id", "left_anti")
    if "content_cluster" in tables:
        kept["content_cluster"] = live_clusters(tables["content_cluster"], kept["content_cluster_member"])
    return {**tables, **kept}, _count(removed)
