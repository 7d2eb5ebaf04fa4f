"""The topic and asset registry as small tables, and its synchronisation.

``load`` turns parsed registry documents into dimension tables; ``sync``
compares them with the stored ones and returns the new tables and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOPIC_SCHEMA = "slug STRING, name STRING, status STRING, aliases ARRAY<STRING>, retired_aliases ARRAY<STRING>, reference_assets ARRAY<STRING>"
ASSET_SCHEMA = (
    "market STRING, symbol STRING, name STRING, asset_type STRING, currency STRING, timezone STRING, benchmark STRING, sector_benchmark STRING,"
    " aliases ARRAY<STRUCT<value: STRING, type: STRING, priority: INT>>, retired_aliases ARRAY<STRING>, topics ARRAY<STRING>"
)


def load(spark: SparkSession, topics_path: str, assets_path: str) -> tuple[DataFrame, DataFrame]:
    """Registry tables landed as JSON lines with explicit schemas."""
    return spark.read.schema(TOPIC_SCHEMA).json(topics_path), spark.read.schema(ASSET_SCHEMA).json(assets_path)


def reference_order(topics: DataFrame) -> DataFrame:
    """Position of every reference asset of a topic."""
    return topics.where(F.col("reference_assets").isNotNull()).select("slug", F.posexplode("reference_assets").alias("position", "symbol"))


def registry_errors(topics: DataFrame, assets: DataFrame) -> DataFrame:
    """Reference assets named twice, or not linked to their topic."""
    order = reference_order(topics)
    doubled = order.groupBy("slug", "symbol").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("slug", "symbol", F.lit("duplicate_reference").alias("problem"))
    linked = assets.select("symbol", F.explode("topics").alias("slug"))
    loose = order.select("slug", "symbol").distinct().join(linked, ["slug", "symbol"], "left_anti").withColumn("problem", F.lit("reference_not_linked"))
    return doubled.unionByName(loose)


def _with_ids(wanted: DataFrame, stored: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Keep stored ids; number new rows after the largest one. Registry tables only."""
    known = wanted.join(stored.select(*key, ident), key, "left")
    top = stored.agg(F.coalesce(F.max(ident), F.lit(0)).alias("top")).scalar()
    order = Window.partitionBy(F.col(ident).isNull()).orderBy(*key)
    numbered = known.withColumn("_n", F.row_number().over(order))
    return numbered.withColumn(ident, F.coalesce(F.col(ident), top + F.col("_n"))).drop("_n")


def sync(topics: DataFrame, assets: DataFrame, stored: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, counts of what was created or removed).

    ``stored`` and the result hold ``topic``, ``topic_alias``, ``asset``,
    ``asset_alias`` and ``asset_topic``. Aliases compare without case; retired
    ones go. Benchmarks are resolved after all assets have ids. For registered
    assets and topics the registry's link set is the only truth.
    """
    wanted_topics = topics.select("slug", "name", F.coalesce("status", F.lit("active")).alias("status"))
    topic = _with_ids(wanted_topics, stored["topic"], ["slug"], "topic_id")
    topic = topic.unionByName(stored["topic"].join(topics.select("slug"), "slug", "left_anti").select(*topic.columns))
    wanted_assets = assets.select("market", "symbol", "name", "asset_type", "currency", "timezone")
    asset = _with_ids(wanted_assets, stored["asset"], ["market", "symbol"], "asset_id")
    by_symbol = asset.groupBy("symbol").agg(F.max("asset_id").alias("asset_id"))

    def with_link(df: DataFrame, field: str, out: str) -> DataFrame:
        names = assets.select("market", "symbol", F.col(field).alias("_name"))
        target = by_symbol.select(F.col("symbol").alias("_name"), F.col("asset_id").alias("_target"))
        kept = stored["asset"].select("market", "symbol", F.col(out).alias("_kept"))
        joined = df.join(names, ["market", "symbol"], "left").join(target, "_name", "left").join(kept, ["market", "symbol"], "left")
        return joined.withColumn(out, F.coalesce("_target", "_kept")).drop("_name", "_target", "_kept")

    asset = with_link(with_link(asset, "benchmark", "benchmark_asset_id"), "sector_benchmark", "sector_benchmark_asset_id")
    columns = [*stored["asset"].columns]
    asset = asset.select(*columns).unionByName(stored["asset"].join(assets.select("market", "symbol"), ["market", "symbol"], "left_anti").select(*columns))

    def aliases(kind: str, owner: str, wanted: DataFrame, retired: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        old = stored[kind]
        gone = old.join(retired, [owner, "alias"], "left_semi")
        kept = old.join(retired, [owner, "alias"], "left_anti")
        fresh = wanted.withColumn("_low", F.lower("alias"))
        rest = [c for c in old.columns if c != owner]
        once = fresh.groupBy(owner, "_low").agg(F.min_by(F.struct(*rest), "position").alias("_a"))
        added = once.join(kept.select(owner, F.lower("alias").alias("_low")), [owner, "_low"], "left_anti").select(owner, "_a.*")
        return kept.unionByName(added.select(*kept.columns)), added, gone

    t_ids, a_ids = topic.select("topic_id", "slug"), asset.select("asset_id", "market", "symbol")
    t_all, t_new, t_gone = aliases(
        "topic_alias", "topic_id",
        topics.select("slug", F.posexplode("aliases").alias("position", "alias")).join(t_ids, "slug"),
        topics.select("slug", F.explode("retired_aliases").alias("alias")).join(t_ids, "slug").select("topic_id", "alias"),
    )
    named = assets.select("market", "symbol", F.posexplode("aliases").alias("position", "a")).join(a_ids, ["market", "symbol"])
    a_all, a_new, a_gone = aliases(
        "asset_alias", "asset_id",
        named.select("asset_id", "position", F.col("a.value").alias("alias"), F.coalesce("a.type", F.lit("name")).alias("alias_type"), F.coalesce("a.priority", F.lit(100)).alias("priority")),
        assets.select("market", "symbol", F.explode("retired_aliases").alias("alias")).join(a_ids, ["market", "symbol"]).select("asset_id", "alias"),
    )
    desired = assets.select("symbol", F.explode("topics").alias("slug")).join(by_symbol, "symbol").join(t_ids, "slug").select("asset_id", "topic_id").distinct()
    links = stored["asset_topic"]
    managed = links.join(assets.select("symbol").join(by_symbol, "symbol").select("asset_id").distinct(), "asset_id", "left_semi").join(
        topics.select("slug").join(t_ids, "slug").select("topic_id"), "topic_id", "left_semi"
    )
    stale = managed.join(desired, ["asset_id", "topic_id"], "left_anti")
    kept = links.join(stale.select("link_id"), "link_id", "left_anti")
    link_all = _with_ids(desired, links, ["asset_id", "topic_id"], "link_id").select(*links.columns).unionByName(
        kept.join(desired, ["asset_id", "topic_id"], "left_anti").select(*links.columns)
    )
    size = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("change"), "n")
    counts = [
        size(topics.select("slug").join(stored["topic"].select("slug"), "slug", "left_anti"), "topics"),
        size(assets.select("market", "symbol").join(stored["asset"].select("market", "symbol"), ["market", "symbol"], "left_anti"), "assets"),
        size(t_new.select("alias").unionByName(a_new.select("alias")), "aliases"), size(t_gone.select("alias").unionByName(a_gone.select("alias")), "aliases_removed"),
        size(desired.join(links.select("asset_id", "topic_id"), ["asset_id", "topic_id"], "left_anti"), "links"), size(stale, "links_removed"),
    ]
    summary = counts[0]
    for part in counts[1:]:
        summary = summary.unionByName(part)
    return {"topic": topic, "topic_alias": t_all, "asset": asset, "asset_alias": a_all, "asset_topic": link_all}, summary


def active_topics(topics: DataFrame) -> DataFrame:
    """The topics in use."""
    return topics.where(F.col("status") == "active")
