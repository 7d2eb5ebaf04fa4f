"""Descriptive statistics, rank correlation and event studies."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.ordering import exact_median, running_total
from murmur.session import checkpointed

HORIZONS = ("1d", "3d", "5d", "10d", "20d")
RETURN_KINDS = ("raw_return", "market_abnormal_return", "sector_abnormal_return")


def finite(value: Column) -> Column:
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(~bad, number)


def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N, mean, median, population spread, hit rate and 95% interval per key.

    NULL, NaN and infinite values do not count. The median is exact and found by
    parted ordering, so a key of any size spreads over many tasks.
    """
    rows = df.select(*keys, finite(F.col(value)).alias("_x"))
    base = rows.groupBy(*keys).agg(
        F.count("_x").alias("N"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"),
        F.avg((F.col("_x") > 0).cast("double")).alias("hit_rate"),
    )
    median = exact_median(rows, keys, "_x", "median")
    renamed = median.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "median")
    condition = F.lit(True)
    for k in keys:
        condition = condition & base[k].eqNullSafe(renamed[f"_k_{k}"])
    half = F.when(F.col("N") == 1, F.lit(0.0)).otherwise(1.96 * F.col("std") / F.sqrt(F.col("N").cast("double")))
    joined = base.join(renamed, condition, "left").drop(*[f"_k_{k}" for k in keys])
    return joined.select(
        *keys, "N", "mean", "median", "std", "hit_rate", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high")
    )


def average_rank(counts: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Mid rank of every distinct value; ``weight`` says how often it occurs."""
    distinct = counts.groupBy(*keys, value).agg(F.sum(weight).alias("_n"))
    placed = running_total(distinct, keys, [value], weight=F.col("_n"), before="_b", total="_t")
    return placed.select(*keys, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(out), F.col("_t").alias("_rows"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, ranks_x: DataFrame | None = None) -> DataFrame:
    """Rank correlation per key; under two pairs NULL, without variance 0.

    Equal pairs are counted first, so heavy ties shrink before any shuffle of
    rows, and ranks are computed on distinct values only. ``ranks_x`` hands over
    mid ranks that an earlier ordering has given already.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_w"))
    ranks_x = average_rank(pairs, keys, x, "_w", "_rx") if ranks_x is None else ranks_x
    ranks_y = average_rank(pairs, keys, y, "_w", "_ry").drop("_rows")

    def attach(rows: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
        renamed = ranks.select(*[F.col(c).alias(f"_j_{c}") for c in on], *[c for c in ranks.columns if c not in on])
        condition = reduce(and_, [rows[c].eqNullSafe(renamed[f"_j_{c}"]) for c in on])
        return rows.join(renamed, condition).drop(*[f"_j_{c}" for c in on])

    ranked = attach(attach(pairs, ranks_x, [*keys, x]), ranks_y, [*keys, y])
    # Ranks are centred on the known mean rank before they are multiplied.
    mid = (F.col("_rows") + 1) / 2
    dx, dy, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_w").alias("pairs"), F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy")
    )
    spread = F.sqrt(F.col("_xx") * F.col("_yy"))
    value = F.when(F.col("pairs") < 2, F.lit(None).cast("double")).when(spread == 0, 0.0).otherwise(F.try_divide(F.col("_xy"), spread))
    return sums.select(*keys, "pairs", value.alias("spearman"))


def _quintile() -> Column:
    return (F.least(F.lit(4), F.floor(F.col("_b") * 5 / F.col("_t"))).cast("int") + 1).alias("quintile")


def quintiles(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Bucket ``min(4, floor(i * 5 / n)) + 1`` over rows in order; not ``ntile``."""
    return running_total(df, keys, order, before="_b", total="_t").select(*df.columns, _quintile())


def reference_assets(topics: DataFrame, asset_topic: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """First configured asset of a topic, else the asset of its lowest link."""
    linked = asset_topic.groupBy("topic_id").agg(F.min_by("asset_id", "link_id").alias("_linked"))
    rows = topics.select("topic_id").join(linked, "topic_id", "left")
    if configured is None:
        return rows.withColumnRenamed("_linked", "reference_asset_id")
    first = configured.groupBy("topic_id").agg(F.min_by("asset_id", "position").alias("_first"))
    return rows.join(first, "topic_id", "left").select("topic_id", F.coalesce("_first", "_linked").alias("reference_asset_id"))


def _study_returns(events: DataFrame, returns: DataFrame, reference: DataFrame) -> DataFrame:
    rows = events.select("event_key", "topic_id", "event_type").join(reference, "topic_id")
    paid = returns.select("event_key", F.col("asset_id").alias("reference_asset_id"), "horizon", *RETURN_KINDS)
    return rows.join(paid, ["event_key", "reference_asset_id"])


def event_study(events: DataFrame, returns: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, readiness) for every topic and event type.

    Summaries have one row per horizon and kind of return; readiness counts
    events, entries and matured rows and names the state of the study.
    """
    study = ["topic_id", "event_type"]
    rows = checkpointed(_study_returns(events, returns, reference))
    kinds = F.array(*[F.struct(F.lit(k).alias("return_kind"), F.col(k).alias("value")) for k in RETURN_KINDS])
    summaries = summarize(rows.select(*study, "horizon", F.inline(kinds)), [*study, "horizon", "return_kind"], "value")
    end = F.coalesce("ended_at", "peaked_at")
    found = events.where(F.col("topic_id").isNotNull()).groupBy(*study).agg(
        F.count("*").alias("event_count"), F.min("started_at").alias("period_from"), F.max(end).alias("period_until")
    )
    entered = rows.groupBy(*study).agg(
        F.countDistinct("event_key").alias("entry_event_count"), F.count("*").alias("return_rows"), F.count("raw_return").alias("mature_return_rows")
    )
    counted = found.join(entered, study, "left").fillna(0, ["entry_event_count", "return_rows", "mature_return_rows"])
    waiting = F.col("event_count") - F.col("entry_event_count")
    pending = F.col("return_rows") - F.col("mature_return_rows")
    status = (
        F.when(F.col("event_count") == 0, "no_events").when(F.col("return_rows") == 0, "awaiting_entry")
        .when(F.col("mature_return_rows") == 0, "awaiting_maturity").when((waiting > 0) | (pending > 0), "partially_mature").otherwise("ready")
    )
    return summaries, counted.withColumn("pending_entry_events", waiting).withColumn("status", status)


def quantile_rows(events: DataFrame, links: DataFrame, returns: DataFrame, reference: DataFrame, horizon: str = "5d") -> DataFrame:
    """Every linked signal with the event's return at one horizon, if any."""
    if horizon not in HORIZONS:
        raise ValueError(f"unsupported horizon: {horizon}")
    scoped = events.where(F.col("topic_id").isNotNull()).select("event_key", F.col("topic_id")).join(reference, "topic_id")
    signals = links.select("event_key", "bucket_at", "metric_name", "raw_value")
    paid = returns.where(F.col("horizon") == horizon).select(
        "event_key", F.col("asset_id").alias("reference_asset_id"), "raw_return", "market_abnormal_return", F.lit(True).alias("has_return")
    )
    return signals.join(scoped, "event_key").join(paid, ["event_key", "reference_asset_id"], "left")


def quantile_study(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(five bucket summaries, overall row) for every topic and metric.

    One event counts once per linked signal. Ties of the metric are ordered by
    event and bucket, so the buckets do not depend on the physical order.
    """
    study = ["topic_id", "metric_name"]
    rows = checkpointed(rows)
    usable = rows.where(F.col("market_abnormal_return").isNotNull())
    # One ordering by the metric gives the buckets and the ranks of the correlation.
    placed = running_total(usable.select(*study, "raw_value", "event_key", "bucket_at", "market_abnormal_return"), study, ["raw_value", "event_key", "bucket_at"], before="_b", total="_t")
    buckets = summarize(placed.select(*study, "market_abnormal_return", _quintile()), [*study, "quintile"], "market_abnormal_return")
    ranks = placed.where(F.col("raw_value").isNotNull()).groupBy(*study, "raw_value").agg((F.min("_b") + (F.count("*") + 1) / 2).alias("_rx"), F.max("_t").alias("_rows"))
    counts = rows.groupBy(*study).agg(
        F.countDistinct("event_key").alias("linked_events"), F.count("has_return").alias("return_rows"),
        F.count("raw_return").alias("raw_mature"), F.count("market_abnormal_return").alias("abnormal_mature"),
    )
    correlation = spearman(usable, study, "raw_value", "market_abnormal_return", ranks)
    status = (
        F.when(F.col("linked_events") == 0, "no_signals").when(F.col("return_rows") == 0, "awaiting_entry")
        .when(F.col("raw_mature") == 0, "awaiting_maturity").when(F.col("abnormal_mature") == 0, "benchmark_unavailable").otherwise("ready")
    )
    return buckets, counts.join(correlation.drop("pairs"), study, "left").withColumn("status", status)


# What each readiness state means.
READINESS_NOTES = {
    "no_events": "no event of this kind at the current thresholds",
    "no_signals": "no event was raised by this metric",
    "awaiting_entry": "events wait for the next trading day",
    "awaiting_maturity": "entries exist, the horizon has not been reached",
    "partially_mature": "some horizons have returns, others still wait",
    "benchmark_unavailable": "raw returns exist, the benchmark is not aligned",
    "ready": "all entries have matured",
}


def readiness_note(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*READINESS_NOTES.items())]), status)


def research_runs(results: DataFrame, *, study_type: str, versions: dict[str, str]) -> DataFrame:
    """Study results as one JSON row per study key with the versions they rest on."""
    keys = [c for c in ("topic_id", "event_type", "metric_name") if c in results.columns]
    body = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*body)))).alias("result")).select(
        F.lit(study_type).alias("study_type"), *keys, "result", *[F.lit(v).alias(k) for k, v in versions.items()]
    )
