"""Structured Streaming forms of ingest, metrics, events and baselines (ST1-ST8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmur.functions.timeutil import BUCKET_SECONDS, bucket_seconds
from murmur.operators.analysis import engagement
from murmur.operators.events import EVENT_GROUP, event_key
from murmur.operators.ingest import VERSION
from murmur.operators.metrics import METRIC_NAMES, counters, metrics_long
from murmur.sources.raw import RAW_SCHEMA
from murmur.sources.store import PART, SEEN, Run, Store

WATERMARK = "2 hours"
ANALYSIS = "struct<actor_type:string,investor_level:string,direction:string,intent:string,fomo_flags:int,panic:boolean,promotion:boolean,spam:boolean>"
ENGAGEMENT = {"likes", "favorites", "comments", "shares", "views"}


def read_raw(spark: SparkSession, folder: str, *, files_per_trigger: int = 100, schema: str = RAW_SCHEMA) -> DataFrame:
    """Landed raw Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_versions(raw: DataFrame, *, delay: str = WATERMARK) -> DataFrame:
    """ST1: each (source, item, payload) once while its watermark is open.

    State is bounded by the delay; a repeat that comes later is dropped by the
    batch append step, which compares with everything stored.
    """
    return raw.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(VERSION)


def bucket_counts(posts: DataFrame, *, size: str = "1h", delay: str = WATERMARK, keys: tuple[str, ...] = ("source", "topic_id")) -> DataFrame:
    """ST2/ST3/ST5: the twelve counters per tumbling bucket; daily buckets start at Shanghai midnight.

    The first step sums per author, the second over authors, so authors are
    counted exactly and a busy bucket is many small rows of state, which leave
    with the watermark. Posts may carry ``analysis`` and the engagement columns;
    without them those counters are 0. Rows later than the delay are left to the
    batch recomputation.
    """
    step = bucket_seconds(size)
    window = F.window("published_at", "1 hour") if step == 3600 else F.window("published_at", "1 day", "1 day", "16 hours")
    rows = posts if "analysis" in posts.columns else posts.withColumn("analysis", F.lit(None).cast(ANALYSIS))
    score = engagement() if set(posts.columns) >= ENGAGEMENT else F.lit(0.0)
    sums = counters()
    by_author = rows.withWatermark("published_at", delay).withColumn("_engagement", score).groupBy(window.alias("w"), *keys, "author_id").agg(
        *[value.alias(name) for name, value in sums.items()]
    )
    totals = by_author.groupBy("w", *keys).agg(F.count("author_id").alias("unique_author_count"), *[F.sum(name).alias(name) for name in sums])
    return totals.select(F.col("w.start").alias("bucket_at"), F.lit(size).alias("bucket_size"), *keys, "unique_author_count", *sums)


def with_registry(posts: DataFrame, entity_dim: DataFrame, *, on: str) -> DataFrame:
    """ST8: stream-static join with a registry table; Spark broadcasts it when its size allows."""
    return posts.join(entity_dim, on, "left")


EVENT_STATE = "times ARRAY<BIGINT>, names ARRAY<STRING>, raws ARRAY<DOUBLE>, zs ARRAY<DOUBLE>, robusts ARRAY<DOUBLE>, percentiles ARRAY<DOUBLE>"
_LINK = "bucket_at: TIMESTAMP, metric_name: STRING, raw_value: DOUBLE, zscore: DOUBLE, robust_z: DOUBLE, percentile: DOUBLE"
_GROUP = {"event_type": "STRING", "source": "STRING", "topic_id": "BIGINT", "asset_id": "BIGINT", "bucket_size": "STRING", "metric_name": "STRING"}


def _typed(names: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {_GROUP[c]}" for c in names)


def _keyed_frame(names: tuple[str, ...], key: tuple, out: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows of one key with the key in front; NULL key parts stay NULL."""
    frame = pd.DataFrame(out, columns=columns)
    for place, (name, value) in enumerate(zip(names, key, strict=True)):
        empty = value is None or value != value
        frame.insert(place, name, pd.Series([None if empty else value] * len(out), dtype="Int64" if _GROUP[name] == "BIGINT" else "object"))
    return frame


def merged_events(strong: DataFrame, *, delay: str = WATERMARK, rule_version: str = "discovery-v1") -> DataFrame:
    """ST4/W08: events of qualifying signals, each once, when the watermark says that nothing can join it any more.

    The state of a group holds the signals of its open runs only; a timer closes the
    first of them one bucket after its end. Signals that come late but inside the
    watermark extend or join runs as in the batch. A row has the columns of an event
    and its signals as ``links``; ``event_links`` makes rows of them.
    """
    steps = {size: bucket_seconds(size) for size in BUCKET_SECONDS}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, watermark = steps[key[-1]], state.getCurrentWatermarkMs()
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in () if state.hasTimedOut else frames:
            numbers = [[None if x != x else float(x) for x in rows[c].astype("float64")] for c in ("raw_value", "zscore", "robust_z", "percentile")]
            held += zip([int(t.timestamp()) for t in rows["bucket_at"]], rows["metric_name"], *numbers, strict=True)
        held.sort(key=lambda r: (r[0], METRIC_NAMES.index(r[1])))
        runs: list[list[tuple]] = []
        for row in held:
            if runs and row[0] <= runs[-1][-1][0] + size:
                runs[-1].append(row)
            else:
                runs.append([row])
        # A late signal of the next bucket could still extend a run that is not closed.
        closed = [r for r in runs if (r[-1][0] + size) * 1000 < watermark]
        left = [row for r in runs[len(closed) :] for row in r]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(max((runs[len(closed)][-1][0] + size) * 1000 + 1, watermark + 1))
        elif state.exists:
            state.remove()
        out = []
        for run in closed:
            peak = max(run, key=lambda r: (r[4], r[5], -r[0], -METRIC_NAMES.index(r[1])))
            links = [{"bucket_at": pd.Timestamp(r[0], unit="s"), "metric_name": r[1], "raw_value": r[2], "zscore": r[3], "robust_z": r[4], "percentile": r[5]} for r in run]
            out.append((run[0][0], peak[0], run[-1][0], peak[2], peak[4], peak[5], peak[1], len(run), links))
        yield _keyed_frame(EVENT_GROUP, key, out, ["_start", "_peak", "_end", "peak_value", "peak_zscore", "peak_percentile", "peak_metric", "signal_count", "links"])

    output = f"{_typed(EVENT_GROUP)}, _start BIGINT, _peak BIGINT, _end BIGINT, peak_value DOUBLE, peak_zscore DOUBLE, peak_percentile DOUBLE, peak_metric STRING, signal_count BIGINT, links ARRAY<STRUCT<{_LINK}>>"
    slim = strong.withWatermark("bucket_at", delay).select(*EVENT_GROUP, "bucket_at", "metric_name", "raw_value", "zscore", "robust_z", "percentile")
    rows = slim.groupBy(*EVENT_GROUP).applyInPandasWithState(step, output, EVENT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_seconds(c)
    return rows.select(
        event_key(F.col("_start")), *EVENT_GROUP, at("_start").alias("started_at"), at("_peak").alias("peaked_at"), at("_end").alias("ended_at"), "peak_value", "peak_zscore", "peak_percentile",
        "peak_metric", at("_peak").alias("trigger_bucket_at"), "signal_count", F.lit(rule_version).alias("rule_version"), F.lit("discovered").alias("status"), "links",
    )


def event_links(events: DataFrame) -> DataFrame:
    """A row per signal of the events of ``merged_events``."""
    return events.select("event_key", *EVENT_GROUP, F.inline("links"))


def upsert_latest(store: Store, name: str, keys: list[str], order: str, *, stream: str, parts: int = 64):
    """ST6: a ``foreachBatch`` writer that keeps the newest row per key in a table of the store.

    The table is cut by key hash; a batch reads and rewrites the parts it touches
    and no others. The commit that shows them also names the batch of this
    ``stream``, so a batch that is repeated after a failure changes nothing and
    readers never see half of one. A stream that starts over an older state takes
    it over; of two rows with one key and equal ``order`` the stored one stays.
    """
    fence = (SEEN, f"{name} by {stream}")

    def write(batch: DataFrame, batch_id: int) -> None:
        run = Run(Store(batch.sparkSession, store.folder))
        done = run.before.get(fence)
        if done and int(done[0]) >= batch_id:
            return
        part = F.lpad(F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string"), 4, "0")
        rows, rest = batch.withColumn(PART, part), [c for c in batch.columns if c not in keys]
        touched = [r[0] for r in rows.select(PART).distinct().collect()]
        before = run.stored(name, touched)
        both = rows.withColumn("_stored", F.lit(0))
        if before is not None:
            both = both.unionByName(before.withColumn(PART, part).withColumn("_stored", F.lit(1)))
        newest = both.groupBy(PART, *keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_stored")).alias("_r")).select(*keys, "_r.*", PART)
        if touched:
            run.write_parts(name, newest, touched)
        run.changes[fence] = [str(batch_id)]
        run.commit()

    return write


BASELINE_KEYS = ("bucket_size", "source", "topic_id", "asset_id", "metric_name")
BASELINE_STATE = "times ARRAY<BIGINT>, values ARRAY<DOUBLE>"


def rolling_baseline(buckets: DataFrame, *, days: int = 30, min_samples: int = 14, delay: str = WATERMARK, version: str = "metric-v1") -> DataFrame:
    """ST7/W02-W05: signals of all nine metrics of finished buckets against the 30 days before them.

    ``buckets`` are rows of ``bucket_counts`` (a missing asset_id is NULL), which
    come in order of time for a key. The state of a (size, source, topic, asset,
    metric) holds at most 720 hourly values; a timer drops a key that has had no
    bucket for ``days``, so state follows the keys in use and not the age of the stream.
    """
    rows = buckets if "asset_id" in buckets.columns else buckets.withColumn("asset_id", F.lit(None).cast("long"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            times, values = (np.array(v, dtype=t) for v, t in zip(state.get if state.exists else ([], []), ("i8", "f8"), strict=True))
            new = pd.concat(list(frames)).sort_values("bucket_at")
            for at, current in zip(new["bucket_at"], new["raw_value"], strict=True):
                now = int(at.timestamp())
                first, last = np.searchsorted(times, (now - days * 86400, now))
                out.append((at, float(current), *_stats(values[first:last], float(current), min_samples)))
                times, values = np.insert(times, last, now), np.insert(values, last, current)
            kept = times >= times[-1] - days * 86400
            state.update((times[kept].tolist(), values[kept].tolist()))
            state.setTimeoutTimestamp(max((int(times[-1]) + days * 86400) * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield _keyed_frame(BASELINE_KEYS, key, out, ["bucket_at", "raw_value", "zscore", "robust_z", "percentile"])

    slim = metrics_long(rows.withWatermark("bucket_at", delay)).select(*BASELINE_KEYS, "bucket_at", "raw_value")
    output = f"{_typed(BASELINE_KEYS)}, bucket_at TIMESTAMP, raw_value DOUBLE, zscore DOUBLE, robust_z DOUBLE, percentile DOUBLE"
    made = slim.groupBy(*BASELINE_KEYS).applyInPandasWithState(step, output, BASELINE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("bucket_at", *BASELINE_KEYS, "raw_value", "zscore", "robust_z", "percentile", F.lit(f"{days}d").alias("baseline_window"), F.lit(version).alias("metric_version"))


def _stats(past: np.ndarray, current: float, least: int) -> tuple:
    if len(past) < least:
        return None, None, None
    std, med = past.std(), np.median(past)
    mad = np.median(np.abs(past - med))
    flat = past.min() == past.max()
    return (
        None if flat or std == 0 else (current - past.mean()) / std,
        None if mad == 0 else (current - med) / (1.4826 * mad),
        (int((past <= current).sum()) + 1) / (len(past) + 1),
    )
