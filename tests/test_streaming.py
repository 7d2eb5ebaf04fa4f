"""Streams give what the batch operators give."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import functions as F

from murmur.functions.timeutil import floor_bucket
from murmur.operators import events as ev
from murmur.operators import metrics as mt
from murmur.sources.store import Store
from murmur.streaming import jobs as st

RAW = "raw_id long, source string, source_item_id string, payload_hash string, observed_at timestamp"


def drain(stream, mode="append"):
    name = "t" + uuid.uuid4().hex
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def land(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        for j, file in enumerate(sorted((folder / f"part{i}").glob("*.parquet"))):
            shutil.copy(file, folder / f"{i:03d}-{j}.parquet")
        shutil.rmtree(folder / f"part{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_repeats_inside_the_watermark_are_dropped(spark, tmp_path, at):
    rows = [(1, "s", "a", "h1", at("2026-07-01T10:00:00")), (2, "s", "a", "h1", at("2026-07-01T10:30:00")), (3, "s", "a", "h2", at("2026-07-01T10:40:00"))]
    got = drain(st.distinct_versions(land(spark, tmp_path, [rows[:1], rows[1:]], RAW)))
    assert sorted((r.source_item_id, r.payload_hash) for r in got.collect()) == [("a", "h1"), ("a", "h2")]


POST = "content_id long, source string, topic_id long, kind string, author_id long, published_at timestamp"


def test_buckets_equal_the_batch_counts_and_late_rows_wait(spark, tmp_path, at):
    batches = [
        [(1, "s", 1, "post", 1, at("2026-07-01T10:10:00")), (2, "s", 1, "comment", 2, at("2026-07-01T12:00:00"))],
        [(3, "s", 1, "post", 2, at("2026-07-01T10:50:00")), (4, "s", 1, "post", 2, at("2026-07-01T13:00:00"))],
        [(5, "s", 1, "post", 3, at("2026-07-01T20:00:00"))],
        [(6, "s", 1, "post", 3, at("2026-07-01T10:05:00")), (7, "s", 1, "post", 3, at("2026-07-02T23:00:00"))],
    ]
    got = {(r.bucket_at.hour, r.bucket_at.day): (r.post_count, r.comment_count, r.unique_author_count) for r in drain(st.bucket_counts(land(spark, tmp_path, batches, POST))).collect()}
    assert got == {(10, 1): (2, 0, 2), (12, 1): (0, 1, 1), (13, 1): (1, 0, 1), (20, 1): (1, 0, 1)}


def test_daily_buckets_start_at_shanghai_midnight(spark, tmp_path, at):
    batches = [[(1, "s", 1, "post", 1, at("2026-07-01T15:59:00")), (2, "s", 1, "post", 2, at("2026-07-01T16:00:00"))], [(3, "s", 1, "post", 2, at("2026-07-05T16:00:00"))], [(4, "s", 1, "post", 2, at("2026-07-06T16:00:00"))]]
    stream = land(spark, tmp_path, batches, POST)
    got = sorted(r.bucket_at for r in drain(st.bucket_counts(stream, size="1d")).collect())
    batch = spark.createDataFrame([r for b in batches for r in b], POST).select(floor_bucket(F.col("published_at"), "1d").alias("b")).distinct().orderBy("b").collect()
    assert got[:2] == [r.b for r in batch][:2]


SIGNAL = "bucket_at timestamp, bucket_size string, source string, topic_id long, asset_id long, metric_name string, raw_value double, zscore double, robust_z double, percentile double, event_type string"


def values(df):
    return sorted(repr([(c, r[c]) for c in sorted(df.columns)]) for r in df.collect())


def test_events_close_once_and_equal_the_batch_with_late_signals(spark, tmp_path, at):
    def signal(hour, *, topic=1, asset=2, metric="post_count", robust=4.0, day=1, z=1.0):
        kind = {"post_count": "attention_spike", "unique_author_count": "attention_spike", "fomo_ratio": "fomo_spike"}[metric]
        return (at(f"2026-07-{day:02d}T{hour:02d}:00:00"), "1h", "s", topic, asset, metric, float(hour), z, robust, 0.99, kind)

    batches = [
        [signal(10), signal(12), signal(10, topic=None, asset=None)],
        # Inside the watermark of two hours: the hole at 11 is filled late, and 12 ties with it.
        [signal(11, robust=5.0), signal(11, metric="unique_author_count", robust=5.0), signal(12, topic=None, asset=None, z=None)],
        [signal(15), signal(16, robust=9.0), signal(15, metric="fomo_ratio", robust=3.5)],
        [signal(20)], [signal(0, day=3)], [signal(0, day=4)], [signal(0, day=5)],
    ]
    stream = drain(st.merged_events(land(spark, tmp_path, batches, SIGNAL)))
    events, links = ev.detect_events(spark.createDataFrame([r for b in batches for r in b], SIGNAL).drop("event_type"))
    done = F.col("started_at") < F.lit("2026-07-04").cast("timestamp")
    stream = stream.where(done).cache()
    assert stream.count() == 7 and values(stream.drop("links").select(*events.columns)) == values(events.where(done))
    assert values(st.event_links(stream)) == values(links.join(events.where(done).select("event_key"), "event_key").select(*st.event_links(stream).columns))


def test_state_keeps_the_newest_row_per_item(spark, tmp_path, at):
    rows = [[(1, "s", "a", "h1", at("2026-07-01")), (2, "s", "b", "h1", at("2026-07-01"))], [(3, "s", "a", "h2", at("2026-07-02"))]]
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "state"))
    write = st.upsert_latest(store, "newest", ["source", "source_item_id"], "raw_id", stream="one")
    query = land(spark, tmp_path / "in", rows, RAW).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    newest = lambda: sorted((r.source_item_id, r.raw_id) for r in store.read("newest").collect())
    assert newest() == [("a", 3), ("b", 2)]
    before = store.folders()
    # A repeated batch changes nothing, a new one rewrites the part it touches.
    write(spark.createDataFrame([(9, "s", "b", "h9", at("2026-07-09"))], RAW), 1)
    assert store.folders() == before
    write(spark.createDataFrame([(9, "s", "b", "h9", at("2026-07-09")), (1, "s", "b", "old", at("2026-07-01"))], RAW), 2)
    after = store.folders()
    assert newest() == [("a", 3), ("b", 9)] and sum(after[k] != before.get(k) for k in after if k[0] == "newest") == 1
    # Another stream begins with batch 0 over the state that is there.
    st.upsert_latest(store, "newest", ["source", "source_item_id"], "raw_id", stream="two")(spark.createDataFrame([(10, "s", "c", "h", at("2026-07-09"))], RAW), 0)
    assert newest() == [("a", 3), ("b", 9), ("c", 10)]


COUNTED = "bucket_at timestamp, bucket_size string, source string, topic_id long, asset_id long, post_count long, comment_count long, unique_author_count long, retail_count long, novice_count long, fomo_count long, panic_count long, buy_intent_count long, sell_intent_count long, engagement_sum double"


def test_rolling_state_equals_the_batch_baseline_in_every_column(spark, tmp_path, at):
    from datetime import timedelta

    first, keys = at("2026-01-01"), [(1, None), (None, None), (1, 7)]
    rows = []
    for i in range(34):
        for j, (topic, asset) in enumerate(keys):
            v = (i * 7 + j * 3) % 11 + (30 if i == 29 else 0)
            # The last key stops early: its state has gone when it speaks again.
            if (topic, asset) != (1, 7) or i < 4 or i == 33:
                rows.append((first + timedelta(days=2 * i), "1d", "s", topic, asset, v, i % 3, v // 2, v // 2, v // 3, i % 2, 0, v % 2, 1, float(v) / 3))
    cut = [0, 20, 45, len(rows)]
    stream = land(spark, tmp_path, [rows[a:b] for a, b in zip(cut, cut[1:], strict=False)], COUNTED)
    got, batch = drain(st.rolling_baseline(stream)), mt.metric_signals(spark.createDataFrame(rows, COUNTED))
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if c in ("raw_value", "zscore", "robust_z", "percentile") else F.col(c) for c in batch.columns])
    assert batch.count() == 9 * len(rows) and batch.where("robust_z is not null").count() > 100
    assert values(rounded(got)) == values(rounded(batch))


def test_keys_without_buckets_leave_the_state(spark, tmp_path, at):
    row = lambda day, topic: (at(f"2026-{day}"), "1d", "s", topic, None, 3, 0, 1, 1, 0, 0, 0, 0, 0, 1.0)
    stream = land(spark, tmp_path, [[row("01-01", 1), row("01-01", 2)], [row("03-01", 2)], [row("03-02", 2)], [row("03-03", 2)]], COUNTED)
    query = st.rolling_baseline(stream).writeStream.outputMode("append").format("memory").queryName("leaving").start()
    query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert held[0] == 18 and held[-1] == 9


def test_registry_join_on_a_stream(spark, tmp_path, at):
    stream = land(spark, tmp_path, [[(1, "s", 1, "post", 1, at("2026-07-01")), (2, "s", 9, "post", 1, at("2026-07-01"))]], POST)
    dim = spark.createDataFrame([(1, "gold")], "topic_id long, slug string")
    assert sorted((r.content_id, r.slug) for r in drain(st.with_registry(stream, dim, on="topic_id")).collect()) == [(1, "gold"), (2, None)]
