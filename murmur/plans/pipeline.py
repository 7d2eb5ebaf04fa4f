"""End-to-end jobs over stored tables.

Stages meet in Parquet tables of one store, so each stage has a short plan and a
lost executor repeats only its own stage; a run becomes visible with its commit.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.classify import classify
from murmur.functions.timeutil import floor_bucket
from murmur.operators import entities as en
from murmur.operators import events as ev
from murmur.operators import ingest as ig
from murmur.operators import market as mk
from murmur.operators import metrics as mt
from murmur.operators import neardup as nd
from murmur.operators import quality as ql
from murmur.operators import rebuild as rb
from murmur.operators import trends as tr
from murmur.operators import worklists as wl
from murmur.sources import archive, tables
from murmur.sources.store import PART, SEEN, Run, Store


def normalise(raw: DataFrame, stored: DataFrame | None, *, secret: str, fresh: DataFrame | None = None) -> DataFrame:
    """state of the posts that have versions the stored state does not know.

    Only those posts are folded, over all their versions; only ``fresh`` rows
    (default: all) are looked through for them. Known posts keep their id; new ones
    are numbered after the largest stored id in order of arrival.
    """
    rows = raw
    if stored is not None:
        changed = ig.pending_versions(raw if fresh is None else fresh, stored).select(*ig.ITEM)
        rows = raw.join(changed, ig.ITEM, "left_semi")
    folded = tables.numbered(ig.fold_versions(rows, secret), stored, ig.ITEM, "content_id", ["first_raw_id", *ig.ITEM])
    content = folded.select(
        "content_id", "source", "source_item_id", "kind", F.xxhash64("source", "author_hash").alias("_author"), "author_hash",
        "published_at", "title", "body", "url", "likes", "favorites", "comments", "shares", "views", "content_hash", F.lit(False).alias("is_deleted"),
    )
    return content.withColumn("author_id", F.when(F.col("author_hash").isNotNull(), F.col("_author"))).drop("_author")


def rule_analyses(content: DataFrame, content_topic: DataFrame, topics: DataFrame, stored: DataFrame | None = None, **options) -> DataFrame:
    """A rule-based row for every open target; the text is classified once per post.

    Stored analyses of any model stay; new rows are numbered after the largest id.
    """
    targets = wl.analysis_targets(content, content_topic, topics)
    versions = {"model": "rule-based-v0", "prompt_version": "content-analysis-v1", "schema_version": "content-analysis-v1"}
    rows = targets.withColumns({k: F.lit(v) for k, v in versions.items()})
    if stored is not None:
        rows = tables.insert_absent(rows, stored, wl.ANALYSIS_KEY)
    labels = classify(content.select("content_id", "title", "body"), **options).select("content_id", "analysis.*")
    made = rows.join(labels, "content_id").withColumn("_topic", F.coalesce("topic_id", F.lit(-1)))
    top = F.lit(0) if stored is None else stored.select(F.coalesce(F.max("analysis_id"), F.lit(0)).cast("long")).scalar()
    made = tables.numbered(made, None, [], "analysis_id", ["content_id", "_topic"])
    return made.select((F.col("analysis_id") + top).cast("long").alias("analysis_id"), *[c for c in made.columns if c not in ("analysis_id", "_topic")])


#: A signal looks back so many days, so a changed bucket reaches as far ahead.
BASELINE_DAYS = 30
#: Registry tables that all sums over buckets depend on.
REGISTRY = ("asset_topic",)


def _day(instant: Column) -> Column:
    return F.coalesce(F.to_date(instant).cast("string"), F.lit("none"))


def _bucket_part(size: str, bucket_at: Column) -> Column:
    return F.concat(F.lit(f"{size}_"), _day(bucket_at))


def _values(df: DataFrame, column: Column) -> list[str]:
    """Distinct days or buckets' days, at most one for each day of the calendar."""
    return sorted(r[0] for r in df.select(column.alias("v")).distinct().collect() if r[0] is not None)


def _shifted(parts: list[str], first: int, last: int) -> set[str]:
    """``size_day`` parts moved by each number of days from ``first`` to ``last``."""
    out = set()
    for part in parts:
        size, day = part.split("_")
        if day != "none":
            out.update(f"{size}_{date.fromisoformat(day) + timedelta(days=k)}" for k in range(first, last + 1))
    return out


def _update_content(run: Run, changed: DataFrame) -> list[str]:
    """Write the changed posts into the days they were and are published on; returns those days, all of them at first."""
    rows = changed.withColumn(PART, _day(F.col("published_at")))
    before = run.stored("content")
    if before is None:
        run.write_parts("content", rows)
        return run.parts("content")
    ids = changed.select("content_id")
    moved = before.join(ids, "content_id", "left_semi")
    days = sorted({*_values(rows, F.col(PART)), *_values(moved, _day(F.col("published_at")))})
    kept = run.read("content", days).join(ids, "content_id", "left_anti").withColumn(PART, _day(F.col("published_at")))
    run.write_parts("content", kept.unionByName(rows), days)
    return days


def _update_entities(run: Run, found: DataFrame, changed: DataFrame, days: list[str]) -> None:
    """Write the links of the changed posts into the days of their posts."""
    rows = found.join(changed.select("content_id", _day(F.col("published_at")).alias(PART)), "content_id")
    if run.stored("content_entity") is None:
        run.write_parts("content_entity", rows)
        return
    of_day = run.read("content", days).select("content_id", _day(F.col("published_at")).alias(PART))
    kept = run.read("content_entity", days).join(changed.select("content_id"), "content_id", "left_anti").join(of_day, "content_id")
    run.write_parts("content_entity", kept.unionByName(rows.select(*kept.columns)), days)


def _update_metrics(run: Run, sizes: tuple[str, ...], dirty: DataFrame | None) -> list[str] | None:
    """Sums of the buckets that hold ``dirty`` instants (None: of all); returns their parts (None: all).

    A bucket belongs to the day it begins on and reaches into the next one, so the
    posts of both days are read, and no others.
    """
    asset_topic, analysis = run.read("asset_topic"), run.read("content_analysis")
    parts, metrics = None if dirty is None else [], None
    for size in sizes:
        part = _bucket_part(size, F.col("bucket_at"))
        days = own = None
        if dirty is not None:
            own = _values(dirty, _bucket_part(size, floor_bucket(F.col("published_at"), size)))
            parts += own
            days = {p.split("_")[1] for p in own} | {p.split("_")[1] for p in _shifted(own, 0, 1)}
        content, entity = run.read("content", days), run.read("content_entity", days)
        topics = entity.where(F.col("entity_type") == "topic").select("content_id", F.col("entity_id").alias("topic_id"))
        assets = entity.where(F.col("entity_type") == "asset").select("content_id", F.col("entity_id").alias("asset_id"))
        made = mt.platform_metrics(content, topics, assets, asset_topic, analysis, size=size).withColumn(PART, part)
        made = made if own is None else made.where(F.col(PART).isin(own))
        metrics = made if metrics is None else metrics.unionByName(made)
    run.write_parts("platform_metric", metrics, parts)
    return parts


def _update_signals(run: Run, parts: list[str] | None) -> None:
    """Signals of the changed buckets' days and the 30 days behind them, from the 30 days before those."""
    if parts is None:
        signals = mt.metric_signals(run.read("platform_metric"), baseline_days=BASELINE_DAYS)
    else:
        reached = _shifted(parts, 0, BASELINE_DAYS) & (set(run.parts("platform_metric")) | set(run.parts("metric_signal")))
        parts = sorted(reached | set(parts))
        signals = mt.metric_signals(run.read("platform_metric", _shifted(parts, -BASELINE_DAYS, 0) | set(parts)), baseline_days=BASELINE_DAYS)
    run.write_parts("metric_signal", signals.withColumn(PART, F.concat("bucket_size", F.lit("_"), _day(F.col("bucket_at")))), parts)


def refresh_sums(run: Run, sizes: tuple[str, ...], dirty: DataFrame | None = None) -> None:
    """Sums and signals that posts published at ``dirty`` instants reach (None: all), from the store's posts."""
    _update_signals(run, _update_metrics(run, sizes, dirty))


def run_core(
    store: Store, *, secret: str, bucket_sizes: tuple[str, ...] = ("1h", "1d"), min_robust_z: float = 3.0, resolver: dict | None = None, whole: bool = False,
) -> dict[str, DataFrame]:
    """normalise, resolve, cluster, analyse, aggregate, detect, evaluate and rate, then commit everything at once.

    A later run looks through raw folders that no committed run has taken in; folds,
    resolves, clusters and analyses only posts with new versions; leaves stored
    analyses alone; sums only the days whose posts or analyses changed and follows
    them 30 days on in the signals. Events are found anew in the signals over the
    threshold, and their returns with the bars that are there now. A changed registry
    or other bucket sizes, or ``whole``, make all sums and signals anew. A run that is
    stopped leaves no trace; the next one starts from the last commit.
    """
    run = Run(store)
    raw, raw_links = run.read("raw_observation"), run.read("raw_observation_topic")
    assets, asset_topic = run.read("asset"), run.read("asset_topic")
    topics, topic_terms, aliases = run.read("topic"), run.read("topic_term"), run.read("asset_alias")
    stored, analyses, members = run.stored("content"), run.stored("content_analysis"), run.stored("content_cluster_member")
    new_raw = run.fresh("raw_observation")
    changed = run.write("content_changed", normalise(raw, stored, secret=secret, fresh=raw.limit(0) if new_raw is None else new_raw))
    # Before the stored rows are replaced: when the changed posts were and are published.
    moments = changed.select("published_at")
    if stored is not None:
        moments = moments.union(stored.join(changed.select("content_id"), "content_id", "left_semi").select("published_at"))
    days = _update_content(run, changed)
    content = run.read("content")
    run.write("trend_observation", ig.trend_points(ig.route(raw), raw_links))
    active = topics.where(F.col("status") == "active")
    queries = raw.select("raw_id", "source", "source_item_id").join(raw_links, "raw_id").join(active.select("topic_id"), "topic_id", "left_semi")
    queries = changed.select("content_id", "source", "source_item_id").join(queries, ["source", "source_item_id"]).select("content_id", "topic_id").distinct()
    in_use = lambda df: df.join(active.select("topic_id"), "topic_id", "left_semi")
    found = run.write("content_entity_changed", en.resolve_entities(changed, assets, aliases, in_use(asset_topic), in_use(topic_terms), queries, **(resolver or {})))
    _update_entities(run, found, changed, days)
    content_topic = run.read("content_entity").where(F.col("entity_type") == "topic").select("content_id", F.col("entity_id").alias("topic_id"))
    content_asset = run.read("content_entity").where(F.col("entity_type") == "asset").select("content_id", F.col("entity_id").alias("asset_id"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body"))
    run.append("content_cluster_member", nd.cluster_contents(changed.select("content_id", nd.simhash(text).alias("fingerprint")), stored=members))
    run.append("content_analysis", rule_analyses(content, content_topic, active, analyses))
    run.write("trend_signal", tr.trend_signals(run.read("trend_observation")))
    settled = not whole and run.stored("metric_signal") is not None and all(run.fresh(name) is None for name in REGISTRY)
    settled = settled and {p.split("_")[0] for p in run.parts("platform_metric")} <= set(bucket_sizes) <= set(run.before.get((SEEN, "bucket_sizes"), []))
    dirty = None
    if settled:
        analysed = run.fresh("content_analysis")
        dirty = moments if analysed is None else moments.union(content.join(analysed.select("content_id"), "content_id", "left_semi").select("published_at"))
    refresh_sums(run, bucket_sizes, dirty)
    events, links = ev.detect_events(run.read("metric_signal"), min_robust_z=min_robust_z)
    diffusion = run.write("diffusion_event", ev.detect_diffusion(events))
    events = run.write("signal_event", events.unionByName(ev.cross_platform_events(diffusion, events)))
    run.write("event_metric_link", links)
    run.write("event_return", mk.event_returns(ev.event_signal_time(events), asset_topic, run.read("market_bar"), assets))
    run.write("source_quality", ql.source_quality(run.read("source"), raw, content, content_asset, run.read("content_analysis")))
    run.taken_in("raw_observation", "content_analysis", *REGISTRY)
    run.changes[SEEN, "bucket_sizes"] = list(bucket_sizes)
    run.commit()
    return {name: store.read(name) for name in CORE_TABLES}


#: What the core chain makes.
CORE_TABLES = (
    "content", "trend_observation", "content_entity", "content_cluster_member", "content_analysis", "trend_signal", "platform_metric", "metric_signal",
    "signal_event", "event_metric_link", "diffusion_event", "event_return", "source_quality",
)


def rebuild(store: Store, *, secret: str, **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """drop posts that never should have been made, then recompute every derived table.

    The repairs are committed together, so removed posts, analyses and links are gone
    for good; the counts of removed rows are returned.
    """
    run = Run(store)
    names = ("raw_observation", "content", "content_analysis", "content_entity", "content_cluster_member")
    tables_now = {name: run.read(name) for name in names}
    kept, counts = rb.remove_snapshot_content(tables_now)
    counts = run.write("rebuild_counts", counts)
    of_day = tables_now["content"].select("content_id", _day(F.col("published_at")).alias(PART))
    run.write_parts("content", kept["content"].withColumn(PART, _day(F.col("published_at"))))
    run.write_parts("content_entity", kept["content_entity"].join(of_day, "content_id"))
    for name in ("content_analysis", "content_cluster_member"):
        run.write(name, kept[name])
    run.commit()
    return run_core(store, secret=secret, whole=True, **options), store.read("rebuild_counts")


def sync_market(readers: list[tuple[DataFrame, Callable]], stored: DataFrame, assets: DataFrame, *, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(new closed bars, assets set aside) over all landed responses.

    Assets with a broken price series are reported and left out; the others go
    on. ``readers`` pairs landed responses with the reader of their format.
    """
    bars = None
    for responses, read in readers:
        part = read(responses)[0].select("asset_id", "market", "asset_type", "timezone", "ts", "open", "high", "low", "close", "volume", "amount", "adjustment", "interval", "provider")
        bars = part if bars is None else bars.unionByName(part)
    bad = mk.discontinuous_assets(bars)
    good = bars.join(bad.select("asset_id"), "asset_id", "left_anti")
    closed = mk.closed_bars(good, as_of).drop("market", "asset_type", "timezone")
    return mk.new_bars(closed, stored), bad


def review_results(answers: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checked reviews, invalid items, unreadable answers) of landed review answers.

    ``rows`` are the reviewed posts (content_id, source_text). Evidence that is
    not in the text costs the item its intent, never its other labels.
    """
    items, unreadable = wl.review_items(answers)
    parsed = wl.parse_contract(items).withColumns({"content_id": F.col("c.id"), "intent_basis": F.col("c.intent_basis"), "intent_evidence": F.col("c.intent_evidence"), "rationale": F.col("c.rationale")})
    invalid = parsed.where((F.size("faults") > 0) | F.col("content_id").isNull())
    flat = wl.flatten_contract(parsed.where((F.size("faults") == 0) & F.col("content_id").isNotNull()))
    return wl.review(flat.join(rows, "content_id")), invalid.drop("c"), unreadable


def enrich_from_archive(content: DataFrame, state: DataFrame, captures: DataFrame, pages: DataFrame, *, crawl_id: str, since: Column, until: Column, now: Column, limit: int, max_body_bytes: int = archive.MAX_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(posts with filled bodies, new lookup states) from landed captures and pages."""
    queue = archive.lookup_queue(content, state, crawl_id=crawl_id, since=since, until=until, now=now, limit=limit)
    found = queue.join(archive.newest_capture(captures), "url", "left")
    bodies = archive.page_bodies(pages, max_body_bytes=max_body_bytes).select("url", "body", "body_truncated")
    filled = found.where(F.col("captured_at").isNotNull()).select("content_id", "url").join(bodies, "url")
    status = F.when(F.col("captured_at").isNull(), "no_capture").otherwise("complete")
    states = found.select("content_id", F.lit(crawl_id).alias("last_crawl_id"), status.alias("status"), now.alias("checked_at"))
    return archive.fill_bodies(content, filled), states


def bundle_warnings(day: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a reader of an evidence bundle should know, one line per warning."""
    pending = day.where(F.col("analysis_pending_count") > 0).select(F.format_string("%d posts still wait for analysis", "analysis_pending_count").alias("warning"))
    partial = day.where(F.col("collection_status") != "complete").select(F.concat(F.lit("collection of the last day is "), F.col("collection_status")).alias("warning"))
    ill = sources.where(F.col("enabled") & (F.col("health_status") != "healthy")).select(F.concat(F.lit("source is not healthy: "), F.col("source")).alias("warning"))
    cut = evidence.where("truncated").select(F.format_string("evidence holds %d of %d posts", "returned", "total").alias("warning"))
    return pending.unionByName(partial).unionByName(ill).unionByName(cut)


def write_bundle(parts: dict[str, DataFrame], folder: str) -> None:
    """Every part of an evidence bundle as JSON lines under one folder."""
    for name, df in parts.items():
        tables.export_json(df, f"{folder.rstrip('/')}/{name}")
