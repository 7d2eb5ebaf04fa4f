"""The evidence bundle of a topic and a range of days, written in one call.

Counts and warnings are observed while the parts are written, so no part is scanned
a second time for them. What reaches the driver is one row of figures per part.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from murmur.functions.timeutil import day_start
from murmur.operators import events as ev
from murmur.operators import quality as ql
from murmur.operators import reads as rd
from murmur.operators import trends as tr
from murmur.operators.analysis import content_filter
from murmur.plans.overview import topic_overview
from murmur.sources.tables import export_json


def evidence_bundle(
    spark: SparkSession, tables: dict[str, DataFrame], folder: str, *, first: date, last: date, topic_id: int | None = None, expected_sources: list[str],
    source: str = "all", name: str = "all", post_limit: int = 200, max_body: int = 2000, attention_limit: int = 200, event_limit: int = 50, reference_order: DataFrame | None = None,
) -> list[str]:
    """Overview (R01), posts (R03), events (R07), source status (R12) and attention (J25) under one folder.

    ``first`` and ``last`` are Shanghai days, both included. Posts, attention points
    and events are the newest of the range, at most as many as their limits; bodies
    over ``max_body`` code points are cut and marked. Without a topic all of them are
    taken. Returns the warnings, which are also written, as are the figures (``meta``).
    """
    if not 1 <= (last - first).days + 1 <= 366:
        raise ValueError("the range must span 1 to 366 days")
    start, end = (day_start(F.lit(d.isoformat()).cast("date")) for d in (first, last + timedelta(days=1)))
    root = folder.rstrip("/")

    def write(part: str, rows: DataFrame) -> None:
        export_json(rows, f"{root}/{part}")

    of_topic = lambda df: df if topic_id is None else df.where(F.col("topic_id") == topic_id)
    in_range = lambda df, at: df.where((F.col(at) >= start) & (F.col(at) < end))

    day = Observation()
    overview = topic_overview(tables, selected=last, history_start=first, expected_sources=expected_sources, reference_order=reference_order)
    for part, rows in overview.items():
        if part == "topics":
            rows = of_topic(rows)
        if part == "coverage":
            rows = rows.observe(day, F.max("analysis_pending_count").alias("pending"), F.max("collection_status").alias("status"))
        write(f"overview/{part}", rows)

    health = Observation()
    ill = F.when(F.col("enabled") & (F.col("health_status") != "healthy"), F.col("source"))
    status = ql.source_status(tables["source"], tables["raw_observation"], tables["content"], tables["trend_observation"], tables["trend_signal"])
    # One name per configured source.
    write("source_status", status.observe(health, F.array_sort(F.collect_set(ill)).alias("ill")))

    seen = Observation()
    posts = rd.scoped_posts(tables["content"], tables["content_topic"], tables["content_analysis"], topic_id=topic_id, period="custom", from_at=start, to_at=end - F.expr("INTERVAL 1 MICROSECOND"))
    posts = rd.of_source(posts, source).where(content_filter(name)).observe(seen, F.count(F.lit(1)).alias("total"))
    posts = posts.orderBy(F.desc("published_at"), F.desc("content_id")).limit(post_limit)
    if "body" in posts.columns:
        posts = posts.withColumn("body_cut", F.coalesce(F.length("body") > max_body, F.lit(False))).withColumn("body", F.substring("body", 1, max_body))
    write("posts", posts)

    points = tr.trend_snapshot(tables["trend_observation"], in_range(tables["trend_signal"], "observed_at"), topic_id=topic_id, limit=attention_limit, all_topics=topic_id is None)
    write("attention", points)

    events = in_range(of_topic(tables["signal_event"]), "started_at").orderBy(F.desc("started_at"), "event_key").limit(event_limit)
    write("events", ev.event_payloads(events, tables["event_metric_link"], tables["event_return"]))

    # A part without rows may give no figures at all.
    total, pending, state, names = seen.get.get("total") or 0, day.get.get("pending"), day.get.get("status"), health.get.get("ill") or []
    warnings = [f"{pending} posts of the last day still wait for analysis"] if pending else []
    if state is not None and state != "complete":
        warnings.append(f"collection of the last day is {state}")
    warnings += [f"source is not healthy: {s}" for s in names]
    if total > post_limit:
        warnings.append(f"evidence holds {post_limit} of {total} posts")
    write("warnings", spark.createDataFrame([(w,) for w in warnings], "warning string").coalesce(1))
    meta = [(topic_id, first, last, source, name, total, min(total, post_limit), total > post_limit)]
    write("meta", spark.createDataFrame(meta, "topic_id long, first_day date, last_day date, source string, filter string, total long, returned long, truncated boolean"))
    return warnings
