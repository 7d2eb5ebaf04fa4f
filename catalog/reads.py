"""Queries over post pages, facets, coverage, quality and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, r6, secs, table
from catalog.heat import trend_observations
from catalog.standins import BARS, DAILY, HOURLY, RAW, TRENDS, asset_topic, assets, daily, hourly, market_bars, raw_observations
from murmur.functions.timeutil import day_start, shanghai_date
from murmur.operators import coverage as cv
from murmur.operators import ingest as ig
from murmur.operators import quality as ql
from murmur.operators import reads as rd
from murmur.operators import trends as tr
from murmur.operators.analysis import CONTENT_FILTERS
from catalog.metrics import _FACETS

_WEEK = """scope AS (SELECT c.*, p.analysis_id, p.retail, p.intent, p.fomo_flags, p.panic, p.promotion FROM content c
  JOIN content_topic ct ON ct.content_id = c.content_id AND ct.topic_id = 3 LEFT JOIN preferred p ON p.content_id = c.content_id AND p.pair_topic = 3,
  (SELECT max(published_at) AS latest FROM content JOIN content_topic USING (content_id) WHERE topic_id IN (SELECT topic_id FROM content_topic GROUP BY 1 HAVING count(*) % 2 = 0 OR topic_id = 3)) m WHERE c.published_at >= latest - INTERVAL 7 DAY AND c.published_at <= latest)"""


def _scope(spark, sf):
    d = hourly(spark, sf)
    # Topics with an odd number of posts are paused, apart from the topic itself.
    active = d.content_topic.groupBy("topic_id").agg(F.count("*").alias("_n")).where("_n % 2 = 0 OR topic_id = 3")
    return rd.scoped_posts(d.content, d.content_topic, d.analysis, topic_id=3, size="1d", period="7d", active_topics=active)


@query("a06_filter_facets", f"WITH {HOURLY}, {_WEEK} SELECT {_FACETS} FROM scope")
def a06(spark, sf):
    return rd.filter_facets(_scope(spark, sf)).select(*[n(f) for f in CONTENT_FILTERS])


@query("a07_source_facets", f"WITH {HOURLY}, {_WEEK} SELECT source, count(*) AS posts FROM scope GROUP BY 1")
def a07(spark, sf):
    return rd.source_facets(_scope(spark, sf))


@query(
    "r03_post_page",
    f"WITH {HOURLY}, {_WEEK} SELECT content_id, source, CAST(floor(epoch(published_at)) AS BIGINT) AS published_at, analysis_id, CAST(likes + comments AS DOUBLE) AS engagement_sum, 'published' AS time_semantics"
    " FROM scope WHERE retail AND intent = 'buy' ORDER BY scope.published_at DESC, content_id DESC LIMIT 30 OFFSET 10",
)
def r03(spark, sf):
    page = rd.post_page(_scope(spark, sf), name="buy", limit=30, offset=10)
    return page.select("content_id", "source", secs("published_at"), "analysis.analysis_id", r6("engagement_sum"), "time_semantics")


@query(
    "o01_deep_page",
    f"""WITH {DAILY}, ranked AS (SELECT content_id, source, published_at, likes, row_number() OVER (ORDER BY published_at DESC, content_id DESC) - 1 AS place FROM content)
    SELECT CASE WHEN place < 100 THEN 0 ELSE 10000 END AS behind, content_id, source, CAST(floor(epoch(published_at)) AS BIGINT) AS published_at, CAST(likes AS DOUBLE) AS engagement_sum
    FROM ranked WHERE place < 30 OR place BETWEEN 30 AND 59 OR place BETWEEN 10000 AND 10099""",
)
def o01(spark, sf):
    """The first page, the one behind its last post, and a page behind 10,000 posts."""
    d = daily(spark, sf)
    posts = rd.scoped_posts(d.content, d.content_topic, d.analysis, topic_id=None, period="all")
    first = rd.post_page(posts, limit=30)
    last = lambda c: first.agg(F.min_by(c, F.struct("published_at", "content_id"))).scalar()
    second = rd.post_page(posts, limit=30, after=(last("published_at"), last("content_id")))
    deep = rd.deep_page(posts, rd.page_days(posts), limit=100, offset=10_000)
    pages = [p.select(F.lit(behind).alias("behind"), "content_id", "source", secs("published_at"), r6("engagement_sum")) for p, behind in ((first, 0), (second, 0), (deep, 10_000))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(
    "r03_market_facets",
    f"WITH {HOURLY} SELECT {_FACETS} FROM content LEFT JOIN preferred_any USING (content_id)",
)
def r03_market(spark, sf):
    """Without a topic the tier alone picks the analysis."""
    d = hourly(spark, sf)
    posts = rd.scoped_posts(d.content, d.content_topic, d.analysis, topic_id=None, size="1h", period="all")
    return rd.filter_facets(posts).select(*[n(f) for f in CONTENT_FILTERS])


@query(
    "o06_bounded_evidence",
    f"WITH {HOURLY}, {_WEEK} SELECT count(*) AS total, least(count(*), 50) AS returned, count(*) > 50 AS truncated FROM scope WHERE retail",
)
def o06(spark, sf):
    _, summary = rd.bounded_evidence(_scope(spark, sf), name="retail", limit=50)
    return summary.select(n("total"), n("returned"), "truncated")


@query(
    "r06_asset_prices",
    f"""WITH {BARS}, link AS (SELECT a * 2 AS link_id, a AS asset_id, a AS topic_id FROM range(1, 7) r(a) UNION ALL SELECT a * 2 + 1, a, a % 8 + 1 FROM range(1, 7) r(a)),
    pos AS (SELECT 3 AS topic_id, 2 AS asset_id, 0 AS position)
    SELECT l.topic_id, l.asset_id, row_number() OVER (PARTITION BY l.topic_id ORDER BY position NULLS LAST, link_id) AS rank, count(b.ts) > 0 AS has_price_data,
      coalesce(string_agg(CAST(epoch(b.ts) AS BIGINT) || '/' || CAST(floor(b.close * 1000 + 0.37) AS BIGINT), ';' ORDER BY b.ts), '') AS history
    FROM link l LEFT JOIN pos USING (topic_id, asset_id) LEFT JOIN bars b ON b.asset_id = l.asset_id AND b.ts >= TIMESTAMP '1990-01-01' AND b.ts < TIMESTAMP '2010-01-01' GROUP BY l.topic_id, l.asset_id, position, link_id""",
)
def r06(spark, sf):
    order = spark.createDataFrame([(3, 2, 0)], "topic_id long, asset_id long, position int")
    bars = market_bars(spark, sf).withColumn("bar_id", F.xxhash64("asset_id", "ts"))
    bounds = {"start": F.lit("1990-01-01").cast("timestamp"), "end": F.lit("2010-01-01").cast("timestamp")}
    rows = rd.asset_prices(asset_topic(spark), assets(spark), bars, order=order, **bounds)
    bar = lambda b: F.concat_ws("/", F.unix_seconds(b["ts"]).cast("string"), F.floor(b["close"] * 1000 + 0.37).cast("string"))
    return rows.select("topic_id", "asset_id", n("rank"), "has_price_data", F.coalesce(F.array_join(F.transform("price_history", bar), ";"), F.lit("")).alias("history"))


@query(
    "w20_even_sample",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT DISTINCT o_orderkey, o_orderstatus FROM r JOIN (SELECT range AS s FROM range(0, 37)) k ON i = CAST(round_even(s * (n - 1) / 36, 0) AS BIGINT)""",
)
def w20(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (-F.col("o_totalprice")).alias("rank_key"))
    return rd.even_sample(rows, ["o_orderstatus"], ["rank_key", "o_orderkey"], 37).select("o_orderkey", "o_orderstatus")


@query("w21_round_robin", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part")
def w21(spark, sf):
    return rd.round_robin(table(spark, sf, "part"), "p_brand", "p_partkey").select("p_partkey", n("turn"))


def collection_tasks(spark, sf):
    d = hourly(spark, sf)
    seen = d.content.select("content_id", "source", shanghai_date(F.col("published_at")).alias("day")).join(d.content_topic, "content_id").select("source", "topic_id", "day").distinct()
    i = F.datediff("day", F.lit("2024-01-01")) + F.col("topic_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("degraded", "partial", "pending", "complete", "running", "complete", "complete")]), (F.pmod(i, F.lit(7)) + 1).cast("int"))
    start = day_start(F.col("day"))
    half = F.pmod(i, F.lit(5)) == 0
    return seen.select(
        "source", "topic_id", start.alias("window_start"), F.when(half, start + F.expr("INTERVAL 12 HOURS")).otherwise(start + F.expr("INTERVAL 24 HOURS")).alias("window_end"),
        status.alias("status"), F.when(status.isin("degraded", "partial"), start + F.expr("INTERVAL 25 HOURS")).alias("next_retry_at"),
    )


_EXPECTED = ["click", "view", "Purchase", "ghost_source"]
_COVERAGE = f"""WITH {HOURLY},
task AS (SELECT DISTINCT source, topic_id, CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day FROM content JOIN content_topic USING (content_id)),
st AS (SELECT source, topic_id, day, ((date_diff('day', DATE '2024-01-01', day) + topic_id) % 7 + 7) % 7 AS s, ((date_diff('day', DATE '2024-01-01', day) + topic_id) % 5 + 5) % 5 = 0 AS half FROM task WHERE source IN ('click', 'view', 'purchase', 'ghost-source')),
state AS (SELECT day, source, topic_id, half, s, CASE WHEN half THEN 'window_partial' ELSE ['degraded', 'partial', 'pending', 'complete', 'running', 'complete', 'complete'][s + 1] END AS state FROM st),
seen AS (SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, source, count(*) AS content_count FROM content GROUP BY ALL),
days AS (SELECT DISTINCT day FROM seen),
spine AS (SELECT day, unnest(['click', 'view', 'purchase', 'ghost-source']) AS name FROM days UNION SELECT day, source FROM seen),
agg AS (SELECT day, source AS name, count(*) AS recorded_topics, count(*) FILTER (state = 'complete') AS c, count(*) FILTER (state = 'degraded') AS d, count(*) FILTER (state = 'partial') AS p, count(*) FILTER (state = 'running') AS r,
  count(*) FILTER (state = 'window_partial') AS w, count(*) FILTER (state = 'pending') AS q, max(CASE WHEN s <= 1 THEN 1 END) AS retry FROM state GROUP BY ALL),
src AS (SELECT spine.day, spine.name, spine.name IN ('click', 'view', 'purchase', 'ghost-source') AS expected, coalesce(content_count, 0) AS content_count, coalesce(c, 0) AS complete_topics, coalesce(recorded_topics, 0) AS recorded_topics,
  CASE WHEN spine.name IN ('click', 'view', 'purchase', 'ghost-source') THEN 8 ELSE 0 END AS expected_topics,
  CASE WHEN spine.name NOT IN ('click', 'view', 'purchase', 'ghost-source') THEN 'observed' WHEN c = 8 THEN 'complete' WHEN d > 0 THEN 'degraded' WHEN r > 0 THEN 'running' WHEN c + p > 0 THEN 'partial' WHEN w > 0 THEN 'window_partial' WHEN q > 0 THEN 'pending'
    WHEN content_count > 0 THEN 'observed_untracked' ELSE 'not_recorded' END AS status, retry
  FROM spine LEFT JOIN seen ON seen.day = spine.day AND seen.source = spine.name LEFT JOIN agg ON agg.day = spine.day AND agg.name = spine.name)"""


def _sources(spark, sf):
    d = hourly(spark, sf)
    topics = spark.range(1, 9).withColumnRenamed("id", "topic_id")
    return d, topics, cv.source_coverage(d.content, collection_tasks(spark, sf), topics, expected_sources=_EXPECTED)


@query(
    "r05_source_coverage",
    _COVERAGE + " SELECT day, name, expected, status, content_count, complete_topics, recorded_topics, expected_topics, CASE WHEN retry = 1 THEN CAST(epoch(CAST(day AS TIMESTAMP) + INTERVAL 17 HOUR) AS BIGINT) END AS next_retry_at FROM src",
)
def r05(spark, sf):
    rows = _sources(spark, sf)[2]
    return rows.select("day", "name", "expected", "status", n("content_count"), n("complete_topics"), n("recorded_topics"), n("expected_topics"), secs("next_retry_at"))


@query(
    "r05_day_coverage",
    _COVERAGE + """, i AS (SELECT DISTINCT content_id FROM content_topic), a AS (SELECT DISTINCT content_id FROM analysis),
    x AS (SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS content_count, count(i.content_id) AS indexed_content_count, count(i.content_id) FILTER (a.content_id IS NOT NULL) AS analyzed_content_count
      FROM content c LEFT JOIN i USING (content_id) LEFT JOIN a ON a.content_id = c.content_id GROUP BY 1),
    k AS (SELECT day, bool_and(status = 'complete') AS ok FROM src WHERE expected GROUP BY 1)
    SELECT day, content_count, indexed_content_count, analyzed_content_count, CASE WHEN ok THEN 'complete' ELSE 'partial' END AS collection_status,
      CASE WHEN analyzed_content_count = indexed_content_count THEN 'complete' ELSE 'pending' END AS analysis_status, 6 AS linked_asset_count, 0 AS exact_day_asset_count, 6 AS missing_asset_count FROM x JOIN k USING (day)""",
)
def r05_day(spark, sf):
    d, topics, sources = _sources(spark, sf)
    rows = cv.day_coverage(d.content, d.content_topic, d.analysis, sources, d.asset_topic, market_bars(spark, sf), topics)
    return rows.select("day", n("content_count"), n("indexed_content_count"), n("analyzed_content_count"), "collection_status", "analysis_status", n("linked_asset_count"), n("exact_day_asset_count"), n("missing_asset_count"))


def _source_dim(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("source")).distinct().select(
        "source", F.lit("content").alias("source_type"), F.when(F.col("source") == "error", "degraded").otherwise("healthy").alias("health_status")
    )


_QUALITY = f"""WITH {HOURLY}, {RAW.replace('ev AS', 'ev2 AS').replace('FROM ev)', 'FROM ev2)')},
s AS (SELECT source, count(*) AS raws, count(DISTINCT source_item_id) AS items FROM raw GROUP BY 1),
c AS (SELECT source, count(*) AS posts FROM content GROUP BY 1),
a AS (SELECT source, count(DISTINCT content_id) AS ap FROM content_asset JOIN content USING (content_id) GROUP BY 1),
p AS (SELECT source, count(*) AS an, count(*) FILTER (actor_type = 'unknown') AS u, count(*) FILTER (spam) AS sp, count(*) FILTER (promotion) AS pr FROM preferred_any JOIN content USING (content_id) GROUP BY 1),
w AS (SELECT source, CASE WHEN source = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS source_success_rate, raws::DOUBLE AS items_collected, 1 - items / raws AS duplicate_ratio, 0::DOUBLE AS parse_failure_ratio, 1 - an / posts AS analysis_failure_ratio,
  u / an AS unknown_actor_ratio, 1 - ap / posts AS unknown_asset_ratio, sp / an AS spam_ratio, pr / an AS promotion_ratio, 0::DOUBLE AS collection_delay FROM s JOIN c USING (source) JOIN a USING (source) JOIN p USING (source))"""


@query(
    "a08_source_quality",
    _QUALITY + " SELECT source, metric_name, round(v, 6) AS metric_value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (source)) INTO NAME metric_name VALUE v)",
)
def a08(spark, sf):
    d = hourly(spark, sf)
    rows = ql.source_quality(_source_dim(spark, sf), raw_observations(spark, sf), d.content, d.content_asset, d.analysis)
    return rows.select("source", "metric_name", r6("metric_value"))


@query("o03_latest_quality", _QUALITY + " SELECT source, metric_name, row_number() OVER (PARTITION BY source ORDER BY metric_name) AS position FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (source)) INTO NAME metric_name VALUE v) QUALIFY position <= 4")
def o03(spark, sf):
    d = hourly(spark, sf)
    rows = ql.source_quality(_source_dim(spark, sf), raw_observations(spark, sf), d.content, d.content_asset, d.analysis)
    dated = rows.withColumn("metric_date", F.lit("2024-01-31").cast("date"))
    return ql.latest_quality(dated, 4).select("source", "metric_name", n("position"))


_AUDIT = f"""WITH {RAW}, newest AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY raw_id DESC) = 1),
post AS (SELECT event_type AS source, event_id::VARCHAR AS source_item_id, CASE WHEN k % 9 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts END AS content_at FROM ev WHERE k < 90),
aud AS (SELECT n.*, published_at IS NULL AS miss, coalesce(published_at > observed_at + INTERVAL 10 MINUTE, false) AS fut, coalesce(updated_at < published_at, false) AS upd, content_at IS NULL AS norm,
  content_at IS NOT NULL AND verified AND published_at IS NOT NULL AND content_at <> published_at AS mism FROM newest n LEFT JOIN post USING (source, source_item_id))"""


def _audit(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    posts = table(spark, sf, "events").where(k < 90).select(
        F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("source_item_id"),
        F.when(k % 9 == 0, F.expr("ts - INTERVAL 1 MINUTE")).otherwise(F.col("ts")).alias("published_at"),
    )
    return ql.publication_audit(raw_observations(spark, sf), posts)


@query(
    "a09_timestamp_audit",
    _AUDIT + """ SELECT source, count(*) AS items, count(*) FILTER (verified) AS verified, count(*) FILTER (miss) AS missing_publication_time, count(*) FILTER (fut) AS future_after_observation,
    count(*) FILTER (upd) AS updated_before_published, count(*) FILTER (norm) AS normalized_missing, count(*) FILTER (mism) AS content_time_mismatch, count(*) FILTER (NOT verified) AS edit_time, round(count(*) FILTER (verified) / count(*), 6) AS verified_ratio FROM aud GROUP BY 1""",
)
def a09(spark, sf):
    names = ("items", "verified", "missing_publication_time", "future_after_observation", "updated_before_published", "normalized_missing", "content_time_mismatch")
    return ql.audit_summary(_audit(spark, sf)).select("source", *[n(c) for c in names], n(F.col("timestamp_fields")["edit_time"], "edit_time"), r6("verified_ratio"))


@query("o04_audit_problems", _AUDIT + " SELECT raw_id, array_to_string(list_filter([CASE WHEN miss THEN 'missing_publication_time' END, CASE WHEN fut THEN 'future_after_observation' END, CASE WHEN upd THEN 'updated_before_published' END, CASE WHEN norm THEN 'normalized_missing' END, CASE WHEN mism THEN 'content_time_mismatch' END, CASE WHEN NOT (miss OR fut OR upd OR norm OR mism) THEN 'ambiguous_timestamp_semantics' END], lambda x: x IS NOT NULL), ',') AS issues FROM aud WHERE miss OR fut OR upd OR norm OR mism OR NOT verified ORDER BY raw_id LIMIT 20")
def o04(spark, sf):
    return ql.audit_problems(_audit(spark, sf)).select("raw_id", F.array_join("issues", ",").alias("issues"))


@query(
    "a10_source_status",
    f"""WITH {RAW}, {TRENDS}, s AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'wikimedia-pageviews')
    SELECT name AS source, (SELECT count(*) FROM raw WHERE raw.source = name) AS raw_observation_count, (SELECT count(*) FROM events WHERE event_type = name) AS content_count,
      (SELECT CAST(floor(epoch(max(observed_at))) AS BIGINT) FROM raw WHERE raw.source = name) AS last_observed_at,
      CASE WHEN name = 'wikimedia-pageviews' THEN (SELECT count(*) FROM obs) ELSE 0 END AS trend_observation_count, CASE WHEN name = 'wikimedia-pageviews' THEN (SELECT count(*) FROM trend) ELSE 0 END AS trend_signal_count FROM s""",
)
def a10(spark, sf):
    d = hourly(spark, sf)
    dims = _source_dim(spark, sf).select("source").unionByName(spark.createDataFrame([("wikimedia-pageviews",)], "source string"))
    obs = trend_observations(spark, sf)
    rows = ql.source_status(dims, raw_observations(spark, sf), d.content, obs, tr.trend_signals(obs))
    return rows.select("source", n("raw_observation_count"), n("content_count"), secs("last_observed_at"), n("trend_observation_count"), n("trend_signal_count"))


@query(
    "r12_source_report",
    _QUALITY + """, q AS (SELECT source, metric_name FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (source)) INTO NAME metric_name VALUE v) QUALIFY row_number() OVER (PARTITION BY source ORDER BY metric_name) <= 4),
    arch AS (SELECT string_agg(o_orderstatus || ':' || n || '/' || c, ',' ORDER BY o_orderstatus) AS t FROM (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS c FROM orders GROUP BY 1))
    SELECT name AS source, (SELECT count(*) FROM raw WHERE raw.source = name) AS raw_observation_count, (SELECT string_agg(metric_name, ',' ORDER BY metric_name) FROM q WHERE q.source = name) AS quality,
      CASE WHEN name = 'click' THEN (SELECT t FROM arch) END AS archive FROM (SELECT DISTINCT event_type AS name FROM events)""",
)
def r12(spark, sf):
    """Status, newest quality and archive lookups in one read; orders stand in for the lookups of one source."""
    d, raw, obs = hourly(spark, sf), raw_observations(spark, sf), trend_observations(spark, sf)
    dims = _source_dim(spark, sf)
    figures = ql.source_quality(dims, raw, d.content, d.content_asset, d.analysis).withColumn("metric_date", F.lit("2024-01-31").cast("date"))
    lookups = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("2024-01-31").cast("timestamp")).alias("checked_at"))
    status = ql.source_status(dims.select("source"), raw, d.content, obs, tr.trend_signals(obs))
    rows = ql.status_report(status, figures, lookups, archive_source="click", per_source=4)
    looked = F.transform("archive", lambda a: F.concat(a["status"], F.lit(":"), a["lookups"].cast("string"), F.lit("/"), a["checked"].cast("string")))
    return rows.select("source", n("raw_observation_count"), F.array_join(F.transform("quality", lambda q: q["metric_name"]), ",").alias("quality"), F.array_join(looked, ",").alias("archive"))


@query("a20_publication_histogram", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS items FROM events GROUP BY 1")
def a20(spark, sf):
    return ql.publication_histogram(table(spark, sf, "events"), "ts")


def _runs(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.when(k % 11 != 0, k % 20 + 1).alias("topic_id"), F.col("o_orderstatus").alias("source"), (k % 40).alias("items_collected"), (k % 7).alias("duplicates"), (k % 3).alias("topic_links_added"),
        (k % 13 == 0).alias("source_degraded"), (k % 17 == 0).alias("source_partial"), (k % 5 == 0).alias("collection_skipped"), F.when(k % 10 == 0, "checkpoint_complete").when(k % 5 == 0, "cooldown").alias("skip_reason"),
    )


@query(
    "a18_collection_summary",
    """SELECT count(DISTINCT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 20 + 1 END) AS topic_count, count(DISTINCT o_orderstatus) AS source_count, count(*) AS attempt_count, sum(o_orderkey % 40)::BIGINT AS items_collected, sum(o_orderkey % 7)::BIGINT AS duplicates,
    sum(o_orderkey % 3)::BIGINT AS topic_links_added, count(*) FILTER (o_orderkey % 13 = 0) AS degraded, count(*) FILTER (o_orderkey % 17 = 0) AS partial, count(*) FILTER (o_orderkey % 10 = 0) AS skipped_completed, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0) AS deferred FROM orders""",
)
def a18(spark, sf):
    rows = ql.collection_summary(_runs(spark, sf))
    return rows.select(*[n(c) for c in rows.columns])


@query(
    "a19_merged_diagnostics",
    """WITH p AS (SELECT user_id AS run_id, event_id AS page, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)
    SELECT run_id, 'items' AS name, CAST(sum(k)::DOUBLE AS VARCHAR) AS value FROM p GROUP BY 1 UNION ALL SELECT run_id, 'pending', CASE WHEN bool_or(k % 50 = 0) THEN 'true' ELSE 'false' END FROM p GROUP BY 1
    UNION ALL SELECT run_id, 'basis', arg_max(event_type, page) FROM p GROUP BY 1""",
)
def a19(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    pages = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("page"),
        F.create_map(F.lit("items"), k.cast("string"), F.lit("pending"), (k % 50 == 0).cast("string"), F.lit("basis"), F.col("event_type")).alias("diagnostics"),
    )
    return ql.merge_diagnostics(pages)


@query("r14_listings", "SELECT p_brand AS market, p_partkey AS symbol, row_number() OVER (ORDER BY p_brand, p_partkey) AS position FROM part")
def r14(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("market"), F.col("p_partkey").alias("symbol"))
    return rd.listing(rows, ["market", "symbol"])


@query(
    "w19_answer_ranks",
    "SELECT l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity::BIGINT DESC, l_linenumber DESC, l_partkey DESC, l_orderkey * 1000000 + l_suppkey, l_extendedprice) AS answer_rank, l_returnflag FROM lineitem",
)
def w19(spark, sf):
    """Line items as answers of three questions, each holding a third of all rows."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", F.col("l_quantity").cast("long").alias("votes"), F.col("l_linenumber").cast("long").alias("favorites"), F.col("l_partkey").alias("comments"),
        F.struct((F.col("l_orderkey") * 1000000 + F.col("l_suppkey")).alias("a"), F.col("l_extendedprice").alias("b")).alias("position"),
    )
    return ig.session_answer_rank(rows, ["l_returnflag"]).select("l_orderkey", n("answer_rank"), "l_returnflag")
