"""Queries over work lists, contracts, evidence review and asset codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, secs, table
from catalog.standins import HOURLY, hourly
from murmur.functions import hashing as hs
from murmur.functions.text import kind_slug
from murmur.operators import market as mk
from murmur.operators import worklists as wl
from murmur.plans import review as rv
from murmur.session import written

_NOW = "2024-01-15 00:00:00"


def _targets(spark, sf):
    d = hourly(spark, sf)
    content = d.content.withColumns({
        "title": F.lit(None).cast("string"), "body": F.concat(F.lit("post "), F.col("source_item_id")), "content_hash": F.sha2("source_item_id", 256),
    })
    topics = spark.range(1, 9).select(F.col("id").alias("topic_id"), F.concat(F.lit("topic-"), F.col("id").cast("string")).alias("slug"))
    return content, wl.analysis_targets(content, d.content_topic, topics)


def _tasks(targets):
    c = F.col("content_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed")]), (c % 4 + 1).cast("int"))
    return targets.where(c % 6 < 4).select(
        "content_id", "topic_id", F.when(c % 8 == 0, "old").otherwise(F.col("input_hash")).alias("input_hash"), F.lit("m1").alias("model"), status.alias("status"),
        F.when(c % 3 == 0, F.timestamp_seconds(F.unix_seconds(F.lit(_NOW).cast("timestamp")) + (c % 7 - 3) * 3600)).alias("next_retry_at"),
    )


_TARGETS = f"""WITH {HOURLY},
target AS (SELECT c.content_id, t.topic_id, sha256('{{"body":"post ' || c.content_id || '","content_hash":"' || sha256(c.content_id::VARCHAR) || '","title":"","topic_id":' || coalesce(t.topic_id::VARCHAR, 'null') || ',"topic_slug":' || coalesce('"topic-' || t.topic_id || '"', 'null') || '}}') AS input_hash
  FROM content c LEFT JOIN content_topic t USING (content_id)),
task AS (SELECT content_id, topic_id, CASE WHEN content_id % 8 = 0 THEN 'old' ELSE input_hash END AS input_hash, ['pending', 'running', 'completed', 'failed'][content_id % 4 + 1] AS status,
  CASE WHEN content_id % 3 = 0 THEN TIMESTAMP '{_NOW}' + INTERVAL 1 HOUR * (content_id % 7 - 3) END AS next_retry_at FROM target WHERE content_id % 6 < 4)"""


@query("x20_analysis_input_hash", _TARGETS + " SELECT * FROM target")
def x20(spark, sf):
    return _targets(spark, sf)[1].select("content_id", "topic_id", "input_hash")


@query(
    "j08_pending_targets",
    _TARGETS + f""" SELECT content_id, topic_id FROM target t WHERE content_id % 9 <> 0 AND content_id % 5 <> 0
    AND NOT EXISTS (SELECT 1 FROM task k WHERE k.content_id = t.content_id AND k.topic_id IS NOT DISTINCT FROM t.topic_id AND k.input_hash = t.input_hash AND k.next_retry_at > TIMESTAMP '{_NOW}')""",
)
def j08(spark, sf):
    content, targets = _targets(spark, sf)
    reviewed = content.where(F.col("content_id") % 9 == 0).select("content_id")
    done = targets.where(F.col("content_id") % 5 == 0).withColumn("model", F.lit("m1"))
    return wl.pending_targets(targets, reviewed, done, _tasks(targets), models=("m1",), now=F.lit(_NOW).cast("timestamp")).select("content_id", "topic_id")


@query(
    "a17_task_summary",
    _TARGETS + f""", live AS (SELECT k.*, EXISTS (SELECT 1 FROM target t WHERE t.content_id = k.content_id AND t.topic_id IS NOT DISTINCT FROM k.topic_id AND t.input_hash = k.input_hash) AS cur FROM task k)
    SELECT (SELECT count(*) FROM target) AS targets, count(*) FILTER (cur) AS total, count(*) AS historical_total, count(*) FILTER (NOT cur) AS superseded, count(*) FILTER (cur AND status = 'pending') AS pending, count(*) FILTER (cur AND status = 'running') AS running,
      count(*) FILTER (cur AND status = 'completed') AS completed, count(*) FILTER (cur AND status = 'failed') AS failed, count(*) FILTER (cur AND status IN ('pending', 'failed') AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{_NOW}')) AS retry_ready,
      count(*) FILTER (cur AND status IN ('pending', 'failed') AND next_retry_at > TIMESTAMP '{_NOW}') AS retry_deferred, (SELECT count(*) FROM target) - count(*) FILTER (cur) AS untracked FROM live""",
)
def a17(spark, sf):
    _, targets = _targets(spark, sf)
    rows = wl.task_summary(targets, _tasks(targets), now=F.lit(_NOW).cast("timestamp"))
    return rows.select(*[n(c) for c in rows.columns])


@query(
    "x27_retry_times",
    f"""SELECT event_id, CAST(epoch(TIMESTAMP '{_NOW}') + least(21600, 30 * pow(2, least(event_id % 15, 8))) AS BIGINT) AS task_retry, CAST(epoch(TIMESTAMP '{_NOW}') + 60 * CASE event_type WHEN 'error' THEN 360 WHEN 'click' THEN 30 ELSE 15 END AS BIGINT) AS source_retry FROM events""",
)
def x27(spark, sf):
    now = F.lit(_NOW).cast("timestamp")
    error = F.when(F.col("event_type") == "error", "upstream returned HTTP 403").when(F.col("event_type") == "click", "429 too many").otherwise("timeout")
    return table(spark, sf, "events").select("event_id", secs(wl.task_retry_at(now, F.col("event_id") % 15 + 1), "task_retry"), secs(wl.collection_retry_at(now, error), "source_retry"))


@query(
    "w23_source_cooldowns",
    f"""WITH j AS (SELECT l_shipdate AS d, l_returnflag || l_linestatus AS source, l_linenumber = 1 AS partial, l_linenumber = 7 AS done FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01')
    SELECT source, count(*) FILTER (partial) AS partial_jobs, CAST(epoch(CASE WHEN count(*) FILTER (partial) >= 3 THEN max(d) FILTER (partial) ELSE max(d) FILTER (NOT partial) END) AS BIGINT) AS retry_at FROM j WHERE NOT done GROUP BY 1""",
)
def w23(spark, sf):
    jobs = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("source"), (F.col("l_linenumber") == 1).alias("partial"), (F.col("l_linenumber") == 7).alias("done"), F.col("l_shipdate").alias("next_retry_at"),
    )
    return wl.source_cooldowns(jobs, now=F.lit("1998-01-01").cast("timestamp")).select("source", n("partial_jobs"), secs("retry_at"))


@query(
    "st2_next_windows",
    """WITH c AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c_custkey, CAST(epoch(coalesce(last::TIMESTAMP - INTERVAL 2 HOUR, TIMESTAMP '2002-01-01' - INTERVAL 24 HOUR)) AS BIGINT) AS window_start FROM customer LEFT JOIN c ON o_custkey = c_custkey""",
)
def st2(spark, sf):
    scopes = table(spark, sf, "customer").select("c_custkey", F.lit("s").alias("source"), F.col("c_custkey").cast("string").alias("scope_key"))
    marks = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").groupBy(F.lit("s").alias("source"), F.col("o_custkey").cast("string").alias("scope_key")).agg(F.max("o_orderdate").alias("last_successful_until"))
    return wl.next_windows(scopes, marks, now=F.lit("2002-01-01").cast("timestamp")).select("c_custkey", secs("window_start"))


@query(
    "p16_review_candidates",
    f"""WITH {HOURLY}, latest AS (SELECT content_id, arg_max(intent, analysis_id) AS intent FROM analysis WHERE model = 'rule-based-v0' GROUP BY 1)
    SELECT content_id FROM content JOIN latest USING (content_id) WHERE latest.intent IN ('buy', 'unknown') AND published_at >= TIMESTAMP '2024-01-05' AND published_at <= TIMESTAMP '2024-01-20' AND source IN ('click', 'view', 'error')
      AND length('post ' || content_id) >= 8 AND content_id NOT IN (SELECT content_id FROM analysis WHERE model = 'm2')""",
)
def p16(spark, sf):
    d = hourly(spark, sf)
    content = d.content.withColumns({"title": F.lit(None).cast("string"), "body": F.concat(F.lit("post "), F.col("source_item_id")), "content_hash": F.sha2("source_item_id", 256)})
    scanned = d.analysis.where(F.col("model") == "m2").select("content_id").distinct()
    rows = wl.review_candidates(
        content, d.analysis, sources=("click", "view", "error"), since=F.lit("2024-01-05").cast("timestamp"), until=F.lit("2024-01-20").cast("timestamp"),
        min_chars=8, candidate_model="rule-based-v0", candidate_intents=("buy", "unknown"), scanned=scanned, resume_models=("m-via-openai-compatible",),
    )
    return rows.select("content_id")


@query("p17_review_shards", "SELECT event_id % 8 AS shard, count(*) AS posts FROM events GROUP BY 1")
def p17(spark, sf):
    """Every shard of the modulo split, so all posts are covered exactly once."""
    content = hourly(spark, sf).content.withColumns({"title": F.lit(None).cast("string"), "body": F.lit("x"), "content_hash": F.lit("h")})
    analysis = hourly(spark, sf).analysis
    parts = [wl.review_candidates(content, analysis, shard_count=8, shard_index=i).select(F.lit(i).alias("shard")) for i in range(8)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(n("shard")).agg(F.count("*").alias("posts"))


_BASES = list(wl.ALL_BASES)


def _items(spark, sf):
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("source_text"), pick(wl.INTENTS).alias("intent"), pick(("bullish", "bearish", "neutral")).alias("direction"), pick(_BASES).alias("intent_basis"),
        F.when(i % 4 == 3, "zz not in here").when(i % 4 == 2, "").otherwise(F.substring("text", 1, 12)).alias("intent_evidence"),
        F.when(i % 11 == 0, " ").when(i % 7 == 0, "作者 非作者 本人").otherwise("ok").alias("rationale"),
    )


def _sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_REVIEW = f"""WITH i AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS src, {list(wl.INTENTS)}[doc_id % 5 + 1] AS intent, ['bullish', 'bearish', 'neutral'][doc_id % 3 + 1] AS direction, {_BASES}[doc_id % {len(_BASES)} + 1] AS basis0,
  regexp_replace(CASE WHEN doc_id % 4 = 3 THEN 'zz not in here' WHEN doc_id % 4 = 2 THEN '' ELSE substr(text, 1, 12) END, '\\s+', '', 'g') AS proof, doc_id % 11 = 0 AS no_reason, doc_id % 7 = 0 AND doc_id % 11 <> 0 AS contra FROM documents),
j AS (SELECT *, CASE WHEN intent = 'unknown' AND basis0 IN {_sql_in(wl.TENDENCY_BASES)} THEN 'insufficient' ELSE basis0 END AS basis FROM i),
f AS (SELECT *, list_filter([CASE WHEN no_reason THEN 'no_rationale' END, CASE WHEN intent <> 'unknown' AND basis IN {_sql_in(wl.EXPLICIT_BASES)} AND contra THEN 'contradicts_rationale' END,
  CASE WHEN proof <> '' AND NOT contains(src, proof) THEN 'evidence_not_in_text' END, CASE WHEN intent IN ('buy', 'sell') AND (basis NOT IN {_sql_in(wl.ACTION_BASES + wl.TENDENCY_BASES)} OR proof = '') THEN 'no_action_evidence' END,
  CASE WHEN intent = 'hold' AND (basis NOT IN ('explicit_self_position', 'advice_or_recommendation') OR proof = '') THEN 'no_position_evidence' END, CASE WHEN intent = 'wait' AND (basis NOT IN ('explicit_wait', 'advice_or_recommendation') OR proof = '') THEN 'no_waiting_evidence' END,
  CASE WHEN intent = 'unknown' AND basis NOT IN {_sql_in(wl.OTHER_BASES)} THEN 'unknown_with_action_basis' END,
  CASE WHEN basis = 'market_directional_view' AND ((intent = 'buy' AND direction <> 'bullish') OR (intent = 'sell' AND direction <> 'bearish') OR intent NOT IN ('buy', 'sell')) THEN 'direction_not_aligned' END,
  CASE WHEN basis = 'risk_warning' AND (intent <> 'sell' OR direction <> 'bearish') THEN 'warning_not_bearish' END], lambda x: x IS NOT NULL) AS faults FROM j)"""


@query("p13_evidence_rules", _REVIEW + " SELECT doc_id, array_to_string(faults, ',') AS faults, CASE WHEN len(faults) > 0 THEN 'unknown' ELSE intent END AS intent, CASE WHEN len(faults) > 0 THEN 'insufficient' ELSE basis END AS intent_basis, len(faults) > 0 AS degraded FROM f")
def p13(spark, sf):
    return wl.review(_items(spark, sf)).select("doc_id", F.array_join("evidence_faults", ",").alias("faults"), "intent", "intent_basis", "degraded")


@query("a26_review_counters", _REVIEW + ", o AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, CASE WHEN len(faults) > 0 THEN 'unknown' ELSE intent END AS intent FROM f) SELECT model, count(*) FILTER (intent = 'buy') AS buy, count(*) FILTER (intent = 'sell') AS sell, count(*) FILTER (intent = 'hold') AS hold, count(*) FILTER (intent = 'wait') AS wait, count(*) FILTER (intent = 'unknown') AS unknown, count(*) AS reviewed FROM o GROUP BY 1")
def a26(spark, sf):
    rows = wl.review(_items(spark, sf)).withColumn("model", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    return wl.review_counters(rows)


def _answers(spark, sf):
    """Landed answers: a contract per document, some fenced, some wrong in one place."""
    i = F.col("doc_id")
    valued = lambda v, c=0.5: F.struct(F.lit(v).alias("value"), F.lit(c).alias("confidence"))
    good = F.to_json(F.struct(
        F.struct(F.when(i % 17 != 0, "retail").alias("type"), F.when(i % 17 == 0, "kol").alias("value"), F.when(i % 19 == 0, 1.5).otherwise(0.9).alias("confidence")).alias("actor"),
        F.struct(F.lit("novice").alias("level"), F.lit(0.5).alias("confidence")).alias("investor"), F.array(F.lit("first_time")).alias("novice_signals"),
        valued("bullish").alias("direction"), F.struct(F.when(i % 23 == 0, "dance").otherwise("buy").alias("value"), F.lit(0.5).alias("confidence")).alias("intent"),
        valued("owned").alias("position"), F.struct(F.lit(True).alias("urgency"), F.lit(False).alias("panic")).alias("emotion"), F.struct(F.lit(False).alias("value"), F.lit(0.1).alias("confidence")).alias("spam"),
        F.when(i % 2 == 0, F.struct(F.lit(True).alias("value"), F.lit(0.2).alias("confidence"))).alias("promotion"), F.when(i % 13 == 0, "x").alias("mood"), i.alias("id"),
    ))
    wrapped = F.when(i % 3 == 0, F.concat(F.lit("<think>{\"id\": 0}</think>\n```json\n"), good, F.lit("\n```"))).when(i % 29 == 0, "sorry, no json").otherwise(F.concat(F.lit('{"items": ['), good, F.lit("]}")))
    return table(spark, sf, "documents").select("doc_id", wrapped.alias("answer"))


@query(
    "p12_contract_validation",
    """SELECT doc_id, CASE WHEN doc_id % 29 = 0 AND doc_id % 3 <> 0 THEN 'no_items' ELSE array_to_string(list_filter([CASE WHEN doc_id % 13 = 0 THEN 'unknown_field' END, CASE WHEN doc_id % 19 = 0 THEN 'bad_confidence_in_actor' END, CASE WHEN doc_id % 23 = 0 THEN 'bad_value_in_intent' END], lambda x: x IS NOT NULL), ',') END AS faults,
    CASE WHEN doc_id % 29 = 0 AND doc_id % 3 <> 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'kol' ELSE 'retail' END AS actor_type, CASE WHEN doc_id % 29 = 0 AND doc_id % 3 <> 0 THEN NULL ELSE doc_id % 2 = 0 END AS promotion FROM documents""",
)
def p12(spark, sf):
    items, bad = wl.review_items(_answers(spark, sf))
    checked = wl.parse_contract(items)
    flat = wl.flatten_contract(checked.withColumn("fault_list", F.array_join("faults", ","))).select("doc_id", F.col("fault_list").alias("faults"), "actor_type", "promotion")
    return flat.unionByName(bad.select("doc_id", F.lit("no_items").alias("faults"), F.lit(None).cast("string").alias("actor_type"), F.lit(None).cast("boolean").alias("promotion")))


@query(
    "x38_exchange_codes",
    """WITH a AS (SELECT p_partkey AS id, ['CN', 'HK', 'US'][p_partkey % 3 + 1] AS m, CASE WHEN p_partkey % 3 = 0 THEN lpad((p_partkey * 7919 % 999983)::VARCHAR, 6, '0') WHEN p_partkey % 3 = 1 THEN lpad((p_partkey * 31 % 9999)::VARCHAR, 5, '0') ELSE 'sym' || p_partkey END AS s, p_partkey % 5 = 0 AS idx FROM part),
    b AS (SELECT *, upper(s) AS u, (idx AND s LIKE '000%') OR left(s, 1) IN ('5', '6', '9') AS sh FROM a)
    SELECT id, CASE m WHEN 'US' THEN CASE WHEN idx THEN '100.' ELSE '105.' END || u WHEN 'HK' THEN '116.' || CASE WHEN ltrim(u, '0') = '' THEN '0' ELSE ltrim(u, '0') END ELSE CASE WHEN sh THEN '1.' ELSE '0.' END || u END AS secid,
      CASE m WHEN 'US' THEN 'us.' || u WHEN 'HK' THEN 'hk' || lpad(u, 5, '0') ELSE CASE WHEN sh THEN 'sh' ELSE 'sz' END || u END AS code, CASE WHEN m = 'US' THEN 'nasdaq' ELSE 'tencent' END AS provider FROM b""",
)
def x38(spark, sf):
    i = F.col("p_partkey")
    symbol = F.when(i % 3 == 0, F.lpad((i * 7919 % 999983).cast("string"), 6, "0")).when(i % 3 == 1, F.lpad((i * 31 % 9999).cast("string"), 5, "0")).otherwise(F.concat(F.lit("sym"), i.cast("string")))
    market = F.element_at(F.array(F.lit("CN"), F.lit("HK"), F.lit("US")), (i % 3 + 1).cast("int"))
    kind = F.when(i % 5 == 0, "index").otherwise("stock")
    return table(spark, sf, "part").select(
        i.alias("id"), mk.exchange_code(market, symbol, kind, "secid").alias("secid"), mk.exchange_code(market, symbol, kind, "code").alias("code"),
        mk.provider_for_asset(F.lit("public"), market).alias("provider"),
    )


@query("x21_fingerprints", "SELECT o_orderkey, sha256(trim(o_orderpriority)) AS fingerprint, sha256('explicit:1:2:' || o_orderstatus || ':topic-' || (o_orderkey % 8)) AS run_key, 'zhihu_' || regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS kind FROM orders")
def x21(spark, sf):
    topic = F.concat(F.lit("topic-"), (F.col("o_orderkey") % 8).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey", hs.query_fingerprint(F.col("o_orderpriority")).alias("fingerprint"), hs.task_run_key(F.lit("explicit:1:2"), F.col("o_orderstatus"), topic).alias("run_key"), kind_slug(F.col("o_orderpriority")).alias("kind"),
    )


@query(
    "u08_first_seen",
    "SELECT l_partkey::VARCHAR AS note_id, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem WHERE l_returnflag <> 'A' AND l_partkey % 10 <> 0 GROUP BY 1",
)
def u08(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("note_id"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("").alias("token"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position")
    )
    known = table(spark, sf, "part").where(F.col("p_partkey") % 10 == 0).select(F.col("p_partkey").cast("string").alias("note_id"))
    return wl.first_seen(rows, known=known).select("note_id", "position")


@query(
    "j26_archive_queue",
    f"""WITH {HOURLY} SELECT content_id, 'http://x/' || content_id AS url FROM content WHERE content_id % 4 <> 0 AND published_at >= TIMESTAMP '2024-01-03' AND published_at < TIMESTAMP '2024-01-25'
    AND (content_id % 5 <> 0 OR content_id % 3 = 0) AND (content_id % 5 <> 0 OR content_id % 7 <> 0) ORDER BY content_id LIMIT 500""",
)
def j26(spark, sf):
    from murmur.sources.archive import lookup_queue

    c = F.col("content_id")
    content = hourly(spark, sf).content.withColumn("url", F.when(c % 4 != 0, F.concat(F.lit("http://x/"), c.cast("string"))))
    state = content.where(c % 5 == 0).select(
        "content_id", F.when(c % 3 == 0, "old").otherwise("now").alias("last_crawl_id"), F.lit("complete").alias("status"), F.when(c % 7 == 0, F.lit("2030-01-01").cast("timestamp")).alias("next_retry_at")
    )
    at = lambda v: F.lit(v).cast("timestamp")
    return lookup_queue(content, state, crawl_id="now", since=at("2024-01-03"), until=at("2024-01-25"), now=at("2024-02-01"), limit=500)


_REVIEWER = "m-via-codex-cli"


def _review_answers(requests):
    """An answer per batch: some items break the contract, name another post or come twice; every tenth batch is no JSON."""
    i = F.col("content_id")
    sure = lambda value: F.struct(F.lit(value).alias("value"), F.lit(0.5).alias("confidence"))
    named = lambda name, value: F.struct(F.lit(value).alias(name), F.lit(0.5).alias("confidence"))
    item = F.struct(
        named("type", "retail").alias("actor"), named("level", "unknown").alias("investor"), F.array().cast("array<string>").alias("novice_signals"),
        sure("bullish").alias("direction"), sure("buy").alias("intent"), sure("owned").alias("position"), F.struct(F.lit(False).alias("panic")).alias("emotion"), sure(False).alias("spam"),
        F.when(i % 17 == 0, i + 1000000000).otherwise(i).alias("id"), F.lit("explicit_self_executed").alias("intent_basis"), F.lit("ok").alias("rationale"),
        F.when(i % 4 == 3, "zz not in here").otherwise(F.substring("body", 1, 12)).alias("intent_evidence"), F.when(i % 13 == 0, 1).alias("mood"),
    )
    times = F.explode(F.sequence(F.lit(0), F.when(i % 19 == 0, 1).otherwise(0)))
    # Items are few bytes and slow to print; left to their size, all batches would be made in one task.
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = requests.select("batch", item.alias("item"), times.alias("_t")).repartition(parts, "batch").groupBy("batch").agg(F.collect_list("item").alias("items"))
    answer = F.when(F.col("batch") % 10 == 0, "no answer today").otherwise(F.to_json(F.struct("items")))
    return items.select(F.col("batch").alias("answer_id"), "batch", F.lit(_REVIEWER).alias("model"), answer.alias("answer"))


@query(
    "f07_review_job",
    """WITH asked AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 20 + 1 AS batch FROM documents WHERE doc_id % 7 <> 0),
    item AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unknown_field' WHEN doc_id % 17 = 0 THEN 'not_asked' WHEN doc_id % 19 = 0 THEN 'returned_twice' END AS reason FROM asked WHERE batch % 10 <> 0),
    top AS (SELECT max(CASE WHEN doc_id % 11 = 0 THEN doc_id * 2 + 1 WHEN doc_id % 7 = 0 THEN doc_id * 2 END) AS top FROM documents)
    SELECT doc_id AS content_id, batch, CASE WHEN doc_id % 4 = 3 OR regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', '', 'g') = '' THEN 'unknown' ELSE 'buy' END AS outcome,
      row_number() OVER (ORDER BY doc_id) + (SELECT top FROM top) AS analysis_id FROM item WHERE reason IS NULL
    UNION ALL SELECT CASE WHEN doc_id % 17 = 0 THEN doc_id + 1000000000 ELSE doc_id END, batch, reason, NULL FROM (SELECT *, unnest(range(CASE WHEN doc_id % 19 = 0 THEN 2 ELSE 1 END)) AS t FROM item WHERE reason IS NOT NULL)
    UNION ALL SELECT DISTINCT NULL, batch, 'unreadable', NULL FROM asked WHERE batch % 10 = 0""",
)
def f07(spark, sf):
    """All documents as posts: one in seven is reviewed already, one in eleven was reviewed with an older text."""
    content = table(spark, sf, "documents").select(
        F.col("doc_id").alias("content_id"), "source", F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("title"),
        F.coalesce("text", F.lit("")).alias("body"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.lit(False).alias("is_deleted"),
    )
    i, version = F.col("content_id"), F.concat(F.lit("codex-content-review-v4:"), F.substring("content_hash", 1, 12))
    stored = lambda rows, ident, prompt: rows.select(
        ident.alias("analysis_id"), "content_id", F.lit(None).cast("long").alias("topic_id"), F.col("content_hash").alias("input_hash"), F.lit(_REVIEWER).alias("model"),
        prompt.alias("prompt_version"), F.lit("content-analysis-v1").alias("schema_version"), F.lit("hold").alias("intent"),
    )
    analysis = stored(content.where(i % 7 == 0), i * 2, version).unionByName(stored(content.where(i % 11 == 0), i * 2 + 1, F.lit("codex-content-review-v4:old")))
    requests = written(rv.review_requests(content, analysis, resume_models=(_REVIEWER,)))
    accepted, rejected = rv.judge_answers(written(_review_answers(requests)), requests)
    fresh, said = rv.review_rows(accepted, analysis, None, reviewer="r")
    batches = requests.select("content_id", "batch")
    done = fresh.join(said.select("analysis_id"), "analysis_id", "left_semi").join(batches, "content_id").select("content_id", n("batch"), F.col("intent").alias("outcome"), n("analysis_id"))
    return done.unionByName(rejected.select("content_id", n("batch"), F.col("reason").alias("outcome"), F.lit(None).cast("long").alias("analysis_id")))
