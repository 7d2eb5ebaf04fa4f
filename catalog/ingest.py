"""Queries over raw versions: append, links, folds, audits and text cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, secs, table
from catalog.standins import RAW, raw_links, raw_observations
from murmur.functions import text as tx
from murmur.functions.hashing import canonical_json, payload_hash
from murmur.functions import timeutil as tu
from murmur.operators import ingest as ig
from murmur.sources.raw import with_payload

_S = "CAST(floor(epoch({0})) AS BIGINT) AS {1}"


def _pad(byte: int) -> str:
    """The inner or outer key block of the pseudonym's HMAC as a blob literal."""
    return "".join(f"\\x{b ^ byte:02x}" for b in b"murmur".ljust(64, b"\0"))


def _stored(raw):
    return raw.where((F.col("raw_id") % 3 == 0) & (F.col("raw_id") % 2 == 0))


_LINE = """'{{"comment":"a b","discount":' || {0} || ',"lines":[' || l_linenumber || ',1.0],"order":' || l_orderkey || ',"price":' || {1} || '}}'"""


@query(
    "x03_payload_hash",
    f"SELECT l_orderkey, l_linenumber, sha256({_LINE.format('CAST(l_discount AS DOUBLE)', 'CAST(l_extendedprice AS DOUBLE)')}) AS payload_hash FROM lineitem WHERE l_extendedprice < 1e7",
)
def x03(spark, sf):
    """Payloads with names out of order, blanks, and whole and broken numbers, over all line items."""
    lines = table(spark, sf, "lineitem").where("l_extendedprice < 1e7")
    price, discount = F.col("l_extendedprice").cast("double").cast("string"), F.col("l_discount").cast("double").cast("string")
    text = F.concat(
        F.lit('{"price": '), price, F.lit(', "order":'), F.col("l_orderkey").cast("string"), F.lit(', "lines" : ['), F.col("l_linenumber").cast("string"),
        F.lit(', 1.0], "discount":'), discount, F.lit(',"comment":"a b"}'),
    )
    return lines.select("l_orderkey", "l_linenumber", payload_hash(canonical_json(text)).alias("payload_hash"))


@query(
    "j01_append_new",
    f"""WITH {RAW}, stored AS (SELECT * FROM hashed WHERE raw_id % 3 = 0 AND raw_id % 2 = 0),
    firsts AS (SELECT * FROM hashed WHERE issue IS NULL QUALIFY row_number() OVER (PARTITION BY source, source_item_id, payload_hash ORDER BY raw_id) = 1),
    fresh AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = f.source AND s.source_item_id = f.source_item_id AND s.payload_hash = f.payload_hash))
    SELECT raw_id, payload_hash, 'appended' AS outcome FROM fresh f WHERE NOT (cut AND (
      EXISTS (SELECT 1 FROM stored s WHERE s.source = f.source AND s.source_item_id = f.source_item_id AND NOT s.cut)
      OR EXISTS (SELECT 1 FROM fresh e WHERE e.source = f.source AND e.source_item_id = f.source_item_id AND NOT e.cut AND e.raw_id < f.raw_id)))
    UNION ALL SELECT raw_id, payload_hash, issue FROM hashed WHERE issue IS NOT NULL""",
)
def j01(spark, sf):
    raw = raw_observations(spark, sf)
    fresh, rejected = ig.append_new(raw, _stored(raw))
    return fresh.select("raw_id", "payload_hash", F.lit("appended").alias("outcome")).unionByName(
        rejected.select("raw_id", "payload_hash", F.col("issue").alias("outcome"))
    )


@query(
    "j03_new_topic_links",
    f"WITH {RAW} SELECT DISTINCT raw_id, topic_id, 'q' || topic_id AS collection_query FROM links WHERE NOT (topic_id = 1 AND raw_id % 2 = 0)",
)
def j03(spark, sf):
    links = raw_links(raw_observations(spark, sf))
    return ig.new_topic_links(links, links.where((F.col("topic_id") == 1) & (F.col("raw_id") % 2 == 0)))


@query(
    "j04_known_items",
    f"""WITH {RAW}, known AS (SELECT source, source_item_id, max(raw_id) AS known_id FROM hashed WHERE raw_id % 3 = 0 AND raw_id % 2 = 0 GROUP BY ALL),
    f AS (SELECT source, source_item_id, min(raw_id) AS first_id FROM hashed GROUP BY ALL)
    SELECT raw_id, CASE WHEN known_id IS NULL AND raw_id = first_id THEN NULL ELSE coalesce(known_id, first_id) END AS known_raw_id
    FROM hashed LEFT JOIN known USING (source, source_item_id) JOIN f USING (source, source_item_id)""",
)
def j04(spark, sf):
    raw = raw_observations(spark, sf)
    fresh, repeats = ig.split_known(raw, _stored(raw))
    return fresh.select("raw_id", F.lit(None).cast("long").alias("known_raw_id")).unionByName(repeats.select("raw_id", "known_raw_id"))


@query("w12_latest_version", f"WITH {RAW} SELECT source, source_item_id, max(raw_id) AS raw_id, arg_max(payload_hash, raw_id) AS payload_hash FROM hashed GROUP BY ALL")
def w12(spark, sf):
    return ig.latest_versions(raw_observations(spark, sf)).select("source", "source_item_id", "raw_id", "payload_hash")


@query(
    "w13_latest_complete_version",
    f"WITH {RAW} SELECT source, source_item_id, raw_id FROM hashed QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY cut, raw_id DESC) = 1",
)
def w13(spark, sf):
    return ig.latest_complete(raw_observations(spark, sf)).select("source", "source_item_id", "raw_id")


@query("p10_validity_issues", f"WITH {RAW} SELECT raw_id, issue FROM hashed")
def p10(spark, sf):
    return with_payload(raw_observations(spark, sf)).select("raw_id", ig.validity_issue().alias("issue"))


@query(
    "p01_observation_window",
    f"""WITH {RAW} SELECT raw_id, observation_kind = 'pageviews' OR (coalesce(published_at, observed_at) >= TIMESTAMP '2024-01-10' AND coalesce(published_at, observed_at) < TIMESTAMP '2024-01-20') AS inside FROM raw""",
)
def p01(spark, sf):
    since, until = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return with_payload(raw_observations(spark, sf)).select("raw_id", ig.in_window(since, until).alias("inside"))


@query(
    "x29_folded_content",
    f"""WITH {RAW}, c AS (SELECT *, coalesce(published_at, observed_at) AS pub FROM hashed WHERE observation_kind = 'forum_post'),
    base AS (SELECT source, source_item_id, coalesce(max(raw_id) FILTER (verified), min(raw_id)) AS from_id, max(observed_at) AS last_seen, count(*) AS versions,
      arg_max(title, raw_id) FILTER (title IS NOT NULL) AS title, arg_max(likes, raw_id) AS likes, arg_max(comments, raw_id) FILTER (comments IS NOT NULL) AS comments,
      arg_max(body, row(length(body), raw_id)) AS body, arg_max(payload_hash, raw_id) AS content_hash FROM c GROUP BY ALL),
    t AS (SELECT source, source_item_id, min(pub) AS published FROM c JOIN base USING (source, source_item_id) WHERE raw_id >= from_id GROUP BY ALL)
    SELECT source, source_item_id, title, body, likes, comments, content_hash, versions, {_S.format('last_seen', 'last_seen_at')}, {_S.format('published', 'published_at')} FROM base JOIN t USING (source, source_item_id)""",
)
def x29(spark, sf):
    return ig.fold_versions(raw_observations(spark, sf)).select(
        "source", "source_item_id", "title", "body", "likes", "comments", "content_hash", n("versions"), secs("last_seen_at"), secs("published_at")
    )


@query(
    "f02_pending_versions",
    f"""WITH {RAW}, c AS (SELECT * FROM hashed WHERE observation_kind = 'forum_post'),
    newest AS (SELECT source, source_item_id, max(raw_id) AS raw_id, arg_max(payload_hash, raw_id) AS payload_hash FROM c GROUP BY ALL),
    done AS (SELECT source, source_item_id, payload_hash FROM c WHERE raw_id % 3 = 0 AND raw_id % 2 = 0)
    SELECT raw_id, payload_hash FROM newest ANTI JOIN done USING (source, source_item_id, payload_hash)""",
)
def f02(spark, sf):
    raw = raw_observations(spark, sf)
    done = _stored(raw).where(F.col("observation_kind") == "forum_post").select("source", "source_item_id", F.col("payload_hash").alias("content_hash"))
    return ig.pending_versions(raw, done).select("raw_id", "payload_hash")


@query(
    "x30_trend_points",
    f"""WITH {RAW}, t AS (SELECT raw_id, count(DISTINCT topic_id) AS c, min(topic_id) AS topic_id FROM links GROUP BY 1)
    SELECT raw_id AS observation_id, CASE WHEN c = 1 THEN topic_id END AS topic_id, {_S.format('published_at', 'observed_at')} FROM raw LEFT JOIN t USING (raw_id) WHERE observation_kind = 'pageviews'""",
)
def x30(spark, sf):
    raw = raw_observations(spark, sf)
    return ig.trend_points(ig.route(raw), raw_links(raw)).select("observation_id", "topic_id", secs("observed_at"))


@query(
    "f04_authors",
    f"""WITH {RAW} SELECT source, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(source || ':' || user_id)))) AS author_hash,
    {_S.format('arg_min(observed_at, raw_id)', 'first_seen_at')}, {_S.format('max(observed_at)', 'last_seen_at')} FROM raw GROUP BY source, user_id""",
)
def f04(spark, sf):
    return ig.authors(raw_observations(spark, sf)).select("source", "author_hash", secs("first_seen_at"), secs("last_seen_at"))


_CERTIFIED = {"click": {"timestamp_semantics": "published"}, "view": {"timestamp_semantics": "published"}}


@query(
    "i16_history_import",
    f"""WITH {RAW}, inside AS (SELECT * FROM hashed WHERE source IN ('click', 'view') AND published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'),
    best AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY cut, raw_id DESC) = 1),
    carried AS (SELECT DISTINCT source_item_id, topic_id FROM inside JOIN links USING (raw_id))
    SELECT raw_id, source, source_item_id, 'published' AS semantics, (SELECT count(*) FROM carried c WHERE c.source_item_id = best.source_item_id) AS topics FROM best""",
)
def i16(spark, sf):
    raw = raw_observations(spark, sf)
    bounds = {"since": F.lit("2024-01-05").cast("timestamp"), "until": F.lit("2024-01-25").cast("timestamp")}
    stamped, links = ig.import_history(raw, raw_links(raw), _CERTIFIED, **bounds)
    topics = links.groupBy("raw_id").agg(F.count("*").alias("topics"))
    return stamped.join(topics, "raw_id", "left").select(
        "raw_id", "source", "source_item_id", F.get_json_object("payload", "$.timestamp_semantics").alias("semantics"), n("topics")
    )


_HTML_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'gis') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<!--.*?-->', '', 'gs'), '<img\b[^>]*>', ' [图片] ', 'gi') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?(article|blockquote|br|div|h1|h2|h3|h4|h5|h6|li|p|section|tr)(\s[^>]*|/)?>', chr(10), 'gi'), '<[!?/a-zA-Z][^>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, html_decode_twice AS t FROM (SELECT page_id, """ + "replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&amp;', '&')" + r""" AS html_decode_twice FROM c)),
e AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(t, chr(160), ' '), chr(8203), ''), '[ \t\f\x0B]+', ' ', 'g'), ' ?[\r\n]+[ \r\n]*', chr(10), 'g') AS t FROM d)
SELECT page_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS body FROM e
"""


@query("x01_html_to_text", _HTML_SQL)
def x01(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("body"))


@query(
    "x02_canonical_urls",
    r"""WITH p AS (SELECT page_id, regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
    q AS (SELECT page_id, u, array_to_string(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]+|spm|from|share_source)=', 'i')), '&') AS kept FROM p),
    c AS (SELECT page_id, lower(u.scheme) || '://' || lower(u.host) || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical_url FROM q)
    SELECT canonical_url, min(page_id) AS first_page, count(*) AS pages FROM c GROUP BY 1""",
)
def x02(spark, sf):
    urls = table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical_url"))
    return urls.groupBy("canonical_url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


@query(
    "i09_page_bodies",
    f"SELECT page_id, md5(body) AS body_md5, octet_length(encode(html)) > 4000 AS body_truncated FROM ({_HTML_SQL}) JOIN pages USING (page_id)",
)
def i09(spark, sf):
    """Whole bodies of all pages, with the flag of a small limit."""
    from murmur.sources.archive import page_bodies

    return page_bodies(table(spark, sf, "pages"), max_body_bytes=4000).select("page_id", F.md5("body").alias("body_md5"), "body_truncated")


@query(
    "i08_newest_capture",
    r"""WITH c AS (SELECT page_id, regexp_replace(lower(split_part(url, '#', 1)), '[?].*$', '') AS u, DATE '2024-01-01' + (page_id * 37 % 365)::INTEGER AS d FROM pages)
    SELECT u AS url, max(epoch(CAST(d AS TIMESTAMP)))::BIGINT AS captured_at, arg_max(page_id, row(d, page_id)) AS page_id FROM c GROUP BY 1""",
)
def i08(spark, sf):
    from murmur.sources.archive import newest_capture

    pages = table(spark, sf, "pages")
    stamp = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")), "yyyyMMddHHmmss")
    index = pages.select("page_id", F.regexp_replace(F.lower(F.substring_index("url", "#", 1)), "[?].*$", "").alias("url"), stamp.alias("timestamp"))
    captures = index.withColumn("captured_at", tu.compact_instant(F.col("timestamp")))
    return newest_capture(captures, tie="page_id").select("url", secs("captured_at"), "page_id")


@query(
    "x10_bucket_floor",
    "SELECT event_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_at, CAST(epoch(date_trunc('day', ts + INTERVAL 8 HOUR) - INTERVAL 8 HOUR) AS BIGINT) AS day_at FROM events",
)
def x10(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", secs(tu.floor_bucket(ts, "1h"), "hour_at"), secs(tu.floor_bucket(ts, "1d"), "day_at"))


@query(
    "x08_parsed_instants",
    "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS zoned, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS naive, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS slashed, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS millis FROM events",
)
def x08(spark, sf):
    """The same instant written four ways must read back the same."""
    local = F.from_utc_timestamp("ts", tu.SHANGHAI)
    return table(spark, sf, "events").select(
        "event_id",
        secs(tu.parse_instant(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "zoned"),
        secs(tu.parse_instant(F.date_format(local, "yyyy-MM-dd HH:mm:ss")), "naive"),
        secs(tu.parse_instant(F.date_format(local, "yyyy/MM/dd HH:mm:ss")), "slashed"),
        secs(tu.epoch_instant((F.unix_seconds("ts") * 1000).cast("string")), "millis"),
    )


@query(
    "x25_completed_session",
    """WITH l AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events), d AS (SELECT event_id, CAST(CASE WHEN hour(t) < 15 THEN t - INTERVAL 1 DAY ELSE t END AS DATE) AS d FROM l)
    SELECT event_id, CAST(d - CASE dayofweek(d) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS DATE) AS session_day FROM d""",
)
def x25(spark, sf):
    return table(spark, sf, "events").select("event_id", tu.completed_session_day(F.col("ts")).alias("session_day"))


@query(
    "x07_number_parsing",
    "SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, CAST(round(value * 100) AS BIGINT) * 100 AS wan, CAST(floor(value) AS BIGINT) * 1000 AS grouped FROM events",
)
def x07(spark, sf):
    value = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", tx.whole_number(F.format_string("%.2f", value)).alias("whole"),
        F.round(tx.social_count(F.concat(F.format_string("%.2f", value), F.lit("万"))) / 100).cast("long").alias("wan0"),
        tx.social_count(F.format_number(F.floor(value) * 1000, 0)).alias("grouped"),
    ).withColumn("wan", F.col("wan0") * 100).drop("wan0")


@query(
    "p23_trimmed_evidence",
    r"""WITH o AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
    SELECT doc_id, md5(CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 267) || chr(10) || '…[中间省略]…' || chr(10) || right(t, 133) END) AS evidence FROM o""",
)
def p23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.trimmed_evidence(F.col("text"), 400)).alias("evidence"))
