"""Queries over landed responses, bars and small rules, built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import n, query, secs, table
from murmur.functions import timeutil as tu
from murmur.functions.hashing import author_hash
from murmur.operators import entities as en
from murmur.operators import ingest as ig
from murmur.operators import market as mk
from murmur.operators import reads as rd
from murmur.operators import worklists as wl
from murmur.sources import archive, bars, payloads, tables
from murmur.sources.raw import source_user_id

_S = "CAST(floor(epoch({0})) AS BIGINT) AS {1}"


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))


def _day(column: str = "o_orderdate"):
    return F.date_format(column, "yyyy-MM-dd")


def _text(*parts):
    """JSON text from literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _response(kind: str, item, spare):
    shapes = {"0": ('{"items":[', '],"next_cursor":"c"}'), "1": ('{"data":{"results":[', ']},"has_more":false}'), "2": ("[", "]")}
    rule = F.when(F.col("k") % 4 == 3, F.lit("{not json"))
    for rest, (head, tail) in shapes.items():
        rule = rule.when(F.col("k") % 4 == int(rest), _text(head, item, ',"junk",', spare, tail))
    return rule.alias(kind)


@query(
    "i01_paged_items",
    """SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 4 = 3 THEN [-1] ELSE [0, 2] END) AS position,
    CASE WHEN o_orderkey % 4 = 3 THEN 'not_json' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'c' END END AS note FROM orders""",
)
def i01(spark, sf):
    """Pages of four shapes, with an entry that is no object in each."""
    k = F.col("k")
    rows = _orders(spark, sf).select("k", _response("response", _text('{"id":', k, "}"), _text('{"id":', k + 1, "}")))
    items, broken, states = payloads.paged_items(rows)
    noted = items.join(states.select("k", "next_cursor"), "k").select("k", n("position"), F.col("next_cursor").alias("note"))
    return noted.unionByName(broken.select("k", F.lit(-1).cast("long").alias("position"), F.col("issue").alias("note")))


@query(
    "i02_observations",
    f"""SELECT 'o' || o_orderkey AS source_item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'forum_post' END AS observation_kind,
    {_S.format("CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 HOUR", "published_at")},
    sha256('{{"a":[1.0,2],"id":"o' || o_orderkey || '","observation_kind":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'forum_post' END || '","published_at":"' || strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00"}}') AS payload_hash
    FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT NULL, 'no_stable_id', NULL, NULL FROM orders WHERE o_orderkey % 5 = 0""",
)
def i02(spark, sf):
    k = F.col("k")
    own = F.when(k % 3 == 0, F.lit('"observation_kind":"own",')).otherwise("")
    ident = F.when(k % 5 == 0, F.lit("")).otherwise(_text('"id" : "o', k, '",'))
    rows = _orders(spark, sf).select("k", _text("{", own, ident, '"published_at":"', _day(), 'T10:00:00", "a":[1.0, 2]}').alias("item"))
    good, bad = payloads.observations(rows, observed_at=F.lit("2026-01-01").cast("timestamp"))
    shown = good.select("source_item_id", "observation_kind", secs("published_at"), "payload_hash")
    null = F.lit(None)
    return shown.unionByName(bad.select("source_item_id", F.col("issue").alias("observation_kind"), null.cast("long").alias("published_at"), null.cast("string").alias("payload_hash")))


_POST = ("url", "body", "title", "views", "likes", "author_id")


def _posts(rows, *fields):
    return rows.select("source_item_id", "observation_kind", secs("published_at"), *[F.get_json_object("payload", f"$.{f}").alias(f) for f in fields])


@query(
    "i03_board_posts",
    f"""SELECT o_orderkey::VARCHAR AS source_item_id, 'forum_post' AS observation_kind, {_S.format("CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE", "published_at")},
    CASE WHEN o_orderkey % 7 = 0 THEN 'https://caifuhao.eastmoney.com/news/s' || o_orderkey ELSE 'https://guba.eastmoney.com/news,c1,' || o_orderkey || '.html' END AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN o_comment || '...' ELSE 'T & ' || o_orderstatus END AS body, 'T & ' || o_orderstatus AS title, o_custkey::VARCHAR AS views, NULL AS likes, 'u' || o_custkey AS author_id,
    (o_orderkey % 2 = 0)::VARCHAR AS body_truncated FROM (SELECT *, 'text ' || o_orderkey AS o_comment FROM orders)""",
)
def i03(spark, sf):
    k = F.col("k")
    item = _text(
        '{"post_id":"', k, '","post_publish_time":"', _day(), ' 09:30:00","post_title":"<b>T</b> &amp; ', F.col("o_orderstatus"), '","post_content":"',
        F.when(k % 2 == 0, _text("text ", k, "...")).otherwise(""), '","post_user":{"user_id":"u', F.col("o_custkey"), '"},"post_guba":{"stockbar_code":"c1"},"post_click_count":', F.col("o_custkey"),
        ',"post_type":', F.when(k % 7 == 0, 20).otherwise(0), ',"post_source_id":"s', k, '"}',
    )
    good, _ = payloads.board_posts(_orders(spark, sf).select("k", item.alias("item")))
    return _posts(good, *_POST, "body_truncated")


@query(
    "i04_forum_topics",
    f"""SELECT o_orderkey::VARCHAR AS source_item_id, 'forum_post' AS observation_kind, CAST(epoch(o_orderdate) AS BIGINT) - CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 8 * 3600 END AS published_at,
    'https://www.taoguba.com.cn/a/' || CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey ELSE o_orderkey::VARCHAR END AS url, 'line ' || o_orderkey AS body, 'T' AS title, o_custkey::VARCHAR AS views, '3' AS likes,
    'u' || o_custkey AS author_id FROM orders""",
)
def i04(spark, sf):
    k = F.col("k")
    when = F.when(k % 2 == 0, (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string")).otherwise(_day())
    item = _text(
        '{"topicID":"', k, '","newTopicID":"', F.when(k % 3 == 0, _text("n", k)).otherwise(""), '","postDate":"', when, '","subject":"T","body":"<p>line ', k, '</p>","userID":"u', F.col("o_custkey"),
        '","totalViewNum":', F.col("o_custkey"), ',"usefulNum":3}',
    )
    good, _ = payloads.forum_topics(_orders(spark, sf).select("k", item.alias("item")))
    return _posts(good, *_POST)


@query(
    "i05_qa_items",
    f"""SELECT 'answer:' || o_orderkey AS source_item_id, 'zhihu_answer' AS observation_kind, CAST(epoch(o_orderdate) AS BIGINT) AS published_at, o_custkey::VARCHAR AS likes, '12' AS favorites,
    CASE WHEN o_orderkey % 2 = 0 THEN '["a ' || o_orderkey || '","b"]' END AS featured_comments FROM orders WHERE o_orderkey % 11 <> 0""",
)
def i05(spark, sf):
    k = F.col("k")
    comments = F.when(k % 2 == 0, _text('[{"Content":"<i>a</i> ', k, '"},{"Content":""},{"Content":"b"}]')).otherwise("[]")
    item = _text(
        '{"ContentID":"', F.when(k % 11 == 0, "").otherwise(k.cast("string")), '","ContentType":"Answer","ContentText":"body","VoteUpCount":"', F.col("o_custkey"), '","FavoriteCount":"","CollectionCount":"12","CommentInfoList":',
        comments, ',"CreateTime":"', F.unix_seconds(F.col("o_orderdate").cast("timestamp")), '"}',
    )
    good, _ = payloads.qa_items(_orders(spark, sf).select("k", item.alias("item"), F.lit("q").alias("query")))
    return _posts(good, "likes", "favorites", "featured_comments")


@query(
    "i06_note_details",
    f"""SELECT o_orderkey::VARCHAR AS source_item_id, 'xiaohongshu_note' AS observation_kind, CAST(epoch(o_orderdate) AS BIGINT) AS published_at, '12000' AS likes, '3000' AS favorites,
    'https://www.xiaohongshu.com/explore/' || o_orderkey AS url, 12 AS samples FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT NULL, 'upstream:E1', NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0""",
)
def i06(spark, sf):
    """Notes with twelve comments each, and failed envelopes."""
    k = F.col("k")
    comments = ",".join(f'{{"content":"c{i}"}}' for i in range(12))
    whole = _text(
        '{"data":{"note":{"noteId":"', k, '","time":"', F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000, '","title":"t","desc":"d","interactInfo":{"likedCount":"1.2万","collectedCount":"3千"}},"comments":{"list":[',
        comments, "]}}}",
    )
    response = F.when(k % 5 == 0, F.lit('{"success":false,"error_code":"E1"}')).otherwise(whole)
    good, bad = payloads.note_details(_orders(spark, sf).select("k", response.alias("response"), F.lit("q").alias("query")))
    shown = _posts(good, "likes", "favorites", "url", "sample_comments").withColumn("samples", F.size(F.from_json("sample_comments", "array<string>"))).drop("sample_comments")
    null = F.lit(None)
    return shown.unionByName(bad.select(
        "source_item_id", F.col("issue").alias("observation_kind"), null.cast("long").alias("published_at"), *[null.cast("string").alias(c) for c in ("likes", "favorites", "url")], null.cast("int").alias("samples"),
    ))


_OPEN = "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE"


def _responses(spark, sf, text):
    asset = [F.col("k").alias("asset_id"), F.lit("CN").alias("market"), F.lit("600519").alias("symbol"), F.lit("stock").alias("asset_type"), F.lit("Asia/Shanghai").alias("timezone")]
    return _orders(spark, sf).select(*asset, text.alias("response"))


def _bars(good, bad):
    columns = ["asset_id", secs("ts"), "open", "high", "low", "close", "volume", "adjustment", "provider"]
    return good.select(*columns).withColumn("kept", F.lit(True)).unionByName(bad.select(*columns).withColumn("kept", F.lit(False)))


def _bar_sql(ts, open_, volume, adjustment, provider, bad="false"):
    return f"""SELECT o_orderkey AS asset_id, {_S.format(ts, 'ts')}, {open_} AS open, 9.0 AS high, 1.0 AS low, 2.0 AS close, {volume} AS volume, '{adjustment}' AS adjustment, '{provider}' AS provider,
    NOT ({bad}) AS kept FROM orders"""


@query("i10_generic_bars", _bar_sql(_OPEN, "CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey::DOUBLE END", "0.0", "none", "http-json", "o_orderkey % 6 = 0"))
def i10(spark, sf):
    k = F.col("k")
    price = F.when(k % 6 == 0, F.lit('"x"')).otherwise(F.col("o_custkey").cast("string"))
    text = _text('{"bars":[{"t":1,"time":"', _day(), 'T09:30:00","o":', price, ',"h":9,"l":"1.0","close":2},"junk"]}')
    return _bars(*bars.generic_bars(_responses(spark, sf, text))[:2])


@query("i11_delimited_bars", _bar_sql(_OPEN, "o_custkey::DOUBLE", "CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 7.0 END", "forward", "eastmoney"))
def i11(spark, sf):
    text = _text('{"data":{"klines":["', _day(), ",", F.col("o_custkey"), ",2,9,1,", F.when(F.col("k") % 2 == 0, "").otherwise("7"), ',5","too,short"]}}')
    return _bars(*bars.delimited_bars(_responses(spark, sf, text)))


@query("i12_array_bars", _bar_sql(_OPEN, "o_custkey::DOUBLE", "7.0", "forward", "tencent") + " WHERE o_orderkey % 2 = 0 AND o_orderdate BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' UNION ALL "
       + _bar_sql(_OPEN, "3.0", "7.0", "none", "tencent") + " WHERE o_orderkey % 2 = 1 AND o_orderdate BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'")
def i12(spark, sf):
    row = lambda price: _text('[["', _day(), '","', price, '","2","9","1","7"]]')
    forward = F.when(F.col("k") % 2 == 0, row(F.col("o_custkey"))).otherwise("[]")
    text = _text('{"data":{"sh600519":{"qfqday":', forward, ',"day":', row(F.lit("3")), "}}}")
    good, bad = bars.array_bars(_responses(spark, sf, text), start=F.lit("1993-01-01").cast("date"), end=F.lit("1996-12-31").cast("date"))
    return _bars(good, bad)


@query("i13_table_bars", _bar_sql(_OPEN, "o_custkey + 1000.5", "CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 1234.0 END", "none", "nasdaq"))
def i13(spark, sf):
    money = F.concat(F.lit("$"), F.format_number(F.col("o_custkey") + 1000.5, 1))
    text = _text(
        '{"data":{"tradesTable":{"rows":[{"date":"', F.date_format("o_orderdate", "MM/dd/yyyy"), '","open":"', money, '","high":"$9","low":"1.00","close":"2","volume":"',
        F.when(F.col("k") % 2 == 0, "N/A").otherwise("1,234"), '"},{"date":""}]}}}',
    )
    return _bars(*bars.table_bars(_responses(spark, sf, text), start=F.lit("1900-01-01").cast("date"), end=F.lit("2100-01-01").cast("date")))


@query(
    "i18_upserted_rows",
    """SELECT o_orderkey AS k, NULLIF(o_custkey % 5, 0) AS part, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
)
def i18(spark, sf):
    """Every third order is new or renewed, every second one is stored; a part of the key may be null."""
    rows = _orders(spark, sf).select("k", F.expr("nullif(o_custkey % 5, 0)").alias("part"), F.col("o_totalprice").cast("double").alias("price"))
    new = rows.where("k % 3 = 0").withColumn("price", F.col("price") + 1)
    return tables.upsert(new.unionByName(new), rows.where("k % 2 = 0"), ["k", "part"])


@query(
    "i19_new_bars",
    """SELECT DISTINCT o_custkey AS asset_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 3 = 0 AND s.o_custkey = o.o_custkey AND s.o_orderdate = o.o_orderdate)""",
)
def i19(spark, sf):
    rows = _orders(spark, sf).select("k", F.col("o_custkey").alias("asset_id"), F.lit("1d").alias("interval"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("p").alias("provider"))
    return mk.new_bars(rows, rows.where("k % 3 = 0")).select("asset_id", secs("ts"))


@query(
    "u03_merged_bars",
    """SELECT o_custkey AS asset_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, coalesce(max(o_orderkey) FILTER (o_orderkey % 2 = 1) + 0.5, max(o_orderkey)) AS close FROM orders GROUP BY 1, 2
    HAVING count(*) FILTER (o_orderkey % 2 = 1) <= 1 AND count(*) FILTER (o_orderkey % 2 = 0) <= 1""",
)
def u03(spark, sf):
    """Bars of even orders, with a tail of odd ones that wins; keys met twice in one pass are left out of both."""
    rows = _orders(spark, sf).select(F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), "k")
    single = rows.groupBy("asset_id", "ts", (F.col("k") % 2).alias("pass")).agg(F.count("*").alias("c")).groupBy("asset_id", "ts").agg(F.max("c").alias("c")).where("c = 1").drop("c")
    rows = rows.join(single, ["asset_id", "ts"])
    merged = mk.merge_tail(rows.where("k % 2 = 0").select("asset_id", "ts", F.col("k").cast("double").alias("close")), rows.where("k % 2 = 1").select("asset_id", "ts", (F.col("k") + 0.5).alias("close")))
    return merged.select("asset_id", secs("ts"), "close")


@query(
    "i23_new_analyses",
    """SELECT DISTINCT o_custkey AS content_id, NULLIF(o_orderkey % 4, 0) AS topic_id, o_orderpriority AS input_hash FROM orders o WHERE NOT EXISTS (
    SELECT 1 FROM orders s WHERE s.o_orderkey % 5 = 0 AND s.o_custkey = o.o_custkey AND NULLIF(s.o_orderkey % 4, 0) IS NOT DISTINCT FROM NULLIF(o.o_orderkey % 4, 0) AND s.o_orderpriority = o.o_orderpriority)""",
)
def i23(spark, sf):
    rows = _orders(spark, sf).select(
        "k", F.col("o_custkey").alias("content_id"), F.expr("nullif(k % 4, 0)").alias("topic_id"), F.col("o_orderpriority").alias("input_hash"),
        F.lit("m").alias("model"), F.lit("p").alias("prompt_version"), F.lit("s").alias("schema_version"),
    )
    return wl.new_analyses(rows, rows.where("k % 5 = 0")).select("content_id", "topic_id", "input_hash")


@query(
    "i24_board_items",
    """SELECT page_id, unnest([0, 1]) AS position, unnest([page_id, page_id + 1]) AS id, NULL AS issue FROM pages WHERE page_id % 4 = 0
    UNION ALL SELECT page_id, NULL, NULL, CASE page_id % 4 WHEN 1 THEN 'verification_page' WHEN 2 THEN 'malformed_value' ELSE 'missing_value' END FROM pages WHERE page_id % 4 <> 0""",
)
def i24(spark, sf):
    """A script value put into every page: whole, behind a verification mark, broken, or missing."""
    i = F.col("page_id")
    value = F.when(i % 4 == 2, F.lit("var list = {broken;</script>")).when(i % 4 == 3, F.lit("</script>")).otherwise(
        _text('var list = {"re":[{"id":', i, '},{"id":', i + 1, '}],"s":"a}b"};</script>')
    )
    html = F.concat(F.when(i % 4 == 1, F.lit("身份核实")).otherwise(""), F.lit("<script>"), value, F.col("html"))
    values, bad = payloads.script_values(table(spark, sf, "pages").select("page_id", html.alias("html")), "list")
    items, odd = payloads.board_items(values)
    shown = items.select("page_id", n("position"), F.get_json_object("item", "$.id").cast("long").alias("id"), F.lit(None).cast("string").alias("issue"))
    null = F.lit(None).cast("long")
    return shown.unionByName(bad.select("page_id", null.alias("position"), null.alias("id"), "issue")).unionByName(odd.select("page_id", null.alias("position"), null.alias("id"), "issue"))


@query(
    "j12_topic_texts",
    """WITH q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) || '-' ELSE 'x ' || n_name END AS t, n_nationkey, n_regionkey, c_custkey % 3 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, CASE WHEN m < 2 THEN n_nationkey WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS topic_id, CAST(CASE WHEN m < 2 THEN 1.0 WHEN n_nationkey % 2 = 0 THEN 0.98 END AS DOUBLE) AS confidence FROM q""",
)
def j12(spark, sf):
    """Names of nations as topics; the alias 'x name' of every second nation is shared by two topics."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("topic_id"), F.col("n_name").alias("name"))
    topics = nation.select("topic_id", F.concat(F.lit("s"), F.col("topic_id").cast("string")).alias("slug"), "name")
    alias = nation.select("topic_id", F.concat(F.lit("X-"), F.col("name")).alias("alias"))
    aliases = alias.unionByName(alias.where("topic_id % 2 = 1").withColumn("topic_id", F.col("topic_id") + 1))
    k = F.col("c_custkey")
    names = table(spark, sf, "customer").join(nation.withColumnRenamed("topic_id", "c_nationkey"), "c_nationkey")
    text = F.when(k % 3 == 0, F.upper("name")).when(k % 3 == 1, F.concat(F.lower("name"), F.lit("-"))).otherwise(F.concat(F.lit("x "), F.col("name")))
    return en.resolve_topic_text(names.select("c_custkey", text.alias("text")), topics, aliases).select("c_custkey", "topic_id", "confidence")


@query(
    "j27_filled_bodies",
    """SELECT doc_id AS content_id, (doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0))) AS body_filled,
    md5(CASE WHEN doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0)) THEN 'archived ' || text WHEN doc_id % 3 = 1 THEN 'short' WHEN doc_id % 3 = 2 THEN repeat('long ', 40) END) AS body FROM documents""",
)
def j27(spark, sf):
    """Posts without a body, with a short one and with a long one; captures of four fifths, every odd one cut."""
    i = F.col("content_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("content_id"), "text")
    content = docs.select("content_id", F.when(i % 3 == 1, F.lit("short")).when(i % 3 == 2, F.lit("long " * 40)).alias("body"))
    captures = docs.where("content_id % 5 <> 0").select("content_id", F.concat(F.lit("archived "), F.col("text")).alias("body"), (i % 2 == 1).alias("body_truncated"))
    return archive.fill_bodies(content, captures).select("content_id", "body_filled", F.md5("body").alias("body"))


@query("p09_source_posts", "SELECT 'src1' AS asked, count(*) AS posts FROM documents WHERE source = 'src1' UNION ALL SELECT 'all', count(*) FROM documents UNION ALL SELECT 'none', 0")
def p09(spark, sf):
    docs = table(spark, sf, "documents")
    parts = [rd.of_source(docs, name).agg(F.count("*").alias("posts")).select(F.lit(name).alias("asked"), "posts") for name in ("src1", "all", "none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "p11_session_answers",
    """SELECT o_orderkey AS k, o_orderkey % 6 IN (0, 3) AS eligible, CASE o_orderkey % 6 WHEN 0 THEN 'explicit_market_session_date' WHEN 1 THEN 'conflicting_market_session_year' WHEN 2 THEN 'market_session_day_not_mentioned'
    WHEN 3 THEN 'recent_edit_matches_market_session' WHEN 4 THEN 'market_session_year_unverified' ELSE 'missing_market_session_date' END AS reason FROM orders""",
)
def p11(spark, sf):
    k, day = F.col("k"), F.add_months(F.col("o_orderdate").cast("date"), 240)
    named = F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))
    year = F.when(k % 6 == 0, F.year(day)).otherwise(F.lit(2050))
    body = F.when(k % 6 <= 1, F.concat(F.lit("如何看待"), year.cast("string"), F.lit("年"), named)).when(k % 6 == 2, F.lit("nothing")).otherwise(F.concat(F.lit("看"), named))
    edited = F.date_format(F.date_add(day, F.when(k % 6 == 3, F.lit(6)).otherwise(F.lit(60))), "yyyy-MM-dd")
    session = F.when(k % 6 != 5, F.date_format(day, "yyyy-MM-dd"))
    p = F.struct(session.alias("market_session_date"), F.lit(None).cast("string").alias("title"), body.alias("body"), edited.alias("answer_edit_time"), F.lit(None).cast("string").alias("updated_at"))
    return _orders(spark, sf).select("k", p.alias("p")).select("k", ig.session_reference().alias("r")).select("k", "r.eligible", "r.reason")


@query(
    "u05_batch_mismatches",
    """WITH want AS (SELECT o_custkey AS batch_id, o_orderkey AS content_id FROM orders), got AS (SELECT o_custkey AS batch_id, CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS content_id FROM orders WHERE o_orderkey % 11 <> 0),
    c AS (SELECT batch_id, content_id, count(*) AS g FROM got GROUP BY ALL)
    SELECT batch_id, count(*) AS mismatches FROM want FULL JOIN c USING (batch_id, content_id) WHERE want.content_id IS NULL OR g IS NULL GROUP BY 1""",
)
def u05(spark, sf):
    rows = _orders(spark, sf).select(F.col("o_custkey").alias("batch_id"), F.col("k").alias("content_id"))
    got = rows.where("content_id % 11 <> 0").withColumn("content_id", F.when(F.col("content_id") % 13 == 0, -F.col("content_id")).otherwise(F.col("content_id")))
    return wl.batch_mismatches(got, rows)


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02x}" for b in b"catalog".ljust(64, b"\0"))


@query(
    "x04_author_hashes",
    f"SELECT DISTINCT c_custkey, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(c_mktsegment || ':' || c_name)))) AS author_hash FROM customer",
)
def x04(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", author_hash("catalog", F.col("c_mktsegment"), F.col("c_name")).alias("author_hash"))


@query(
    "x05_user_ids",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'a' || c_custkey WHEN 1 THEN 's' || c_custkey WHEN 2 THEN 'n' || c_custkey WHEN 3 THEN 'u' || c_custkey WHEN 4 THEN 'x' || c_custkey END AS user_id FROM customer""",
)
def x05(spark, sf):
    """The id under the first, second or last of the names, plain or in an object."""
    k, name = F.col("c_custkey"), F.col("c_custkey").cast("string")
    at = lambda i, value: F.when(k % 6 == i, value)
    p = F.struct(
        F.coalesce(at(0, F.concat(F.lit("a"), name)), F.lit("")).alias("author_id"), F.coalesce(at(0, F.lit("later")), at(1, F.concat(F.lit("s"), name))).alias("source_user_id"),
        at(3, F.concat(F.lit("u"), name)).alias("user_id"), at(2, F.concat(F.lit('{"name":"z","id":"n'), name, F.lit('"}'))).alias("author"), at(4, F.concat(F.lit('{"uid":"x'), name, F.lit('"}'))).alias("user"),
    )
    return table(spark, sf, "customer").select("c_custkey", p.alias("p")).select("c_custkey", source_user_id().alias("user_id"))


@query(
    "x11_window_bounds",
    f"""SELECT o_orderkey AS k, {_S.format("CAST(o_orderdate AS TIMESTAMP) - INTERVAL 8 HOUR", "from_at")},
    CAST(epoch(o_orderdate) AS BIGINT) + CASE WHEN o_orderkey % 2 = 0 THEN 16 * 3600 ELSE 3 * 3600 + 1800 END AS until_at,
    {_S.format("CAST(o_orderdate AS TIMESTAMP) - INTERVAL 32 HOUR", "day_from")}, {_S.format("CAST(o_orderdate AS TIMESTAMP) - INTERVAL 8 HOUR", "day_until")} FROM orders""",
)
def x11(spark, sf):
    """Date-only bounds of both kinds, an instant as end, and the closed day before noon of the order's day."""
    text = F.when(F.col("k") % 2 == 0, _day()).otherwise(F.concat(_day(), F.lit("T11:30:00")))
    first, last = tu.previous_closed_day(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 4 HOURS"))
    return _orders(spark, sf).select("k", secs(tu.collection_bound(_day()), "from_at"), secs(tu.collection_bound(text, end=True), "until_at"), secs(first, "day_from"), secs(last, "day_until"))


@query(
    "x23_session_opens",
    """SELECT o_orderkey AS k, CAST(epoch(o_orderdate) AS BIGINT) + 34200 - CASE o_orderkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 0 ELSE 0 END * 3600 AS open_at FROM orders""",
)
def x23(spark, sf):
    zone = F.when(F.col("k") % 4 == 0, "Asia/Shanghai").when(F.col("k") % 4 == 1, "Asia/Tokyo").when(F.col("k") % 4 == 2, "UTC")
    return _orders(spark, sf).select("k", secs(tu.local_open(F.col("o_orderdate").cast("date"), zone), "open_at"))


@query(
    "x26_question_days",
    """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN CASE WHEN strftime(o_orderdate, '%m-%d') <> '02-29' THEN '2021' || strftime(o_orderdate, '-%m-%d') END END AS day FROM orders""",
)
def x26(spark, sf):
    k, day = F.col("k"), F.col("o_orderdate").cast("date")
    named = F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日A股大涨"))
    text = F.when(k % 3 == 0, F.concat(F.lit("如何看待"), F.year(day).cast("string"), F.lit("年"), named)).when(k % 3 == 1, F.concat(F.lit("如何看待"), named)).otherwise("其他问题")
    observed = F.lit("2021-06-01 00:00:00").cast("timestamp")
    return _orders(spark, sf).select("k", tu.question_session_date(text, observed).cast("string").alias("day"))


@query(
    "x37_view_targets",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'en.wikipedia.org' WHEN 1 THEN 'de.wikipedia.org' ELSE 'zh.wikipedia.org' END AS project, c_name AS article FROM customer""",
)
def x37(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"project":"en.wikipedia.org","article":"'), name, F.lit('"}'))).when(k % 4 == 1, F.concat(F.lit("de.wikipedia.org | "), name)).when(
        k % 4 == 2, F.concat(F.lit('{"title":"'), name, F.lit('"}'))
    ).otherwise(F.concat(F.lit("  "), name))
    return table(spark, sf, "customer").select("c_custkey", payloads.view_target(text).alias("t")).select("c_custkey", "t.project", "t.article")
