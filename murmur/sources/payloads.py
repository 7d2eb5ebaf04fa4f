"""Landed source responses as raw observations.

Collectors write responses as JSON text, one per row. Each reader returns the
good rows and the rows that break its contract, with the reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.hashing import canonical_json
from murmur.functions.text import html_texts, html_to_text, kind_slug, looks_truncated, social_count, whole_number
from murmur.functions.timeutil import compact_day, epoch_instant, epoch_or_text_instant, parse_instant

ID_NAMES = ("source_item_id", "id", "post_id", "question_id", "answer_id")
TIME_NAMES = ("published_at", "created_at", "time")
DEFAULT_PROJECT = "zh.wikipedia.org"
BOARD_URL, ARTICLE_URL = "https://guba.eastmoney.com", "https://caifuhao.eastmoney.com/news/"
FORUM_URL, NOTE_URL = "https://www.taoguba.com.cn/a/", "https://www.xiaohongshu.com/explore/"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One landed response per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("response"), F.col("_metadata.file_path").alias("file"))


def read_response_lines(spark: SparkSession, path: str) -> DataFrame:
    """One landed response or item per line, the layout that splits across tasks."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("response"), F.col("_metadata.file_path").alias("file"))


def _get(value: Column, path: str) -> Column:
    """A field of a variant; absent and JSON null are both NULL."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _marked(rows: DataFrame, issue: Column) -> DataFrame:
    """The rows with their issue, which comes out of a generator.

    Spark carries a filter on a plain column down into what computes it, and there
    every field read of a parsed response would parse it again.
    """
    named = rows.withColumn("_issue", issue)
    return named.select(*rows.columns, F.inline(F.array(F.struct(F.col("_issue").alias("issue")))))


def _split(rows: DataFrame, issue: Column) -> tuple[DataFrame, DataFrame]:
    marked = _marked(rows, issue)
    return marked.where(F.col("issue").isNull()).drop("issue"), marked.where(F.col("issue").isNotNull())


def records_of(value: Column, names: tuple[str, ...], nested: tuple[str, ...]) -> tuple[Column, Column]:
    """(array of records, issue) of the usual page shapes: a list, or a list under one of the names."""
    first = F.coalesce(*[_get(value, f"$.{n}") for n in names])
    inner = F.coalesce(*[_get(first, f"$.{n}") for n in nested])
    chosen = F.when(_is(value, "ARRAY"), value).otherwise(F.when(_is(first, "OBJECT"), inner).otherwise(first))
    issue = (
        F.when(value.isNull(), "not_json").when(~_is(value, "ARRAY") & ~_is(value, "OBJECT"), "not_an_object_or_list")
        .when(chosen.isNotNull() & ~_is(chosen, "ARRAY"), "items_not_a_list")
    )
    return F.when(chosen.isNotNull() & _is(chosen, "ARRAY"), F.try_variant_get(chosen, "$", "array<variant>")), issue


def paged_items(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, broken pages, page states) of generic paged JSON; entries that are no objects are skipped."""
    rows = responses.withColumn("_v", F.try_parse_json("response"))
    items, issue = records_of(F.col("_v"), ("items", "data", "results"), ("items", "results"))
    good, bad = _split(rows.withColumn("_items", items), issue)
    v = F.col("_v")
    cursor = F.coalesce(_text(v, "$.next_cursor"), _text(v, "$.nextCursor"), _text(v, "$.cursor"))
    exhausted = F.coalesce(
        F.try_variant_get(v, "$.exhausted", "boolean"), ~F.try_variant_get(v, "$.has_more", "boolean"), cursor.isNull()
    )
    states = good.select(*[c for c in responses.columns if c != "response"], F.when(_is(v, "OBJECT"), cursor).alias("next_cursor"), F.when(_is(v, "OBJECT"), exhausted).otherwise(True).alias("exhausted"))
    exploded = good.select(*[c for c in responses.columns if c != "response"], F.posexplode("_items").alias("position", "_item")).where(_is(F.col("_item"), "OBJECT"))
    return exploded.withColumn("item", F.col("_item").cast("string")).drop("_item"), bad.drop("_v", "_items"), states


def observations(items: DataFrame, *, kind: str = "forum_post", observed_at: Column, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """Items as raw observations; the payload is kept whole and gets a default kind."""
    v = F.try_parse_json(item)
    rows = items.withColumn("_v", v)
    field = lambda names: F.coalesce(*[_text(F.col("_v"), f"$.{n}") for n in names])
    ident, stated = field(ID_NAMES), field(TIME_NAMES)
    own_kind = _text(F.col("_v"), "$.observation_kind")
    payload = canonical_json(F.col(item), observation_kind=kind)
    shaped = rows.select(
        *[c for c in items.columns if c not in (item, "position")], ident.alias("source_item_id"), F.coalesce(own_kind, F.lit(kind)).alias("observation_kind"),
        parse_instant(stated).alias("published_at"), observed_at.alias("observed_at"), payload.alias("payload"), stated.alias("_stated"),
    ).withColumn("payload_hash", F.sha2("payload", 256))
    issue = F.when(F.col("source_item_id").isNull(), "no_stable_id").when((F.col("_stated") != "") & F.col("published_at").isNull(), "invalid_time")
    good, bad = _split(shaped, issue)
    return good.drop("_stated"), bad.drop("_stated")


def _filled(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def _iso(ts: Column) -> Column:
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.concat(F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def _payload(fields: dict[str, Column]) -> Column:
    """JSON text with sorted names; missing fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _emit(rows: DataFrame, keep: list[str], fields: dict[str, Column], published: Column, issue: Column, kind: str | Column) -> tuple[DataFrame, DataFrame]:
    marked = _marked(rows, issue)
    shaped = [
        *keep, fields["id"].alias("source_item_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("observation_kind"),
        published.alias("published_at"), _payload(fields).alias("payload"),
    ]
    good = marked.where(F.col("issue").isNull()).select(*shaped)
    return good.withColumn("payload_hash", F.sha2("payload", 256)), marked.where(F.col("issue").isNotNull()).select(*shaped, "issue")


BOARD_SCHEMA = (
    "post_id STRING, post_publish_time STRING, post_last_time STRING, post_title STRING, post_content STRING, post_abstract STRING, source_post_content STRING,"
    " post_user STRUCT<user_id: STRING, user_nickname: STRING>, post_guba STRUCT<stockbar_code: STRING, stockbar_name: STRING>, stockbar_code STRING,"
    " post_click_count BIGINT, post_comment_count BIGINT, post_like_count BIGINT, post_forward_count BIGINT, post_type INT, post_source_id STRING"
)


def board_posts(items: DataFrame, *, item: str = "item", full_body: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Forum board posts; times are Shanghai time, the body falls back over five fields."""
    r = lambda n: F.col(f"r.{n}")
    keep = [c for c in items.columns if c not in (item, full_body)]
    rows = items.withColumn("r", F.from_json(item, BOARD_SCHEMA))
    rows = rows.withColumn("_title", html_to_text(r("post_title")))
    rows = rows.withColumn("_summary", html_to_text(F.coalesce(_filled(r("post_content")), _filled(r("post_abstract")), _filled(r("source_post_content")), F.col("_title"))))
    published = parse_instant(r("post_publish_time"))
    updated = parse_instant(F.coalesce(_filled(r("post_last_time")), r("post_publish_time")))
    full = _filled(F.col(full_body)) if full_body else F.lit(None).cast("string")
    code = F.coalesce(_filled(r("post_guba.stockbar_code")), r("stockbar_code"), F.lit(""))
    article = (F.coalesce(r("post_type"), F.lit(0)) == 20) & (F.coalesce(r("post_source_id"), F.lit("")) != "")
    url = F.when(article, F.concat(F.lit(ARTICLE_URL), F.url_encode(r("post_source_id")))).otherwise(
        F.concat(F.lit(BOARD_URL + "/news,"), F.url_encode(code), F.lit(","), F.url_encode(r("post_id")), F.lit(".html"))
    )
    fields = {
        "id": r("post_id"), "published_at": _iso(published), "updated_at": _iso(updated), "timestamp_semantics": F.lit("published"),
        "source_timestamp_field": F.lit("post_publish_time"), "source_timezone": F.lit("Asia/Shanghai"), "title": _filled(F.col("_title")),
        "body": F.coalesce(full, _filled(F.col("_summary")), F.col("_title")), "url": url, "author_id": _filled(r("post_user.user_id")),
        "author": _filled(html_to_text(r("post_user.user_nickname"))), "views": r("post_click_count"), "comments": r("post_comment_count"),
        "likes": r("post_like_count"), "shares": r("post_forward_count"), "stockbar_code": _filled(r("post_guba.stockbar_code")),
        "stockbar_name": _filled(html_to_text(r("post_guba.stockbar_name"))), "post_type": r("post_type"),
        "body_truncated": looks_truncated(F.col("_summary")) & full.isNull(), "language": F.lit("zh-CN"),
    }
    issue = F.when(_filled(r("post_id")).isNull(), "no_stable_id").when(published.isNull(), "invalid_time").when(updated.isNull(), "invalid_update_time")
    return _emit(rows, keep, fields, published, issue, "forum_post")


FORUM_SCHEMA = (
    "topicID STRING, newTopicID STRING, postDate STRING, lastReplyDate STRING, subject STRING, body STRING, userID STRING, userName STRING,"
    " totalViewNum BIGINT, totalReplyNum BIGINT, usefulNum BIGINT, favoriteNum BIGINT, catalogName STRING, stockCode STRING, stockName STRING"
)


def forum_topics(items: DataFrame, *, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """Forum topics; times are an epoch or ISO text."""
    r = lambda n: F.col(f"r.{n}")
    keep = [c for c in items.columns if c != item]
    rows = items.withColumn("r", F.from_json(item, FORUM_SCHEMA)).withColumn("_title", html_to_text(r("subject")))
    published = epoch_or_text_instant(r("postDate"))
    updated = epoch_or_text_instant(F.coalesce(_filled(r("lastReplyDate")), r("postDate")))
    fields = {
        "id": r("topicID"), "published_at": _iso(published), "updated_at": _iso(updated), "timestamp_semantics": F.lit("published"),
        "source_timestamp_field": F.lit("postDate"), "source_timezone": F.lit("Asia/Shanghai_or_unix_epoch"), "title": _filled(F.col("_title")),
        "body": F.coalesce(_filled(html_to_text(r("body"))), F.col("_title")), "url": F.concat(F.lit(FORUM_URL), F.url_encode(F.coalesce(_filled(r("newTopicID")), r("topicID")))),
        "author_id": _filled(r("userID")), "author": _filled(html_to_text(r("userName"))), "views": r("totalViewNum"), "comments": r("totalReplyNum"),
        "likes": r("usefulNum"), "favorites": r("favoriteNum"), "catalog": _filled(html_to_text(r("catalogName"))), "stock_code": _filled(r("stockCode")),
        "stock_name": _filled(html_to_text(r("stockName"))), "language": F.lit("zh-CN"),
    }
    issue = F.when(_filled(r("topicID")).isNull(), "no_stable_id").when(published.isNull(), "invalid_time").when(updated.isNull(), "invalid_update_time")
    return _emit(rows, keep, fields, published, issue, "forum_post")


QA_SCHEMA = (
    "ContentID STRING, ContentType STRING, Title STRING, ContentText STRING, Url STRING, AuthorName STRING, AuthorBadgeText STRING, CommentCount STRING, VoteUpCount STRING,"
    " FavoriteCount STRING, CollectionCount STRING, CollectCount STRING, AuthorityLevel STRING, CommentInfoList ARRAY<STRUCT<Content: STRING>>, CreateTime STRING, EditTime STRING"
)


def qa_items(items: DataFrame, *, item: str = "item", query: str = "query") -> tuple[DataFrame, DataFrame]:
    """Question-and-answer items with their featured comments as an array of text."""
    r = lambda n: F.col(f"r.{n}")
    keep = [c for c in items.columns if c != item]
    rows = items.withColumn("r", F.from_json(item, QA_SCHEMA)).withColumn("_title", html_to_text(r("Title")))
    kind = F.coalesce(_filled(F.trim(r("ContentType"))), F.lit("content"))
    created, updated = epoch_instant(r("CreateTime")), epoch_instant(r("EditTime"))
    body = F.coalesce(_filled(html_to_text(r("ContentText"))), _filled(F.col("_title")))
    comments = html_texts(F.transform(r("CommentInfoList"), lambda c: F.coalesce(c["Content"], F.lit(""))))
    fields = {
        "id": F.concat(F.lower(kind), F.lit(":"), F.trim(r("ContentID"))), "observation_kind": kind_slug(kind), "published_at": _iso(created),
        "updated_at": _iso(F.coalesce(updated, created)), "timestamp_semantics": F.lit("created"), "source_timestamp_field": F.lit("CreateTime"),
        "source_timezone": F.lit("unix_epoch_utc"), "title": _filled(F.col("_title")), "body": body, "body_is_summary": F.lit(True), "url": _filled(F.trim(r("Url"))),
        "author_name": _filled(html_to_text(r("AuthorName"))), "author_badge_text": _filled(html_to_text(r("AuthorBadgeText"))),
        "comments": whole_number(r("CommentCount")), "likes": whole_number(r("VoteUpCount")),
        "favorites": whole_number(F.coalesce(_filled(r("FavoriteCount")), _filled(r("CollectionCount")), _filled(r("CollectCount")))),
        "authority_level": _filled(r("AuthorityLevel")), "featured_comments": F.when(F.size(comments) > 0, comments), "content_type": kind,
        "query": F.col(query), "source_role": F.lit("discovery"), "language": F.lit("zh-CN"),
    }
    issue = F.when(_filled(F.trim(r("ContentID"))).isNull(), "no_stable_id").when(body.isNull(), "no_text").when(created.isNull(), "invalid_time")
    return _emit(rows, keep, fields, created, issue, kind_slug(kind))


DETAIL_SCHEMA = (
    "note STRUCT<noteId: STRING, id: STRING, time: STRING, title: STRING, desc: STRING, description: STRING,"
    # Kept as text: two of its names differ in case only.
    " user: STRING,"
    " interactInfo: STRUCT<likedCount: STRING, collectedCount: STRING, commentCount: STRING, sharedCount: STRING>>,"
    " comments STRUCT<list: ARRAY<STRUCT<content: STRING>>>"
)


def note_details(responses: DataFrame, *, response: str = "response", query: str = "query") -> tuple[DataFrame, DataFrame]:
    """Note detail envelopes: human counts, all comments as samples; failures keep their code."""
    v = F.try_parse_json(response)
    keep = [c for c in responses.columns if c != response]
    rows = responses.withColumn("_v", v)
    data = F.coalesce(_get(F.col("_v"), "$.data"), F.col("_v"))
    inner = _get(data, "$.data")
    rows = rows.withColumn("r", F.from_json(F.coalesce(F.when(_is(inner, "OBJECT"), inner), data).cast("string"), DETAIL_SCHEMA))
    n = lambda p: F.col(f"r.note.{p}")
    u = lambda p: F.get_json_object(n("user"), f"$.{p}")
    ident = F.coalesce(_filled(F.trim(n("noteId"))), _filled(F.trim(n("id"))))
    rows = rows.withColumn("_title", html_to_text(n("title")))
    published = epoch_instant(n("time"))
    body = F.coalesce(_filled(html_to_text(F.coalesce(_filled(n("desc")), n("description")))), _filled(F.col("_title")))
    samples = html_texts(F.transform(F.col("r.comments.list"), lambda c: F.coalesce(c["content"], F.lit(""))))
    fields = {
        "id": ident, "observation_kind": F.lit("xiaohongshu_note"), "published_at": _iso(published), "updated_at": _iso(published), "timestamp_semantics": F.lit("published"),
        "source_timestamp_field": F.lit("note.time"), "source_timezone": F.lit("unix_epoch_utc"), "title": _filled(F.col("_title")), "body": body,
        "url": F.concat(F.lit(NOTE_URL), F.url_encode(ident)), "author_id": F.coalesce(_filled(F.trim(u("userId"))), _filled(F.trim(u("id")))),
        "author": _filled(html_to_text(F.coalesce(_filled(u("nickname")), u("nickName")))), "likes": social_count(n("interactInfo.likedCount")),
        "favorites": social_count(n("interactInfo.collectedCount")), "comments": social_count(n("interactInfo.commentCount")), "shares": social_count(n("interactInfo.sharedCount")),
        "sample_comments": F.when(F.size(samples) > 0, samples), "query": F.col(query), "source_role": F.lit("discovery"), "sampled": F.lit(True), "language": F.lit("zh-CN"),
    }
    failed = (F.try_variant_get(F.col("_v"), "$.success", "boolean") == False) | _filled(_text(F.col("_v"), "$.error")).isNotNull()  # noqa: E712
    code = F.coalesce(_text(F.col("_v"), "$.error_code"), _text(F.col("_v"), "$.code"), F.lit("unknown"))
    issue = (
        F.when(F.col("_v").isNull(), "not_json").when(F.coalesce(failed, F.lit(False)), F.concat(F.lit("upstream:"), code))
        .when(F.col("r.note").isNull(), "no_note").when(ident.isNull(), "no_stable_id").when(published.isNull(), "invalid_time").when(body.isNull(), "no_text")
    )
    return _emit(rows, keep, fields, published, issue, "xiaohongshu_note")


def renamed_note(items: DataFrame, *, item: str = "item") -> DataFrame:
    """Snake-case bridge notes in the shape ``note_details`` reads."""
    v = F.try_parse_json(item)
    pick = lambda *paths: F.coalesce(*[_filled(_text(v, p)) for p in paths])
    note = F.struct(
        pick("$.note_id", "$.id").alias("noteId"), pick("$.time").alias("time"), pick("$.title").alias("title"), pick("$.desc", "$.description").alias("desc"),
        F.struct(pick("$.user.user_id", "$.user.userId", "$.user.id").alias("userId"), pick("$.user.nickname", "$.user.nick_name").alias("nickname")).alias("user"),
        F.struct(
            pick("$.interact_info.liked_count", "$.interact_info.likedCount").alias("likedCount"), pick("$.interact_info.collected_count", "$.interact_info.collectedCount").alias("collectedCount"),
            pick("$.interact_info.comment_count", "$.interact_info.commentCount").alias("commentCount"), pick("$.interact_info.share_count", "$.interact_info.sharedCount").alias("sharedCount"),
        ).alias("interactInfo"),
    )
    return items.withColumn("response", F.to_json(F.struct(F.struct(note.alias("note")).alias("data")))).drop(item)


def script_values(pages: DataFrame, name: str, *, html: str = "html", markers: tuple[str, ...] = ("身份核实", "fd_guba_validate")) -> tuple[DataFrame, DataFrame]:
    """JSON assigned to a script variable of a page; verification pages and broken JSON are set aside."""
    start = rf"var\s+{name}\s*=\s*"
    short = F.regexp_extract(F.col(html), rf"(?s){start}(\{{.*?\}})\s*(?:;|</script>)", 1)
    long = F.regexp_extract(F.col(html), rf"(?s){start}(\{{.*\}})\s*;?\s*</script>", 1)
    value = F.coalesce(F.when(F.try_parse_json(short).isNotNull(), _filled(short)), F.when(F.try_parse_json(long).isNotNull(), _filled(long)))
    blocked = reduce(lambda a, b: a | b, [F.col(html).contains(m) for m in markers])
    issue = F.when(blocked, "verification_page").when(~F.col(html).rlike(start), "missing_value").when(value.isNull(), "malformed_value")
    rows = pages.withColumn("value", value).withColumn("issue", issue)
    return rows.where(F.col("issue").isNull()).drop("issue", html), rows.where(F.col("issue").isNotNull()).drop("value", html)


def board_items(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The posts of a board page; a value without a list under ``re`` is a wrong shape."""
    rows = values.withColumn("_v", F.try_parse_json("value"))
    listed = F.try_variant_get(F.col("_v"), "$.re", "array<variant>")
    good, bad = _split(rows.withColumn("_items", listed), F.when(listed.isNull(), "unexpected_shape"))
    items = good.select(*[c for c in values.columns if c != "value"], F.posexplode("_items").alias("position", "_i")).withColumn("item", F.col("_i").cast("string")).drop("_i")
    return items, bad.drop("_v", "_items")


def view_target(query: Column) -> Column:
    """struct(project, article) of a page-view target written as JSON, ``project|article`` or plain."""
    value = F.trim(F.coalesce(query, F.lit("")))
    v = F.try_parse_json(value)
    article = _filled(F.trim(F.coalesce(_filled(_text(v, "$.article")), _text(v, "$.title"))))
    is_json = value.startswith("{") & article.isNotNull()
    left, right = F.trim(F.substring_index(value, "|", 1)), F.trim(F.substring(value, F.locate("|", value) + 1, F.length(value)))
    piped = value.contains("|") & (right != "")
    project = F.when(is_json, F.coalesce(_filled(_text(v, "$.project")), F.lit(DEFAULT_PROJECT))).when(piped, F.coalesce(_filled(left), F.lit(DEFAULT_PROJECT))).otherwise(DEFAULT_PROJECT)
    return F.struct(project.alias("project"), F.when(is_json, article).when(piped, right).otherwise(value).alias("article"))


def pageview_items(responses: DataFrame) -> DataFrame:
    """Daily rows of landed page-view responses with their target query."""
    target = view_target(F.col("query"))
    rows = responses.select(target.alias("t"), F.explode(F.from_json(F.get_json_object("response", "$.items"), "array<struct<timestamp:string,views:bigint>>")).alias("i"))
    return rows.select("t.project", "t.article", compact_day(F.col("i.timestamp")).alias("day"), F.col("i.views").alias("views")).where(F.col("day").isNotNull())
