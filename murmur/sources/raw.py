"""The stored shape of raw observations and the fields read from their JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREND_KINDS = ("search_index", "topic_rank", "trend", "pageviews")
ARCHIVE_KIND = "archived_snapshot"
SNAPSHOT_KIND = "zhihu_answer_snapshot"
VERIFIED_SEMANTICS = ("published", "created")

RAW_SCHEMA = (
    "raw_id BIGINT, source STRING, source_item_id STRING, observation_kind STRING, published_at TIMESTAMP,"
    " observed_at TIMESTAMP, collected_at TIMESTAMP, payload STRING, payload_hash STRING"
)
# Payload fields are read as text: sources write numbers and strings alike.
PAYLOAD_FIELDS = (
    "title", "body", "text", "content", "kind", "url", "language", "likes", "favorites", "comments", "shares", "views",
    "author_id", "source_user_id", "user_id", "author", "user", "body_truncated", "timestamp_semantics",
    "source_timestamp_field", "updated_at", "answer_edit_time", "market_session_date", "keyword", "query", "value", "unit",
    "followers_bucket", "following_bucket", "account_age_bucket",
)


def with_payload(raw: DataFrame, out: str = "p", fields: tuple[str, ...] = PAYLOAD_FIELDS) -> DataFrame:
    """Parse the payload once, in a generator, for the named fields.

    A later filter on payload fields cannot be pushed below a generator, so no
    plan ever parses the same JSON again for every field it looks at.
    """
    names = [f"_{out}_{name}" for name in fields]
    parsed = raw.select("*", F.json_tuple("payload", *fields).alias(*names))
    packed = F.struct(*[F.col(n).alias(f) for n, f in zip(names, fields)])
    return parsed.withColumn(out, packed).drop(*names)


def first_text(*columns: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def payload_body(p: str = "p") -> Column:
    return F.coalesce(first_text(F.col(f"{p}.body"), F.col(f"{p}.text"), F.col(f"{p}.content")), F.lit(""))


def is_truncated(p: str = "p") -> Column:
    return F.coalesce(F.col(f"{p}.body_truncated") == "true", F.lit(False))


def is_complete(p: str = "p") -> Column:
    """A version with a body that is not marked as cut off."""
    return (F.coalesce(F.col(f"{p}.body"), F.lit("")) != "") & ~is_truncated(p)


def is_verified(p: str = "p") -> Column:
    return F.coalesce(F.col(f"{p}.timestamp_semantics").isin(*VERIFIED_SEMANTICS), F.lit(False))


def source_user_id(p: str = "p") -> Column:
    """The user id under any of five names; an object gives its ``id`` or ``uid``."""

    def value(name: str) -> Column:
        text = F.col(f"{p}.{name}")
        nested = first_text(F.get_json_object(text, "$.id"), F.get_json_object(text, "$.uid"))
        return F.when(text.startswith("{"), nested).otherwise(F.when(text != "", text))

    return F.coalesce(*[value(n) for n in ("author_id", "source_user_id", "user_id", "author", "user")])
