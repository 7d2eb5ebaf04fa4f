"""Append-only ingest and the current state folded from versions.

P01, P10, P11, J01-J04, W12, W13, X29, X30, F02, F04, I16, I17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.hashing import author_hash
from murmur.functions.text import whole_number
from murmur.functions.timeutil import SHANGHAI, parse_instant, shanghai_date
from murmur.operators.ordering import latest, running_total
from murmur.session import checkpointed
from murmur.sources.raw import (
    ARCHIVE_KIND, SNAPSHOT_KIND, TREND_KINDS, first_text, is_complete, is_truncated, is_verified, payload_body, source_user_id, with_payload,
)

ITEM = ["source", "source_item_id"]
VERSION = [*ITEM, "payload_hash"]
COUNTERS = ("likes", "favorites", "comments", "shares", "views")


def in_window(since: Column, until: Column, p: str = "p") -> Column:
    """Half-open window on publication time, with two exceptions.

    Trend points always pass; session snapshots pass on the Shanghai date of
    their session, up to the date just before ``until``.
    """
    kind = F.col("observation_kind")
    session = F.col(f"{p}.market_session_date").try_cast("date")
    last = shanghai_date(until - F.expr("INTERVAL 1 MICROSECOND"))
    at = F.coalesce("published_at", "observed_at")
    by_session = F.coalesce(session.between(shanghai_date(since), last), F.lit(False))
    return F.when(kind.isin(*TREND_KINDS), True).when(kind == SNAPSHOT_KIND, by_session).otherwise((at >= since) & (at < until))


def validity_issue(p: str = "p") -> Column:
    """P10: why an observation must not be stored, or NULL."""
    published = F.col("published_at")
    updated_text = F.col(f"{p}.updated_at")
    updated = parse_instant(updated_text)
    return (
        F.when(is_verified(p) & published.isNull(), "missing_publication_time")
        .when(published > F.col("observed_at") + F.expr("INTERVAL 10 MINUTES"), "future_after_observation")
        .when(published.isNotNull() & (updated_text != "") & updated.isNull(), "invalid_updated_at")
        .when(updated < published, "updated_before_published")
    )


_TIMES = ("timestamp_semantics", "updated_at")
_BODY = ("body", "body_truncated")


def append_new(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows quarantined with a reason).

    ``batch`` carries ``raw_id`` in arrival order. A known payload is a no-op. A
    cut-off version is skipped once a complete version of the item is stored or
    arrived earlier. Payloads are read once into a narrow verdict table; all
    checks run on that table, and the payloads meet its result in one semi join.
    """
    verdict = checkpointed(
        with_payload(batch, fields=(*_BODY, *_TIMES)).select(
            *VERSION, "raw_id", is_complete().alias("complete"), is_truncated().alias("cut"), validity_issue().alias("issue")
        )
    )
    valid = verdict.where(F.col("issue").isNull()).drop("issue")
    first = valid.groupBy(*VERSION).agg(F.min_by(F.struct("raw_id", "complete", "cut"), "raw_id").alias("v")).select(*VERSION, "v.*")
    fresh = first.join(stored.select(*VERSION), VERSION, "left_anti")
    arrived = fresh.where("complete").groupBy(*ITEM).agg(F.min("raw_id").alias("_complete_from"))
    kept = with_payload(stored, fields=_BODY).where(is_complete()).select(*ITEM).distinct().withColumn("_stored", F.lit(True))
    checked = fresh.where("cut").join(kept, ITEM, "left").join(arrived, ITEM, "left")
    poorer = F.col("_stored").isNotNull() | F.coalesce(F.col("_complete_from") < F.col("raw_id"), F.lit(False))
    accepted = fresh.where(~F.col("cut")).select("raw_id").unionByName(checked.where(~poorer).select("raw_id"))
    rejected = verdict.where(F.col("issue").isNotNull()).select("raw_id", "issue")
    return batch.join(accepted, "raw_id", "left_semi").select(*batch.columns), batch.join(rejected, "raw_id")


def split_known(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, duplicates with the raw row they stand for).

    A known item is a duplicate even with a changed payload; it only earns a new
    topic link. Session snapshots are exempt and always go to the append step.
    """
    snapshot = F.col("observation_kind") == SNAPSHOT_KIND
    known = stored.groupBy(*ITEM).agg(F.max("raw_id").alias("known_raw_id"))
    first = batch.where(~snapshot).groupBy(*ITEM).agg(F.min("raw_id").alias("_first"))
    rows = batch.where(~snapshot).join(known, ITEM, "left").join(first, ITEM)
    target = F.coalesce("known_raw_id", "_first")
    fresh = rows.where(F.col("known_raw_id").isNull() & (F.col("raw_id") == F.col("_first"))).select(*batch.columns)
    repeats = rows.where(F.col("known_raw_id").isNotNull() | (F.col("raw_id") != F.col("_first")))
    return fresh.unionByName(batch.where(snapshot)), repeats.select(*batch.columns, target.alias("known_raw_id"))


def new_topic_links(links: DataFrame, stored: DataFrame) -> DataFrame:
    """(raw, topic) links not stored yet, each once; the first query is kept."""
    keys = ["raw_id", "topic_id"]
    once = links.groupBy(*keys).agg(F.min("collection_query").alias("collection_query"))
    return once.join(stored.select(*keys), keys, "left_anti")


def latest_versions(raw: DataFrame) -> DataFrame:
    """The newest row per item."""
    rest = [c for c in raw.columns if c not in ITEM]
    return latest(raw, ITEM, F.col("raw_id"), rest)


def latest_complete(raw: DataFrame) -> DataFrame:
    """The newest row that is not cut off; a cut-off row only while there is no other."""
    parsed = with_payload(raw, fields=_BODY)
    rest = [c for c in raw.columns if c not in ITEM]
    return latest(parsed, ITEM, F.struct((~is_truncated()).alias("whole"), F.col("raw_id").alias("id")), rest)


def session_reference(p: str = "p", session_date: Column | None = None) -> Column:
    """struct(eligible, reason) of an answer for a market session.

    The session day must be mentioned. Explicit years must all equal the session
    year; without a year the edit must lie within seven days of the session.
    """
    day = F.col(f"{p}.market_session_date").try_cast("date") if session_date is None else session_date
    text = F.concat_ws(" ", F.coalesce(F.col(f"{p}.title"), F.lit("")), F.coalesce(F.col(f"{p}.body"), F.lit("")))
    month, number = F.month(day).cast("string"), F.dayofmonth(day).cast("string")
    named = F.concat(F.lit(r"(?<!\d)0?"), month, F.lit("月0?"), number, F.lit("日"))
    chinese = F.concat(F.lit(r"(?<!\d)(20\d{2})年\s*0?"), month, F.lit(r"月\s*0?"), number, F.lit("日"))
    dashed = F.concat(F.lit(r"(?<!\d)(20\d{2})[-/]0?"), month, F.lit("[-/]0?"), number, F.lit(r"(?!\d)"))
    years = F.array_distinct(F.concat(F.regexp_extract_all(text, chinese, F.lit(1)), F.regexp_extract_all(text, dashed, F.lit(1))))
    edited = shanghai_date(parse_instant(first_text(F.col(f"{p}.answer_edit_time"), F.col(f"{p}.updated_at"))))
    reason = (
        F.when(day.isNull(), "missing_market_session_date")
        .when(~F.regexp_like(text, named), "market_session_day_not_mentioned")
        .when(F.size(years) > 0, F.when(years == F.array(F.year(day).cast("string")), "explicit_market_session_date").otherwise("conflicting_market_session_year"))
        .when(F.abs(F.datediff(edited, day)) <= 7, "recent_edit_matches_market_session")
        .otherwise("market_session_year_unverified")
    )
    eligible = reason.isin("explicit_market_session_date", "recent_edit_matches_market_session")
    return F.struct(eligible.alias("eligible"), reason.alias("reason"))


def route(raw: DataFrame, p: str = "p") -> DataFrame:
    """Where each observation goes, its item id and its reference time.

    ``trend`` rows become attention points; ``content`` rows become posts;
    archive snapshots and ineligible session snapshots stay raw only. An
    eligible snapshot is a post of its own per session, at the session close.
    """
    parsed = with_payload(raw, p)
    kind = F.col("observation_kind")
    verdict = session_reference(p)
    day = F.col(f"{p}.market_session_date").try_cast("date")
    snapshot = kind == SNAPSHOT_KIND
    close = F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 15 HOURS"), SHANGHAI)
    target = (
        F.when(kind.isin(*TREND_KINDS), "trend").when(kind == ARCHIVE_KIND, "raw_only")
        .when(snapshot & ~verdict["eligible"], "raw_only").otherwise("content")
    )
    observed = F.when(snapshot & verdict["eligible"], close).otherwise(F.col("observed_at"))
    return parsed.select(
        *raw.columns, p, target.alias("target"), observed.alias("effective_observed_at"),
        F.when(snapshot, F.concat(F.col("source_item_id"), F.lit("@"), day.cast("string"))).otherwise(F.col("source_item_id")).alias("item_id"),
        F.when(snapshot, "reference_answer").otherwise(F.coalesce(first_text(F.col(f"{p}.kind")), kind)).alias("content_kind"),
    )


def trend_points(routed: DataFrame, links: DataFrame) -> DataFrame:
    """Attention points; the topic is set only when exactly one is linked."""
    one = links.groupBy("raw_id").agg(F.countDistinct("topic_id").alias("_n"), F.min("topic_id").alias("_topic"))
    at = F.when(F.col("observation_kind") == "pageviews", F.coalesce("published_at", "observed_at")).otherwise(F.col("observed_at"))
    return (
        routed.where(F.col("target") == "trend").join(one, "raw_id", "left")
        .select(
            F.col("raw_id").alias("observation_id"), "source", F.coalesce(first_text(F.col("p.keyword"), F.col("p.query")), F.lit("")).alias("keyword"),
            F.when(F.col("_n") == 1, F.col("_topic")).alias("topic_id"), at.alias("observed_at"),
            F.coalesce(F.col("p.value").try_cast("double"), F.lit(0.0)).alias("value"), F.col("p.unit").alias("unit"),
        )
    )


def fold_versions(raw: DataFrame, secret: str = "murmur") -> DataFrame:
    """The current state of every post, folded over all its versions in id order.

    Every rule is an order-free aggregate: last non-empty title and URL, last
    readable counters, longest body (later wins ties), first author. Only the
    publication time needs a second pass: it is the least time from the last
    verified version onward, or over all versions when none is verified.
    """
    rows = route(raw).where(F.col("target") == "content").withColumn("verified", is_verified())
    rows = rows.select(
        "source", F.col("item_id").alias("source_item_id"), "raw_id", "verified", "payload_hash", "content_kind", "collected_at",
        F.col("effective_observed_at").alias("observed_at"), F.coalesce("published_at", "effective_observed_at").alias("published"),
        F.col("p.title").alias("title"), payload_body().alias("body"), first_text(F.col("p.url")).alias("url"), first_text(F.col("p.language")).alias("language"),
        *[whole_number(F.when(F.col(f"p.{c}") != "", F.col(f"p.{c}"))).alias(c) for c in COUNTERS],
        author_hash(secret, F.col("source"), source_user_id()).alias("author_hash"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("raw_id"))).alias(c)
    state = rows.groupBy(*ITEM).agg(
        F.max("observed_at").alias("last_seen_at"), F.min_by("collected_at", "raw_id").alias("first_collected_at"),
        F.min_by("content_kind", "raw_id").alias("kind"), F.min_by("language", "raw_id").alias("language"),
        last("title"), last("url"), *[last(c) for c in COUNTERS],
        F.max_by("body", F.struct(F.length("body"), F.col("raw_id"))).alias("body"),
        F.min_by("author_hash", F.when(F.col("author_hash").isNotNull(), F.col("raw_id"))).alias("author_hash"),
        F.max_by("payload_hash", "raw_id").alias("content_hash"), F.count("*").alias("versions"), F.min("raw_id").alias("first_raw_id"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("raw_id"))), F.min("raw_id")).alias("_from"),
    )
    times = rows.select(*ITEM, "raw_id", "published").join(state.select(*ITEM, "_from"), ITEM).where(F.col("raw_id") >= F.col("_from"))
    return state.drop("_from").join(times.groupBy(*ITEM).agg(F.min("published").alias("published_at")), ITEM)


def pending_versions(raw: DataFrame, content: DataFrame) -> DataFrame:
    """the newest post version per item whose hash is not the stored one."""
    rows = route(raw).where(F.col("target") == "content").drop("p")
    newest = latest(rows.drop("source_item_id").withColumnRenamed("item_id", "source_item_id"), ITEM, F.col("raw_id"), ["raw_id", "payload", "payload_hash", "published_at", "observed_at", "content_kind"])
    stored = content.select(*ITEM, F.col("content_hash").alias("payload_hash"))
    return newest.join(stored, VERSION, "left_anti")


def authors(raw: DataFrame, secret: str = "murmur") -> DataFrame:
    """pseudonymous authors with first and last sighting; buckets come from the first row."""
    rows = with_payload(raw).select(
        "source", "raw_id", "observed_at", author_hash(secret, F.col("source"), source_user_id()).alias("author_hash"),
        *[first_text(F.col(f"p.{c}")).alias(c) for c in ("followers_bucket", "following_bucket", "account_age_bucket")],
    ).where(F.col("author_hash").isNotNull())
    return rows.groupBy("source", "author_hash").agg(
        F.min_by("observed_at", "raw_id").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"),
        *[F.min_by(c, "raw_id").alias(c) for c in ("followers_bucket", "following_bucket", "account_age_bucket")],
    )


def import_history(raw: DataFrame, links: DataFrame, stamps: dict[str, dict[str, str]], *, since: Column, until: Column) -> tuple[DataFrame, DataFrame]:
    """I16: (re-stamped observations, topic links) of sources whose times are certified.

    ``stamps`` names, per allowed source, the payload fields to set. The window
    is inclusive on both ends. Links of every version go with the item.
    """
    window = raw.where(F.col("source").isin(*sorted(stamps)) & F.col("published_at").between(since, until))
    chosen = latest_complete(window)
    added = F.create_map(F.lit("timestamp_verification_method"), F.lit("immutable_source_adapter_contract_v1").cast("variant"))
    added = F.map_concat(
        added, F.create_map(F.lit("source_raw_observation_id"), F.col("raw_id").cast("variant")),
        F.create_map(F.lit("published_at"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").cast("variant")),
    )
    fields = sorted({f for stamp in stamps.values() for f in stamp})
    for field in fields:
        value = None
        for name, stamp in sorted(stamps.items()):
            text = F.lit(stamp.get(field)).cast("string")
            value = F.when(F.col("source") == name, text) if value is None else value.when(F.col("source") == name, text)
        added = F.map_concat(added, F.create_map(F.lit(field), value.cast("variant")))
    replaced = [F.lit(x) for x in [*fields, "timestamp_verification_method", "source_raw_observation_id", "published_at"]]
    own = F.map_filter(F.from_json("payload", "map<string,variant>"), lambda k, _: ~F.array_contains(F.array(*replaced), k))
    payload = F.parse_json(F.to_json(F.map_concat(own, added))).cast("string")
    stamped = chosen.withColumn("payload", payload).withColumn("payload_hash", F.sha2("payload", 256))
    carried = (
        window.select("raw_id", *ITEM).join(links, "raw_id").groupBy(*ITEM, "topic_id")
        .agg(F.max_by("collection_query", "raw_id").alias("collection_query"))
    )
    return stamped, carried.join(stamped.select(*ITEM, "raw_id"), ITEM).select("raw_id", "topic_id", "collection_query")


def session_answer_rank(answers: DataFrame, keys: list[str]) -> DataFrame:
    """1-based rank of answers by votes, favourites and comments, input order on ties.

    A question may hold very many answers, so the rank comes from parted ordering.
    """
    order = ["_votes", "_favorites", "_comments", "position"]
    signed = answers.select("*", *[(-F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0))).alias(f"_{c}") for c in ("votes", "favorites", "comments")])
    placed = running_total(signed, keys, order, before="_b", total="_t")
    return placed.withColumn("answer_rank", F.col("_b") + 1).drop("_b", "_t", *order[:3])
