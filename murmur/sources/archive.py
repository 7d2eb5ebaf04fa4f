"""Landed archive captures: newest per URL, page bodies, the lookup queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.text import html_to_text
from murmur.functions.timeutil import compact_instant

CAPTURE_SCHEMA = "url STRING, timestamp STRING, digest STRING, filename STRING, offset BIGINT, length BIGINT, status STRING, mime STRING"
BODY_LENGTH_TO_REPLACE = 80
# Bytes at which a fetched page counts as incomplete.
MAX_BODY_BYTES = 5 * 1024 * 1024
FINISHED = ("no_capture", "complete")


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(captures, malformed lines) of landed index files, one JSON object a line.

    One malformed line spoils the lookup file it came from, so the captures of
    such a file are held back; the caller sees which file and line it was.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = lines.withColumn("c", F.from_json("value", CAPTURE_SCHEMA)).withColumn("captured_at", compact_instant(F.col("c.timestamp")))
    good = F.col("captured_at").isNotNull() & F.col("c.filename").isNotNull() & F.col("c.offset").isNotNull() & F.col("c.length").isNotNull()
    good = good & (F.col("c.status").isNull() | (F.col("c.status") == "") | F.col("c.status").try_cast("int").isNotNull())
    marked = parsed.withColumn("_good", F.coalesce(good, F.lit(False)))
    bad = marked.where(~F.col("_good")).select("file", "value")
    kept = marked.where("_good").join(bad.select("file").distinct(), "file", "left_anti")
    return kept.select("file", "c.*", "captured_at"), bad


def newest_capture(captures: DataFrame, tie: str | None = None) -> DataFrame:
    """The newest capture of every URL."""
    rest = [c for c in captures.columns if c != "url"]
    order = F.struct("captured_at", tie) if tie else F.struct("captured_at")
    return captures.groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("_c")).select("url", "_c.*")


def page_bodies(pages: DataFrame, *, html: str = "html", max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Text of the whole page; the flag tells that the page is over the fetch limit, nothing is cut here."""
    return pages.withColumn("body", html_to_text(F.col(html))).withColumn("body_truncated", F.octet_length(html) > max_body_bytes)


def lookup_queue(content: DataFrame, state: DataFrame, *, crawl_id: str, since: Column, until: Column, now: Column, limit: int) -> DataFrame:
    """The first posts by id whose archived copy is still to be looked up."""
    rows = content.where(F.col("url").isNotNull() & (F.col("published_at") >= since) & (F.col("published_at") < until)).join(
        state.select("content_id", "last_crawl_id", "status", "next_retry_at"), "content_id", "left"
    )
    open_ = F.col("status").isNull() | (F.col("last_crawl_id") != crawl_id) | ~F.col("status").isin(*FINISHED)
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    return rows.where(open_ & due).select("content_id", "url").orderBy("content_id").limit(limit)


def fill_bodies(content: DataFrame, captures: DataFrame) -> DataFrame:
    """An archived body fills an empty one, or replaces a short one when it is whole."""
    rows = content.join(captures.select("content_id", F.col("body").alias("_body"), F.col("body_truncated").alias("_cut")), "content_id", "left")
    own = F.coalesce("body", F.lit(""))
    better = (F.coalesce("_body", F.lit("")) != "") & ((own == "") | (~F.col("_cut") & (F.length(own) < BODY_LENGTH_TO_REPLACE)))
    return rows.withColumn("body_filled", F.coalesce(better, F.lit(False))).withColumn("body", F.when(better, F.col("_body")).otherwise(F.col("body"))).drop("_body", "_cut")
