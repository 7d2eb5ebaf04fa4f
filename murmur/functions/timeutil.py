"""Instants, buckets and calendar days.

All instants are Spark ``TIMESTAMP`` in a UTC session. Product days are
Asia/Shanghai calendar days, stored as the UTC instant of local midnight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHANGHAI = "Asia/Shanghai"
BUCKET_SECONDS = {"1h": 3600, "1d": 86400}

# Weekday closures of the mainland exchanges.
CN_HOLIDAYS = (
    "2024-01-01", "2024-02-09", "2024-02-12", "2024-02-13", "2024-02-14", "2024-02-15",
    "2024-02-16", "2024-04-04", "2024-04-05", "2024-05-01", "2024-05-02", "2024-05-03",
    "2024-06-10", "2024-09-16", "2024-09-17", "2024-10-01", "2024-10-02", "2024-10-03",
    "2024-10-04", "2024-10-07",
    "2025-01-01", "2025-01-28", "2025-01-29", "2025-01-30", "2025-01-31", "2025-04-04",
    "2025-05-01", "2025-05-02", "2025-05-05", "2025-05-31", "2025-06-02", "2025-10-01",
    "2025-10-02", "2025-10-03", "2025-10-06", "2025-10-07", "2025-10-08",
    "2026-01-01", "2026-02-16", "2026-02-17", "2026-02-18", "2026-04-06", "2026-05-01",
    "2026-06-19", "2026-09-25", "2026-10-01", "2026-10-02", "2026-10-05", "2026-10-06",
    "2026-10-07",
)


def bucket_seconds(size: str) -> int:
    if size not in BUCKET_SECONDS:
        raise ValueError("bucket size must be 1h or 1d")
    return BUCKET_SECONDS[size]


def floor_bucket(ts: Column, size: str) -> Column:
    """UTC hour for ``1h``; Shanghai midnight as a UTC instant for ``1d``."""
    if bucket_seconds(size) == 3600:
        seconds = F.unix_seconds(ts)
        return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(3600)))
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, SHANGHAI)), SHANGHAI)


def shift(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(seconds)} SECONDS")


def shanghai_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, SHANGHAI))


def day_start(day: Column) -> Column:
    """X11: first instant of a Shanghai calendar day."""
    return F.to_utc_timestamp(day.cast("timestamp"), SHANGHAI)


def collection_bound(text: Column, *, end: bool = False) -> Column:
    """X11: a date-only end bound is inclusive, so it becomes the next midnight."""
    date_only = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$")
    day = F.trim(text).try_cast("date")
    bound = day_start(F.date_add(day, 1) if end else day)
    return F.when(date_only, bound).otherwise(parse_instant(text))


def previous_closed_day(now: Column) -> tuple[Column, Column]:
    """X11: the scheduled window, i.e. the Shanghai day before ``now``."""
    today = day_start(shanghai_date(now))
    return day_start(F.date_sub(shanghai_date(now), 1)), today


_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([Zz]|[+-]\d{2}:?\d{2})$"
_NAIVE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?)?$"
_SLASHED = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"


def parse_instant(text: Column) -> Column:
    """ISO text, ``Z`` or offset honoured, naive text read as Shanghai time."""
    value = F.translate(F.trim(text.cast("string")), ",", ".")
    offset = F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2")
    local = F.translate(value, "/", "-").try_cast("timestamp_ntz").cast("timestamp")
    return F.when(value.rlike(_ZONED), offset.try_cast("timestamp")).when(
        value.rlike(_NAIVE) | value.rlike(_SLASHED), F.to_utc_timestamp(local, SHANGHAI)
    )


def epoch_instant(value: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e11; zero and below are invalid."""
    number = value.try_cast("double")
    seconds = F.when(number > 100_000_000_000, number / 1000).otherwise(number)
    return F.when(seconds > 0, F.timestamp_micros((seconds * 1_000_000).cast("long")))


def epoch_or_text_instant(value: Column) -> Column:
    """Digits are an epoch, anything else is ISO text in Shanghai time."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^\d+(\.\d+)?([eE]\d+)?$"), epoch_instant(text)).otherwise(parse_instant(text))


def compact_instant(text: Column) -> Column:
    """``yyyyMMddHHmmss`` in UTC."""
    value = F.trim(text.cast("string"))
    return F.when(value.rlike(r"^\d{14}$"), F.try_to_timestamp(value, F.lit("yyyyMMddHHmmss")))


def compact_day(text: Column) -> Column:
    """The day of a ``yyyyMMdd...`` stamp."""
    value = F.substring(text.cast("string"), 1, 8)
    return F.when(
        value.rlike(r"^\d{8}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd")).cast("date")
    )


def local_open(day: Column, zone: Column) -> Column:
    """09:30 local time of a trading day in the asset's own zone."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 570 MINUTES"), F.coalesce(zone, F.lit("UTC")))


def is_trading_day(day: Column, holidays=CN_HOLIDAYS) -> Column:
    """A weekday outside the closure list."""
    closed = [F.lit(value).cast("date") for value in holidays]
    return (F.weekday(day) < 5) & ~day.isin(*closed)


def trading_sessions(spark: SparkSession, first_day: str, last_day: str, holidays=CN_HOLIDAYS) -> DataFrame:
    """One row per calendar day, with open and close instants and the next open day.

    One row per calendar day is the whole input of the window, so its single
    partition stays a few thousand rows for any data size.
    """
    days = spark.sql(
        f"SELECT explode(sequence(DATE'{first_day}', DATE'{last_day}')) AS trade_date"
    )
    is_open = is_trading_day(F.col("trade_date"), holidays)
    local = F.col("trade_date").cast("timestamp")
    # Read backwards, the last open day so far is the next one.
    following = F.last(F.when(F.col("is_open"), F.col("trade_date")), ignorenulls=True).over(
        _calendar_order().rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        days.withColumn("is_open", is_open)
        .withColumn("open_at", F.when(F.col("is_open"), F.to_utc_timestamp(local + F.expr("INTERVAL 570 MINUTES"), SHANGHAI)))
        .withColumn("close_at", F.when(F.col("is_open"), F.to_utc_timestamp(local + F.expr("INTERVAL 15 HOURS"), SHANGHAI)))
        .withColumn("next_trade_date", following)
        .withColumn("next_open_at", F.to_utc_timestamp(F.col("next_trade_date").cast("timestamp") + F.expr("INTERVAL 570 MINUTES"), SHANGHAI))
    )


def _calendar_order():
    return Window.partitionBy(F.lit("calendar")).orderBy(F.desc("trade_date"))


def next_safe_entry(signals: DataFrame, sessions: DataFrame, ts: str = "signal_at") -> DataFrame:
    """Same-day open when the signal precedes it, else the next trading day's open."""
    calendar = sessions.select(
        F.col("trade_date").alias("_day"), F.col("open_at").alias("_open"), F.col("next_open_at").alias("_next")
    )
    day = signals.withColumn("_day", shanghai_date(F.col(ts)))
    return (
        day.join(calendar, "_day", "left")
        .withColumn("entry_at", F.when(F.col(ts) < F.col("_open"), F.col("_open")).otherwise(F.col("_next")))
        .drop("_day", "_open", "_next")
    )


def completed_session_day(until: Column) -> Column:
    """Latest weekday whose 15:00 Shanghai close has passed."""
    local = F.from_utc_timestamp(until, SHANGHAI)
    day = F.when(F.hour(local) < 15, F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def question_session_date(query: Column, observed_at: Column) -> Column:
    """The market day named in a review question; the year may be left out."""
    pattern = r"如何看待(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日"
    year = F.regexp_extract(query, pattern, 1)
    month = F.regexp_extract(query, pattern, 2)
    number = F.when(year != "", year.try_cast("int")).otherwise(
        F.year(F.from_utc_timestamp(observed_at, SHANGHAI))
    )
    text = F.format_string("%04d-%02d-%02d", number, month.try_cast("int"), F.regexp_extract(query, pattern, 3).try_cast("int"))
    return F.when(month != "", text.try_cast("date"))
