"""Landed price responses as daily bars.

Every reader takes rows with ``response`` and the asset's columns (asset_id,
market, symbol, asset_type, timezone) and returns (bars, rejected rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.timeutil import local_open, parse_instant
from murmur.operators.market import exchange_code
from murmur.sources.payloads import _get, _is, _text, records_of

BAR = ("ts", "open", "high", "low", "close", "volume", "amount", "adjustment")
MISSING = ("", "n/a", "na", "--")


def _finish(rows: DataFrame, keep: list[str], values: dict[str, Column], provider: str) -> tuple[DataFrame, DataFrame]:
    shaped = rows.select(*keep, *[values[k].alias(k) for k in BAR]).withColumn("interval", F.lit("1d")).withColumn("provider", F.lit(provider))
    broken = F.lit(False)
    for name in BAR:
        broken = broken | F.col(name).isNull()
    return shaped.where(~broken), shaped.where(broken)


def _first(value: Column, *names: str) -> Column:
    return F.coalesce(*[_text(value, f"$.{n}") for n in names])


def _assets(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != "response"]


def generic_bars(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, bad bars, broken responses) of generic JSON with short or long names."""
    keep = _assets(responses)
    rows = responses.withColumn("_v", F.try_parse_json("response"))
    items, issue = records_of(F.col("_v"), ("bars", "items", "data", "results"), ("bars", "items", "results"))
    rows = rows.withColumn("_items", items).withColumn("issue", issue)
    broken = rows.where(F.col("issue").isNotNull()).select(*keep, "issue")
    b = F.col("_b")
    found = rows.where(F.col("issue").isNull()).select(*keep, F.explode("_items").alias("_b")).where(_is(b, "OBJECT"))
    number = lambda *n: _first(b, *n).try_cast("double")
    zero = lambda *n: F.when(_first(b, *n).isNull(), 0.0).otherwise(number(*n))
    values = {
        "ts": parse_instant(_first(b, "ts", "timestamp", "datetime", "time", "date")), "open": number("open", "o"), "high": number("high", "h"),
        "low": number("low", "l"), "close": number("close", "c"), "volume": zero("volume", "v"), "amount": zero("amount", "turnover", "a"),
        "adjustment": F.coalesce(_first(b, "adjustment", "adj"), F.lit("none")),
    }
    return (*_finish(found, keep, values, "http-json"), broken)


def _or_zero(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(text.try_cast("double"))


def delimited_bars(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comma-delimited lines; lines with fewer than seven fields are dropped."""
    keep = _assets(responses)
    lines = F.from_json(F.get_json_object("response", "$.data.klines"), "array<string>")
    rows = responses.select(*keep, F.explode(lines).alias("_line")).withColumn("_f", F.split("_line", ",")).where(F.size("_f") >= 7)
    f = lambda i: F.get("_f", F.lit(i))
    day = f(0).try_cast("date")
    values = {
        "ts": local_open(day, F.col("timezone")), "open": f(1).try_cast("double"), "close": f(2).try_cast("double"), "high": f(3).try_cast("double"),
        "low": f(4).try_cast("double"), "volume": _or_zero(f(5)), "amount": _or_zero(f(6)), "adjustment": F.lit("forward"),
    }
    return _finish(rows, keep, values, "eastmoney")


def array_bars(responses: DataFrame, *, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """Array rows ``[date, open, close, high, low, volume]`` inside the wanted dates.

    Forward-adjusted rows are preferred; when both passes of a tail request are
    landed, ``merge_tail`` keeps the later one.
    """
    keep = _assets(responses)
    v = F.try_parse_json("response")
    by_code = F.try_variant_get(_get(v, "$.data"), "$", "map<string,variant>")
    code = exchange_code(F.col("market"), F.col("symbol"), F.col("asset_type"), "code")
    rows = responses.withColumn("_r", F.try_element_at(by_code, code))
    adjusted = F.try_variant_get(F.col("_r"), "$.qfqday", "array<array<variant>>")
    plain = F.try_variant_get(F.col("_r"), "$.day", "array<array<variant>>")
    forward = F.coalesce(F.size(adjusted) > 0, F.lit(False))
    rows = rows.withColumn("_rows", F.when(forward, adjusted).otherwise(plain)).withColumn("_adj", F.when(forward, "forward").otherwise("none"))
    rows = rows.select(*keep, "_adj", F.explode("_rows").alias("_f")).where(F.size("_f") >= 6)
    f = lambda i: F.try_variant_get(F.get("_f", F.lit(i)), "$", "string")
    day = f(0).try_cast("date")
    rows = rows.where(day.between(start, end))
    values = {
        "ts": local_open(day, F.col("timezone")), "open": f(1).try_cast("double"), "close": f(2).try_cast("double"), "high": f(3).try_cast("double"),
        "low": f(4).try_cast("double"), "volume": _or_zero(f(5)), "amount": F.lit(0.0), "adjustment": F.col("_adj"),
    }
    return _finish(rows, keep, values, "tencent")


def _money(text: Column) -> Column:
    plain = F.translate(F.trim(F.coalesce(text, F.lit(""))), ",$", "")
    return F.when(~F.lower(plain).isin(*MISSING), plain.try_cast("double"))


def table_bars(responses: DataFrame, *, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """Table rows with ``MM/DD/YYYY`` dates and money text; a missing volume is zero."""
    keep = _assets(responses)
    shape = "array<struct<date:string,open:string,high:string,low:string,close:string,volume:string>>"
    rows = responses.select(*keep, F.explode(F.from_json(F.get_json_object("response", "$.data.tradesTable.rows"), shape)).alias("b"))
    rows = rows.where(F.coalesce("b.date", F.lit("")) != "")
    day = F.regexp_replace("b.date", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2").try_cast("date")
    rows = rows.where(day.isNull() | day.between(start, end))
    plain = F.lower(F.translate(F.trim(F.coalesce("b.volume", F.lit(""))), ",$", ""))
    values = {
        "ts": local_open(day, F.col("timezone")), "open": _money(F.col("b.open")), "high": _money(F.col("b.high")), "low": _money(F.col("b.low")),
        "close": _money(F.col("b.close")), "volume": F.when(plain.isin(*MISSING), 0.0).otherwise(_money(F.col("b.volume"))), "amount": F.lit(0.0), "adjustment": F.lit("none"),
    }
    return _finish(rows, keep, values, "nasdaq")
