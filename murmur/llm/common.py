"""Registration of the queries and small column helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space between words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot express the result."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    blanks = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.size(F.array_remove(F.split(blanks, " "), "")).cast("long")


def row_key(*columns: Column) -> Column:
    """128-bit digest of values, nulls told apart from empty strings."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def released(rows: Iterator) -> Iterator:
    """The rows of a task; behind them a worker gives back memory that it no longer needs, since later stages reuse its process."""
    import pyarrow as pa

    try:
        yield from rows
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # only the GNU library has it
            pass
