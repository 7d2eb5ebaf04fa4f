"""Registration of checkable queries: a Spark callable next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot express the result."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its naive timestamps read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else df


def _named(column: Column, name, alias: str | None) -> Column:
    label = alias or (name if isinstance(name, str) else None)
    return column.alias(label) if label else column


def _column(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def r6(name: str | Column, alias: str | None = None) -> Column:
    """Rounded to six places; minus zero becomes zero."""
    return _named(F.round(_column(name).cast("double"), 6) + F.lit(0.0), name, alias)


def secs(name: str | Column, alias: str | None = None) -> Column:
    return _named(F.unix_seconds(_column(name).cast("timestamp")), name, alias)


def n(name: str | Column, alias: str | None = None) -> Column:
    return _named(_column(name).cast("long"), name, alias)
