"""Derived tables on shared storage: append, partition overwrite, keyed insert, JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.ordering import running_total

# Derived tables are laid out by bucket size and day, so a re-run of some days
# replaces exactly those days and readers prune to the days they need.
DAY = "part_day"


def append(df: DataFrame, path: str, *, day_from: str | None = None) -> None:
    """Add rows; existing files are never touched."""
    rows = df if day_from is None else df.withColumn(DAY, F.to_date(day_from))
    writer = rows.write.mode("append")
    (writer.partitionBy(DAY) if day_from else writer).parquet(path)


def overwrite_days(df: DataFrame, path: str, *, day_from: str, also: tuple[str, ...] = ()) -> None:
    """Replace the days present in ``df``; other days keep their files.

    Rows of one day go to a few files: the day and a salt of the row spread a
    heavy day over several writers.
    """
    rows = df.withColumn(DAY, F.to_date(day_from))
    spread = rows.repartition(*[F.col(c) for c in (*also, DAY)], F.pmod(F.xxhash64(*df.columns[:4]), F.lit(8)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*also, DAY).parquet(path)


def insert_absent(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once; NULL key parts compare equal."""
    right = stored.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(right[f"_s_{k}"])
    return df.join(right, condition, "left_anti").dropDuplicates(keys)


def upsert(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored ones with the same key."""
    fresh = df.dropDuplicates(keys).withColumn("_new", F.lit(1))
    old = stored.withColumn("_new", F.lit(0))
    rest = [c for c in stored.columns if c not in keys]
    both = fresh.select(*keys, *rest, "_new").unionByName(old.select(*keys, *rest, "_new"))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_r")).select(*keys, "_r.*").select(*stored.columns)


def numbered(df: DataFrame, stored: DataFrame | None, keys: list[str], ident: str, order: list[str]) -> DataFrame:
    """Stored ids of known keys; new keys are numbered after the largest one in ``order``.

    Keys must not be NULL and ``order`` must be total over the new keys. Numbers
    are given in parts, so no task sees all new rows.
    """
    if stored is None:
        known, fresh, top = None, df, F.lit(0).cast("long")
    else:
        ids = stored.select(*keys, ident)
        known, fresh = df.join(ids, keys), df.join(ids, keys, "left_anti")
        top = stored.select(F.coalesce(F.max(ident), F.lit(0)).cast("long")).scalar()
    given = running_total(fresh, [], order, before="_before", total="_total").withColumn(ident, F.col("_before") + 1 + top).drop("_before", "_total")
    return given if known is None else known.select(*given.columns).unionByName(given)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; instants as ISO text."""
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
