"""Exact ordered totals inside a key when one key may hold most of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here the rows
are range partitioned on (key, order), so a large key spreads over many tasks;
each part is scanned on its own and gets the total of the parts before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.session import checkpointed


def running_total(
    df: DataFrame, keys: list[str], order: list[str], *, weight: Column | None = None,
    before: str = "before", total: str = "total",
) -> DataFrame:
    """Add the weight of all earlier rows of the key (``before``) and of the key (``total``).

    ``order`` must name a total order inside a key. The parted rows are
    checkpointed first: part numbers come from sampled bounds, and both uses
    below must see the same ones even when a task is run again.
    """
    spread = [F.col(n) for n in [*keys, *order]]
    parts = df.withColumn("_w", F.lit(1) if weight is None else weight)
    parts = checkpointed(parts.repartitionByRange(*spread).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "_part").agg(F.sum("_w").alias("_size"))
    # At most one row per key and part, so this window stays small.
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *[F.col(n).alias(f"_k_{n}") for n in keys],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_size").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_size").over(by_key).alias(total),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    on = [ranked["_part"] == offsets["_p"]] + [ranked[n].eqNullSafe(offsets[f"_k_{n}"]) for n in keys]
    return (
        ranked.join(offsets, reduce(lambda a, b: a & b, on))
        .withColumn(before, F.col("_inside") + F.col("_offset"))
        .drop("_w", "_part", "_p", "_inside", "_offset", *[f"_k_{n}" for n in keys])
    )


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """One median per key: equal values are counted first, then ordered in parts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_total(counts, keys, [value], weight=F.col("_n"), before="_b", total="_t")
    low, high = F.floor((F.col("_t") + 1) / 2), F.floor(F.col("_t") / 2) + 1
    holds = lambda position: (F.col("_b") < position) & (position <= F.col("_b") + F.col("_n"))
    return (
        placed.where(holds(low) | holds(high))
        .groupBy(*keys)
        .agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(out))
    )


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, combined on the map side.

    ``max_by`` keeps one candidate per key and task, so a key with very many
    versions never meets in one place as a sorted list.
    """
    best = F.max_by(F.struct(*columns), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")
