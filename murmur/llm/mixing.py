"""Operator 7, mixing sources to target weights: Efraimidis-Spirakis sampling.

Every document draws an exponential key whose rate is its quality weight; smallest
keys come first. Inside a source the documents are prefix-summed in key order up
to the source's budget. Complete epochs are taken before the fractional one.
DataFrame functions only; a source that holds most rows is ordered in many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import fresh, query, row_key, table, word_count
from murmur.operators.ordering import running_total
from murmur.session import checkpointed

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most epochs of a source.
EPOCHS = 3
#: Characters that speak against prose, and the least quality weight.
NOISE, LEAST_QUALITY = "#*$%&|<>!0123456789", 0.05


def quality_weight(text: Column) -> Column:
    """Share of characters that are no symbols or digits; 0.05 at least, also for empty texts."""
    plain = F.try_divide(F.length(F.translate(text, NOISE, "")), F.length(text))
    return F.greatest(F.coalesce(plain, F.lit(0.0)), F.lit(LEAST_QUALITY))


def sampling_key(unit: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the unit's digest."""
    u = (F.conv(F.substring(unit, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all sizes by weight.

    A target stops at ``epochs`` times its source's size and the excess is shared
    anew by weight among the others until none is above. Each round reads two sums
    of the source table; sources never meet in one task.
    """
    ranked = running_total(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], before="_place", total="_n")
    place = (F.col("_place") % len(weights) + 1).cast("int")
    ranked = ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), place).alias("_w"))
    cap, level, rounds = F.col("source_size") * epochs, 0.0, 0
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped = -1
    while total:
        full = cap <= F.lit(level) * F.col("_w")
        spent, open_weight, now = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0)), F.count(F.when(full, 1))
        ).first()
        if now == capped or not open_weight:
            break
        level, capped, rounds = (total - spent) / open_weight, now, rounds + 1
    return ranked.select("source", "source_size", F.round(F.least(cap.cast("double"), F.lit(level) * F.col("_w")), 6).alias("target"))


def units_of(documents: DataFrame) -> DataFrame:
    """Equal rows (source, doc_id, text) as one unit with their number ``n``."""
    text = F.col("text").cast("string")
    return documents.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id"), row_key(F.col("source"), F.col("doc_id"), F.col("text")).alias("unit"),
        word_count(text).alias("size"), quality_weight(text).alias("weight"),
    ).groupBy("source", "doc_id", "unit", "size", "weight").agg(F.count("*").alias("n"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """How often the mix takes every unit of equal rows.

    Size is the number of words; a null text has 0. A null source is a source, the
    last one. Repeated rows are one unit and share its fate; ``n`` tells how many.
    Ties of the key are broken by the unit's digest. The document at the edge of a
    budget is taken when at least half of it fits. An empty table gives no rows;
    extra columns are not read. Returns source, doc_id, unit, size, n,
    source_size, target and ``copies`` (0 to ``epochs``) per row.
    """
    units = checkpointed(units_of(documents).withColumn("key", sampling_key(F.col("unit"), F.col("weight"))).drop("weight"))
    # Sums per source are made on the map side; a hot source sends a row per task.
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(sizes, weights, epochs)
    placed = running_total(units, ["source"], ["key", "unit"], weight=F.col("size") * F.col("n"), before="before", total="source_words")
    joined = placed.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    more = (F.col("before") + F.col("size") * F.col("n") / 2 <= rest) & (whole < epochs)
    return joined.select("source", "doc_id", "unit", "size", "n", "source_size", "target", (whole + more.cast("int")).cast("int").alias("copies"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, columns unchanged.

    Rows of a source whose target is below its size leave in key order; those of a
    source above it repeat. Nulls, ties, repeated rows and empty tables as in ``mix``.
    """
    key, times = fresh(documents, "_unit"), fresh(documents, "_copies")
    plan = mix(documents).where(F.col("copies") > 0).select(F.col("unit").alias(key), F.col("copies").alias(times))
    keyed = documents.withColumn(key, row_key(F.col("source"), F.col("doc_id"), F.col("text")))
    each = fresh(documents, "_each")
    return keyed.join(plan, key).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in documents.columns])


OP7_SQL = r"""
WITH rows_ AS (
  SELECT source, doc_id, coalesce(text, '') AS t,
    md5(concat_ws('|', coalesce(length(source)::VARCHAR || ':' || source, '-'), coalesce(length(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'),
        coalesce(length(text)::VARCHAR || ':' || text, '-'))) AS unit
  FROM documents),
units AS (
  SELECT source, doc_id, unit, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
    greatest(CASE WHEN length(t) = 0 THEN 0 ELSE length(translate(t, '#*$%&|<>!0123456789', ''))::DOUBLE / length(t) END, 0.05) AS weight, count(*) AS n
  FROM rows_ GROUP BY source, doc_id, unit, t),
keyed AS (SELECT *, -ln((('0x' || unit[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key FROM units),
sizes AS (SELECT source, sum(size * n)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sizes),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER ahead, 0) AS spent, sum(w) OVER () - coalesce(sum(w) OVER ahead, 0) AS open_weight
  FROM ranked WINDOW ahead AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT 3.0 * source_size / w AS full_at, (total - spent)::DOUBLE / open_weight AS v FROM filled),
level AS (SELECT coalesce(arg_min(v, full_at) FILTER (v <= full_at), 0) AS v FROM levels),
plan AS (SELECT source, source_size, round(least(3.0::DOUBLE * source_size, (SELECT v FROM level) * w), 6) AS target FROM ranked),
placed AS (
  SELECT k.*, p.source_size, p.target,
    coalesce(sum(size * n) OVER (PARTITION BY k.source ORDER BY key, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN whole < 3 AND before_ + size * n / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cut, unnest(range(n)) AS r(i)
"""


@query("op7_mixing", OP7_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mix(table(spark, sf_dir, "documents"))
    rows = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
