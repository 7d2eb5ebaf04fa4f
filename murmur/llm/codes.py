"""Operator 12, vector code compression: product quantisation in exact integers with LAESA pivots.

A vector becomes integers floor(4096 x) and is cut into equal parts; every part
position has a codebook. Distances of all parts to a few fixed pivots are computed
once and stored beside the parts. In each round the pivot-entry distances give a
lower bound |d(part, pivot) - d(pivot, entry)| on every part-entry distance;
entries are taken by ascending bound and evaluated exactly until the bound of the
next one is above the best distance found.

A round reads the stored parts and brings back sums per entry, added up inside a
task first and then by Spark: a fixed number of rows whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import query, table
from murmur.session import written

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Components are held to this size, so that squares and sums fit into 64 bits.
LIMIT = 1 << 25
#: Rows that a task works on together, and the rounding allowance of a bound.
ROWS, SLACK = 4096, 1e-9


def usable(vector: Column) -> Column:
    """Not null and all components there and finite."""
    number = lambda x: x.cast("double")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def integers(vector: Column) -> Column:
    """floor(4096 x) of every component, held to LIMIT."""
    scaled = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return F.transform(vector, scaled)


def pivots_of(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Pivots of one part position: starting entries far from each other, the first one first."""
    chosen, far = [0], ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(entries)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances, a column for each of the few ``others``."""
    return np.sqrt(np.stack([((points - o) ** 2).sum(axis=1) for o in others], axis=1).astype("f8"))


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each part and the number of exact evaluations; ties to the lower entry."""
    pivot_entry = distances(entries, pivots)
    bound = np.zeros((len(points), len(entries)))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None], pivot_entry[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b + 1), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2
    best = np.full(len(points), np.iinfo("i8").max)
    entry = np.zeros(len(points), dtype="i8")
    left, evaluated = np.arange(len(points)), 0
    for r in range(len(entries)):
        # Bounds rise and the best falls, so a part that has stopped stays out.
        left = left[bound[left, r] * (1 - SLACK) <= best[left]]
        if not len(left):
            break
        tried = order[left, r]
        squared = ((points[left] - entries[tried]) ** 2).sum(axis=1)
        better = (squared < best[left]) | ((squared == best[left]) & (tried < entry[left]))
        at = left[better]
        best[at], entry[at] = squared[better], tried[better]
        evaluated += len(left)
    return entry, best, evaluated


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, width: int, pivots: int) -> Iterator[tuple]:
    """(batch, points[rows, parts, width], to_pivots[rows, parts, pivots]) of a few rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows = batch.slice(k, ROWS)
            points = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(rows.num_rows, parts, width)
            yield rows, points, rows.column("d").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, parts, pivots)


class Codes:
    """Coded vectors of ``compress``: ``rows`` (vec_id, label, code array, error) and ``codebooks`` [part, entry, place]."""

    def __init__(self, rows: DataFrame, codebooks: np.ndarray):
        self.rows, self.codebooks = rows, codebooks

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
) -> Codes:
    """Entry of every part of every vector after ``rounds`` rounds from the parts of the smallest ids.

    Vectors that are null or hold null or non-finite components are dropped, and so
    are empty ones and those of another length than the commonest (the longer of
    equally common ones). A length that ``parts`` does not divide is filled up with
    zeros. Components beyond 8192 in size count as 8192. Null ids come last among the
    smallest ids, equal ids are ordered by their components. Fewer rows than
    ``entries`` give fewer entries. Repeated rows count each. Extra columns are not
    read; without a label column every label is null. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if label in vectors.columns else F.lit(None).cast("int")).alias("label"), integers(F.col(vector)).alias("v"),
    ).where(F.size("v") > 0)
    common = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code array<int>, error long"
    if common is None:
        return Codes(spark.createDataFrame([], schema), np.zeros((parts, 0, 0), dtype="i8"))
    width = -(-common["n"] // parts)
    filled = F.concat(F.col("v"), F.array_repeat(F.lit(0), parts * width - common["n"])) if common["n"] % parts else F.col("v")
    kept = kept.where(F.size("v") == common["n"]).select("vec_id", "label", filled.alias("v"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], dtype="i8").reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    # The same number of pivots everywhere; a position with fewer distinct entries repeats its first.
    pivots = [pivots_of(b) for b in books]
    count = max(map(len, pivots))
    pivots = np.stack([np.concatenate([p, np.repeat(p[:1], count - len(p), axis=0)]) for p in pivots])

    @F.pandas_udf("array<double>")
    def to_pivots(column):
        # Only here are part-pivot distances computed.
        points = np.array(column.to_list(), dtype="i8").reshape(len(column), parts, width)
        found = np.concatenate([distances(points[:, p], pivots[p]) for p in range(parts)], axis=1) if len(column) else np.zeros((0, parts * count))
        return column.__class__(list(found), index=column.index)

    stored = written(kept.withColumn("d", to_pivots("v")))

    def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(books.shape, dtype="i8"), np.zeros(books.shape[:2], dtype="i8")
        for _, points, to in _blocks(batches, parts, width, count):
            for p in range(parts):
                entry, _, _ = nearest(points[:, p], to[:, p], books[p], pivots[p])
                np.add.at(total[p], entry, points[:, p])
                used[p] += np.bincount(entry, minlength=books.shape[1])
        p, e = np.nonzero(used)
        for k in range(len(p)):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p[k]] * width, pa.int32()), "entry": pa.array([e[k]] * width, pa.int32()), "place": pa.array(range(width), pa.int32()),
                "total": pa.array(total[p[k], e[k]]), "used": pa.array([used[p[k], e[k]]] * width, pa.int64()),
            })

    for _ in range(rounds):
        made = stored.select("v", "d").mapInArrow(lambda batches, books=books: sums(batches, books), "part int, entry int, place int, total long, used long")
        added = made.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("used").alias("used"))
        books = books.copy()
        for r in added.collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["used"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, points, to in _blocks(batches, parts, width, count):
            found = [nearest(points[:, p], to[:, p], books[p], pivots[p]) for p in range(parts)]
            code = pa.array(list(np.stack([f[0] for f in found], axis=1).astype("i4")), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), code, pa.array(np.sum([f[1] for f in found], axis=0))], names=["vec_id", "label", "code", "error"])

    return Codes(stored.select("vec_id", "label", "v", "d").mapInArrow(coded, schema), books)


def label_errors(rows: DataFrame) -> DataFrame:
    """(label, label_error): errors added up over equal labels, nulls together."""
    return rows.groupBy("label").agg(F.sum("error").alias("label_error"))


def code_text(code: Column) -> Column:
    """Two lower-case hex digits for each part."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def _rounds_sql(rounds: int) -> str:
    """A book and an assignment per round, components as rows."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""far{k} AS MATERIALIZED (
  SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comps c JOIN book{k} b ON c.p = b.p AND c.i = b.i GROUP BY c.r, c.p, b.e),
near{k} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS place FROM far{k}) WHERE place = 1)""")
        if k < rounds:
            out.append(f"""moved{k} AS (
  SELECT n.p, n.e, c.i, sum(c.x) AS s, count(*) AS n FROM near{k} n JOIN comps c ON n.r = c.r AND n.p = c.p GROUP BY n.p, n.e, c.i),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.x ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS x
  FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    return ",\n".join(out)


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS v, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))),
cut AS (SELECT r, w, unnest(v) AS x, unnest(range(len(v))) AS place FROM kept),
comps AS MATERIALIZED (SELECT r, place // w AS p, place % w AS i, floor({SCALE} * x::DOUBLE)::BIGINT AS x FROM cut),
book0 AS MATERIALIZED (SELECT p, r AS e, i, x FROM comps WHERE r < {ENTRIES}),
{_rounds_sql(ROUNDS)},
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), digest
"""


@query("op12_codes", OP12_SQL)
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors, the final codebooks as a digest."""
    codes = compress(table(spark, sf_dir, "embeddings"))
    # Written once; the errors per label and the result both read it.
    rows = written(codes.rows.select("vec_id", "label", code_text(F.col("code")).alias("code"), "error"))
    per_label = label_errors(rows).withColumnRenamed("label", "_label")
    both = rows.join(per_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
