"""Near copies by exact Jaccard similarity of shingle sets, found with prefix filters.

The distinct shingles of a text are put into one order for the whole corpus, rare
ones first. Two sets of similarity t have a shingle in common among the first
``n - ceil(t n) + 1`` of each, so texts that meet under no such key need no
comparison, and none is missed. What the order is does not matter for that; it
follows counts of hashed shingles, so that common passages come last.

Links that another method gives come first. Of the texts under a key the first is
compared with the others; then only the others whose groups are still apart are.
Every link is confirmed on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import released
from murmur.llm.simhash import components
from murmur.session import checkpointed, written

#: Words of a shingle; similarity as a fraction; buckets of the counts that give the order, and the fullest of them, whose shingles come last.
SHINGLE, OVER, UNDER, BUCKETS, FULLEST = 5, 4, 5, 1 << 20, 1 << 15
KEYED = "key long, place int, n int, fp binary"
#: Parity bits of a set, in longs; rows of a key above which some pairs lack its first row, and those of a block of a busy key.
LONGS, FEW, BLOCK = 8, 2, 512
#: Keys of a set before a key that a row brings along, by which a pair is made under the first of them.
PRIOR = 6
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shingle_set(value: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; words and short texts as in ``simhash.fingerprint``."""
    words = value.encode("utf-8", "surrogatepass").lower().split() if value else []
    if not words:
        return np.empty(0, dtype="u8")
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="u8", count=len(words))
    k = min(SHINGLE, len(words))
    out = np.full(len(words) - k + 1, k, dtype="u8")
    for i in range(k):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - k + 1 + i]
    return np.unique((out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least OVER / UNDER; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit.

    What two sets share cancels out, so they differ in at least as many shingles as
    their bits do; sets of similarity OVER / UNDER differ in at most a ninth of both.
    """
    return np.packbits(np.bincount((shingles >> np.uint64(64 - (64 * LONGS).bit_length() + 1)).astype("i8"), minlength=64 * LONGS) & 1).view("<i8")


def prefix_length(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1


def digests(text: Column) -> Column:
    """Digest of the shingle set of each text."""

    @F.pandas_udf("binary")
    def column(texts):
        return texts.map(lambda t: set_digest(shingle_set(t if isinstance(t, str) else None)))

    # Null is not mapped by pandas; it has the empty set like a text without words.
    return column(F.coalesce(text.cast("string"), F.lit("")))


def _bucket_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """About the ``FULLEST`` fullest buckets and how many texts have shingles there; it orders the shingles and drops none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype="i8")
        for batch in _slices(batches):
            for value in batch.column("text").to_pylist():
                np.add.at(total, (shingle_set(value) % np.uint64(BUCKETS)).astype("i8"), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], names=["bucket", "n"])

    counts = checkpointed(texts.mapInArrow(lambda b: released(count(b)), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    # A sort with a limit would send as many rows of every part to the driver.
    buckets = counts.count()
    least = 0 if buckets <= FULLEST else counts.agg(F.percentile_approx("n", 1 - FULLEST / buckets)).first()[0]
    found = counts.where(F.col("n") > least).toArrow()
    return found["bucket"].to_numpy().astype("i8"), found["n"].to_numpy().astype("i8")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, since texts may be long."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys from rows sorted by key."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and fp in; each set once under a key out, keys of one set dropped."""
    for rows in _runs(batches):
        for column in ("key", "fp"):
            values = rows.column(column)
            changed = pc.not_equal(values.slice(1), values.slice(0, rows.num_rows - 1)).to_numpy()
            new = changed if column == "key" else new | changed
        rows = rows.filter(pa.array(np.concatenate([[True], new])))
        _, at, counts = np.unique(rows.column("key").to_numpy(), return_inverse=True, return_counts=True)
        yield from rows.filter(pa.array(counts[at] > 1)).combine_chunks().to_batches()


def _keyed(texts: DataFrame) -> DataFrame:
    """(key, place, n, fp) of the sets that share a prefix shingle with another set; place is the key's in the set."""
    order = texts.sparkSession.sparkContext.broadcast(_bucket_counts(texts))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = np.zeros(BUCKETS, dtype="i8"), set()
        common[order.value[0]] = order.value[1]
        for batch in _slices(batches):
            keys, sizes, lengths, fps = [], [], [], []
            for value in batch.column("text").to_pylist():
                shingles = shingle_set(value)
                fp = set_digest(shingles)
                # Copies in a task are dropped here, those of other tasks behind the exchange.
                if not len(shingles) or fp in seen:
                    continue
                seen.add(fp)
                rare = np.argsort(common[(shingles % np.uint64(BUCKETS)).astype("i8")], kind="stable")
                keys.append(shingles[rare[: prefix_length(len(shingles))]])
                sizes.append(len(shingles))
                lengths.append(len(keys[-1]))
                fps.append(fp)
            if fps:
                of = np.repeat(np.arange(len(fps)), lengths)
                place = np.concatenate([np.arange(k, dtype="i4") for k in lengths])
                columns = [pa.array(np.concatenate(keys).view("i8")), pa.array(place), pa.array(np.array(sizes, dtype="i4")[of]), pa.array(fps, pa.binary()).take(pa.array(of))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "n", "fp"])

    rows = texts.mapInArrow(lambda b: released(prefixes(b)), KEYED)
    return checkpointed(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: released(_shared(b)), KEYED))


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; pairs under a key whose roots differ and that may be similar out.

    The order of keys is the same for all sets, so a pair that has a key before this
    one in common was made there or under its first row, where no bound is tighter.
    """
    for rows in _runs(batches):
        key, left, n = (rows.column(c).to_numpy() for c in ("key", "left", "n"))
        root = rows.column("root").combine_chunks().dictionary_encode()
        root = (root.combine_chunks() if isinstance(root, pa.ChunkedArray) else root).indices.to_numpy()
        prior = np.stack([rows.column(f"before{i}").to_numpy() for i in range(PRIOR)], axis=1)
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype="u8").reshape(-1, LONGS)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
        mixed = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), np.diff(np.append(starts, len(key))))
        at, lag, fp = np.flatnonzero(mixed), 0, rows.column("fp")
        while len(at):
            lag += 1
            at = at[at + lag < ends[at]]
            a = at[(root[at] != root[at + lag]) & (9 * np.minimum(left[at], left[at + lag]) >= 4 * (n[at] + n[at + lag]))]
            if len(a):
                a = a[9 * np.bitwise_count(bits[a] ^ bits[a + lag]).sum(axis=1, dtype="i8") <= n[a] + n[a + lag]]
            if len(a):
                a = a[~((prior[a][:, :, None] == prior[a + lag][:, None, :]) & (prior[a] != 0)[:, :, None]).any(axis=(1, 2))]
            if len(a):
                u, v = (fp.take(pa.array(i)).combine_chunks() for i in (a, a + lag))
                low = pc.less(u, v)
                yield pa.RecordBatch.from_arrays([pc.if_else(low, u, v), pc.if_else(low, v, u)], names=["u", "v"])


def _stored(texts: DataFrame) -> DataFrame:
    """(fp, text) with the number of shingles and the parity bits, written."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            sizes, bits = pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, bits], names=["fp", "text", "n", "bits"])

    return written(texts.select("fp", "text").mapInArrow(lambda b: released(described(b)), "fp binary, text string, n int, bits binary"))


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that the parity bits do not rule out; no similar pair is lost, and no text has travelled yet."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="u8").reshape(-1, LONGS) for c in ("a", "b"))
            kept = 9 * np.bitwise_count(a ^ b).sum(axis=1, dtype="i8") <= batch.column("n").to_numpy()
            yield batch.select(["u", "v"]).take(pa.array(np.flatnonzero(kept)))

    side = lambda node, bits, size: sets.select(F.col("fp").alias(node), F.col("bits").alias(bits), F.col("n").alias(size))
    both = pairs.join(side("u", "a", "n_a"), "u").join(side("v", "b", "n_b"), "v")
    return both.select("u", "v", "a", "b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(near, "u binary, v binary")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = None, None
        for batch in _slices(batches):
            kept = []
            for i, (v, one, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("v", "a", "b")), strict=True)):
                if v != last:
                    last, b = v, shingle_set(other)
                if similar(shingle_set(one), b):
                    kept.append(i)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))

    left = checkpointed(_possible(pairs, texts))
    # Only texts of these pairs travel to both ends.
    wanted = left.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    texts = written(texts.select("fp", "text").join(wanted, "fp", "left_semi"))
    both = left.join(texts.select(F.col("fp").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("fp").alias("v"), F.col("text").alias("b")), "v")
    return checkpointed(both.select("u", "v", "a", "b").mapInArrow(lambda b: released(compare(b)), "u binary, v binary"))


def _dealt(placed: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The rows with parity bits; a key of more than ``block`` is dealt so that every two parts meet."""
    rows = placed.withColumn("parts", F.ceil(F.col("rows") / block).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part")))
    met = rows.withColumn("part", part).withColumn("other", F.explode(others))
    key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return met.select(key.alias("key"), "left", "n", "fp", "root", *[f"before{i}" for i in range(PRIOR)]).join(sets.select("fp", "bits"), "fp")


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Every query begun inside runs once and drops its shuffle files behind it, so that one step's files are on disk at a time."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def near_copies(texts: DataFrame, fp: str = "fp", text: str = "text", block: int = BLOCK, linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets that links of similarity OVER / UNDER or more join to another; fp is ``digests(text)``.

    ``linked`` has pairs (u, v) of fp that another method holds for copies; they are confirmed before prefix filters look for the rest.
    """
    with _shuffles_dropped(texts.sparkSession):
        return _near_copies(texts, fp, text, block, linked)


def _near_copies(texts: DataFrame, fp: str, text: str, block: int, linked: DataFrame | None) -> DataFrame:
    values = texts.select(F.col(fp).alias("fp"), F.col(text).cast("string").alias("text"))
    keyed = _keyed(values.select("text"))
    met = keyed.select("fp").distinct()
    one = values.groupBy("fp").agg(F.min("text").alias("text"))
    stored = _stored(one.join(met, "fp", "left_semi"))
    rows = keyed.withColumn("left", F.col("n") - F.col("place"))
    first = rows.groupBy("key").agg(F.min(F.struct("fp", "left", "n")).alias("first"), F.count("*").alias("rows"))
    rows = rows.join(first, "key").withColumn("met", F.col("fp") == F.col("first.fp"))
    may = ~F.col("met") & (9 * F.least("left", "first.left") >= 4 * (F.col("n") + F.col("first.n")))
    stars = rows.where(may).select(F.col("first.fp").alias("u"), F.col("fp").alias("v"))
    if linked is not None:
        # Two similar sets share a prefix shingle, so a pair without one is none.
        stars = stars.unionByName(linked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    links = _confirmed(stars.distinct(), stored)
    roots = components(links)
    # The first set under a key has met all others there; only keys with more than FEW have pairs without it.
    in_order = Window.partitionBy("fp").orderBy("place")
    before = [F.coalesce(F.lag("key", i + 1).over(in_order), F.lit(0)).alias(f"before{i}") for i in range(PRIOR)]
    others = rows.where(F.col("rows") > FEW).select("key", "left", "n", "fp", "rows", "met", *before).where("not met").drop("met")
    placed = others.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    dealt = _dealt(placed, stored, block).repartition("key").sortWithinPartitions("key")
    crossing = dealt.mapInArrow(lambda b: released(_crossing(b)), "u binary, v binary").distinct()
    return components(links.union(_confirmed(crossing, stored)))
