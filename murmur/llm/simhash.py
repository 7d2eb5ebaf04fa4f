"""Operator 4, SimHash near-duplicates by bit-sliced comparison.

A text becomes one fingerprint; equal fingerprints are one node. Fingerprints that
may be within the radius share a key made of some of their bits. Rows of a key
are compared with bit planes stored vertically: plane b holds bit b of 64 rows in
a machine word, so one word operation works on 64 distances. All planes are
compared with themselves shifted by 1, 2, ... rows; differing bits are summed by
carry-save adders, and words in which every distance is over the radius leave.

Links are joined inside a batch, so that a key with n rows emits less than n
links; components then come from star contraction with a reliable checkpoint per
round. Keys with more rows than a block are dealt as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import fresh, query, row_key, table
from murmur.session import checkpointed, written

#: Seed of the shingle hash, rows of a block, rows of a batch, planes between two looks at the radius.
SEED, BLOCK, BATCH, LOOK = 42, 2048, 1 << 16, 16
#: Bytes of a node before its fingerprint, and parts that the links of a node are dealt to.
RANK, SALTS = 9, 16


def fingerprint(text: Column, shingle: int = 3, bits: int = 64) -> Column:
    """Hex SimHash of a text; a text without words, or null, has all zeros.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are
    ``shingle`` space-joined words with repeats; fewer words are one shingle. Word
    ``i`` of 64 bits hashes with XXH64 and seed 42 + i.
    """

    def one(value: str | None) -> str:
        words = value.encode("utf-8", "surrogatepass").lower().split() if value else []
        if not words:
            return "0" * (bits // 4)
        runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        joined = [b" ".join(run) for run in runs]
        out = ""
        for i in range(bits // 64):
            hashes = np.array([xxhash.xxh64_intdigest(s, SEED + i) for s in joined], dtype=">u8")
            # Long texts are summed in pieces, to keep the bit matrix small.
            ones = sum(np.unpackbits(hashes[k : k + 8192].view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8") for k in range(0, len(hashes), 8192))
            out += np.packbits(ones * 2 > len(hashes)).tobytes().hex()
        return out

    @F.pandas_udf("string")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="object")

    return column(text.cast("string"))


def exact_keys(bits: int, radius: int, spare: int = 3) -> list[list[int]]:
    """Bit positions of the keys that any two fingerprints within ``radius`` must share one of.

    The bits are cut into ``radius + spare`` blocks; at most ``radius`` blocks
    differ, so some ``spare`` blocks agree.
    """
    edges = np.linspace(0, bits, radius + spare + 1).astype(int)
    blocks = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(chosen, []) for chosen in combinations(blocks, spare)]


def _bit_matrix(prints: list[bytes] | np.ndarray, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(prints), dtype="u1").reshape(-1, bits // 8)
    return np.unpackbits(raw, axis=1)


def _csa(a, b, c):
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _add(counts: list[np.ndarray], planes: list[np.ndarray]) -> None:
    """Adds bit planes to vertical counters, two at a time through carry-save adders."""
    for level in range(len(counts)):
        carries = []
        for k in range(0, len(planes) - 1, 2):
            counts[level], carry = _csa(counts[level], planes[k], planes[k + 1])
            carries.append(carry)
        if len(planes) % 2:
            counts[level], carry = counts[level] ^ planes[-1], counts[level] & planes[-1]
            carries.append(carry)
        planes = carries


def _over(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the rows whose counter is above ``radius``."""
    above, equal = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for level in range(len(counts) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counts[level]
        else:
            above |= equal & counts[level]
            equal &= ~counts[level]
    return above


def linked_leaders(bit_rows: np.ndarray, run_end: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest row of its run that links within ``radius`` lead to.

    ``run_end[i]`` is the index behind the run of row i; only rows of one run meet.
    """
    n, bits = bit_rows.shape
    words = -(-n // 64)
    longest = int((run_end - np.arange(n)).max(initial=1))
    packed = np.packbits(bit_rows, axis=0, bitorder="little")
    space = np.zeros(((words + longest // 64 + 2) * 8, bits), dtype="u1")
    space[: len(packed)] = packed
    planes = np.ascontiguousarray(space.T).view("<u8")
    label, place = np.arange(n), np.arange(n)
    left = run_end - place
    rows = place
    for lag in range(1, longest):
        rows = rows[left[rows] > lag]
        todo = rows[label[rows] != label[rows + lag]]
        if not len(todo):
            continue
        wanted = np.zeros(words * 64, dtype=bool)
        wanted[todo] = True
        alive = np.packbits(wanted, bitorder="little").view("<u8")
        at = np.flatnonzero(alive)
        alive = alive[at]
        skip, shift = divmod(lag, 64)
        counts = [np.zeros(len(at), dtype="<u8") for _ in range(bits.bit_length())]
        for first in range(0, bits, LOOK):
            part = planes[first : first + LOOK]
            other = part[:, at + skip]
            if shift:
                other = (other >> np.uint64(shift)) | (part[:, at + skip + 1] << np.uint64(64 - shift))
            differ = part[:, at] ^ other
            _add(counts, list(differ))
            alive = alive & ~_over(counts, radius)
            keep = np.flatnonzero(alive)
            if len(keep) < len(at):
                at, alive, counts = at[keep], alive[keep], [c[keep] for c in counts]
            if not len(at):
                break
        if not len(at):
            continue
        hits = np.unpackbits(alive.astype("<u8").view("u1"), bitorder="little").reshape(len(at), 64)
        word, bit = np.nonzero(hits)
        a = at[word] * 64 + bit
        b = a + lag
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not (label == label[label]).all():
                label = label[label]
    return label


def _links(batches: Iterator[pa.RecordBatch], bits: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, (node, leader) links out; holds one batch and one unfinished run."""
    names = ["t", "key", "a", "b"]
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def work(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(c).to_numpy() for c in names]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        ends = np.append(starts[1:], rows.num_rows)
        prints = rows.column("node").to_pylist()
        label = linked_leaders(_bit_matrix([p[RANK:] for p in prints], bits), np.repeat(ends, ends - starts), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array([prints[i] for i in moved], pa.binary()), pa.array([prints[i] for i in label[moved]], pa.binary())], schema=schema)

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < BATCH:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        keys = [rows.column(c).to_numpy() for c in names]
        changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        held, size = [rows.slice(cut)], rows.num_rows - cut
        if cut:
            yield work(rows.slice(0, cut))
    if size:
        yield work(pa.concat_tables(held).combine_chunks())


def links(prints: DataFrame, keys: list[list[int]], *, bits: int, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that join every two distinct nodes that share a key and are within ``radius``.

    ``prints`` has binary ``node``: ``RANK`` bytes of order, then the fingerprint.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _bit_matrix([n[RANK:] for n in batch.column("node").to_pylist()], bits)
            for t, chosen in enumerate(keys):
                key = rows[:, chosen].astype("i8") @ (1 << np.arange(len(chosen), dtype="i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, dtype="i2")), pa.array(key), batch.column("node")], names=["t", "key", "node"])

    keyed = prints.select("node").mapInArrow(emit, "t short, key long, node binary")
    # Counted on the map side; keys with a single row need no comparison.
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = keyed.join(counts, ["t", "key"])
    parts = F.ceil(F.col("rows") / block).cast("int")
    shared = shared.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(others, lambda p: F.struct(F.least(p, F.col("part")).alias("a"), F.greatest(p, F.col("part")).alias("b")))
    )
    dealt = shared.select("t", "key", "node", F.explode(pairs).alias("pair")).select("t", "key", "pair.a", "pair.b", "node")
    ordered = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "node")
    return ordered.mapInArrow(lambda batches: _links(batches, bits, radius), "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links; the root is the component's smallest node.

    Large-star and small-star contraction: every round moves links towards smaller
    nodes, with sums of the links telling when nothing changes any more.
    """
    # Written, since a checkpoint keeps estimated sizes, which joins multiply round by round, and a table has its own.
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def with_least(links: DataFrame, low: DataFrame) -> DataFrame:
        """Each link with the least neighbour of its u; the links of a busy node are dealt to ``SALTS`` parts."""
        salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        # Merged in place: a broadcast of a few rows takes whole pages of the driver's heap, twice a round.
        return salted.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["u", "salt"])

    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        # Cut here, because what follows reads it three times and the driver plans every reading.
        large = checkpointed(with_least(both, both.groupBy("u").agg(F.min("v").alias("m"))).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        # Links now lead from larger to smaller nodes.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small)
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(documents: DataFrame, shingle: int, bits: int, radius: int, keys: list[list[int]] | None, doc_id: str, text: str) -> DataFrame:
    """doc_id, unit (digest of doc_id and text), fp, its component's root and that root's doc_id for every row.

    A node is a fingerprint behind the bytes of its smallest doc_id, so the smallest
    node of a component is the one with the smallest id; null ids come last.
    """
    prints = checkpointed(documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("unit"), F.unhex(fingerprint(F.col(text), shingle, bits)).alias("fp"),
    ))
    first = F.min("doc_id").alias("first_id")
    # A byte for null, then the id with its sign flipped, which sorts as bytes do.
    ordered = F.lpad(F.hex(F.col("first_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rank = F.when(F.col("first_id").isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), ordered))
    nodes = checkpointed(prints.groupBy("fp").agg(first).select("fp", "first_id", F.concat(F.unhex(rank), F.col("fp")).alias("node")))
    roots = components(links(nodes, keys or exact_keys(bits, radius), bits=bits, radius=radius))
    of_print = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("fp", F.coalesce("root", "node").alias("root"))
    lead = (F.conv(F.hex(F.substring("root", 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    return prints.join(of_print.withColumn("lead_id", F.when(F.hex(F.substring("root", 1, 1)) == "00", lead)), "fp")


def near_duplicates(
    documents: DataFrame, *, shingle: int = 3, bits: int = 64, radius: int = 2, keys: list[list[int]] | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Fingerprint and component of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; without
    ``keys`` no link is missed. Null and empty texts have the zero fingerprint and
    are linked like any other. ``component_id`` is the smallest doc_id reachable
    (null only if all of them are null). Repeated rows stay. An empty table gives
    no rows; extra columns are not read. Returns doc_id, fingerprint, component_id.
    """
    rows = _grouped(documents, shingle, bits, radius, keys, doc_id, text)
    return rows.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("lead_id").alias("component_id"))


def _linked(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v): the sets of a component of ``near_duplicates``, each with the component's smallest; of prints (unit, fp)."""
    rows = _grouped(documents, 3, 64, 2, None, "doc_id", "text").select("unit", F.col("root").alias("group")).distinct()
    sets = checkpointed(rows.join(prints.select("unit", F.col("fp").alias("v")).distinct(), "unit").select("group", "v").distinct())
    least = sets.groupBy("group").agg(F.min("v").alias("u"))
    return sets.join(least, "group").where("u <> v").select("u", "v").distinct()


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, columns unchanged.

    Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8
    are linked. Copies come from the components of ``near_duplicates`` first; each is
    confirmed by that similarity, and ``jaccard`` finds every pair that is left. The row
    with the smallest doc_id of a group stays (null ids last), then the smallest text
    digest; of rows that repeat both, the one with the smallest lang, source and
    n_chars. Nulls, empty texts and empty tables as in ``near_duplicates``: all
    texts without words form one group.
    """
    from murmur.llm import jaccard

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("unit"), F.col("text"), jaccard.digests(F.col("text")).alias("fp"))
    prints = checkpointed(texts.select("doc_id", "unit", "fp"))
    roots = jaccard.near_copies(texts, linked=_linked(documents, prints)).withColumnRenamed("node", "fp")
    found = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    key, whole = fresh(documents, "_unit"), fresh(documents, "_whole")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "unit")).alias("first")
    winners = found.groupBy("root").agg(first).select(F.col("first.unit").alias(key))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    kept = documents.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(winners, key)
    order = F.struct(*[F.col(f"`{c}`") for c in ("lang", "source", "n_chars") if c in documents.columns], F.col(key))
    return kept.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias(whole)).select(f"{whole}.*")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of three-word shingles and component at two differing bits of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
