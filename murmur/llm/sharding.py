"""Operator 1, sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group. Groups stand in the order of their
128-bit text digest; shards are contiguous runs of groups, cut so that the
largest shard is as small as any contiguous cut allows. The smallest feasible
capacity comes from a binary search with a greedy check.

The groups never meet in one place. A check only has to know the group ends near
the possible cuts, so the search runs on summaries: sizes by leading digest
digits (at most 65,536 rows reach the driver), then only the digest ranges that
can still hold a cut of a possible capacity are summed by further digits, until
the least sure and the least possible capacity are one. The cuts then stand at
group ends within that capacity, nearest to the mean of the bytes that are left,
so that a huge group does not leave other shards empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import fresh, query, table
from murmur.operators.ordering import running_total
from murmur.session import checkpointed

#: Digest digits (hexadecimal) of the first summary, and those added per round.
FIRST_DIGITS, MORE_DIGITS = 4, 2
DIGEST_DIGITS = 32
#: Stands behind every digest.
AFTER_ALL = "g"


class _Line:
    """Blocks of groups in digest order, with what is known about the group ends.

    ``blocks`` are (digest prefix, bytes, single): a single block is one group, any
    other may be cut inside at places that are not known yet.
    """

    def __init__(self, blocks: list[tuple[str, int, bool]]):
        self.blocks = blocks
        self.ends = list(accumulate(size for _, size, _ in blocks))
        self.total = self.ends[-1]

    def known(self, reach: int) -> int:
        """Last known group end that is not beyond ``reach``."""
        i = bisect_right(self.ends, reach)
        return self.ends[i - 1] if i else 0

    def hoped(self, reach: int) -> int:
        """Last place not beyond ``reach`` where a group may end."""
        i = bisect_right(self.ends, reach)
        inside = i < len(self.blocks) and not self.blocks[i][2]
        return reach if inside else self.known(reach)

    def chain(self, capacity: int, shards: int, last) -> list[int]:
        """Greedy ends of at most ``shards`` shards; feasible if it comes to the total."""
        cuts, at = [], 0
        while len(cuts) < shards and at < self.total:
            at = self.total if at + capacity >= self.total else last(at + capacity)
            cuts.append(at)
        return cuts

    def smallest(self, least: int, shards: int, last) -> int:
        """Binary search of the smallest capacity whose greedy check passes."""
        low, high = least, self.total
        while low < high:
            middle = (low + high) // 2
            if self.chain(middle, shards, last)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Known group ends that keep every shard within ``capacity`` and near the mean of what is left."""
        needed = [self.total]  # the earliest end of each shard from which the rest still fits
        for _ in range(shards):
            i = bisect_left(self.ends, needed[-1] - capacity) if needed[-1] > capacity else -1
            needed.append(self.ends[i] if i >= 0 else 0)
        needed = needed[::-1][1:]
        cuts, at = [], 0
        for i in range(shards - 1):
            goal = at + (self.total - at) / (shards - i)
            k = bisect_left(self.ends, goal)
            near = [e for e in (self.ends[k - 1] if k else 0, self.ends[min(k, len(self.ends) - 1)])]
            best = min(near, key=lambda e: (e <= at, abs(e - goal)))
            at = max(needed[i], at, min(best, self.known(at + capacity)))
            cuts.append(at)
        return cuts


def _blocks(groups: DataFrame, prefixes: list[str], digits: int) -> list[tuple[str, int, bool, int]]:
    """(prefix, bytes, single, largest group) of the digest blocks inside ``prefixes``; all if there are none."""
    rows = groups
    if prefixes:
        lengths = {len(p) for p in prefixes}
        rows = rows.where(reduce(lambda a, b: a | b, [F.substring("digest", 1, n).isin([p for p in prefixes if len(p) == n]) for n in sorted(lengths)]))
    summed = rows.groupBy(F.substring("digest", 1, digits).alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"))
    return [(r["block"], r["size"], r["n"] == 1, r["most"]) for r in summed.collect()]


def cut_digests(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity, and for shards 1, 2, ... the digest (or its first digits) where each begins.

    ``groups`` holds one (digest, size) row per group.
    """
    digits, known = FIRST_DIGITS, {b[0]: b for b in _blocks(groups, [], FIRST_DIGITS)}
    if not known:
        return 0, []
    while True:
        line = _Line([known[k][:3] for k in sorted(known)])
        least = max(-(-line.total // shards), *(b[3] for b in known.values()))
        # A block larger than a shard would stop the check on known ends: open it first.
        wanted = [k for k, size, single in line.blocks if size > least and not single]
        if not wanted:
            sure = line.smallest(least, shards, line.known)
            hope = line.smallest(least, shards, line.hoped)
            first, last = line.chain(hope, shards, line.known), line.chain(sure, shards, line.hoped)
            last += [line.total] * (len(first) - len(last))
            # Every capacity still possible has its i-th end between first[i] and last[i].
            near: set[int] = set()
            for a, b in zip(first, last, strict=False):
                near.update(range(bisect_right(line.ends, a), min(bisect_left(line.ends, b) + 1, len(line.blocks))))
            wanted = [line.blocks[i][0] for i in sorted(near) if not line.blocks[i][2]] if hope < sure else []
        if not wanted:
            starts = [bisect_right(line.ends, c) for c in line.even_cuts(sure, shards)]
            return sure, [line.blocks[i][0] if i < len(line.blocks) else AFTER_ALL for i in starts]
        digits = min(DIGEST_DIGITS, max(map(len, wanted)) + (MORE_DIGITS if len(wanted) <= 1024 else 1))
        for k in wanted:
            del known[k]
        known.update({b[0]: b for b in _blocks(groups, wanted, digits)})


def _placed(documents: DataFrame, shards: int, doc_id: str, text: str, *keep: Column) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, and the columns of ``keep``."""
    value = F.col(f"`{text}`").cast("string")
    rows = documents.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(value, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(value.cast("binary")), F.lit("0" * DIGEST_DIGITS)).alias("digest"),
        *keep,
    )
    rows = checkpointed(rows)
    # One row per group: a text that a third of all rows share is summed on the map side.
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("size")))
    _, cuts = cut_digests(groups, shards)
    # A cut is a digest prefix, and its group or block begins there.
    shard: Column = sum(((F.col("digest") >= F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")
    placed = running_total(rows.withColumn("shard", shard), ["shard"], ["digest", "doc_id"], before="slot", total="rows_in_shard")
    return placed.withColumn("slot", F.col("slot").cast("long"))


def shards_of(documents: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard and its gapless place there.

    Size is the UTF-8 length of the text plus 1. A null text has size 1 and forms
    a group of its own kind, apart from the empty text. Repeated rows each keep
    their place. A null ``doc_id`` stands first in its group. Extra columns are
    not read. An empty table gives no rows; fewer groups than shards leave the
    last shards empty. Returns doc_id, size, text_crc32, shard, slot.
    """
    return _placed(documents, shards, doc_id, text).select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded_documents(documents: DataFrame, shards: int = 16, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents themselves, all rows and columns, with ``shard`` and ``slot`` as ``shards_of`` gives them.

    Columns of those names get an underscore behind the new ones. Written with
    ``partitionBy("shard")`` every shard is a folder.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_whole")
    placed = _placed(documents, shards, doc_id, text, whole)
    return placed.select("_whole.*", F.col("shard").alias(fresh(documents, "shard")), F.col("slot").alias(fresh(documents, "slot")))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    placed = shards_of(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
