"""Operator 2, quality rules: hashed n-gram log-likelihood ratio of trusted and raw text.

Two multinomials over hashed one- and two-token features are counted: one over a
trusted target (labelled good documents), one over the whole corpus. A document's
mean log ratio per feature is held against one threshold, the same for all.
Plain base rules are reported with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from murmur.llm.common import fresh, query, released, table
from murmur.session import checkpointed, written

#: Feature buckets (a power of two).
BUCKETS = 1 << 16
#: Characters of texts that are cut into tokens at once, bytes of a token hashed side by side with others, and most words of which three numbers fit one integer.
GROUP, LONG, WIDEST = 1 << 18, 24, 1 << 21
#: Least and most bits by which texts without a label are told before the join; one bitmap of Spark has the least.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 26
#: Base rules: least words, and most of 100 words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


def _kind(char: str) -> int:
    """0 for white space, 1 for characters of words and 2 for others, as regular expressions tell them."""
    return 0 if char.isspace() else 1 if char.isalnum() or char == "_" else 2


def _crcs(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of parts of the bytes, a byte of all parts at a time."""
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    order = np.argsort(-np.minimum(size, LONG + 1).astype("i1"), kind="stable")
    at, sizes = first[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, dtype="u4")
    # Sizes fall, so the parts that have a byte left are the first ones.
    left = np.cumsum(np.bincount(np.minimum(sizes, LONG + 1), minlength=LONG + 2)[::-1])[::-1]
    for k in range(LONG):
        n = int(left[k + 1])
        if not n:
            break
        crc[:n] = table[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ crc[:n] >> 8
    crc ^= 0xFFFFFFFF
    for i in range(int(left[LONG + 1])):
        crc[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty(len(at), dtype="u8")
    out[order] = crc
    return out


def _found(texts: list[str]) -> Iterator[np.ndarray]:
    """Bucket numbers of the tokens and of neighbouring token pairs of each text; tokens are the runs of one kind of character."""
    parts = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), dtype="u1")
    kind, high = np.array([_kind(chr(c)) for c in range(256)], dtype="u1")[data], np.flatnonzero(data > 0x7F)
    if len(high):
        points = np.frombuffer(data[high].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points, at = np.unique(points, return_inverse=True)
        kind[high] = np.repeat(np.array([_kind(chr(c)) for c in points], dtype="u1")[at], (2 + (points > 0x7FF) + (points > 0xFFFF))[at])
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    token = kind[edges[:-1]] > 0
    first, last = edges[:-1][token], edges[1:][token]
    one = _crcs(data, first, last - first)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    one, two = ((found & np.uint64(BUCKETS - 1)).astype("i8") for found in (one, two))
    cuts = np.searchsorted(first, np.cumsum([0, *(len(part) + 1 for part in parts)])).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.concatenate([one[a:b], two[a : max(a, b - 1)]])


def found_in(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """``_found`` of the texts in groups, since most of its work is done for a group at once."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP:
            yield from _found(group)
            group, size = [], 0
    if group:
        yield from _found(group)


def features():
    """text -> bucket numbers of its tokens and of neighbouring token pairs."""
    return lambda text: next(found_in([text]))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    last = dict(zip(words, range(len(words)), strict=True))
    repeated = _repeated(np.fromiter(map(last.__getitem__, words), dtype="i8", count=len(words)))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _repeated(numbers: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    n = len(numbers)
    if n < 4:
        return 0
    pairs, span = numbers[:-1] * (numbers.max() + 1) + numbers[1:], int(numbers.max()) + 1
    if span > WIDEST:
        # Pairs are numbered first, so that three words fit one integer for any vocabulary.
        _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * span + numbers[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def _classes(labels: DataFrame) -> DataFrame:
    """(_id, good, poor) of every labelled document, written: Spark knows its size and broadcasts it while it is small."""
    has = lambda value: F.max(F.coalesce(F.col("quality") == value, F.lit(False)))
    return written(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(has(1).alias("good"), has(0).alias("poor")).where("good or poor"))


def _maybe_labelled(documents: DataFrame, classes: DataFrame, name: str = "text", kind: str = "string", make: Callable[[Iterator], Iterator] = iter) -> DataFrame:
    """(doc_id, ``name``) of the rows whose id falls on a bit of the labelled ids: all labelled ones and few others, so that other texts need not travel.

    ``make`` gives the values of some texts, the texts themselves by default. The bits are read and the values made in one pass, so a task has one
    Python worker, and no row with its text waits in the JVM for a worker's answer.
    """
    schema = StructType().add("doc_id", documents.schema["doc_id"].dataType).add(name, kind)
    place, shared = F.lit(None).cast("long"), None
    if schema["doc_id"].dataType == classes.schema["_id"].dataType:
        bits = min(max(8 * classes.count(), LEAST_BITS), MOST_BITS)
        # Numbers of bitmap_bucket_number and bitmap_bit_position begin at 1 and 0.
        at = lambda column: F.pmod(F.xxhash64(column), F.lit(bits)) + 1
        marked = classes.groupBy(F.bitmap_bucket_number(at("_id")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at("_id"))).alias("marks")).collect()
        held = np.zeros((-(-bits // LEAST_BITS), LEAST_BITS // 8), dtype="u1")
        for r in marked:
            held[r["bucket"] - 1] = np.frombuffer(r["marks"], dtype="u1")
        place, shared = at("doc_id"), documents.sparkSession.sparkContext.broadcast(held.ravel())

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = batch.columns
            rows = np.arange(len(ids))
            if shared is not None:
                places = places.to_numpy(zero_copy_only=False) - 1
                rows = np.flatnonzero(shared.value[places >> 3] >> (places & 7) & 1)
            made = list(make(texts[i].as_py() for i in rows.tolist()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(made, type=pa.type_for_alias(kind))], names=schema.names)

    rows = documents.select("doc_id", F.col("text").cast("string"), place)
    return rows.mapInArrow(lambda b: released(values(b)), schema)


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(found, good, poor) of the labelled documents; the packed features of their texts travel, no text does."""

    def packed(texts: Iterator[str | None]) -> Iterator[bytes]:
        return map(_packed, found_in(texts))

    classes = _classes(labels)
    rows = _maybe_labelled(documents, classes, "found", "binary", packed)
    return rows.join(classes, F.col("doc_id") == F.col("_id")).select("found", "good", "poor")


def _packed(found: np.ndarray) -> bytes:
    """Bucket numbers in ascending order, as compressed steps."""
    return zlib.compress(np.diff(np.sort(found), prepend=0).astype("<u2").tobytes(), 1)


def _unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(steps), dtype="<u2").astype("i8"))


def _feature_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over the good rows and over all given, of ``text`` or packed in ``found``; a task sends at most ``BUCKETS`` rows."""
    column = "text" if "text" in rows.columns else "found"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, trusted = np.zeros(BUCKETS, dtype="i8"), np.zeros(BUCKETS, dtype="i8")
        for batch in batches:
            values = (value.as_py() for value in batch.column(0))
            for found, good in zip(found_in(values) if column == "text" else map(_unpacked, values), batch.column(1), strict=True):
                np.add.at(sums, found, 1)
                if good.as_py():
                    np.add.at(trusted, found, 1)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen]), pa.array(trusted[seen])], names=["bucket", "n", "t"])

    counts = rows.select(column, "good").mapInArrow(lambda b: released(count(b)), "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    raw, trusted = np.zeros(BUCKETS, dtype="f8"), np.zeros(BUCKETS, dtype="f8")
    raw[counts["bucket"].to_numpy()], trusted[counts["bucket"].to_numpy()] = counts["n"].to_numpy(), counts["t"].to_numpy()
    return trusted, raw


def _score(text: str | None, of, ratio: np.ndarray) -> float:
    return _mean(of(text), ratio)


def _mean(found: np.ndarray, ratio: np.ndarray) -> float:
    return float(ratio[found].mean()) if len(found) else 0.0


def _threshold(scores: DataFrame) -> float:
    """The middle between two neighbouring scores, or a place below all, with the fewest errors; the first of several.

    ``scores`` has score, good and poor, the numbers of documents of each class with
    that score. They are sorted by ranges; only a range's sums reach the driver.
    """
    dealt = checkpointed(scores.repartitionByRange("score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor"), F.max("score").alias("last"), F.min("score").alias("first")).orderBy("part").collect()
    if not sum(r["poor"] for r in sums):
        return -np.inf
    poor, good, before, starts = sum(r["poor"] for r in sums), 0, None, []
    for r in sums:
        starts.append((r["part"], good, poor, before if before is not None else r["first"] - 2))
        good, poor, before = good + r["good"], poor - r["poor"], r["last"]
    # Rows of a list would go through Python workers of another kind, which then stay beside the others.
    kinds = pa.schema([("part", pa.int32()), ("good_before", pa.int64()), ("poor_from", pa.int64()), ("score_before", pa.float64())])
    starts = scores.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, start, strict=True)) for start in starts], schema=kinds))
    order = Window.partitionBy("part").orderBy("score")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda name: F.coalesce(F.sum(name).over(upto), F.lit(0))
    cuts = dealt.join(F.broadcast(starts), "part").select(
        (10 * (F.col("good_before") + below("good")) + F.col("poor_from") - below("poor")).alias("errors"),
        ((F.coalesce(F.lag("score").over(order), F.col("score_before")) + F.col("score")) / 2).alias("cut"),
    )
    return float(cuts.agg(F.min(F.struct("errors", "cut"))["cut"]).first()[0])


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio per bucket, and the threshold.

    Raw counts cover all documents, trusted counts all labelled good ones, and the
    threshold all labelled documents of both classes; it is the middle of the
    interval that parts them with the fewest errors, a rejected good document
    counting ten times. Without labelled documents of a class nothing is rejected
    by the ratio.
    """
    trusted, _ = _feature_counts(_labelled(documents, labels.where("quality = 1")))
    if not trusted.sum():
        return np.zeros(BUCKETS), -np.inf
    _, raw = _feature_counts(documents.select(F.col("text").cast("string").alias("text"), F.lit(False).alias("good")))
    ratio = np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))

    def score(texts: Iterator[str | None]) -> Iterator[float]:
        return (_mean(found, ratio) for found in found_in(texts))

    number = lambda name: F.sum(F.col(name).cast("long")).alias(name)
    classes = _classes(labels)
    scores = _maybe_labelled(documents, classes, "score", "double", score).join(classes, F.col("doc_id") == F.col("_id"))
    return ratio, _threshold(scores.groupBy("score").agg(number("good"), number("poor")))


def _judge(ratio: np.ndarray, threshold: float):
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(verdicts(batches))

    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text, found in zip(texts, found_in(texts), strict=True):
                base = base_counts(text)
                failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]
                value = _mean(found, ratio)
                out.append((*base, failed, not failed and value >= threshold, value))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    return judge


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and verdict of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null or empty text has
    none, fails the base rules and is not kept. Repeated rows are judged each for
    itself, a null doc_id stays null, an empty table gives no rows, extra columns
    are not read. Returns doc_id, the base counts, base_failed, kept and ``ratio``,
    the mean log ratio.
    """
    judge = _judge(*fit(documents, labels))
    return documents.select("doc_id", judge(F.col("text").cast("string")).alias("_j")).select("doc_id", "_j.*")


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that ``judged`` keeps, columns unchanged."""
    judge, verdict = _judge(*fit(documents, labels)), fresh(documents, "_verdict")
    passed: Column = F.col(f"{verdict}.kept")
    return documents.withColumn(verdict, judge(F.col("text").cast("string"))).where(passed).drop(verdict)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents, trusted text from the labels."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
