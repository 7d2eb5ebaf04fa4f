"""Operator 11, cross-tokenizer alignment by diagonal run skipping.

Both tokenizers cut the bytes of a text; where a token of each ends at one place a
group ends. With the two ascending arrays of token ends, the difference of the
indexes is the shift of a diagonal. Along a one-to-one stretch the shift stays:
blocks of doubling length are compared at the current shift, and a block that
differs is halved down to its first difference. There the smaller end steps on
until both meet, which closes an irregular group and gives the next shift.

Counts of id pairs are made per task, added up by Spark and broadcast. Of two
tokens that end together one is a suffix of the other, so the vocabularies bound
the number of pairs (``most_pairs``), whatever the corpus.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.bytebpe import LONG, TOGETHER, by_rank, cut, token_bytes
from murmur.llm.common import query, table
from murmur.llm.packing import byte_bpe_path, remembered
from murmur.session import written

#: Words a worker remembers with their ids (about 60 MB), and bytes of text a task works on together.
WORDS, BYTES = 200_000, 2_000_000
#: Equal ends in a row after which blocks are compared.
STRETCH = 4
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
#: The character that stands for a space in pieces.
SPACE = "▁"


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers of a task, and the bytes of all their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        # Strings of special tokens inside a text are plain text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = token_bytes(self.a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.size_a, self.size_b = (np.array([len(t) for t in tokens], dtype="i8") for tokens in (self.bytes_a, self.bytes_b))
        # Texts may be cut between words if no piece goes on behind a space or holds a line break.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and SPACE in pieces
        self.quick = by_rank(self.a, self.bytes_a)
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.unkept: set[str] = set()
        self.pair, self.single = re.compile(r"\s\s"), re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")

    def units(self, text: str) -> list[str]:
        """The text cut at single spaces (left out) and before single line breaks, where both tokenizers begin anew."""
        if self.pair.search(text) or text[-1].isspace():
            return self.single.split(text)
        return text.replace("\n", " \n").split(" ")

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A for space+text and of B for text, None if one does not keep the bytes."""
        raw = f" {text}".encode("utf-8", "surrogatepass")
        a, b = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.b.encode(text)
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return np.array(a, dtype="<u4"), np.array(b, dtype="<u4")

    def learn(self, units: list[str]) -> None:
        """Remember the ids of units; many are encoded as one text and cut where their bytes end."""
        behind = [u if u[0] == "\n" else f" {u}" for u in units]
        groups = [range(k, min(k + TOGETHER, len(units))) for k in range(0, len(units), TOGETHER)]
        for k in range(0, len(groups), 20):
            quick = self.quick is not None and all(len(behind[i]) <= LONG for g in groups[k : k + 20] for i in g)
            # A word of one letter in front takes the mark that B sets before a text.
            texts = [" a" + "".join([behind[i] for i in g]) for g in groups[k : k + 20]]
            of_a = [self.quick.encode_ordinary(t) for t in texts] if quick else [found.ids for found in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            of_b = self.b.encode([t[1:] for t in texts], num_threads=1)
            for group, text, a, b in zip(groups[k : k + 20], texts, of_a, of_b, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                stops = np.cumsum([2, *[len(behind[i].encode("utf-8", "surrogatepass")) for i in group]])
                cut_a, cut_b = cut(a, self.bytes_a, self.size_a, raw, stops), cut(b, self.bytes_b, self.size_b, raw, stops)
                if cut_a is None or cut_b is None:
                    if len(group) == 1:
                        self.unkept.add(units[group[0]])
                        continue
                    for i in group:
                        self.learn([units[i]])
                    continue
                for i, x, y in zip(group, cut_a, cut_b, strict=True):
                    self.known_a[units[i]], self.known_b[units[i]] = x, y

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A for space+text and of B for text; None for texts without tokens."""
        if len(self.known_a) + len(self.unkept) > WORDS:
            self.known_a, self.known_b, self.unkept = {}, {}, set()
        parts = [self.units(t) if t and self.cuts and not t[0].isspace() else [] for t in texts]
        new: set[str] = set()
        for units in parts:
            new.update(units)
        self.learn(sorted(new.difference(self.known_a).difference(self.unkept), key=len))
        out = []
        for text, units in zip(texts, parts, strict=True):
            if units and (not self.unkept or self.unkept.isdisjoint(units)):
                out.append(tuple(np.frombuffer(b"".join([known[u] for u in units]), dtype="<u4") for known in (self.known_a, self.known_b)))
            else:
                # Texts that begin with white space, and those where a word by itself does not keep its bytes.
                out.append(self.whole(text) if text else None)
        return out


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of A and of B tokens up to the end of every group, from the ascending ends of the tokens."""
    ends_a: list[int] = []
    ends_b: list[int] = []
    i = j = run = 0
    while i < len(a):
        x, y = a[i], b[j]
        if x == y:
            run += 1
            if run == STRETCH:
                start, shift, length, run = i, j - i, STRETCH, 0
                while i + length <= len(a) and a[i : i + length] == b[j : j + length]:
                    i, j, length = i + length, j + length, 2 * length
                while length > 1:
                    length //= 2
                    if i + length <= len(a) and a[i : i + length] == b[j : j + length]:
                        i, j = i + length, j + length
                ends_a.extend(range(start + 1, i + 1))
                ends_b.extend(range(start + 1 + shift, j + 1))
                continue
        else:
            run = 0
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
        i, j = i + 1, j + 1
        ends_a.append(i)
        ends_b.append(j)
    return ends_a, ends_b


def _lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    """A list column from arrays or lists of numbers."""
    at = np.array([0, *accumulate(map(len, rows))], dtype="i4")
    values = np.concatenate([np.asarray(r, dtype=kind.to_pandas_dtype()) for r in rows]) if rows else np.zeros(0, dtype=kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def _by_size(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.RecordBatch]:
    """Slices of about BYTES; a longer row is a slice by itself."""
    for batch in batches:
        lengths, at, held = size(batch), 0, 0
        for k, n in enumerate(lengths):
            if held and held + n > BYTES:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)


def aligned(documents: DataFrame, *, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of both tokenizers and the groups that both cut, a row per document.

    A encodes a space and the text, B the text, both without special tokens. Group g
    holds the ids of ``a_ids`` from ``a_ends[g - 1]`` to ``a_ends[g]``, and likewise
    of B; its last tokens end together and are its link. A null or empty text, or one
    whose bytes a tokenizer does not keep, has no tokens: empty arrays. A null doc_id
    stays null. Repeated rows are rows each. An empty table gives no rows; extra
    columns are not read. ``path_a`` and ``path_b`` name the tokenizer files on the
    workers (default: the installed byte-level BPE and the piece model).
    """

    paths = path_a or byte_bpe_path(), path_b or piece_bpe_path()
    return _texts(documents, doc_id, text).mapInArrow(lambda batches: _align(batches, paths), ALIGNED)


def _texts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _align(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    both = remembered(f"aligner {paths}", lambda: Tokenizers(*paths))
    none = (np.zeros(0, dtype="<u4"),) * 2
    for rows in _by_size(batches, lambda batch: pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
        ids = [found or none for found in both.encode([t or "" for t in rows.column("text").to_pylist()])]
        ends = [group_ends(both.size_a[a].cumsum().tolist(), both.size_b[b].cumsum().tolist()) for a, b in ids]
        columns = [_lists([pair[k] for pair in of], pa.int32()) for of in (ids, ends) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])


class GroupTexts:
    """Groups as text, `a1,a2|b1;a3|b2,b3`: decimal ids in order."""

    def __init__(self, size_a: int, size_b: int):
        self.size_a = size_a
        # One row of bytes for every id and the mark behind it, filled up with zeros.
        rows = np.array([f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(size) for mark in marks], dtype="S")
        self.table = rows.view("u1").reshape(len(rows), -1)

    def text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
        if not len(ends_a):
            return b""
        in_group = lambda ends: np.diff(ends, prepend=0)
        # A group's A ids stand behind all B ids of earlier groups, its B ids behind all A ids up to it.
        at_a = np.arange(len(a)) + np.repeat(ends_b - in_group(ends_b), in_group(ends_a))
        at_b = np.arange(len(b)) + np.repeat(ends_a, in_group(ends_b))
        codes = np.empty(len(a) + len(b), dtype="i8")
        codes[at_a], codes[at_b] = 2 * a, 2 * (b + self.size_a)
        codes[at_a[ends_a - 1]] += 1
        codes[at_b[ends_b - 1]] += 1
        found = self.table[codes].reshape(-1)
        return found[found > 0][:-1].tobytes()


def linked(documents: DataFrame, *, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes, digest of the groups and the distinct linked pairs (A id * B's vocabulary + B id) with their number; rows as in ``aligned``."""
    paths = path_a or byte_bpe_path(), path_b or piece_bpe_path()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = remembered(f"aligner {paths}", lambda: Tokenizers(*paths))
        size_b = len(both.bytes_b)
        texts = remembered(f"group texts {paths}", lambda: GroupTexts(len(both.bytes_a), size_b))
        for part in _align(batches, paths):
            n_a, n_b, n_groups, digests, pairs, times = [], [], [], [], [], []
            for k in range(part.num_rows):
                a, b, x, y = (part.column(c)[k].values.to_numpy().astype("i8") for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
                text = texts.text(a, b, x, y)
                code, n = np.unique(a[x - 1] * size_b + b[y - 1], return_counts=True)
                for column, value in zip((n_a, n_b, n_groups, digests, pairs, times), (len(a), len(b), len(x), hashlib.sha256(text).hexdigest() if text else "", code, n), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int64())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )

    return _texts(documents, doc_id, text).mapInArrow(summed, SUMMARY)


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(code), dtype="i8")
    np.add.at(total, at, np.concatenate(counts))
    return code, total


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): links of the whole corpus that hold each id pair, from ``linked``; added up inside a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [np.zeros(0, dtype="i8")], [np.zeros(0, dtype="i8")], 0
        for batch in batches:
            codes.append(batch.column("pairs").flatten().to_numpy())
            counts.append(batch.column("times").flatten().to_numpy())
            held += len(codes[-1])
            if held > 2_000_000:
                codes, counts = ([c] for c in _added(codes, counts))
                held = 0
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(codes, counts)], names=["pair", "n"])

    return rows.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together: one token's bytes are a suffix of the other's."""
    ids_a, ids_b = ({} for _ in range(2))
    for ids, tokens in ((ids_a, a), (ids_b, b)):
        for t in tokens:
            ids[t] = ids.get(t, 0) + 1
    inside = lambda tokens, ids, start: sum(ids.get(t[k:], 0) for t in tokens for k in range(start, len(t)))
    return inside(a, ids_b, 0) + inside(b, ids_a, 1)


def scored(rows: DataFrame, size_b: int, bound: int) -> DataFrame:
    """``linked`` with n_best and count_sum.

    n_best counts links whose pair is the commonest of its B id in the corpus, ties
    included; count_sum adds up the counts of the links' pairs. The pair table is
    broadcast; ``bound`` is what the vocabularies allow and is checked.
    """
    counts = pair_counts(rows).toArrow()
    if counts.num_rows > bound:
        raise ValueError(f"{counts.num_rows} linked pairs, the vocabularies allow {bound}")
    code, n = (counts.column(c).to_numpy().astype("i8") for c in ("pair", "n"))
    order = np.argsort(code)
    code, n = code[order], n[order]
    top = np.zeros(size_b, dtype="i8")
    np.maximum.at(top, code % size_b, n)
    shared = rows.sparkSession.sparkContext.broadcast((code, n, n == top[code % size_b]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(code, pairs.flatten().to_numpy())
            ends = np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
            totals = [np.concatenate([[0], np.cumsum(values)]) for values in (times * best[at], times * n[at])]
            sums = [pa.array(np.diff(t[np.concatenate([[0], ends]).astype("i8")]).astype("i8")) for t in totals]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *sums, batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and the corpus-wide counts of links of all documents."""
    both = Tokenizers(byte_bpe_path(), piece_bpe_path())
    rows = written(linked(table(spark, sf_dir, "documents")))
    found = scored(rows, len(both.bytes_b), most_pairs(both.bytes_a, both.bytes_b))
    # A group's last tokens are the only ones that end together, so every group is one link.
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
