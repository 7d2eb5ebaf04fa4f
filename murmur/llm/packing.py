"""Operator 5, packing: Karmarkar-Karp multiway differencing into token windows.

A document's ids are cut into full windows and a rest; rests are cut into small
pieces and dealt to windows by multiway differencing: every piece starts as a
partial partition (its length in one window, nothing in the others), and the two
partitions of the largest spread are merged with opposing imbalances until one is
left. That gives windows of nearly equal length. If the longest is over the
capacity, the number of windows rises by one and the merging runs again.

Pieces are gathered and packed inside a task, in batches of a fixed number of
windows, so nothing is shuffled and memory does not depend on the input. A piece carries its ids; the query shows
their digest.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.bytebpe import LONG, TOGETHER, by_rank, cut, token_bytes
from murmur.llm.common import query, released, table

#: Tokens of a window, longest piece of a rest, windows of a batch, id behind a document.
CAPACITY, PIECE, WINDOWS, END_ID = 1024, 256, 128, 0
#: Words a worker remembers (about 20 MB), and texts it encodes together.
WORDS, TEXTS = 100_000, 250
#: Pieces that leave a task together, with their ids a few megabytes.
FRAME = 2000
#: Sequence ids of a task begin at its number times this.
IDS_PER_TASK = 1 << 40
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """texts -> ids (little-endian unsigned 32 bits) as the tokenizer gives them for each whole text.

    A space between two characters that are no white space always begins a new
    pre-token, and a lone line break is one, so texts are cut there and every
    distinct word is encoded once; the first ``WORDS`` are remembered. A unit is a
    word behind a space, or behind a line break that it keeps.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    pair, single = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
    marked = re.compile(r"(\n?[^\W\d_]+)((?:[^\w\s]|_)+)")
    plain = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    marks, line = {}, plain("\n")
    tokens = token_bytes(tokenizer)
    quick, sizes = by_rank(tokenizer, tokens), np.array([len(t) for t in tokens], dtype="i8")
    known: dict[str, bytes] = {}

    def units(text: str) -> tuple[str, list[str]]:
        if pair.search(text) or text[0].isspace() or text[-1].isspace():
            first, *rest = single.split(text)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
        return first, rest

    def words_of(words: list[str]) -> dict[str, bytes]:
        """Ids of short words, each behind its space or line break, encoded many in a text."""
        out: dict[str, bytes] = {}
        behind = [w if w[0] == "\n" else f" {w}" for w in words]
        for k in range(0, len(words), TOGETHER):
            raw = [w.encode("utf-8", "surrogatepass") for w in behind[k : k + TOGETHER]]
            ids = quick.encode_ordinary(" a" + "".join(behind[k : k + TOGETHER]))
            found = cut(ids, tokens, sizes, b" a" + b"".join(raw), np.cumsum([2, *map(len, raw)]))
            # Never None unless a text holds what is no UTF-8; such words are encoded by themselves.
            out.update(zip(words[k : k + TOGETHER], found or [], strict=False))
        return out

    def learn(new: set[str]) -> dict[str, bytes]:
        """Ids of units; marks at the end of letters are a pre-token of their own."""
        parts = {}
        for unit in new:
            m = marked.fullmatch(unit) if not unit.isalpha() else None
            parts[unit] = m.groups() if m and m.group(1).lstrip("\n").isalpha() and "<|" not in unit else (unit, "")
        for mark in {m for _, m in parts.values()}.difference(marks):
            marks[mark] = plain(mark)
        bases = {base for base, _ in parts.values()}.difference(known)
        got = words_of([b for b in bases if 0 < len(b) <= LONG and "<|" not in b]) if quick else {}
        for base in bases.difference(got):
            got[base] = line + plain(base[1:]) if base[:1] == "\n" else plain(" " + base)
        if len(marks) > WORDS // 10:
            marks.clear()
            marks[""] = b""
            marks.update((m, plain(m)) for _, m in parts.values())
        return {unit: (got.get(base) or known[base]) + marks[mark] for unit, (base, mark) in parts.items()}

    def encode(texts: list[str]) -> list[bytes]:
        rows, wanted = [], set()
        for text in texts:
            first, rest = units(text) if text else ("", [])
            ids = list(map(known.get, rest))
            holes = [(i, rest[i]) for i, found in enumerate(ids) if found is None]
            wanted.update(u for _, u in holes)
            rows.append((first, ids, holes))
        now = learn(wanted)
        if len(known) < WORDS:
            known.update(now)
        for _, ids, holes in rows:
            for i, unit in holes:
                ids[i] = now[unit]
        return [(plain(first) if first else b"") + b"".join(ids) for first, ids, _ in rows]

    return encode


def remembered(name: str, make):
    """An object that every task of a Python worker shares, made once in its process."""
    kept = sys.modules.setdefault("_murmur_worker", ModuleType("_murmur_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """Window of each length by Karmarkar-Karp differencing."""
    nodes: list[tuple[int, int, np.ndarray] | None] = [None] * len(lengths)
    heap, sums = [], {}
    for i, length in enumerate(lengths):
        sums[i] = np.zeros(windows, dtype="i8")
        sums[i][0] = length
        heap.append((-length, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        # Largest of one meets smallest of the other.
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[len(nodes)] = both
        heapq.heappush(heap, (-int(both[0]), len(nodes)))
        nodes.append((a, b, order))
    out = np.zeros(len(lengths), dtype="i8")
    places = {len(nodes) - 1: np.arange(windows)}
    for i in range(len(nodes) - 1, -1, -1):
        place = places.pop(i)
        if nodes[i] is None:
            out[i] = place[0]
            continue
        a, b, order = nodes[i]
        places[a], places[b] = np.empty_like(place), np.empty_like(place)
        places[a][order] = place
        places[b][windows - 1 - order] = place
    return out


def windows_of(lengths: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Window of each length so that no window is over the capacity; no length may be."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        at = differencing(lengths, windows)
        if np.bincount(at, weights=lengths).max() <= capacity:
            return at
        windows += 1


def pack_rows(rows: Iterator[pd.DataFrame], path: str, first_id: int, *, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS) -> Iterator[pd.DataFrame]:
    """Pieces of (doc_id, text) batches with their sequences, in batches of about ``windows`` windows."""
    encode, next_id = remembered(f"encoder {path}", lambda: encoder(path)), first_id
    end = np.array([END_ID], dtype="<u4").tobytes()
    rests: list[tuple] = []
    size = 0
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=names)
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    def flush() -> list[tuple]:
        nonlocal next_id, rests, size
        lengths = [r[2] for r in rests]
        at = windows_of(lengths, capacity)
        out, filled = [], {}
        for row, window in zip(rests, at.tolist(), strict=True):
            offset = filled.get(window, 0)
            out.append((*row, next_id + window, offset))
            filled[window] = offset + row[2]
        next_id, rests, size = next_id + int(at.max()) + 1, [], 0
        return out

    for batch in rows:
        out: list[tuple] = []
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        encoded = chain.from_iterable(encode(texts[k : k + TEXTS]) for k in range(0, len(texts), TEXTS))
        for doc_id, ids in zip(batch["doc_id"], encoded, strict=True):
            key = None if doc_id is None or pd.isna(doc_id) else int(doc_id)
            ids += end
            n = len(ids) // 4
            whole = n - n % capacity
            cuts = [*range(0, whole, capacity), *range(whole, n, piece), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                row = (key, a, b - a, ids[4 * a : 4 * b], n)
                if b - a == capacity:
                    out.append((*row, next_id, 0))
                    next_id += 1
                else:
                    rests.append(row)
                    size += b - a
            if size >= windows * capacity:
                out += flush()
            if len(out) >= FRAME:
                yield frame(out)
                out = []
        if out:
            yield frame(out)
    if rests:
        yield frame(flush())


def pack(documents: DataFrame, *, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every document cut into pieces and packed into sequences of at most ``capacity`` ids.

    A null or empty text is the end id alone. A null doc_id stays null. Repeated
    rows are packed each for itself. An empty table gives no rows; extra columns
    are not read. ``path`` names the tokenizer file on the workers (default: the
    installed byte-level BPE). A sequence lies inside one task; its id is unique.
    Returns a row per piece: doc_id, start, length, ids (little-endian unsigned 32
    bits) and their ids_crc32, doc_tokens, sequence_id, offset. ``sequences`` joins them.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from released(pack_rows(batches, path or byte_bpe_path(), TaskContext.get().partitionId() * IDS_PER_TASK, capacity=capacity))

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(packed, SCHEMA).select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of every window: its pieces' ids in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, their ids as a digest."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
