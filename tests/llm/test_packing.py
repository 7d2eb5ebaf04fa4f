from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from murmur.llm import packing as pk


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(pk.byte_bpe_path())


def ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_words_give_the_ids_of_whole_texts(tokenizer):
    encode, draw = pk.encoder(pk.byte_bpe_path()), random.Random(0)
    parts = [" ", " ", "a", "B", "é", "\n", "\n", "\t", "1", "!", "'s", "  ", ".", ",", "\x1c", "<|endoftext|>", "中", "'", "\r", "ab", "ª", "²", "ʰ", "ab,", "cd.", "　", "\x85"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(6000)]
    for k in range(0, len(texts), 500):
        for text, found in zip(texts[k : k + 500], encode(texts[k : k + 500]), strict=True):
            assert found == ids(tokenizer, text)[:-1].tobytes(), repr(text)


def check(rows, texts, tokenizer):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        whole, at = ids(tokenizer, texts[doc_id]), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(1024 - sum(n for _, n in p) for p in sequences.values()) / sum(n for p in sequences.values() for _, n in p)


def test_documents_are_packed_whole(spark, tokenizer):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    padding = check(pk.pack(documents).collect(), {r["doc_id"]: r["text"] for r in documents.collect()}, tokenizer)
    assert padding < 0.01


def test_odd_rows(spark, odd, nothing, tokenizer):
    once = odd.dropDuplicates(["doc_id"]).where("doc_id is not null")
    once = spark.createDataFrame(once.collect(), once.schema)
    check(pk.pack(once).collect(), {r["doc_id"]: r["text"] for r in once.collect()}, tokenizer)
    rows = pk.pack(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == odd.count() and any(r["doc_id"] is None for r in rows)
    assert pk.pack(nothing).collect() == []


def test_differencing_is_even_and_complete():
    draw = random.Random(1)
    for _ in range(30):
        lengths = [draw.randint(1, 1024) for _ in range(draw.randint(1, 300))]
        at = pk.windows_of(lengths)
        loads = np.bincount(at, weights=lengths)
        assert len(at) == len(lengths) and loads.max() <= 1024
    at = pk.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(np.bincount(at, weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_pieces_and_windows_carry_their_ids(spark, documents, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    pieces = pk.pack(documents).collect()
    windows = {r["sequence_id"]: r for r in pk.sequences(spark.createDataFrame(pieces)).collect()}
    held = defaultdict(int)
    for r in pieces:
        whole = ids(tokenizer, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["ids"] == whole and r["ids_crc32"] == zlib.crc32(whole)
        assert windows[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == whole
        held[r["sequence_id"]] += r["length"]
    assert held == {k: w["length"] for k, w in windows.items()} and all(len(w["ids"]) == 4 * w["length"] for w in windows.values())
