from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from murmur.llm import sharding as sh


def smallest(sizes: list[int], shards: int) -> int:
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, count, load = (low + high) // 2, 1, 0
        for size in sizes:
            if load + size > middle:
                count, load = count + 1, 0
            load += size
        low, high = (low, middle) if count <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("trial", range(6))
def test_cuts_reach_the_smallest_capacity(spark, monkeypatch, trial):
    draw = random.Random(trial)
    monkeypatch.setattr(sh, "FIRST_DIGITS", draw.choice([1, 2]))
    monkeypatch.setattr(sh, "MORE_DIGITS", 1)
    n = [1, 3, 40, 500, 3000, 500][trial]
    rows = sorted((hashlib.md5(str(i).encode()).hexdigest(), 10**6 if draw.random() < 0.01 else draw.randint(1, 3000)) for i in range(n))
    capacity, cuts = sh.cut_digests(spark.createDataFrame(rows, "digest string, size long"), 16)
    loads = [0] * 16
    for digest, size in rows:
        loads[sum(digest >= c for c in cuts)] += size
    assert capacity == smallest([s for _, s in rows], 16) and max(loads) <= capacity


def check(rows, shards=16):
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        of_text[(r["size"], r["text_crc32"])].add(r["shard"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for k, v in of_text.items() if k[0] > 1)


def test_documents_are_sharded_whole(spark, documents):
    rows = sh.shards_of(documents).collect()
    source = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    assert all(r["size"] == len(source[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(source[r["doc_id"]].encode()) for r in rows)
    check(rows)


def test_odd_rows(odd, nothing):
    rows = sh.shards_of(odd).collect()
    assert len(rows) == odd.count()
    check(rows)
    assert sh.shards_of(nothing).collect() == []


def test_shards_hold_the_documents(documents, odd, nothing):
    for frame in (documents, odd):
        rows = sh.sharded_documents(frame)
        assert rows.columns == [*frame.columns, "shard", "slot"]
        assert sorted((tuple(r)[:-2] for r in rows.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)
        places = sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in rows.collect())
        assert places == sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in sh.shards_of(frame).collect())
    assert sh.sharded_documents(nothing).collect() == []
