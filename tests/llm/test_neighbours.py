from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from murmur.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, v string, `first` int, rank int"


def exact(rows, query, k):
    q = next(v for i, v in rows if i == query)
    found = [(-(np.array(v, "f4").astype("f8") * np.array(q, "f4").astype("f8")).sum(), i) for i, v in rows if i != query]
    return [i for _, i in sorted(found)[:k]]


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    found = nb.op9_neighbours(spark, "/root/testdata/sf0.01").collect()
    by, vectors = {}, {i: np.array(v, "f8") for i, v in rows}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i, _ in rows if i % 20 == 0]
    assert sorted(by) == sorted(queries)
    hits = 0
    for q in queries:
        own = sorted(by[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(exact(rows, q, 20)))
    assert hits >= 0.9 * 20 * len(queries)


def test_whole_share_is_exact_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK", 16)
    monkeypatch.setattr(nb, "BLOCK", 4)
    draw = random.Random(4)
    good = [(i, [float(draw.randint(-3, 3)) for _ in range(4)] + [1.0]) for i in range(200)]
    good += [(1000 + i, good[0][1]) for i in range(60)]
    bad = [(300, None), (301, [0.0] * 5), (302, [1.0, None, 0.0, 0.0, 1.0]), (303, [float("nan")] + [1.0] * 4), (304, [float("inf")] + [1.0] * 4), (None, [1.0] * 5), (305, [1.0]), (320, [])]
    frame = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in good + bad], SCHEMA)
    found = nb.search(frame, F.col("vec_id") % 20 == 0, share=1.0).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(by) == {i for i, _ in good if i % 20 == 0}
    assert all(by[q] == exact(good, q, 20) for q in by)
    assert nb.search(frame.limit(0), F.lit(True)).collect() == []
    two = frame.where("vec_id in (0, 1)")
    assert [(r["query_id"], r["vec_id"]) for r in nb.search(two, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_walk_takes_cells_in_order_of_distance():
    draw = np.random.default_rng(0)
    for _ in range(50):
        first, second = draw.standard_normal(7), draw.standard_normal(9)
        counts = draw.integers(0, 5, (7, 9))
        wanted = int(draw.integers(1, counts.sum() + 1))
        masks = nb.visited(first, second, counts.tolist(), wanted).view("u8")
        taken = np.array([[bool(int(m) >> j & 1) for j in range(9)] for m in masks])
        total = first[:, None] + second[None, :]
        assert counts[taken].sum() >= wanted
        assert total[taken].max() <= total[~taken].min() if (~taken).any() else True
