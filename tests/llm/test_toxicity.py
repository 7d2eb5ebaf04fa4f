from __future__ import annotations

import random
import zlib

import numpy as np

from murmur.llm import toxicity as tx


def brute(scores):
    """All maximal segments by definition: the best segment, then the same left and right of it."""
    total = np.concatenate([[0.0], np.cumsum(scores)])

    def inside(a, b):
        best = max(((total[j] - total[i], i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        return inside(a, best[2]) + [best[0]] + inside(best[3], b)

    return inside(0, len(scores))


def test_scan_finds_all_maximal_segments():
    draw = random.Random(2)
    for _ in range(300):
        scores = np.array([draw.choice([-3, -2, -1, 1, 2, 4]) + draw.random() / 100 for _ in range(draw.randint(0, 25))])
        assert np.allclose(sorted(tx.segments(scores)), sorted(brute(scores)))


def test_held_out_labels_are_predicted(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = tx.scored(documents, tx.fit(documents, labels)).join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows["doc_id"]]).all()
    test = rows[rows["held_out"]]
    rank, toxic = test["score"].rank().to_numpy(), test["toxic"].to_numpy(dtype=int)
    n = toxic.sum()
    assert (rank[toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(test) - n)) > 0.93
    assert test[(test["predicted"] == 1) & (test["toxic"] == 0)].shape[0] < 0.02 * (len(test) - n)
    assert ((test["score"] >= 0.7).astype(int) == test["predicted"]).all() and test["score"].between(0, 1).all()


def test_labels_of_held_out_rows_do_not_matter(spark, documents, labels):
    changed = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (tx.scored(documents, tx.fit(documents, x)).orderBy("doc_id").collect() for x in (labels, changed))
    assert a == b


def test_odd_rows(odd, nothing, labels):
    model = tx.fit(odd, labels)
    rows = tx.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert tx.scored(nothing, tx.fit(nothing, labels)).collect() == []
