from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from murmur.llm import codes as cd

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, d int, error int"


def brute(rows, entries=16, rounds=6, parts=8):
    """(vec_id, vector, label) rows -> ({(vec_id, code, error, label_error)} as a sorted list, digest), in plain integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    kept = [(i, cut(v), y) for i, v, y in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][p]) for r in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((square(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(best(v[p], books[p])[1], []).append(v[p])
            for k, vs in own.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = [(i, *zip(*[best(v[p], books[p]) for p in range(parts)], strict=True), y) for i, v, y in kept]
    total = {}
    for _, errors, _, y in out:
        total[y] = total.get(y, 0) + sum(errors)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in ks), sum(errors), total[y]) for i, errors, ks, y in out), key=repr), digest


def found(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = cd.op12_codes(spark, str(tmp_path)).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr), {r["codebooks_sha256"] for r in rows}


def test_whole_table_matches_plain_integers(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    expected, digest = brute([(r["vec_id"], r["embedding"], r["label"]) for r in source.collect()])
    rows = cd.op12_codes(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr) == expected
    assert {r["codebooks_sha256"] for r in rows} == {digest}


def test_odd_rows(spark, tmp_path):
    draw = random.Random(3)
    good = [(i, [float(draw.randint(-2, 2)) / 4096 for _ in range(16)], draw.choice([1, 2, None])) for i in range(60)]
    good += [(100 + i, good[0][1], 2) for i in range(50)] + [good[5], good[5], (None, good[7][1], None), (3, good[9][1], 1), (400, [-0.00001] * 16, 1), (401, [8000.0] * 16, 7), (402, [0.0] * 16, 7)]
    bad = [(-1, None, 1), (-2, [None] * 16, 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] + [0.0] * 15, 1), (-5, [0.0] * 15 + [float("-inf")], 1)]
    df = spark.createDataFrame([(*r, "c", "v", 1, 2) for r in good + bad], SCHEMA).repartition(5)
    expected, digest = brute(good)
    assert found(spark, df, tmp_path) == (expected, {digest})


def test_few_short_uneven_and_no_rows(spark, tmp_path):
    few = [(7, [0.5, -0.25] * 4, 1), (2, [0.0, 1.0] * 4, None), (9, [1e300, -1e300] * 4, 1)]
    frame = spark.createDataFrame([(i, v, y) for i, v, y in few[:2]], "vec_id long, embedding array<double>, label int")
    expected, digest = brute(few[:2])
    assert found(spark, frame, tmp_path / "few") == (expected, {digest})
    uneven = spark.createDataFrame([(1, [0.5] * 10), (2, [0.25] * 10), (3, [1.0]), (4, [])], "vec_id long, embedding array<double>")
    made = cd.compress(uneven)
    assert {r["vec_id"]: r["error"] for r in made.rows.collect()} == {1: 0, 2: 0} and made.codebooks.shape == (8, 2, 2)
    huge = cd.compress(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int"))
    assert all(r["error"] == 0 for r in huge.rows.collect()) and abs(huge.codebooks).max() == cd.LIMIT
    assert cd.compress(frame.limit(0)).rows.collect() == []
    assert found(spark, frame.withColumn("embedding", F.lit(None).cast("array<double>")), tmp_path / "none") == ([], set())


def test_bounds_prune_and_never_change_the_nearest():
    draw = np.random.default_rng(5)
    centres = draw.integers(-2000, 2000, (16, 8))
    points = centres[draw.integers(0, 16, 3000)] + draw.integers(-60, 60, (3000, 8))
    entries = centres + draw.integers(-20, 20, (16, 8))
    entries[9] = entries[4]
    pivots = cd.pivots_of(centres)
    entry, squared, evaluated = cd.nearest(points, cd.distances(points, pivots), entries, pivots)
    whole = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (entry == whole.argmin(axis=1)).all() and (squared == whole.min(axis=1)).all()
    assert evaluated < 0.4 * whole.size
