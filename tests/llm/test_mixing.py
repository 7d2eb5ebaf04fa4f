from __future__ import annotations

import math
from collections import defaultdict

import pytest

from murmur.llm import mixing as mx
from murmur.llm.registry import ORACLES
from tools.check import compare


def filled(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mx.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 7}, {"x": 0, "y": 0}, {"a": 1, "b": 1, "c": 1000, None: 3, "é": 50, "Z": 9}, {f"s{i}": i * i for i in range(40)}])
def test_targets_are_shared_anew(spark, sizes):
    rows = mx.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r["source"]: round(r["target"], 4) for r in rows} == {s: round(float(v), 4) for s, v in want.items()}


def check(rows):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["copies"] <= 3
        by[r["source"]].append(r)
    for own in by.values():
        taken = sum(r["size"] * r["copies"] * r["n"] for r in own)
        assert sum(r["size"] * r["n"] for r in own) == own[0]["source_size"]
        assert abs(taken - own[0]["target"]) <= max(r["size"] * r["n"] for r in own) / 2 + 1e-6
        # Whole epochs come first: copies differ by one at most.
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


def test_documents_come_near_their_targets(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, second = mx.mix(documents).collect(), mx.mix(documents.repartition(7)).collect()
    check(first)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, second), key=str)


def test_odd_rows(odd, nothing):
    rows = mx.mix(odd).collect()
    assert sum(r["n"] for r in rows) == odd.count()
    check(rows)
    mixed = mx.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["n"] * r["copies"] for r in rows)
    assert mx.mix(nothing).collect() == [] and mx.mixed_documents(nothing).collect() == []


def test_heavier_documents_come_earlier(spark):
    keys = spark.range(4000).selectExpr("md5(cast(id AS string)) AS unit", "CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.25 END AS weight")
    rows = keys.select("weight", mx.sampling_key(keys["unit"], keys["weight"]).alias("key")).orderBy("key").limit(1000).collect()
    assert 0.72 < sum(r["weight"] == 1.0 for r in rows) / 1000 < 0.88
    assert all(r["key"] > 0 and math.isfinite(r["key"]) for r in rows)


@pytest.mark.parametrize("name", ["op3_urls", "op7_mixing"])
def test_query_agrees_with_its_sql(spark, name):
    import duckdb

    from murmur.llm.registry import QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, result.fetchall(), columns) == "ok"
