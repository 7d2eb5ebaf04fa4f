from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from murmur.llm import jaccard, mixing, packing, quality, simhash
from murmur.llm.secrets import MASK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality_keeps_what_the_operator_keeps(spark, stages):
    verdicts = quality.judged(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()
    assert rows(stages[1]) == {d: r for d, r in rows(stages[0]).items() if d in {v["doc_id"] for v in verdicts}}


def groups(sets):
    """{id: smallest id} over all pairs of similarity 0.8, by plain sets."""
    ids = sorted(sets)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def test_one_document_of_each_group_stays(stages):
    root = groups({d: shingles(r["text"]) for d, r in rows(stages[1]).items()})
    assert set(rows(stages[2])) == set(root.values()) and len(set(root.values())) < len(root)


def test_texts_of_one_template_meet_in_blocks(spark):
    draw = random.Random(6)
    common = [f"c{k}" for k in range(40)]
    texts = {}
    for i in range(240):
        # Groups of ten share half of their own words; all share the middle, which no other text has.
        words = [f"g{i // 10}w{k}" for k in range(200)] + common
        for _ in range(draw.choice((1, 3, 12))):
            words[draw.randrange(200)] = f"x{draw.random()}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", "text", jaccard.digests(F.col("text")).alias("fp")).repartition(6)
    found = {r["node"]: r["root"] for r in jaccard.near_copies(df, block=16).collect()}
    of = {r["doc_id"]: found.get(r["fp"], r["fp"]) for r in df.collect()}
    root = groups({d: shingles(t) for d, t in texts.items()})
    same = lambda labels: {frozenset(d for d in labels if labels[d] == r) for r in set(labels.values())}
    assert same(of) == same(root) and len(same(root)) > 24


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=80), st.sets(st.integers(0, (1 << 64) - 1), max_size=80), st.sets(st.integers(0, (1 << 64) - 1), max_size=300))
def test_parity_bits_never_rule_out_a_similar_pair(one, other, both):
    a, b = (np.array(sorted(s | both), dtype="u8") for s in (one, other))
    differ = int(np.bitwise_count(jaccard.parity(a) ^ jaccard.parity(b)).sum())
    assert differ <= len(np.setxor1d(a, b)) and (not jaccard.similar(a, b) or 9 * differ <= len(a) + len(b))


def test_only_secrets_change(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for d, row in after.items():
        if MASK in row["text"]:
            assert row["n_chars"] == len(row["text"]) and 'oken = "' in before[d]["text"].lower() + 'token = "'
        else:
            assert row == before[d]


def test_mix_repeats_documents_as_planned(stages):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[3]).collect() if r["copies"]}
    counts = {}
    for r in stages[4].collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == plan


def test_packed_pieces_are_the_mixed_documents(stages):
    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    whole = {}
    for r in stages[4].collect():
        whole[r["doc_id"]] = (np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4"), whole.get(r["doc_id"], (0, 0))[1] + 1)
    seen = {}
    for r in stages[5].collect():
        ids, _ = whole[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {d: len(ids) * n for d, (ids, n) in whole.items()}


def test_run_gives_the_last_stage(spark, stages):
    def pieces(df):
        return sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").where("start = 0").select("doc_id", "doc_tokens").collect()))

    assert pieces(cp.run(spark, SF)) == pieces(stages[5])


def test_stages_handle_odd_rows(spark, odd, nothing):
    for _, stage in cp.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, nothing, SF).collect() == []


def test_copies_of_the_simhash_operator_come_first(spark, monkeypatch):
    body = [f"w{k}" for k in range(300)]
    texts = [" ".join(body), " ".join(body).upper() + " ", " ".join([*body, "more"]), " ".join(f"y{k}" for k in range(80)), None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    given, whole = [], jaccard.near_copies

    def seen(texts, **options):
        given.extend(map(tuple, options["linked"].collect()))
        return whole(texts, **options)

    monkeypatch.setattr(jaccard, "near_copies", seen)
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == [0, 3, 4]
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    fps = {r["doc_id"]: bytes(r["fp"]) for r in df.select("doc_id", jaccard.digests(F.col("text")).alias("fp")).collect()}
    wanted = {(min(f for d, f in fps.items() if group[d] == c), fps[k]) for k, c in group.items()}
    assert group[2] == 0 and {(bytes(u), bytes(v)) for u, v in given} == {(u, v) for u, v in wanted if u != v} != set()


def test_links_of_another_method_are_confirmed(spark):
    texts = [" ".join(f"{a}{k}" for k in range(60)) for a in "abc"] + [" ".join([*(f"a{k}" for k in range(60)), "z"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", jaccard.digests(F.col("text")).alias("fp"))
    fp = [r["fp"] for r in df.orderBy("doc_id").collect()]
    false = spark.createDataFrame([(fp[0], fp[1]), (fp[2], fp[1]), (fp[3], fp[0])], "u binary, v binary")
    found = {bytes(r["node"]): bytes(r["root"]) for r in jaccard.near_copies(df, linked=false).collect()}
    assert found.keys() - {bytes(min(fp[0], fp[3]))} == {bytes(max(fp[0], fp[3]))} and set(found.values()) == {bytes(min(fp[0], fp[3]))}


def test_pairs_that_have_met_are_not_made_again(spark, monkeypatch):
    # Every text shares one passage with one other text, too little to be a copy.
    texts = [" ".join([*(f"p{i // 2}x{k}" for k in range(60)), *(f"o{i}x{k}" for k in range(60))]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", jaccard.digests(F.col("text")).alias("fp"))
    dealt, rows = jaccard._dealt, []

    def seen(*args):
        out = dealt(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_dealt", seen)
    assert jaccard.near_copies(df).collect() == [] and rows == [0]


def test_a_pair_is_made_under_few_of_its_keys(spark, monkeypatch):
    # Texts of one family are a little too different; every two share dozens of rare passages.
    draw, texts = random.Random(3), []
    for i in range(60):
        words = [f"f{i // 12}w{k}" for k in range(200)]
        for k in draw.sample(range(200), 6 if i % 12 else 1):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", jaccard.digests(F.col("text")).alias("fp")).repartition(4)
    made, crossing = spark.sparkContext.accumulator(0), jaccard._crossing

    def counted(batches):
        for batch in crossing(batches):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(jaccard, "_crossing", counted)
    found = {r["node"]: r["root"] for r in jaccard.near_copies(df).collect()}
    of = {r["doc_id"]: found.get(r["fp"], r["fp"]) for r in df.collect()}
    root = groups({d: shingles(t) for d, t in enumerate(texts)})
    assert {frozenset(d for d in of if of[d] == r) for r in set(of.values())} == {frozenset(d for d in root if root[d] == r) for r in set(root.values())}
    # 5 families of 66 pairs; each pair was made under dozens of keys before.
    assert made.value <= 2 * 5 * 66


def test_few_bucket_counts_reach_the_driver(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(1, 60)) for i in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    wanted = {}
    for t in texts:
        for bucket in (jaccard.shingle_set(t) % np.uint64(jaccard.BUCKETS)).tolist():
            wanted[bucket] = wanted.get(bucket, 0) + 1
    plans = []
    for name in ("collect", "toArrow"):
        whole = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, whole=whole: plans.append(self._jdf.queryExecution().executedPlan().toString()) or whole(self))
    every = dict(zip(*(a.tolist() for a in jaccard._bucket_counts(df)), strict=True))
    assert every == wanted and len(wanted) > 500
    monkeypatch.setattr(jaccard, "FULLEST", 400)
    some = dict(zip(*(a.tolist() for a in jaccard._bucket_counts(df)), strict=True))
    assert len(some) <= 420 and some == {b: n for b, n in wanted.items() if n > min([*wanted.values()] if not some else [max(n for b, n in wanted.items() if b not in some)])}
    # Each task sent as many rows as the driver keeps of all before.
    assert plans and not any("TakeOrdered" in plan for plan in plans)
