from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from murmur.llm import quality as ql


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_base_counts_match_the_rules(documents):
    texts = [r["text"] for r in documents.limit(60).collect() if len(r["text"]) < 6000]
    for text in [*texts, None, "", " \n", "a a a a a", "a b c a b c", "x\ny\nx\n\n\n \nx", "ü \x0b# * $\xa0|"]:
        assert ql.base_counts(text) == plain(text)


def test_poor_documents_go_and_good_ones_stay(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = ql.judged(documents, labels).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    poor = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in poor) <= 0.1 * len(poor)
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_odd_rows(odd, nothing, labels):
    rows = ql.judged(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    kept = ql.kept_documents(odd, labels)
    assert kept.columns == odd.columns
    assert ql.judged(nothing, labels).collect() == [] and ql.judged(odd, labels.limit(0)).count() == odd.count()


def test_the_fit_reads_every_labelled_document(spark):
    words = lambda k: " ".join(f"{'fine' if k % 3 else 'bad'}{k % 40}x{j % 60}" for j in range(60))
    docs = spark.range(41000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(41000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    trusted, raw = ql._feature_counts(ql._labelled(docs, labels))
    assert trusted.sum() == raw.sum() == 41000 * 3
    rows = [(k, words(k)) for k in range(60)] + [(7, words(8)), (None, words(3))]
    marks = [(k, int(k % 3 > 0)) for k in range(50)] + [(4, 0), (None, 1), (9, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(marks, "doc_id long, quality int")
    ratio, threshold = ql.fit(docs, labels)
    of = ql.features()
    score = {quality: sorted(ql._score(t, of, ratio) for d, t in rows if (d, quality) in marks and d is not None) for quality in (0, 1)}
    edges = sorted({*score[0], *score[1]})
    middles = [edges[0] - 1, *((a + b) / 2 for a, b in zip(edges, edges[1:], strict=False))]
    errors = [10 * sum(v < m for v in score[1]) + sum(v >= m for v in score[0]) for m in middles]
    assert abs(threshold - middles[errors.index(min(errors))]) < 1e-12


def test_only_features_of_labelled_documents_meet_the_labels(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs.where("doc_id = 17")).unionByName(spark.createDataFrame([(None, "none"), (-5, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(0, 1200, 3)] + [(17, 1), (-5, 0), (3, 0), (None, 1), (70000, 1), (8, None)], "doc_id long, quality int")
    marks, of = {}, ql.features()
    for r in labels.where("doc_id is not null and quality is not null").collect():
        marks.setdefault(r["doc_id"], set()).add(r["quality"])
    wanted = sorted((sorted(of(r["text"]).tolist()), 1 in marks[r["doc_id"]], 0 in marks[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in marks)
    found = ql._labelled(docs, labels)
    # No text reaches the join; all 20,003 did before.
    assert "text" not in found.columns and sorted((ql._unpacked(r["found"]).tolist(), r["good"], r["poor"]) for r in found.collect()) == wanted
    sent = {r["doc_id"] for r in ql._maybe_labelled(docs, ql._classes(labels)).collect()}
    assert marks.keys() - {70000} <= sent and len(sent) < 2000
    # Ids of another type are joined as Spark compares them.
    assert ql._labelled(docs, labels.select(F.col("doc_id").cast("int").alias("doc_id"), "quality")).count() == len(wanted)


def test_one_python_worker_a_task_reads_labelled_texts(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(0, 900, 3)], "doc_id long, quality int")
    scores, whole = [], ql._threshold

    def seen(rows):
        scores.append(rows)
        return whole(rows)

    monkeypatch.setattr(ql, "_threshold", seen)
    ratio, _ = ql.fit(docs, labels)
    for rows in (ql._labelled(docs, labels), *scores):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        # The bits of the labelled ids were read by a worker of their own before, behind which whole rows waited.
        assert len(re.findall(r"ArrowEvalPython|MapInArrow|MapInPandas|MapInBatch", plan)) == 1
    of = ql.features()
    wanted = {}
    for k in range(0, 900, 3):
        score = ql._score(f"word {k}", of, ratio)
        good, poor = wanted.get(score, (0, 0))
        wanted[score] = (good + k % 2, poor + 1 - k % 2)
    assert {r["score"]: (r["good"], r["poor"]) for r in scores[0].collect()} == wanted


def test_packed_features_come_back():
    of = ql.features()
    for text in (None, "", "a", "a a a b", "é 中文 #* " * 50, "word " * 3000):
        assert ql._unpacked(ql._packed(of(text))).tolist() == sorted(of(text).tolist())
    assert ql._unpacked(ql._packed(np.array([0, 65535, 0, 65535]))).tolist() == [0, 0, 65535, 65535]


def plain_features(text):
    one = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    two = [((a * 0x9E3779B97F4A7C15 + b) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 33 for a, b in zip(one, one[1:], strict=False)]
    return [h % ql.BUCKETS for h in one + two]


def test_texts_are_cut_into_tokens_in_groups(monkeypatch):
    draw, found, groups = random.Random(4), ql._found, []
    texts = [None, "", " \n", "a", "a\x1cb c\x85d\u3000e\xa0f", "__ -- a-b_c !!?", "\ud800 x", "中文，你好 \U0001f600!", "é" * 40, "x" * 24 + " " + "x" * 25 + " " + "y" * 3000]
    texts += ["".join(draw.choice("ab \n\x0b\x1c\x85\xa0é中\u0301,._-$\U0001f600") for _ in range(draw.randrange(120))) for _ in range(400)]

    def seen(group):
        groups.append(len(group))
        return found(group)

    monkeypatch.setattr(ql, "_found", seen)
    for size, calls in ((ql.GROUP, 1), (5000, 10), (1, len(texts))):
        monkeypatch.setattr(ql, "GROUP", size)
        groups.clear()
        assert [f.tolist() for f in ql.found_in(iter(texts))] == [plain_features(t) for t in texts]
        # One text at a time before, and a look-up for each of its tokens.
        assert len(groups) <= calls
    assert list(ql.found_in([])) == []


def test_kinds_of_characters_are_those_of_regular_expressions():
    every = "".join(map(chr, range(0x110000)))
    kinds = np.array([ql._kind(c) for c in every])
    for pattern, kind in ((r"\s", 0), (r"\w", 1)):
        at = np.zeros(len(every), dtype=bool)
        at[[m.start() for m in re.finditer(pattern, every)]] = True
        assert ((kinds == kind) == at).all()


def test_repeated_words_of_any_vocabulary(monkeypatch):
    draw = random.Random(9)
    texts = [" ".join(f"w{draw.randrange(n)}" for _ in range(draw.randrange(60))) for n in (1, 2, 3, 6, 20) for _ in range(20)]
    for widest in (ql.WIDEST, 1):
        monkeypatch.setattr(ql, "WIDEST", widest)
        assert [ql.base_counts(t) for t in texts] == [plain(t) for t in texts]
