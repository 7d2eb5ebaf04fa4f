from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from murmur.llm import simhash as sm


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    values = list(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def expected(rows):
    prints = [(d, plain(t)) for d, t in rows]
    root = groups({p for _, p in prints}, 2)
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    return sorted(((d, f"{p:016x}", least.get(root[p])) for d, p in prints), key=str)


def test_documents_match_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted((tuple(r) for r in sm.near_duplicates(documents).collect()), key=str) == expected(rows)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in sm.near_duplicates(odd).collect()), key=str) == expected(rows)
    assert sm.near_duplicates(nothing).collect() == []
    kept = sm.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 7, 8] or kept.count() <= 6
    assert sm.deduplicated(nothing).collect() == []


@pytest.mark.parametrize("bits,radius", [(64, 2), (128, 20)])
def test_bit_planes_find_the_links_of_every_run(bits, radius):
    draw = random.Random(bits)
    for _ in range(8):
        values, ends = [], []
        while len(values) < 700:
            n = draw.choice([1, 2, 3, 40, 150])
            base = [draw.getrandbits(bits) for _ in range(max(1, n // 5))]
            run = sorted({draw.choice(base) ^ sum(1 << draw.randrange(bits) for _ in range(draw.randint(0, radius))) & (1 << bits) - 1 for _ in range(n)})
            ends += [len(values) + len(run)] * len(run)
            values += run
        rows = np.array([[v >> b & 1 for b in range(bits)] for v in values], dtype="u1")
        label = sm.linked_leaders(rows, np.array(ends), radius)
        start = 0
        while start < len(values):
            end = ends[start]
            root = groups(values[start:end], radius)
            want = {v: min(i for i in range(start, end) if root[values[i]] == root[v]) for v in values[start:end]}
            assert [want[v] for v in values[start:end]] == label[start:end].tolist()
            start = end


def test_exact_keys_miss_no_pair_and_large_keys_are_split(spark):
    draw = random.Random(3)
    values = {draw.getrandbits(20) for _ in range(300)}
    values |= {v ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64) for v in list(values)}
    rows = [(bytes(sm.RANK) + v.to_bytes(8, "big"),) for v in values]
    frame = spark.createDataFrame(rows, "node binary")
    root = groups(values, 2)
    for block in (2048, 16):
        edges = sm.links(frame, sm.exact_keys(64, 2), bits=64, radius=2, block=block)
        found = {int.from_bytes(r["node"][sm.RANK :], "big"): int.from_bytes(r["root"][sm.RANK :], "big") for r in sm.components(edges).collect()}
        for v in values:
            assert found.get(v, v) == min(w for w in values if root[w] == root[v])


def test_long_chains_become_one_component(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    name = lambda i: i.to_bytes(4, "big")
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in zip(order[:-1], order[1:], strict=True)], "u binary, v binary")
    found = sm.components(edges).collect()
    assert len(found) == 399 and {r["root"] for r in found} == {name(0)}


def test_estimated_sizes_do_not_grow_with_the_rounds(spark):
    name = lambda i: i.to_bytes(4, "big")
    edges = spark.createDataFrame([(name(k * 37 % 101), name((k + 1) * 37 % 101)) for k in range(100)], "u binary, v binary")
    found = sm.components(edges)
    # Hundreds of thousands of bits before, in the driver's heap.
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64 and found.count() == 100


def test_near_copies_leave_one_document(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows, families = [], 12
    for f in range(families):
        words = [word() for _ in range(300)]
        for copy in range(5):
            changed = list(words)
            if copy:
                changed[draw.randrange(300)] = word()
            rows.append((f * 100 + copy, " ".join(changed), "en", "s", 0))
    rows += [(9000 + i, " ".join(word() for _ in range(120)), "en", "s", 0) for i in range(40)]
    kept = sm.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [f * 100 for f in range(families)] + [9000 + i for i in range(40)]


def similarity(a, b):
    a, b = (t.split() for t in (a, b))
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_every_pair_of_similarity_four_fifths_is_joined_and_no_other(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    rows, lost = [], []
    for pair in range(150):
        words = [word() for _ in range(220)]
        changed = list(words)
        # Changes stand apart, so that each takes five shingles: similarities from 0.64 to 0.9.
        for at in draw.sample(range(5, 215, 10), draw.randint(2, 10)):
            changed[at] = word()
        a, b = " ".join(words), " ".join(changed)
        rows += [(2 * pair, a, "en", "s", 0), (2 * pair + 1, b, "en", "s", 0)]
        if similarity(a, b) >= 0.8:
            lost.append(2 * pair + 1)
    kept = sm.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    assert 20 < len(lost) < 130
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r[0] for r in rows} - set(lost))


def test_documents_of_the_table_match_brute_force_similarity(documents):
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in documents.collect()]
    sets = {d: {tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} if t else set() for d, t in rows}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert sorted(r["doc_id"] for r in sm.deduplicated(documents).collect()) == sorted(set(root.values()))
