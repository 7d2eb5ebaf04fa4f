from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from murmur.llm import alignment as al
from murmur.llm.bytebpe import byte_characters


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, A token bytes, B ids, B token bytes) of whole texts, or None."""
    a = Tokenizer.from_file(al.byte_bpe_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=al.piece_bpe_path())
    byte = byte_characters()

    def tokens(text):
        if not text:
            return None
        found = a.encode(" " + text, add_special_tokens=False)
        of_a = [bytes(byte[c] for c in t) for t in found.tokens]
        ids = b.encode(text)
        of_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids)]
        raw = (" " + text).encode()
        return (found.ids, of_a, ids, of_b) if b"".join(of_a) == raw == b"".join(of_b) else None

    return tokens


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def brute(plain, texts):
    """(doc_id, text) rows -> rows of the query, from whole texts and sets of ends."""
    linked, groups = {}, {}
    for k, (_, text) in enumerate(texts):
        found = plain(text)
        if found is None:
            continue
        ids_a, of_a, ids_b, of_b = found
        a, b = dict(zip(ends(of_a), ids_a, strict=True)), dict(zip(ends(of_b), ids_b, strict=True))
        common = sorted(set(a) & set(b))
        linked[k] = [(a[e], b[e]) for e in common]
        part = lambda of, lo, hi: ",".join(str(i) for e, i in of.items() if lo < e <= hi)
        groups[k] = ";".join(f"{part(a, lo, hi)}|{part(b, lo, hi)}" for lo, hi in zip([0, *common], common, strict=False)) if len(a) < 3000 else None
        groups[k] = (len(a), len(b), len(common), groups[k])
    counts = Counter(p for of in linked.values() for p in of)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for k, (d, _) in enumerate(texts):
        if k not in linked:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n, text = groups[k]
        digest = hashlib.sha256(text.encode()).hexdigest() if text is not None else None
        out.append((d, n_a, n_b, n, n, sum(counts[p] == top[p[1]] for p in linked[k]), sum(counts[p] for p in linked[k]), digest))
    return sorted(out, key=repr)


def found(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, al.op11_alignment(spark, str(tmp_path)).collect()), key=repr)


def same(got, expected):
    """Equal but for digests that the brute force left out."""
    return len(got) == len(expected) and all(g[:7] == e[:7] and e[7] in (None, g[7]) for g, e in zip(got, expected, strict=True))


def test_a_table_matches_whole_texts(spark, documents, plain):
    got = sorted(map(tuple, al.op11_alignment(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert same(got, brute(plain, [(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_odd_rows(spark, odd, nothing, plain, tmp_path):
    assert same(found(spark, odd, tmp_path / "odd"), brute(plain, [(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert found(spark, nothing, tmp_path / "nothing") == []


def test_odd_characters_and_special_tokens(spark, plain, tmp_path):
    draw = random.Random(2)
    parts = [" ", " ", "a", "Bc", "é", "é", "\n", "\n", "\t", "1", "!", "'s", "  ", ".", ", ", "\x1c", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "中", "\r", "\r\n", "}\r", "▁", "​", "　", "\x85", "ﬁ", "\x00", "😀", "word", " the"]
    rows = [(k, "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for k in range(1500)]
    rows += [(9000, "▁a"), (9001, " lead"), (9002, "trail "), (9003, "\nlead"), (9004, "x" * 5000), (9005, None), (9006, "")]
    got = found(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    assert same(got, brute(plain, rows))
    assert sum(r[1] == 0 for r in got) > 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=60))
def test_run_skipping_finds_all_common_ends(cuts):
    a = [k for k, (x, _) in enumerate(cuts) if x] + [len(cuts)]
    b = [k for k, (_, y) in enumerate(cuts) if y] + [len(cuts)]
    i, j = al.group_ends(a, b)
    assert [a[x - 1] for x in i] == sorted(set(a) & set(b)) == [b[y - 1] for y in j]


def test_long_stretches_are_jumped():
    class Counting(list):
        reads = 0

        def __getitem__(self, at):
            Counting.reads += 1
            return super().__getitem__(at)

    a = Counting([*range(1, 100_001), 100_003, *range(100_004, 200_000)])
    b = [*range(1, 100_001), 100_002, 100_003, *range(100_004, 200_000)]
    i, _ = al.group_ends(a, b)
    assert len(i) == len(a) and Counting.reads < 200


def test_pairs_are_bounded_by_the_vocabularies():
    assert al.most_pairs([b"ab", b"b"], [b"b", b"cab", b"x"]) == 4
    both = al.Tokenizers(al.byte_bpe_path(), al.piece_bpe_path())
    assert both.cuts and al.most_pairs(both.bytes_a, both.bytes_b) < 1_000_000
    assert sorted(set(byte_characters().values())) == list(range(256)) and ByteLevel().decode([c for c, b in sorted(byte_characters().items(), key=lambda x: x[1]) if 32 <= b < 127]) == bytes(range(32, 127)).decode()
