from __future__ import annotations

import random
import re
import time

import pytest

from murmur.llm import secrets as sc

PLANTED = re.compile(r"(?i)token = \"([0-9a-f]{40})\"")


@pytest.fixture(scope="module")
def scanner(spark):
    return sc.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_planted_tokens_are_found_and_nothing_else(spark, scanner):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    want = {(d, m.start(1), 40) for d, t in texts.items() for m in PLANTED.finditer(t)}
    found = {(r["doc_id"], r["start"], r["length"]) for r in sc.findings(documents, scanner).collect() if r["is_secret"]}
    assert len(want) > 50 and len(found & want) >= 0.99 * len(want)
    assert len(found - want) <= 0.05 * len(want)


def test_forest_on_unseen_findings(scanner, monkeypatch):
    monkeypatch.setattr(sc.random, "Random", lambda _: random.SystemRandom())
    rows = sc._findings(["alpha", "bravo", "charlie", "deltaic", "echoes"])
    right = sum((scanner.forest.predict(__import__("numpy").array([sc.describe(t, a, b, p, scanner.pieces)]))[0] >= 0.5) == bool(y) for t, a, b, p, y in rows[:600])
    assert right >= 0.93 * 600


def test_masking_keeps_the_rest(spark, odd, nothing):
    rows = sc.redacted_documents(odd)
    assert rows.columns == odd.columns and rows.count() == odd.count()
    before, after = ({r["doc_id"]: r for r in x.where("doc_id is not null").collect()} for x in (odd, rows))
    for key, row in after.items():
        if key == 8:
            assert row["text"].startswith('token = "[SECRET]" alpha') and row["n_chars"] == len(row["text"])
        else:
            assert row == before[key]
    assert sc.redacted_documents(nothing).collect() == []
    found = sc.findings(odd, sc.fit(odd)).where("is_secret").collect()
    assert [(r["doc_id"], r["start"], r["length"]) for r in found] == [(8, 9, 40)]
    assert sc.findings(nothing, sc.fit(nothing)).collect() == []


FORMS = [
    ("DB_PASSWORD=hunter2Xy", "hunter2Xy"), ('{"password": "hunter2Xy"}', "hunter2Xy"), ("auth: hunter2Xy9", "hunter2Xy9"), ('password = "correct horse battery"', "correct horse battery"),
    ("token hunter2Xy9Qz", "hunter2Xy9Qz"), ("MY_LONG_DATABASE_PASSWORD=hunter2Xy", "hunter2Xy"), ("credentials='hunter2Xy!'", "hunter2Xy!"), ("auth: bearer hunter2Xy9Qz", "hunter2Xy9Qz"),
    ("password_2 = hunter2Xy", "hunter2Xy"), ("access_key: hunter2Xy", "hunter2Xy"),
]


@pytest.mark.parametrize("text,value", FORMS)
def test_named_values_are_masked_whole(scanner, text, value):
    whole = f"alpha beta {text} gamma delta"
    spans = scanner.scan([whole], ["src1"])[0]
    start = whole.index(value)
    assert (start, start + len(value)) in [(a, b) for a, b, _ in spans]
    assert sc.masked(whole, spans) == whole.replace(value, sc.MASK)


def test_prose_behind_a_name_stays(scanner):
    text = "the key question is whether author: everyone wants the secret garden, a token gesture of password: nothing"
    assert sc.masked(text, scanner.scan([text], ["src1"])[0]) == text


def test_quoted_values_end_at_their_own_quote():
    for text, value in (('password = "a \\"quoted\\" one" y', 'a \\"quoted\\" one'), ('{\\"token\\": \\"hunter2Xy\\"}', "hunter2Xy"), ("key (ghp_hunter2Xy9QzAbCd)", "ghp_hunter2Xy9QzAbCd")):
        assert value in [text[a:b] for a, b in sc.candidates(text)]


def test_features_come_from_the_whole_candidate(scanner):
    head = "documents/" * 40
    tails = [head + "report-of-the-year/" * 20, head + "".join(random.Random(3).choices("0123456789abcdefABCXYZ+", k=380))]
    rows = [sc.describe(f"see {t} here", 4, 4 + len(t), "src1", scanner.pieces) for t in tails]
    assert len(tails[0]) == len(tails[1]) and all(abs(rows[0][k] - rows[1][k]) > 0.02 for k in (1, 3, 4, 5))


def test_dictionary_counts_all_documents(spark):
    rows = [(i, f"zebra{'x' * (i % 3)} quagga" if i >= 2500 else "plain", "s") for i in range(5000)]
    found = sc.fit(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {"qua", "zeb", "pla"} <= found.pieces


def _plain_named(text):
    """Values behind names, found again from every name on its own."""
    pattern = re.compile(sc.NAMED.pattern.replace("{%d}))" % sc.LEAST, "{%d,}))" % sc.LEAST))
    out = []
    for m in pattern.finditer(text):
        a, b = m.span(m.lastgroup)
        while m.lastgroup == "plain" and b > a and text[b - 1] in sc.TRAILING:
            b -= 1
        if b - a >= sc.LEAST:
            out.append((a, b))
    return out


def test_values_match_a_second_search():
    draw, found = random.Random(5), 0
    bits = ["key", "token", ":", "=", " ", '"', "'", "\\", "\n", "(", ")", ".", "abc", "Xy9z81", "password", "auth: ", "\\\""]
    for _ in range(4000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 40)))
        values = sc._named(text)[0]
        assert values == _plain_named(text), text
        found += len(values)
    assert found > 4000


@pytest.mark.parametrize("text", ["key:" * 250_000, "key:" * 100_000 + ":" * 500_000, 'key:"' * 200_000, "key " * 250_000, "key" + " " * 1_000_000, "a" + "-" * 1_000_000, "-----BEGIN " * 90_000])
def test_a_megabyte_takes_linear_time(scanner, text):
    start = time.monotonic()
    scanner.scan([text], [None])
    assert time.monotonic() - start < 20
