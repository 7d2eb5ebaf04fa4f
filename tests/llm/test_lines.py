from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmur.llm import lines as ln

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, length=20, documents=3):
    """(doc_id, text) rows -> sorted (doc_id, kept, lines, dropped); None is the smallest id."""
    order = lambda d: (d is not None, d or 0)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(lower(line.strip(BLANKS)), set()).add(d)
    keeper = {k: max(v, key=order) for k, v in held.items() if len(k) >= length and len(v) >= documents}
    out = []
    for d, t in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if (k := lower(x.strip(BLANKS))) not in keeper or keeper[k] == d]
        out.append((d, "\n".join(kept), len(whole), len(whole) - len(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in ln.deduplicated(df, **options).collect()), key=repr)


def test_whole_tables_match_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    expected = brute(rows)
    assert found(documents) == expected and sum(r[3] for r in expected) > 20
    digests = {r["doc_id"]: r["kept_sha256"] for r in ln.op13_lines(spark, "/root/testdata/sf0.001").collect()}
    assert digests == {d: hashlib.sha256(t.encode()).hexdigest() for d, t, _, _ in expected}


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd) == brute(rows)
    out = ln.deduplicated(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert ln.deduplicated(nothing).collect() == []
    clash = ln.deduplicated(odd.withColumn("n_lines", F.lit("mine")).withColumn("_lines", F.lit(1)))
    assert clash.columns[-2:] == ["n_lines_", "n_dropped"] and {r["n_lines"] for r in clash.collect()} == {"mine"}


def test_keys_positions_and_the_last_holder(spark):
    long = "A line that many documents HOLD"
    rows = [
        (1, f"one\n \t{long}\r\ntwo\n"), (2, long.lower()), (9, f"{long}\nmiddle\n  {long.upper()} "), (3, "É" + long), (4, "é" + long), (5, "É" + long),
        (6, "nineteen characters"), (7, "nineteen characters"), (8, "nineteen characters"), (None, long), (None, long), (10, "twenty characters 中中"), (11, "twenty characters 中中"), (12, "Twenty characters 中中"),
    ]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == brute(rows)
    assert (9, f"{long}\nmiddle\n  {long.upper()} ", 3, 0) in got and (1, "one\ntwo\n", 4, 1) in got
    assert sum(r[0] in (3, 4, 5) and r[3] for r in got) == 0


def test_one_line_in_most_documents_and_a_very_long_text(spark):
    rows = [(i, f"only in {i}\nthis line is in every document\n") for i in range(3000)]
    rows.append((5000, "\n".join(["this line is in every document", "x"] * 50_000)))
    rows.append((4000, "\n".join(["this line is in every document", "y"] * 50_000)))
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))}
    assert got[5000][3] == 0 and got[4000] == (4000, "\n".join(["y"] * 50_000), 100_000, 50_000)
    assert all(got[i] == (i, f"only in {i}\n", 3, 1) for i in range(3000))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.text("aA \n\t\r\x1fé", max_size=12))), max_size=14))
def test_any_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, least_length=2, least_documents=2) == brute(rows, 2, 2)
