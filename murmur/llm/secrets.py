"""Operator 10, secret scans: candidates by pattern, a random forest against false positives.

Candidates are long runs of key characters, values behind a secret's name (or a
longer name with it inside), and blocks of private keys. Each is described by its length, character classes and
transitions, how much of it dictionary pieces cover, the document's path (source)
and its neighbouring words. The forest learns from labelled findings: a fixed set
of keys and look-alikes drawn from the public formats below, set into common words of
the corpus. Its verdict removes false positives.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import fresh, query, released, table
from murmur.llm.forest import Forest

#: Public prefixes of access keys and tokens.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "SG.", "hf_")
#: Words that name a secret, and words that name harmless look-alikes.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "credentials", "key")
HARMLESS_WORDS = ("sha", "sha1", "sha256", "md5", "checksum", "commit", "digest", "hash", "revision", "uuid", "guid", "etag", "id", "isbn", "order", "integrity")
#: Parts of paths that hold examples.
EXAMPLE_PATHS = ("test", "example", "sample", "fixture", "mock", "doc")
#: Commonest words of all documents, which give dictionary pieces and backgrounds; findings drawn; the verdict's threshold.
WORDS, FINDINGS, THRESHOLD = 20_000, 3000, 0.5
PLAIN = ("this", "that", "with", "from", "have", "they", "which", "their")
MASK = "[SECRET]"

#: Code points of the shortest value behind a name; a run without a name has at least 16.
LEAST = 6

RUN = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
    r"|[A-Za-z0-9][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9=]={0,2}"
)
#: A secret's name, also as a part of a longer one, and what stands behind it. The value is
#: looked at and not consumed, since it may be the name of a next one ("auth: bearer ...").
#: Of a plain value only the least length is looked at; ``_named`` finds its end.
NAMED = re.compile(
    "(?i:" + "|".join(re.escape(w) for w in sorted(SECRET_WORDS, key=len, reverse=True)) + r")\w{0,64}+"
    r"(?:\\?[\"'])?(?:\s*(?::=|=>|[:=])\s*|[ \t]+|(?<=[\"'])[ \t]*)"
    r"(?=\\\"(?P<escaped>(?:[^\"\\\n]|\\[^\"\n])+)\\\"|\"(?P<double>(?:[^\"\\\n]|\\.)+)\"|'(?P<single>(?:[^'\\\n]|\\.)+)'|[(\[{<]*[\"']?(?P<plain>[^\s\"']{%d}))" % LEAST
)
PLAIN_END, TRAILING = re.compile(r"[\s\"']"), ",.;:!?)]}'\""
PIECE, WORD = 3, re.compile(r"\w+")
FEATURES = 21


def _named(text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """(start, end) of the values behind names, a quoted one to its closing quote on the line; places of the names."""
    out, names = [], set()
    stop = last = -1
    for m in NAMED.finditer(text):
        a, b = m.span(m.lastgroup)
        names.add(m.start())
        if m.lastgroup == "plain":
            # The names of one run share its end, which is looked for once.
            if a >= stop:
                end = PLAIN_END.search(text, a)
                stop = last = end.start() if end else len(text)
                while last > a and text[last - 1] in TRAILING:
                    last -= 1
            b = max(a, last)
        if b - a >= LEAST:
            out.append((a, b))
    return out, names


def _is_name(value: str) -> bool:
    """Whether a run is made of words, as MY_DATABASE_PASSWORD or databasePassword are, and not of drawn characters."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", value)
    return sum(map(len, parts)) >= 3.5 * len(parts)


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every candidate of the whole text, in order, not overlapping."""
    text = text or ""
    values, names = _named(text)
    found = [(a, -b, True) for a, b in values]
    starts = sorted(names)
    for m in RUN.finditer(text):
        a, b = m.span()
        i = bisect_left(starts, a)
        if i < len(starts) and starts[i] < b and text[a : a + 5] != "-----" and _is_name(text[a:b]):
            continue  # the name of a value
        while b > a and text[b - 1] in TRAILING:
            b -= 1
        # A long run without digit, inner capital or key sign is a word.
        if b - a >= LEAST and (text[a : a + 5] == "-----" or not text[a:b].replace("-", "").replace(".", "").isalpha() or _mixed(text[a:b])):
            found.append((a, -b, False))
    # A block of a private key holds what is in it; else a value behind a name goes before a run that reaches into it.
    found.sort(key=lambda s: (s[0], s[1]))
    out: list[tuple[int, int, bool]] = []
    for a, b, named in ((a, -b, named) for a, b, named in found):
        while named and out and out[-1][1] > a and not out[-1][2] and text[out[-1][0] : out[-1][0] + 5] != "-----" and out[-1][1] <= b:
            out.pop()
        if not out or out[-1][1] <= a:
            out.append((a, b, named))
        elif text[a : a + 5] == "-----":
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2])
    return [(a, b) for a, b, _ in out]


def _mixed(value: str) -> bool:
    return any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)


def _names(word: str) -> bool:
    """Whether a word, or a part of it, names a secret."""
    return any(p in SECRET_WORDS for p in (word, *word.split("_"))) or any(w in word for w in SECRET_WORDS if len(w) > 4)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(text: str, start: int, end: int, path: str | None, pieces: frozenset[str]) -> list[float]:
    """The features of one candidate, from all its characters."""
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = [_kind(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(len(kinds) - 1, 1)
    low = value.lower()
    grams = [low[i : i + PIECE] for i in range(len(low) - PIECE + 1)]
    covered = sum(g in pieces for g in grams) / max(len(grams), 1)
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])][-3:]
    after = [w.lower() for w in WORD.findall(text[end : end + 30])][:2]
    near = text[max(0, start - 3) : start]
    where = (path or "").lower()
    share = [kinds.count(k) / len(kinds) for k in range(4)]
    return [
        n, entropy, entropy / math.log2(max(n, 2)), changes, covered, *share,
        float(all(c in string.hexdigits for c in value)), float(value.startswith(KEY_PREFIXES)), float(value.startswith("-----BEGIN")),
        float(any(_names(w) for w in before)), float(any(w in HARMLESS_WORDS for w in before + after)),
        float("=" in near or ":" in near), float('"' in near or "'" in near), float(any(p in where for p in EXAMPLE_PATHS)),
        float("." in value) + value.count("/"), float(value.count("-") == 4 and n == 36), len(counts) / n, value.count(" ") / n,
    ]


def _findings(words: list[str]) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, path, label): the labelled findings, the same on every run."""
    draw = random.Random(42)
    word = lambda: draw.choice(words)
    chars = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    out = []
    for _ in range(FINDINGS):
        before, after = [word() for _ in range(6)], [word() for _ in range(6)]
        secret = draw.random() < 0.5
        path = f"src{draw.randint(0, 30)}"
        if secret:
            value = draw.choice((
                lambda: chars(hexes, draw.choice((32, 40, 40, 48, 64))), lambda: chars(mixed, draw.randint(20, 64)), lambda: chars(mixed + "+/", draw.randint(24, 60)) + "==",
                lambda: draw.choice(KEY_PREFIXES) + chars(mixed, draw.randint(16, 40)), lambda: chars(mixed + "!$%^*", draw.randint(10, 20)),
                lambda: word()[:8] + chars("0123456789", draw.randint(1, 4)) + chars(mixed, draw.randint(1, 4)), lambda: " ".join(word() for _ in range(draw.randint(3, 5))),
                lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16),
                lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + chars(mixed + "+/", draw.randint(64, 600)) + "\n-----END RSA PRIVATE KEY-----",
            ))()
            named = draw.random() < 0.8 or not value.startswith((*KEY_PREFIXES, "-----"))
            name = draw.choice(("", "", "db_", "my_", "app_")) + draw.choice(SECRET_WORDS) + draw.choice(("", "", "", "_2")) + draw.choice((" = ", "=", ": ", " ", '": ')) if named else ""
            name = name.upper() if draw.random() < 0.2 else name
        else:
            value, name = draw.choice((
                lambda: (chars(hexes, draw.choice((32, 40, 64))), draw.choice(HARMLESS_WORDS) + draw.choice((" ", ": ", "="))),
                lambda: ("-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), draw.choice(("uuid ", "id: ", "", "request "))),
                lambda: (chars("0123456789", draw.randint(16, 20)), draw.choice(("", "", "order ", "id "))),
                lambda: ("-".join(word() for _ in range(3)) + str(draw.randint(1, 99)), ""), lambda: ("/".join(word() for _ in range(4)) + ".html", ""),
                lambda: (".".join(word() for _ in range(3)) + str(draw.randint(0, 99)), ""), lambda: (word() + str(draw.randint(1900, 2030)), draw.choice(("token = ", "password: "))),
                lambda: (word().capitalize() + word().capitalize() + word().capitalize(), ""), lambda: (word() + "." + str(draw.randint(0, 99)) + "example.com", ""),
                lambda: (word(), draw.choice(("token: ", "secret = ", "password: "))), lambda: (word() + draw.choice(("", ",", ".")), draw.choice(SECRET_WORDS) + draw.choice((" ", " ", ": "))), lambda: ("(".join(word() for _ in range(2)) + ")", "token = "),
                lambda: ("2024-01-" + chars("0123456789", 2) + "T" + chars("012345", 2) + ":00:00", ""), lambda: (chars(draw.choice("xX0aA*"), draw.randint(8, 40)), draw.choice(("token = ", "password = ", ""))),
            ))()
        if draw.random() < 0.1:
            before, after = [w.upper() for w in before], [w.upper() for w in after]
            value = value.upper() if secret and set(value) <= set(hexes) else value
            name = name.upper()
        quote = draw.choice(('"', "'")) if secret and " " in value and value[:5] != "-----" else draw.choice(('"', "'", "", ""))
        head = " ".join(before) + " " + name + quote
        out.append((head + value + quote + " " + " ".join(after), len(head), len(head) + len(value), path, int(secret)))
    return out


class Scanner:
    """A fitted forest with its dictionary pieces; a few hundred kilobytes."""

    def __init__(self, forest: Forest, pieces: frozenset[str]):
        self.forest, self.pieces = forest, pieces

    def scan(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """(start, end, score) of the candidates of each text."""
        found = [candidates(t) for t in texts]
        rows = [describe(t, a, b, p, self.pieces) for t, p, spans in zip(texts, paths, found, strict=True) for a, b in spans]
        scores = iter(self.forest.predict(np.array(rows, dtype="f8").reshape(-1, FEATURES)).tolist())
        return [[(a, b, next(scores)) for a, b in spans] for spans in found]


def fit(documents: DataFrame) -> Scanner:
    """Dictionary pieces from the ``WORDS`` commonest words of all documents, forest from the labelled findings.

    Words are counted over every whole text and combined before the shuffle; only the
    commonest reach the driver. Without documents a few plain words serve as background.
    """
    found = documents.select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 2)
    found = found.groupBy("word").agg(F.count("*").alias("n"))
    words = [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(WORDS).collect()] or list(PLAIN)
    grams: Counter[str] = Counter()
    for w in words:
        grams.update({w[i : i + PIECE] for i in range(len(w) - PIECE + 1)})
    pieces = frozenset(g for g, _ in sorted(grams.items(), key=lambda p: (-p[1], p[0]))[:4000])
    findings = _findings(words[:5000])
    x = np.array([describe(t, a, b, p, pieces) for t, a, b, p, _ in findings])
    return Scanner(Forest().fit(x, np.array([f[-1] for f in findings], dtype="f8")), pieces)


def findings(documents: DataFrame, scanner: Scanner) -> DataFrame:
    """One row per candidate of every whole text with the forest's verdict.

    Null and empty texts have no candidates and give no rows; repeated rows give
    theirs each; a null doc_id or source stays null. Extra columns are not read.
    Returns doc_id, start, length (code points), score, is_secret.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            paths = [p if isinstance(p, str) else None for p in batch["source"]]
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for doc_id, spans in zip(batch["doc_id"], scanner.scan(texts, paths), strict=True):
                key = None if pd.isna(doc_id) else int(doc_id)
                out += [(key, a, b - a, s, s >= THRESHOLD) for a, b, s in spans]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "score", "is_secret"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInPandas(lambda b: released(scan(b)), "doc_id long, start long, length long, score double, is_secret boolean")


def masked(text: str, spans: list[tuple[int, int, float]]) -> str:
    out, at = [], 0
    for a, b, score in spans:
        if score >= THRESHOLD:
            out += [text[at:a], MASK]
            at = b
    return "".join([*out, text[at:]])


def redacted_documents(documents: DataFrame) -> DataFrame:
    """All rows with every secret replaced by ``[SECRET]`` and n_chars set anew; other texts stay as they are."""
    scanner, clean = fit(documents), fresh(documents, "_clean")

    @F.pandas_udf("string")
    def redact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from released(cleaned(batches))

    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, paths in batches:
            values = [t if isinstance(t, str) else None for t in texts]
            spans = scanner.scan(values, [p if isinstance(p, str) else None for p in paths])
            yield pd.Series([masked(t, s) if s else t for t, s in zip(values, spans, strict=True)], dtype="object")

    rows = documents.withColumn(clean, redact(F.col("text").cast("string"), F.col("source").cast("string")))
    changed = ~F.col(clean).eqNullSafe(F.col("text"))
    columns = []
    for c in documents.columns:
        column = F.col(f"`{c}`")
        if c == "text":
            column = F.col(clean)
        elif c == "n_chars":
            column = F.when(changed, F.length(clean).cast(documents.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return rows.select(*columns)


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all documents with the forest's verdict."""
    documents = table(spark, sf_dir, "documents")
    return findings(documents, fit(documents))
