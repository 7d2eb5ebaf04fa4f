"""Operator 6, toxicity: maximum-scoring segments of token log-odds.

Log-odds of toxic against clean documents use informative Dirichlet priors: the
whole corpus gives the prior of every feature. A token's features are the word and
its prefixes, so that inflected forms share evidence. A linear-time scan finds
all maximal-scoring segments of a text; the extreme-value distribution of chance
segments turns their scores into evidence, and a logistic curve into a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import query, table

#: Hash buckets of features, and most labelled documents of each class a fit reads.
BUCKETS, SAMPLE = 1 << 19, 20_000
#: Lengths (UTF-8 bytes) of the prefixes that count besides the word itself, and what tells a prefix from a word.
PREFIXES, PREFIX_MARK = (3, 4, 5, 6, 7, 8), 0x5BD1E995
#: Weight of the prior, standard errors a log-odds must be away from 0, and what each token costs.
PRIOR, SURE, COST = 0.02, 1.5, 0.2
#: Least toxic documents with a feature; words a task remembers.
LEAST, WORDS = 2, 400_000
THRESHOLD = 0.7
WORD = re.compile(r"\w+")


def _buckets(word: str) -> list[int]:
    raw = word.encode("utf-8", "surrogatepass")
    out, crc, at = [zlib.crc32(raw) % BUCKETS], 0, 0
    for n in PREFIXES:
        if len(raw) < n:
            break
        crc, at = zlib.crc32(raw[at:n], crc), n
        out.append((crc ^ PREFIX_MARK) % BUCKETS)
    return out


class _Remembered(dict):
    """Values of words, computed once for the first ``WORDS`` words of a task."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str):
        value = self.compute(word)
        if len(self) < WORDS:
            self[word] = value
        return value


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most ``SAMPLE`` learnable documents of each class, the same on every run."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE) for v in (0, 1)]
    # At most 2 * SAMPLE short rows, so sending them to every task is safe at any size.
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def _document_counts(texts: DataFrame, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets with their toxic and clean documents; the entry behind the last bucket holds the sums over distinct words.

    ``texts`` holds text and toxic. Without ``wanted`` only buckets of at least
    ``LEAST`` toxic documents come back, with it only the buckets it marks.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Words without a wanted bucket share one value, which keeps the memory small.
        nothing = [(n, ()) for n in range(len(PREFIXES) + 2)]

        def forms(word: str) -> tuple[int, tuple[int, ...]]:
            found = _buckets(word)
            kept = tuple(found) if wanted is None else tuple(b for b in found if wanted[b])
            return (len(found), kept) if kept else nothing[len(found)]

        of, sums = _Remembered(forms), np.zeros((2, BUCKETS + 1), dtype="i8")
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                known = [of[word] for word in set(WORD.findall(text.lower()))] if text else []
                found = set().union(*(b for _, b in known if b))
                sums[int(toxic)][np.fromiter(found, dtype="i8", count=len(found))] += 1
                sums[int(toxic)][BUCKETS] += sum(n for n, _ in known)
        seen = np.flatnonzero(sums.any(axis=0) & (True if wanted is None else np.append(wanted, True)))
        yield pd.DataFrame({"bucket": seen, "toxic": sums[1][seen], "clean": sums[0][seen]})

    rows = texts.mapInPandas(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    if wanted is None:
        rows = rows.where((F.col("toxic") >= LEAST) | (F.col("bucket") == BUCKETS))
    # Bounded by the number of buckets, not by the corpus.
    found = rows.orderBy("bucket").toPandas()
    return tuple(found[c].to_numpy(dtype="i8") for c in ("bucket", "toxic", "clean"))


def segments(scores: np.ndarray) -> list[float]:
    """Scores of all maximal-scoring segments, in linear time.

    Neighbouring positive tokens are one step of the scan. The stack holds
    candidate segments with the running sum before and at the end of each; a new
    one swallows those that it extends.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    breaks = np.flatnonzero(np.diff(positive) > 1) + 1
    left = total[positive[np.concatenate([[0], breaks])]]
    right = total[positive[np.concatenate([breaks - 1, [len(positive) - 1]])] + 1]
    stack: list[tuple[float, float, int]] = []  # sum before, sum at the end, nearest earlier one with a smaller sum before
    for low, high in zip(left.tolist(), right.tolist(), strict=True):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][2]
            if j < 0 or stack[j][1] >= high:
                stack.append((low, high, j))
                break
            low = stack[j][0]
            del stack[j:]
    return [high - low for low, high, _ in stack]


def _scan(text: str | None, value: _Remembered) -> tuple[int, list[float], list[float]]:
    """Number of tokens, positive token scores and segment scores of a text."""
    words = WORD.findall(text.lower()) if text else []
    scores = np.fromiter(map(value.__getitem__, words), dtype="f8", count=len(words))
    return len(words), scores[scores > 0].tolist(), segments(scores)


class Model:
    """Bucket scores, decay and rate of chance segments, and the logistic curve."""

    def __init__(self, odds: dict[int, float], decay: float = 1.0, rate: float = 1.0, curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.odds, self.decay, self.rate, self.curve = odds, decay, rate, curve

    def token(self, word: str) -> float:
        found = [self.odds.get(b, 0.0) for b in _buckets(word)]
        best = max(found)
        return (best if best > 0 else min(found)) - COST

    def evidence(self, n: int, scores: list[float]) -> tuple[float, float]:
        """Of the best segment, and of the best number r of segments: -log p of as many as good by chance.

        In clean text the number of segments of score s or more is Poisson with
        mean rate * n * exp(-decay * s); the tail is taken by its Chernoff bound.
        """
        if not len(scores) or not n:
            return 0.0, 0.0
        ranked = -np.sort(-np.array(scores))
        r = np.arange(1, len(ranked) + 1)
        mean = np.maximum(self.rate * n * np.exp(-self.decay * ranked), 1e-300)
        each = np.where(r > mean, mean - r + r * np.log(r / mean), 0.0)
        return float(each[0]), float(each.max())

    def passages(self, n: int, scores: list[float]) -> int:
        """Segments that chance gives a text of this length in one of three cases at most."""
        mean = np.maximum(self.rate * n * np.exp(-self.decay * np.array(scores, dtype="f8")), 1e-300)
        return int(((mean < 1) & (mean - 1 - np.log(mean) > 1)).sum())

    def score(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(best) + c * np.log1p(total), -35, 35))))


def _decay(tokens: int, positive: np.ndarray) -> float:
    """The rate at which E[exp(rate * score)] of clean tokens is 1."""
    if not len(positive) or not tokens:
        return 1.0
    low, high = 1e-3, 20.0
    for _ in range(60):
        rate = (low + high) / 2
        mean = ((tokens - len(positive)) * np.exp(-rate * COST) + np.exp(np.minimum(rate * positive, 700)).sum()) / tokens
        low, high = (rate, high) if mean < 1 else (low, rate)
    return low


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small penalty."""
    a = np.column_stack([np.ones(len(x)), np.log1p(x)])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(3)
        w += np.linalg.solve(hessian, a.T @ (y - p) - 1e-3 * w)
    return tuple(float(v) for v in w)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Log-odds, decay and curve; labels of held-out rows and other columns are never read.

    Priors count all documents; classes are counted over at most ``SAMPLE``
    labelled documents each. Without documents of both classes every score is 0.5.
    """
    sample = _sample(documents, labels)
    at, toxic, clean = _document_counts(sample)
    if not len(at) or at[-1] != BUCKETS or not toxic[-1] or not clean[-1]:
        return Model({})
    n_toxic, n_clean, at, toxic, clean = toxic[-1], clean[-1], at[:-1], toxic[:-1], clean[:-1]
    wanted = np.zeros(BUCKETS, dtype=bool)
    wanted[at] = True
    corpus_at, _, corpus = _document_counts(documents.select(F.col("text").cast("string").alias("text"), F.lit(0).alias("toxic")), wanted)
    share = np.zeros(BUCKETS)
    share[corpus_at[:-1]] = corpus[:-1] / corpus[-1]
    a, b = toxic + PRIOR * n_toxic * share[at], clean + PRIOR * n_clean * share[at]
    odds = np.log(a / np.maximum(n_toxic * (1 + PRIOR) - a, 1)) - np.log(b / np.maximum(n_clean * (1 + PRIOR) - b, 1))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - SURE * np.sqrt(1 / a + 1 / b), 0)
    model = Model({int(k): float(v) for k, v in zip(at, sure, strict=True) if v})

    @F.pandas_udf("n long, positive array<double>, segments array<double>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        value = _Remembered(model.token)
        for texts in batches:
            yield pd.DataFrame([_scan(t, value) for t in texts], columns=["n", "positive", "segments"])

    # At most 2 * SAMPLE rows with the few positive tokens of each.
    rows = sample.select("toxic", scan("text").alias("s")).select("toxic", "s.*").toPandas()
    negative = rows[rows["toxic"] == 0]
    tokens, empty = int(negative["n"].sum()), [np.zeros(0)]
    model.decay = _decay(tokens, np.concatenate([*negative["positive"], *empty]))
    chance = np.concatenate([*negative["segments"], *empty])
    if len(chance):
        middle = np.median(chance)
        model.rate = float((chance >= middle).sum() / tokens * np.exp(model.decay * middle))
    x = np.array([model.evidence(n, s) for n, s in zip(rows["n"], rows["segments"], strict=True)])
    model.curve = _curve(x, rows["toxic"].to_numpy(dtype="f8"))
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Score of every row from its whole text alone.

    Null and empty texts have no evidence and get the score of such texts.
    Repeated rows are scored each for itself; an empty table gives no rows; extra
    columns are not read. Returns doc_id, held_out, score, predicted, n_passages
    (significant segments).
    """

    @F.pandas_udf("score double, n_passages long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        value = _Remembered(model.token)
        for texts in batches:
            out = []
            for text in texts:
                n, _, found = _scan(text, value)
                out.append((model.score(*model.evidence(n, found)), model.passages(n, found)))
            yield pd.DataFrame(out, columns=["score", "n_passages"])

    rows = documents.select("doc_id", score(F.col("text").cast("string")).alias("_s"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_s.score", (F.col("_s.score") >= THRESHOLD).cast("int").alias("predicted"), "_s.n_passages")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    documents = table(spark, sf_dir, "documents")
    return scored(documents, fit(documents, table(spark, sf_dir, "labels")))
