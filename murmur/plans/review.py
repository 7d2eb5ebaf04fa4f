"""Evidence review from open posts to stored analyses and reviews.

A model answers outside Spark. The first half writes what it is to read, the second
takes in the answers that have landed; both end in one commit, so either can be run
again at any time. A post counts as reviewed once an analysis of its present
text is stored, so changed posts come up again and nothing is reviewed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.hashing import analysis_input_hash
from murmur.functions.text import trimmed_evidence
from murmur.operators import worklists as wl
from murmur.session import written
from murmur.sources import tables
from murmur.sources.store import Run, Store

#: Stored tables: what a model is to read, what it said, what was accepted, what was not.
REQUESTS, ANSWERS, REVIEWS, REJECTED = "review_request", "review_answer", "content_analysis_review", "review_rejected"
SCHEMA_VERSION = "content-analysis-v1"


def review_requests(
    content: DataFrame, analysis: DataFrame, requests: DataFrame | None = None, answers: DataFrame | None = None, *,
    prompt_prefix: str = "codex-content-review-v4", batch_size: int = 20, max_chars: int = 6000, again: bool = False, **selection,
) -> DataFrame:
    """Open posts as a model is to read them, in batches of ``batch_size`` in order of their ids.

    ``selection`` goes to ``review_candidates``. A request of the same text whose
    batch has no answer yet is waited for, unless ``again``; a rejected answer
    leaves its post open. Batches are numbered after the largest stored one.
    """
    rows = wl.review_candidates(content, analysis, prompt_prefix=prompt_prefix, **selection).withColumn(
        "prompt_version", F.concat(F.lit(prompt_prefix + ":"), F.substring("content_hash", 1, 12))
    )
    last = F.lit(0).cast("long")
    if requests is not None:
        last = requests.select(F.coalesce(F.max("batch"), F.lit(0)).cast("long")).scalar()
        if not again:
            waiting = requests if answers is None else requests.join(answers.select("batch").distinct(), "batch", "left_anti")
            rows = rows.join(waiting.select("content_id", "prompt_version").distinct(), ["content_id", "prompt_version"], "left_anti")
    title, body = F.coalesce("title", F.lit("")), trimmed_evidence(F.col("body"), max_chars)
    shown = rows.select(
        "content_id", "source", "published_at", title.alias("title"), body.alias("body"), "prompt_version",
        analysis_input_hash(F.col("content_hash"), F.col("title"), F.col("body"), F.lit(None).cast("long"), F.lit(None).cast("string")).alias("target_hash"),
    )
    seen = F.struct("body", F.col("content_id").alias("id"), "published_at", "source", "title")
    hashed = shown.withColumn("input_hash", F.sha2(F.to_json(seen, {"ignoreNullFields": "false"}), 256))
    numbered = tables.numbered(hashed, None, [], "_n", ["content_id"])
    return numbered.withColumn("batch", last + 1 + F.floor((F.col("_n") - 1) / batch_size)).drop("_n")


def judge_answers(answers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted items, rejected ones with a reason) of answers (answer_id, batch, model, answer).

    An item counts if it keeps the contract and answers a post of its batch, once.
    Evidence that is not in the text the model read costs an item its intent and
    nothing else. Of several answers of a model for a text the first one stays.
    """
    # Answers are small and slow to parse; left to their size, all of them would be parsed in one task.
    parts = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items, unreadable = wl.review_items(answers.select("answer_id", "batch", "model", "answer").repartition(parts))
    parsed = wl.parse_contract(items).withColumns(
        {"content_id": F.col("c.id"), "intent_basis": F.col("c.intent_basis"), "intent_evidence": F.col("c.intent_evidence"), "rationale": F.col("c.rationale")}
    )
    # Parsed once; the written rows feed the count of ids, the faults and the accepted items.
    parsed = written(parsed)
    twice = parsed.groupBy("answer_id", "content_id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    twice = twice.withColumn("_twice", F.lit(True))
    asked = requests.select("batch", "content_id", "prompt_version", "target_hash", "input_hash", F.concat_ws(" ", "title", "body").alias("source_text"))
    met = parsed.join(asked, ["batch", "content_id"], "left").join(twice, ["answer_id", "content_id"], "left")
    reason = (
        F.when(F.size("faults") > 0, F.array_join("faults", ","))
        .when(F.col("content_id").isNull(), "no_id")
        .when(F.col("target_hash").isNull(), "not_asked")
        .when(F.col("_twice"), "returned_twice")
    )
    met = written(met.withColumn("reason", reason).drop("_twice"))
    rejected = met.where(F.col("reason").isNotNull()).select("answer_id", "batch", "model", "content_id", "reason", "item")
    broken = unreadable.select("answer_id", "batch", "model", F.lit(None).cast("long").alias("content_id"), F.lit("unreadable").alias("reason"), F.col("answer").alias("item"))
    good = wl.review(wl.flatten_contract(met.where(F.col("reason").isNull()).drop("reason")))
    rest = [c for c in good.columns if c not in ("content_id", "target_hash", "model", "prompt_version")]
    first = good.groupBy("content_id", "target_hash", "model", "prompt_version").agg(F.min_by(F.struct(*rest), F.col("answer_id")).alias("_r"))
    return first.select("content_id", "target_hash", "model", "prompt_version", "_r.*").drop("source_text"), rejected.unionByName(broken)


def review_rows(accepted: DataFrame, analysis: DataFrame, reviews: DataFrame | None, *, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """(new analyses, new reviews): an analysis stored under the same key is kept, an analysis has one review."""
    rows = accepted.withColumnRenamed("input_hash", "request_hash").withColumnRenamed("target_hash", "input_hash").withColumns(
        {"topic_id": F.lit(None).cast("long"), "schema_version": F.lit(SCHEMA_VERSION)}
    )
    rows = written(rows)
    top = analysis.select(F.coalesce(F.max("analysis_id"), F.lit(0)).cast("long")).scalar()
    fresh = tables.numbered(tables.insert_absent(rows, analysis, wl.ANALYSIS_KEY), None, [], "analysis_id", ["content_id", "model", "prompt_version", "input_hash"])
    fresh = written(fresh.withColumn("analysis_id", (F.col("analysis_id") + top).cast("long")))
    key = [k for k in wl.ANALYSIS_KEY if k != "topic_id"]
    held = analysis.where(F.col("topic_id").isNull()).select("analysis_id", *key)
    stored = rows.join(held, key)
    said = fresh.unionByName(stored.select(*fresh.columns)).select(
        "analysis_id", F.lit(reviewer).alias("reviewer"), F.col("request_hash").alias("input_hash"), "intent_basis", "intent_evidence", "rationale", "degraded", F.col("item").alias("payload"),
    )
    if reviews is not None:
        said = said.join(reviews.select("analysis_id"), "analysis_id", "left_anti")
    return fresh.select(*analysis.columns), said


def request_reviews(store: Store, **options) -> DataFrame:
    """F07, first half: store the next requests and return them."""
    run = Run(store)
    made = written(review_requests(run.read("content"), run.read("content_analysis"), run.stored(REQUESTS), run.stored(ANSWERS), **options))
    run.append(REQUESTS, made)
    run.commit()
    return made


def take_in_reviews(store: Store, *, reviewer: str) -> DataFrame:
    """F07, second half: judge the answers that no earlier call has taken in and store them in one commit.

    Returns per model: accepted items by intent, in all, and rejected ones (A26). The
    next run of the core chain sums the days of the posts with new analyses again.
    """
    run = Run(store)
    answers = run.fresh(ANSWERS)
    accepted, rejected = judge_answers(run.read(ANSWERS).limit(0) if answers is None else answers, run.read(REQUESTS))
    analyses, reviews = review_rows(accepted, run.read("content_analysis"), run.stored(REVIEWS), reviewer=reviewer)
    # Folders of answers may have been put together since: what was taken in then counts no second time.
    known = run.stored(REJECTED)
    reviews = written(reviews)
    rejected = written(rejected if known is None else rejected.join(known.select("answer_id"), "answer_id", "left_anti"))
    if answers is not None:
        run.append("content_analysis", analyses)
        run.append(REVIEWS, reviews)
        run.append(REJECTED, rejected)
        run.taken_in(ANSWERS)
        run.commit()
    refused = rejected.groupBy("model").agg(F.count("*").alias("rejected"))
    made = store.read("content_analysis").select("analysis_id", "model", "intent").join(reviews.select("analysis_id"), "analysis_id")
    counts = wl.review_counters(made).join(refused, "model", "full_outer")
    return counts.na.fill(0, [*wl.INTENTS, "reviewed", "rejected"])
