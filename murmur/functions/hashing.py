"""Stable hashes: canonical JSON, pseudonyms, fingerprints."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # bytes in a SHA-256 block


def canonical_json(text: Column, **defaults: str) -> Column:
    """JSON text with sorted names, no blanks and numbers as they are; NULL when it is not JSON.

    ``defaults`` fill members of an object that are missing or null. Built-in JSON
    functions rewrite numbers (1.0 becomes 1), so the text goes through Arrow
    batches.
    """

    def one(value: str | None) -> str | None:
        try:
            data = json.loads(value) if value is not None else None
        except ValueError:
            return None
        if value is None:
            return None
        if isinstance(data, dict):
            data |= {k: v for k, v in defaults.items() if data.get(k) is None}
        return json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    @F.pandas_udf("string")
    def column(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return column(text)


def payload_hash(text: Column) -> Column:
    """SHA-256 over canonical JSON text."""
    return F.sha2(text, 256)


def author_hash(secret: str, source: Column, user_id: Column) -> Column:
    """HMAC-SHA256 of ``source:user``, built from two nested SHA-256 calls in the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    message = F.encode(F.concat(source, F.lit(":"), user_id), "UTF-8")
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def analysis_input_hash(content_hash: Column, title: Column, body: Column, topic_id: Column, topic_slug: Column) -> Column:
    """Hash of what a classifier saw; keys in sorted order, missing topic as null."""
    row = F.struct(
        F.coalesce(body, F.lit("")).alias("body"), content_hash.alias("content_hash"),
        F.coalesce(title, F.lit("")).alias("title"), topic_id.alias("topic_id"), topic_slug.alias("topic_slug"),
    )
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def query_fingerprint(query: Column) -> Column:
    """Hash of a trimmed query."""
    return F.sha2(F.trim(query), 256)


def task_run_key(scope: Column, source: Column, topic_slug: Column) -> Column:
    """Key of one collection run over a source and topic."""
    return F.sha2(F.concat_ws(":", scope, source, topic_slug), 256)
