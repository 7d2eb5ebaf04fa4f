"""Operator 13, line dedup: lines that many documents share stay in one of them.

Lines are exploded with their positions, normalised and hashed; the distinct
documents of every hash are counted; positions of lines over the threshold are
gathered per document and the other lines are put together again in order. Only
digests, ids and positions are exploded. A text travels once, to its positions.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import BLANKS, fresh, query, table

#: Shortest key that counts, and the documents from which a line is dropped.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_digests(documents: DataFrame, *, doc_id: str, text: str, least_length: int) -> DataFrame:
    """(doc, text_digest, position, digest) of every line whose key is long enough."""
    value = F.col(text).cast("string")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(value).alias("text_digest"), F.posexplode(F.split(lowered(value), "\n", -1)).alias("position", "line"))
    keyed = rows.select("doc", "text_digest", "position", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= least_length)
    return keyed.select("doc", "text_digest", "position", F.unhex(F.md5("key")).alias("digest"))


def repeated_lines(lines: DataFrame, *, least_documents: int) -> DataFrame:
    """(digest, keeper) of lines found in enough documents; the keeper is the largest id.

    Spark counts the distinct ids in two steps, the first dealt by digest and id, so
    a line of very many documents is spread and then one row per task.
    """
    found = lines.groupBy("digest").agg((F.countDistinct("doc") + F.max(F.col("doc").isNull().cast("int"))).alias("n"), F.max("doc").alias("keeper"))
    return found.where(F.col("n") >= least_documents).select("digest", "keeper")


def deduplicated(
    documents: DataFrame, *, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """All rows and columns, texts without repeated lines, and n_lines, n_dropped beside them.

    A line's key has its white space cut at both ends and A-Z lower-cased. A key of
    ``least_length`` code points found in ``least_documents`` documents loses all its
    lines but those of the largest doc_id that holds it; there all of them stay. A
    null or empty text is one empty line and becomes empty when it is null. Rows with
    one doc_id are one document; a null doc_id is a document too, smaller than any
    other. Repeated rows stay, each treated alike. An empty table gives no rows.
    Extra columns stay as they are; names that clash with n_lines or n_dropped get a
    trailing underscore in the new columns.
    """
    lines = line_digests(documents, doc_id=doc_id, text=text, least_length=least_length)
    shared = repeated_lines(lines, least_documents=least_documents)
    dropped = lines.join(shared, "digest").where(~F.col("doc").eqNullSafe(F.col("keeper")))
    # Repeated rows give a position once each; it is one position of each of them.
    places = dropped.groupBy("doc", "text_digest").agg(F.collect_set("position").alias("places"))
    value, whole = F.col(text).cast("string"), fresh(documents, "_lines")
    doc, digest = fresh(documents, "_doc"), fresh(documents, "_digest")
    gone, n_lines, n_dropped = fresh(documents, "_places"), fresh(documents, "n_lines"), fresh(documents, "n_dropped")
    places = places.select(F.col("doc").alias("_place_doc"), F.col("text_digest").alias("_place_digest"), F.col("places").alias(gone))
    rows = documents.withColumns({doc: F.col(doc_id).cast("long"), digest: F.xxhash64(value), whole: lines_of(F.col(text))})
    rows = rows.join(places, (F.col(digest) == F.col("_place_digest")) & F.col(doc).eqNullSafe(F.col("_place_doc")), "left")
    kept = F.when(F.col(gone).isNull(), F.array_join(F.col(whole), "\n")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(gone)), lambda at: F.get(F.col(whole), at)), "\n")
    )
    columns = [kept.alias(text) if c == text else F.col(f"`{c}`") for c in documents.columns]
    return rows.select(*columns, F.size(whole).cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped))


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, u.line AS line, translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), E'\n'), range(len(string_split(coalesce(text, ''), E'\n'))))) AS z FROM documents) AS d,
    LATERAL (SELECT z[1] AS line, z[2] AS i) AS u),
shared AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, s.key IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op13_lines", OP13_SQL)
def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped of all documents, the kept text as a digest."""
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
