"""Operator 3, URL filters: host suffixes and path prefixes against rules by hash prefix.

Every URL becomes expressions "host suffix + path prefix", of the sizes that rules
have; rules are held under the same form. Both sides meet on a short hash prefix of the expression, then the
full digest and the rest of the rule's path are confirmed, and the longest fitting
rule decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import query, table

#: Hex digits of the digest that both sides are joined on.
SHORT = 8
#: Upper and lower case of A-Z, so that no other letter is folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path behind it; null or no ``://``: both empty."""
    value = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(value, "://")
    rest = F.when(at > 0, F.substring(value, at + 3, F.length(value))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _anchor(path: Column) -> Column:
    """A path up to its last slash; rules are looked up by it."""
    return F.regexp_extract(path, r"^(?s:.*/)?", 0)


def _count(column: str, sign: str) -> Column:
    """How often a sign stands in a text."""
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(sign), F.lit("")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def judged(pages: DataFrame, rules: DataFrame, *, default: str = DEFAULT, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, deciding rule and verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest rule (host and path together) decides; of equally long ones
    the longer host, then "block" before "allow". Null URLs and URLs without
    ``://`` have an empty host and path and get the default. Repeated rows stay, an
    empty table gives no rows, extra columns are not read. Rules may be many: they
    are joined, not collected. Returns page_id, host, path, rule, verdict.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # A place that holds many rows is looked up once.
    places = rows.where("host <> ''").distinct()
    right = rules.select(
        F.col("verdict").alias("rule_verdict"), F.translate("rule_host", UPPER, LOWER).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"),
    ).where("rule_host <> ''")
    right = right.withColumn("anchor", _anchor(F.col("rule_path")))
    # Only sizes that a rule has are expanded, so a URL of many labels or slashes costs no more
    # than its length for each of them. There are as many as rules differ in size.
    sizes = right.agg(F.collect_set(F.struct((_count("rule_host", ".") + 1).alias("labels"), _count("anchor", "/").alias("steps")))).scalar()
    places = places.select("host", "path", (_count("host", ".") + 1).alias("labels"), _count("path", "/").alias("steps"), sizes.alias("sizes"))
    fitting = F.filter("sizes", lambda s: (s["labels"] <= F.col("labels")) & (s["steps"] <= F.col("steps")))
    sized = places.select("host", "path", F.explode(fitting).alias("s"))
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("s.labels"))
    prefix = F.when(F.col("s.steps") == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("s.steps")), F.lit("/")))
    digest = lambda h, p: F.sha2(F.concat_ws("\n", h, p), 256)
    left = sized.select("host", "path", digest(suffix, prefix).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    right = right.withColumn("rule_digest", digest(F.col("rule_host"), F.col("anchor"))).withColumn("rule_short", F.substring("rule_digest", 1, SHORT))
    met = left.join(right, F.col("short") == F.col("rule_short"))
    fits = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(name), F.length("rule_host"), (F.col("rule_verdict") == "block").cast("int"), name)
    best = fits.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max_by(F.struct(name.alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("_best"))
    joined = rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return joined.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
places AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
judged AS (
  SELECT q.page_id, q.host, q.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM (SELECT DISTINCT * FROM places) q LEFT JOIN rules r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p)
  GROUP BY q.page_id, q.host, q.path)
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
FROM places p JOIN judged j ON p.page_id IS NOT DISTINCT FROM j.page_id AND p.host = j.host AND p.path = j.path
"""


@query("op3_urls", OP3_SQL)
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of all pages under the contract's rules."""
    return judged(table(spark, sf_dir, "pages"), rule_table(spark))
