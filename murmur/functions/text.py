"""Text, number and URL cleaning as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags that start or end a line of text.
BLOCK_TAGS = ("article", "blockquote", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "section", "tr")
IMAGE_MARK = " [图片] "
SITE_MARK = "[淘股吧]"
# Tracking parameters dropped from URLs.
TRACKING = r"^(utm_[^=]+|spm|from|share_source)="


@F.pandas_udf(StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """Decode character references twice, in Arrow batches; the full HTML name table has no built-in."""
    return text.map(lambda v: html.unescape(html.unescape(v)) if v and "&" in v else v)


def html_to_text(page: Column) -> Column:
    """Visible text of a page: no script or style, one line per block, blanks collapsed."""
    text = F.coalesce(page, F.lit(""))
    text = F.regexp_replace(text, r"(?i)<(script|style)\b[^>\x01]*>[^\x01]*?(</\1\s*>|(?=\x01)|\z)", "")
    text = F.regexp_replace(text, r"<!--[^\x01]*?-->", "")
    text = F.regexp_replace(text, r"(?i)<img\b[^>\x01]*>", IMAGE_MARK)
    text = F.regexp_replace(text, rf"(?i)</?({'|'.join(BLOCK_TAGS)})(\s[^>\x01]*|/)?>", "\n")
    text = F.regexp_replace(text, r"<[!?/a-zA-Z][^>\x01]*>", "")
    text = decode_references(text)
    text = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    text = F.replace(text, F.lit(SITE_MARK), F.lit(""))
    text = F.regexp_replace(text, "[ \\t\\f\\x0B]+", " ")
    text = F.regexp_replace(text, " ?[\\r\\n]+[ \\r\\n]*", "\n")
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")


def html_texts(parts: Column) -> Column:
    """X01 over an array: the cleaned, non-empty texts. A control character keeps them apart."""
    whole = html_to_text(F.array_join(F.transform(parts, lambda p: F.translate(p, "\x01", " ")), "\x01"))
    pieces = F.transform(F.split(whole, "\x01"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda p: p != "")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters."""
    text = F.trim(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme = F.lower(F.regexp_extract(text, pattern, 1))
    netloc = F.lower(F.regexp_replace(F.regexp_extract(text, pattern, 2), r"^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(netloc, r":(80)?$", "")).when(
        scheme == "https", F.regexp_replace(netloc, r":(443)?$", "")
    ).otherwise(F.regexp_replace(netloc, r":$", ""))
    path = F.regexp_extract(text, pattern, 3)
    parts = F.filter(F.split(F.regexp_extract(text, pattern, 4), "&"), lambda p: (p != "") & ~p.rlike("(?i)" + TRACKING))
    query = F.array_join(parts, "&")
    built = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(text.rlike(pattern) & (netloc != ""), built).otherwise(text)


def whole_number(value: Column) -> Column:
    """Truncated number, NULL when it is not one."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def social_count(value: Column) -> Column:
    """``1.2万`` is 12,000 and ``3千`` is 3,000; commas are dropped."""
    text = F.replace(F.trim(value.cast("string")), F.lit(","), F.lit(""))
    unit = F.when(text.endswith("万"), 10000).when(text.endswith("千"), 1000).otherwise(1)
    return (F.regexp_replace(text, "[万千]$", "").try_cast("double") * unit).try_cast("bigint")


# Full-width forms and the ideographic space with their compatible ASCII characters.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Characters whose NFKC form is themselves and whose case folds by lower(), sharp s apart.
_PLAIN = r"[^\x00-\x1B\x20-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u3001\u3002\u300A-\u3011\u4E00-\u9FFF]"


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding in Arrow batches."""
    return text.map(lambda v: re.sub(r"[\s\-_/]+", "", unicodedata.normalize("NFKC", v).strip().casefold()) if v is not None else None)


def normalize_text(text: Column) -> Column:
    """NFKC and case folded text without blanks, hyphens, underscores and slashes.

    Full-width characters are translated in the JVM; only texts that still hold
    other characters with a compatibility form go through Python, the rest is
    sent there as NULL.
    """
    value = F.coalesce(text, F.lit(""))
    # Most texts have nothing to translate, and looking is much cheaper.
    value = F.when(value.rlike("[\uFF01-\uFF5E\u3000]"), F.translate(value, _WIDE, _NARROW)).otherwise(value)
    simple = F.regexp_replace(F.replace(F.lower(value), F.lit("ß"), F.lit("ss")), r"[\s\-_/]+", "")
    return F.coalesce(_folded(F.when(value.rlike(_PLAIN), value)), simple)


# Fixed value: what counts as a token.
TOKEN = "[a-z0-9_]+|[\u4e00-\u9fff]"


def tokens(text: Column) -> Column:
    """Runs of ASCII word characters, or single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def kind_slug(content_type: Column, prefix: str = "zhihu_") -> Column:
    """Observation kind of a content type."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(content_type, F.lit("content"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix), F.when(slug == "", "content").otherwise(slug))


def source_name(name: Column) -> Column:
    """Lower case with hyphens."""
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def looks_truncated(text: Column) -> Column:
    """The cleaned text ends in an ellipsis."""
    return F.regexp_replace(text, r"\s+$", "").rlike(r"(\.\.\.|…)$")


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), "^ | $", "")


def trimmed_evidence(text: Column, max_chars: int, *, tail_cap: int = 700, tail_share: int = 3, middle: str = "\n…[中间省略]…\n") -> Column:
    """Head and tail of a long text on one line; short texts stay whole."""
    body, tail = one_line(text), min(tail_cap, max_chars // tail_share)
    cut = F.concat(F.substring(body, 1, max_chars - tail), F.lit(middle), F.right(body, F.lit(tail)))
    return F.when(F.length(body) <= max_chars, body).otherwise(cut)
