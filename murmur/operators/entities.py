"""Registry-first entity resolution."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from murmur.functions.classify import contains_any
from murmur.functions.text import normalize_text
from murmur.session import checkpointed, written

DISCOVERY_SOURCES = ("zhihu", "xiaohongshu")
# Words that put a text in a securities context.
MARKET_TERMS = (
    "股票", "股市", "个股", "股价", "a股", "港股", "美股", "大盘", "上证", "深证", "沪指", "深指", "创业板", "科创板", "北证",
    "纳斯达克", "纳指", "标普", "道琼斯", "恒生指数", "恒生科技指数", "etf", "基金", "期货", "期权", "证券", "券商", "板块",
    "概念股", "龙头股", "涨停", "跌停", "市值", "估值", "市盈率", "市净率", "财报", "净利润", "分红", "仓位", "调仓", "建仓",
    "加仓", "减仓", "清仓", "持仓", "被套", "解套", "主力", "北向资金", "成交量", "换手率", "k线", "做多", "做空", "收益率",
    "回撤", "金价", "交易日", "stock", "equity", "share price", "market cap", "nasdaq", "portfolio",
)
# The words strong enough when they stand in a body only.
STRONG_BODY_TERMS = (
    "股票", "个股", "股价", "etf", "基金", "期货", "期权", "证券", "券商", "概念股", "龙头股", "涨停", "跌停", "估值", "市盈率",
    "市净率", "财报", "基本面", "净利润", "仓位", "调仓", "建仓", "加仓", "减仓", "清仓", "持仓", "被套", "解套", "北向资金",
    "成交量", "换手率", "k线", "做多", "做空", "收益率", "回撤", "金价", "交易日", "stock", "equity", "share price", "market cap", "portfolio",
)
# Fixed value: what a ticker looks like.
TICKER = r"(?i)(?<![a-z0-9])(?:sh|sz|bj)?[03689]\d{5}(?:\.(?:sh|sz|bj))?(?![a-z0-9])"
# Confidence by method, in the order in which the steps run.
STEPS = {"ticker": 1.0, "exact_alias": 0.98, "normalized_alias": 0.98, "collection_query": 0.9, "asset_topic": 0.96}
# Characters that the term walk takes together, those of a term that are looked up first, and bits that mark the terms (a power of two).
WALK, HEAD, MARKS = 1 << 18, 8, 1 << 26
# Characters that may not adjoin a clean hit.
EDGES = frozenset(string.ascii_letters + string.digits)


def is_market_text(text: Column, terms=MARKET_TERMS, ticker: str = TICKER) -> Column:
    """Any securities word, or a ticker with clean edges."""
    value = F.coalesce(text, F.lit(""))
    return contains_any(F.lower(value), tuple(terms)) | value.rlike(ticker)


def is_market_content(title: Column, body: Column, terms=MARKET_TERMS, strong=STRONG_BODY_TERMS, ticker: str = TICKER) -> Column:
    """Any hit in the title, or a ticker or a strong word in the body."""
    text = F.coalesce(body, F.lit(""))
    return is_market_text(title, terms, ticker) | text.rlike(ticker) | contains_any(F.lower(text), tuple(strong))


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    codes = (codes.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (codes ^ codes >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)


def _window_hashes(sums: np.ndarray, at: np.ndarray, size: int, inverse: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ``size`` characters at ``at``, from running sums of weighted code points."""
    return (sums[at + size] - sums[at]) * inverse[at]


def _sums(text: str, powers: np.ndarray) -> np.ndarray:
    codes = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    return np.concatenate([np.zeros(1, dtype="u8"), np.cumsum(codes * powers[: len(codes)], dtype="u8")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd factor modulo 2^64, and of its inverse."""
    factor = 0xD6E8FEB86659FD93
    return tuple(np.concatenate([np.ones(1, dtype="u8"), np.cumprod(np.full(max(n - 1, 0), f, dtype="u8"), dtype="u8")]) for f in (factor, pow(factor, -1, 1 << 64)))


def _slots(hashes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Two of ``MARKS`` bit numbers for each hash; ``kind`` tells fields, sizes and heads apart."""
    seed = np.uint64(zlib.crc32(kind.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (hashes ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    low = np.uint64(MARKS - 1)
    return (h >> np.uint64(32)) & low, (h ^ h >> np.uint64(37)) & low


def _marked(bits: np.ndarray, hashes: np.ndarray, kind: str) -> np.ndarray:
    """Which hashes may be of a term: never false for one, rarely true for another text."""
    one, two = _slots(hashes, kind)
    bit = lambda slot: (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    found = bit(one)
    found[found] = bit(two[found])
    return found


def _marks(known: DataFrame) -> np.ndarray:
    """Bits of all terms and of their heads: at most ``MARKS`` of them, however many terms there are."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, inverse = _powers(HEAD)
        for batch in batches:
            slots = [np.zeros(0, dtype="u8")]
            for field, term in zip(batch.column("field").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if len(term) >= len(powers):
                    powers, inverse = _powers(2 * len(term))
                sums, start = _sums(term, powers), np.zeros(1, dtype="i8")
                head = min(len(term), HEAD)
                slots += _slots(_window_hashes(sums, start, head, inverse), f"{field} head {head}")
                slots += _slots(_window_hashes(sums, start, len(term), inverse), f"{field} {len(term)}")
            slots = np.unique(np.concatenate(slots))
            masks = np.uint64(1) << (slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype("i4")), pa.array(masks.view("i8"))], names=["word", "mask"])

    rows = known.select("field", "term").mapInArrow(mark, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(MARKS // 64, dtype="u8")
    bits[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view("u8")
    return bits


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``WALK`` characters together; a longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > WALK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def _places(texts: list[str], field: str, sizes: list[int], bits: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, text number, place in the text) of what the bits take for terms."""
    lengths = np.array([len(t) for t in texts], dtype="i8")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    sums, total = _sums("".join(texts), powers), int(starts[-1])
    left = np.repeat(starts[1:], lengths) - np.arange(total)
    for head in sorted({min(n, HEAD) for n in sizes}):
        at = np.flatnonzero(left >= head)
        at = at[_marked(bits, _window_hashes(sums, at, head, inverse), f"{field} head {head}")]
        for size in (n for n in sizes if min(n, HEAD) == head):
            fit = at[left[at] >= size]
            fit = fit[_marked(bits, _window_hashes(sums, fit, size, inverse), f"{field} {size}")]
            if len(fit):
                of = np.searchsorted(starts, fit, "right") - 1
                yield size, of, fit - starts[of]


def term_hits(texts: DataFrame, terms: DataFrame, *, key: str = "content_id") -> DataFrame:
    """Where the terms stand in the texts, one row per (key, field, term).

    ``texts`` holds key, field, text and ``border``, the length of a title at the
    head of the text; ``terms`` holds field and term. Every text is walked once, in
    Arrow batches: running sums give a hash of the characters at every place, and
    bits of bounded number (of the terms' heads, then of whole terms) tell where a
    term may stand. Only such places leave the walk, one row for each text and
    word, and an equi join with the terms keeps the true ones.

    ``in_title`` tells of a hit inside the border; ``body_hit`` of one beyond it
    and ``body_twice`` of two that do not overlap; ``clean`` of one that no ASCII
    letter or digit adjoins.
    """
    known = written(terms.select("field", "term").where((F.col("term") != "") & F.col("field").isNotNull()).distinct())
    sizes = {r["field"]: sorted(r["sizes"]) for r in known.groupBy("field").agg(F.collect_set(F.length("term")).alias("sizes")).collect()}
    shared = known.sparkSession.sparkContext.broadcast(_marks(known))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, (powers, inverse) = shared.value, _powers(WALK + 1)
        for batch in batches:
            fields, values, borders = (batch.column(c).to_pylist() for c in ("field", "text", "border"))
            # Fields without a term are not walked.
            for field in sorted({f for f in fields if f in sizes}):
                rows = [i for i, f in enumerate(fields) if f == field and values[i]]
                whole = [values[i] for i in rows]
                for first, last in _chunks(whole):
                    part, found = whole[first:last], {}
                    if sum(map(len, part)) >= len(powers):
                        powers, inverse = _powers(sum(map(len, part)) + 1)
                    for size, of, at in _places(part, field, sizes[field], bits, powers, inverse):
                        for i, k in zip(of.tolist(), at.tolist(), strict=True):
                            text, border = part[i], borders[rows[first + i]]
                            title, body = (None, None) if border is None else (k + size <= border, k + 1 if k + 1 > border else None)
                            clean = not (k and text[k - 1] in EDGES) and text[k + size : k + size + 1] not in EDGES
                            spot = rows[first + i], text[k : k + size]
                            seen = found.setdefault(spot, [title, body, body, clean])
                            # Places of one size come in order: the first body place stays, the last one moves.
                            found[spot] = [seen[0] or title, seen[1] if seen[1] is not None else body, body if body is not None else seen[2], seen[3] or clean]
                    if found:
                        at, names = zip(*found, strict=True)
                        title, head, tail, clean = (pa.array(list(c), t) for c, t in zip(zip(*found.values(), strict=True), (pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True))
                        yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array([field] * len(at)), pa.array(names), title, head, tail, clean], names=[key, "field", "term", "title", "head", "tail", "clean"])

    shape = StructType([StructField(key, texts.schema[key].dataType), *StructType.fromDDL("field string, term string, title boolean, head long, tail long, clean boolean")])
    found = texts.where(F.col("text") != "").select(key, "field", "text", "border").mapInArrow(walk, shape).join(known, ["field", "term"], "left_semi")
    return found.groupBy(key, "field", "term").agg(
        F.max("title").alias("in_title"),
        F.max("tail").isNotNull().alias("body_hit"),
        F.coalesce(F.max("tail") - F.min("head") >= F.max(F.length("term")), F.lit(False)).alias("body_twice"),
        F.max("clean").alias("clean"),
    )


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """Normalised aliases that belong to exactly one asset."""
    norm = aliases.withColumn("alias_norm", normalize_text(F.col("alias"))).where(F.col("alias_norm") != "")
    named = norm.groupBy("alias_norm").agg(F.collect_set("asset_id").alias("_owners"), F.collect_list(F.struct(*aliases.columns)).alias("_rows"))
    return named.where(F.size("_owners") == 1).select("alias_norm", F.inline("_rows"))


def normalized_topics(topic_terms: DataFrame) -> DataFrame:
    return topic_terms.select("topic_id", normalize_text(F.col("term")).alias("term")).where(F.col("term") != "").distinct()


def _texts(posts: DataFrame) -> DataFrame:
    """Two texts of a post: normalised, and lower case as written; the border is the title's length."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    low = F.lower(F.concat_ws(" ", F.when(title != "", title), F.when(body != "", body)))
    head = posts.select("content_id", normalize_text(title).alias("_title"), normalize_text(body).alias("_body"), low.alias("_low"))
    norm = F.struct(F.lit("norm").alias("field"), F.concat("_title", "_body").alias("text"), F.length("_title").alias("border"))
    raw = F.struct(F.lit("low").alias("field"), F.col("_low").alias("text"), F.lit(0).alias("border"))
    return head.select("content_id", F.explode(F.array(norm, raw)).alias("t")).select("content_id", "t.*")


def registry_terms(assets: DataFrame, usable: DataFrame, topics: DataFrame) -> DataFrame:
    """All terms that texts are walked for: (field, term); ``usable`` are unique aliases, ``topics`` normalised terms."""
    norm = topics.select("term").union(usable.select("alias_norm"))
    low = assets.select(F.lower("symbol").alias("term")).union(usable.select(F.lower(F.trim("alias"))))
    return norm.select(F.lit("norm").alias("field"), "term").union(low.select(F.lit("low"), "term"))


def asset_matches(hits: DataFrame, assets: DataFrame, usable: DataFrame) -> DataFrame:
    """One match per post and asset; a ticker with clean edges first, else the best unique alias."""
    low, norm = hits.where(F.col("field") == "low"), hits.where(F.col("field") == "norm")
    tickers = low.where("clean").join(assets.select("asset_id", F.lower("symbol").alias("term")), "term")
    tickers = tickers.select("content_id", "asset_id", F.lit("ticker").alias("method"), F.lit("0").alias("_rank"))
    named = norm.select("content_id", F.col("term").alias("alias_norm")).join(usable.withColumn("_alias_low", F.lower(F.trim("alias"))), "alias_norm")
    exact = low.select("content_id", F.col("term").alias("_alias_low"), F.lit(True).alias("_exact"))
    named = named.join(exact, ["content_id", "_alias_low"], "left")
    order = F.concat(F.lit("1"), F.format_string("%010d%06d", F.col("priority"), F.lit(100000) - F.length("alias")), F.col("alias"))
    named = named.select("content_id", "asset_id", F.when(F.col("_exact"), "exact_alias").otherwise("normalized_alias").alias("method"), order.alias("_rank"))
    return tickers.unionByName(named).groupBy("content_id", "asset_id").agg(F.min_by("method", "_rank").alias("method"))


def topic_matches(hits: DataFrame, strict: DataFrame, topics: DataFrame) -> DataFrame:
    """Posts that name a topic in the title, or in the body once, or twice where ``strict`` has the post."""
    named = hits.where((F.col("field") == "norm") & (F.col("in_title") | F.col("body_hit"))).join(strict.withColumn("_strict", F.lit(True)), "content_id", "left")
    named = named.where(F.col("in_title") | F.col("_strict").isNull() | F.col("body_twice"))
    return named.select("content_id", "term").join(topics, "term").select("content_id", "topic_id").distinct()


def collection_topics(posts: DataFrame, raw: DataFrame, raw_topic: DataFrame, topics: DataFrame) -> DataFrame:
    """(content_id, topic_id) of the topics in ``topics`` whose collection queries found a version of a post, each once.

    The posts meet their versions first, so a run over few changed posts carries
    only their versions on to the links.
    """
    seen = posts.select("content_id", "source", "source_item_id").join(raw.select("raw_id", "source", "source_item_id"), ["source", "source_item_id"])
    linked = seen.select("content_id", "raw_id").join(raw_topic.select("raw_id", "topic_id"), "raw_id")
    return linked.join(topics.select("topic_id"), "topic_id", "left_semi").select("content_id", "topic_id").distinct()


def resolve_entities(
    posts: DataFrame, assets: DataFrame, aliases: DataFrame, asset_topic: DataFrame, topic_terms: DataFrame, query_topics: DataFrame,
    *, discovery_sources: tuple[str, ...] = DISCOVERY_SOURCES, terms=MARKET_TERMS, strong=STRONG_BODY_TERMS, ticker: str = TICKER,
) -> DataFrame:
    """All entity links of all posts, one per (post, type, entity).

    Steps in order: asset in the text, topics of the query that found the post
    (not for discovery sources), topics linked to a matched asset, topic named in
    the text. When several steps give the same entity the last step wins.
    Discovery posts without securities context get no links at all.
    """
    discovery = F.col("source").isin(*discovery_sources)
    admitted = posts.where(~discovery | is_market_content(F.col("title"), F.col("body"), terms, strong, ticker))
    # The texts are read twice: for the admitted ids, and for the walk, whose hits are narrow.
    marks = checkpointed(admitted.select("content_id", discovery.alias("strict")))
    usable, topics = written(unique_aliases(aliases)), written(normalized_topics(topic_terms))
    hits = checkpointed(term_hits(_texts(admitted), registry_terms(assets, usable, topics)))
    found = checkpointed(asset_matches(hits, assets, usable))
    by_asset = found.select("content_id", F.lit("asset").alias("entity_type"), F.col("asset_id").alias("entity_id"), "method", F.lit(0).alias("step"))
    by_query = marks.where(~F.col("strict")).select("content_id").join(query_topics, "content_id").select(
        "content_id", F.lit("topic").alias("entity_type"), F.col("topic_id").alias("entity_id"), F.lit("collection_query").alias("method"), F.lit(1).alias("step")
    )
    by_link = found.select("content_id", "asset_id").join(asset_topic.select("asset_id", "topic_id"), "asset_id").select(
        "content_id", F.lit("topic").alias("entity_type"), F.col("topic_id").alias("entity_id"), F.lit("asset_topic").alias("method"), F.lit(2).alias("step")
    )
    by_name = topic_matches(hits, marks.where("strict").select("content_id"), topics).select(
        "content_id", F.lit("topic").alias("entity_type"), F.col("topic_id").alias("entity_id"), F.lit("exact_alias").alias("method"), F.lit(3).alias("step")
    )
    every = by_asset.unionByName(by_query).unionByName(by_link).unionByName(by_name)
    kept = every.groupBy("content_id", "entity_type", "entity_id").agg(F.max_by("method", "step").alias("method"))
    rule = None
    for method, value in STEPS.items():
        rule = F.when(F.col("method") == method, value) if rule is None else rule.when(F.col("method") == method, value)
    return kept.withColumn("confidence", rule)


def resolve_topic_text(queries: DataFrame, topics: DataFrame, aliases: DataFrame, *, text: str = "text") -> DataFrame:
    """Topic of a short text: exact slug or name, else an alias of exactly one topic."""
    keyed = queries.withColumn("_norm", normalize_text(F.col(text)))
    exact = topics.select("topic_id", F.explode(F.array(normalize_text(F.col("slug")), normalize_text(F.col("name")))).alias("_norm"))
    exact = exact.groupBy("_norm").agg(F.min("topic_id").alias("_exact"))
    shared = aliases.select("topic_id", normalize_text(F.col("alias")).alias("_norm")).groupBy("_norm").agg(
        F.countDistinct("topic_id").alias("_n"), F.min("topic_id").alias("_alias")
    )
    joined = keyed.join(exact, "_norm", "left").join(shared, "_norm", "left")
    hit = F.when(F.col("_n") == 1, F.col("_alias"))
    return joined.withColumn("topic_id", F.coalesce("_exact", hit)).withColumn(
        "confidence", F.when(F.col("_exact").isNotNull(), 1.0).when(hit.isNotNull(), 0.98)
    ).drop("_norm", "_exact", "_n", "_alias")


# Query words too common to tell topics apart.
GENERIC_QUERY_TERMS = (
    "etf", "买", "亏钱", "加仓", "回本", "基金", "定投", "投资", "抄底", "持仓", "散户", "概念股", "止盈", "清仓", "股价", "股市", "股票", "行情", "走势", "回调",
)


def query_terms(query: Column) -> Column:
    """Specific words of a query; the generic ones only when nothing else is left."""
    words = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9\\u4e00-\\u9fff]+)"), F.lit(1))

    def trimmed(word: Column) -> Column:
        short = F.regexp_replace(F.regexp_replace(word, "etf$", ""), "^买", "")
        return F.when(short == "", word).otherwise(short)

    words = F.transform(words, trimmed)
    specific = F.filter(words, lambda w: ~w.isin(*GENERIC_QUERY_TERMS) & (F.length(w) >= 2))
    return F.when(F.size(specific) > 0, specific).otherwise(words)


def matches_query(title: Column, body: Column, query: Column) -> Column:
    """The text holds at least one query word."""
    text = F.lower(F.concat_ws(" ", F.when(title != "", title), F.when(body != "", body)))
    return (text != "") & F.exists(query_terms(query), lambda w: F.contains(text, w))
