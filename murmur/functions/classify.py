"""Rule-based classification of a post as column expressions (X19), with its word lists as parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """The words each label looks for."""

    commercial: tuple[str, ...] = ("广告", "推广", "宣传", "开户链接", "课程", "营销", "扫码", "加微信", "加v", "私信领取", "免费领取", "会员群")
    media: tuple[str, ...] = ("快讯", "媒体", "报道", "财联社", "新华社")
    kol: tuple[str, ...] = ("老师", "大V", "跟我", "直播", "粉丝")
    spam: tuple[str, ...] = ("微信群", "内幕消息", "机器人账号", "自动发帖", "刷屏", "批量注册")
    novice: tuple[tuple[str, str], ...] = (
        ("第一次", "first_time"), ("新手", "first_time"), ("怎么买", "how_to_buy"), ("如何买", "how_to_buy"),
        ("入门", "basic_question"), ("想问", "basic_question"), ("求带", "influencer_following"), ("上车", "seeking_entry"),
        ("追涨", "chasing_price"), ("梭哈", "all_in_language"), ("满仓", "all_in_language"), ("风险", "lack_risk_awareness"),
        ("不懂", "product_confusion"), ("被套", "position_uncertainty"),
    )
    experienced: tuple[str, ...] = ("仓位", "纪律", "研究")
    bullish: tuple[str, ...] = ("上涨", "看涨", "继续涨", "冲", "上车", "涨停", "bullish")
    bearish: tuple[str, ...] = ("下跌", "看跌", "回落", "恐慌", "被套", "崩", "bearish")
    buy: tuple[str, ...] = ("买", "上车", "冲", "满仓", "梭哈")
    sell: tuple[str, ...] = ("卖", "止损", "减仓")
    hold: tuple[str, ...] = ("持有", "底仓")
    owned: tuple[str, ...] = ("持有", "底仓", "仓位")
    urgency: tuple[str, ...] = ("现在", "赶紧", "马上", "来不及", "上车")
    fear_of_missing: tuple[str, ...] = ("错过", "踏空", "怕没", "怕错过")
    social_proof: tuple[str, ...] = ("大家都", "朋友群", "群里", "都在", "一致")
    price_chasing: tuple[str, ...] = ("追涨", "冲", "上车", "涨停", "继续涨")
    regret: tuple[str, ...] = ("后悔", "早知道", "踏空")
    panic: tuple[str, ...] = ("恐慌", "慌", "崩", "被套", "亏损扩大")


def contains_any(lowered: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-cased text holds any of the words, ignoring case."""
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found


def classify(posts: DataFrame, *, title: str = "title", body: str = "body", rules: Rules = Rules()) -> DataFrame:
    """Add an ``analysis`` struct with the full contract to every post.

    Only built-in string tests, so the whole classifier stays inside generated
    code and needs no shuffle.
    """
    text = F.trim(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(body), F.lit(""))))
    rows = posts.withColumn("_t", text).withColumn("_low", F.lower("_t"))
    low, raw = F.col("_low"), F.col("_t")
    flags = {
        name: contains_any(low, getattr(rules, name)).alias(f"_{name}")
        for name in ("commercial", "media", "kol", "spam", "experienced", "bullish", "bearish", "buy", "sell", "hold", "owned",
                     "urgency", "fear_of_missing", "social_proof", "price_chasing", "regret", "panic")
    }
    signals = F.array_distinct(F.array_compact(F.array(*[F.when(raw.contains(word), signal) for word, signal in rules.novice])))
    rows = rows.select("*", *flags.values(), signals.alias("_novice"))
    c = lambda n: F.col(f"_{n}")
    novice = F.size("_novice") > 0
    actor = F.when(c("commercial"), "commercial").when(c("media"), "media").when(c("kol"), "kol").otherwise("retail")
    level = F.when(novice, "novice").when(c("experienced"), "experienced").otherwise("unknown")
    direction = F.when(c("bullish") & ~c("bearish"), "bullish").when(c("bearish") & ~c("bullish"), "bearish").otherwise("neutral")
    intent = F.when(c("buy"), "buy").when(c("sell"), "sell").when(c("hold"), "hold").otherwise("unknown")
    position = F.when(c("owned"), "owned").when(novice, "not_owned").otherwise("unknown")
    sure = lambda cond, yes, no: F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    contract = F.struct(
        actor.alias("actor_type"), sure(actor != "retail", 0.84, 0.78).alias("actor_confidence"),
        level.alias("investor_level"), sure(level != "unknown", 0.87, 0.55).alias("investor_confidence"),
        F.col("_novice").alias("novice_signals"), direction.alias("direction"), F.lit(0.82).alias("direction_confidence"),
        intent.alias("intent"), F.lit(0.78).alias("intent_confidence"), position.alias("position"), F.lit(0.76).alias("position_confidence"),
        F.struct(*[c(f).alias(f) for f in ("urgency", "fear_of_missing", "social_proof", "price_chasing", "regret", "panic")]).alias("emotion"),
        c("spam").alias("spam"), sure(c("spam"), 0.9, 0.82).alias("spam_confidence"),
        c("commercial").alias("promotion"), sure(c("commercial"), 0.94, 0.82).alias("promotion_confidence"),
    )
    helpers = ["_t", "_low", "_novice", *[f"_{name}" for name in flags]]
    return rows.withColumn("analysis", contract).drop(*helpers)
