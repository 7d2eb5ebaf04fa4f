"""Cleaning, classification, entities and near duplicates, against brute force where it matters."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.functions.classify import classify
from murmur.operators import entities as en
from murmur.operators import neardup as nd


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_html_to_text(spark):
    page = '<div>A&nbsp; b<script>var x="</p>";</script><br/>c &amp;lt;<img src="x"> d</div><!-- no --><style>p{}</style><p>[淘股吧]e</p>'
    assert one(spark, tx.html_to_text(F.lit(page))) == "A b\nc < [图片] d\ne"
    got = one(spark, tx.html_texts(F.array(F.lit("<p>a"), F.lit("<b> </b>"), F.lit("b<script>x"), F.lit("c &gt; d"))))
    assert got == ["a", "b", "c > d"]


def test_canonical_url(spark):
    cases = {
        "HTTP://Ex.COM:80/a?utm_source=x&b=1&SPM=2#f": "http://ex.com/a?b=1", "https://ex.com:443": "https://ex.com/", "https://ex.com:8443/?from=a&&c": "https://ex.com:8443/?c",
        "plain text": "plain text", "http://u:p@Ex.com/x": "http://ex.com/x",
    }
    for url, want in cases.items():
        assert one(spark, tx.canonical_url(F.lit(url))) == want


def test_counts_and_numbers(spark):
    got = spark.createDataFrame([("1.2万",), ("3千",), ("1,234",), ("x",), ("",)], "v string").select(tx.social_count(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [12000, 3000, 1234, None, None]


def test_default_classifier(spark):
    rows = [(1, "新手", "现在怎么买？朋友群里都在冲，后悔没上车"), (2, None, "财联社快讯：板块回落"), (3, None, "加微信领取课程 持有 仓位"), (4, None, "上涨 下跌")]
    got = {r.content_id: r.analysis for r in classify(spark.createDataFrame(rows, "content_id long, title string, body string")).collect()}
    assert (got[1].actor_type, got[1].investor_level, got[1].intent, got[1].direction, got[1].position) == ("retail", "novice", "buy", "bullish", "not_owned")
    assert got[1].novice_signals == ["first_time", "how_to_buy", "seeking_entry"] and got[1].emotion.urgency and got[1].emotion.regret
    assert (got[2].actor_type, got[2].direction) == ("media", "bearish")
    assert got[3].promotion and got[3].position == "owned" and got[3].promotion_confidence == 0.94
    assert got[4].direction == "neutral"


def _registry(spark):
    assets = spark.createDataFrame([(1, "600519"), (2, "AAPL"), (3, "000001")], "asset_id long, symbol string")
    aliases = spark.createDataFrame([("贵州茅台", 1, 10), ("茅台", 1, 20), ("苹果", 2, 10), ("苹果", 3, 10), ("Apple Inc", 2, 30)], "alias string, asset_id long, priority int")
    links = spark.createDataFrame([(1, 11)], "asset_id long, topic_id long")
    terms = spark.createDataFrame([(11, "白酒"), (12, "gold-etf"), (12, "黄金")], "topic_id long, term string")
    return assets, aliases, links, terms


def test_entity_steps(spark):
    assets, aliases, links, terms = _registry(spark)
    posts = spark.createDataFrame(
        [
            (1, "guba", None, "买了贵州茅台股票"), (2, "guba", None, "苹果 6005190 600519x"), (3, "guba", "黄金", "今天"), (4, "zhihu", "晚餐", "黄金 黄金 饰品"),
            (5, "zhihu", "晚餐", "黄金 股票"), (6, "zhihu", "黄金股票", "x"), (7, "guba", None, "code 600519, APPLE  inc"),
        ],
        "content_id long, source string, title string, body string",
    )
    queries = spark.createDataFrame([(1, 12), (4, 12), (2, 12)], "content_id long, topic_id long")
    got = {}
    for r in en.resolve_entities(posts, assets, aliases, links, terms, queries).collect():
        got.setdefault(r.content_id, set()).add((r.entity_type, r.entity_id, r.method))
    assert got[1] == {("asset", 1, "exact_alias"), ("topic", 12, "collection_query"), ("topic", 11, "asset_topic")}
    assert got[2] == {("topic", 12, "collection_query")}
    assert got[3] == {("topic", 12, "exact_alias")}
    assert 4 not in got and 5 not in got
    assert got[6] == {("topic", 12, "exact_alias")}
    assert got[7] == {("asset", 1, "ticker"), ("asset", 2, "normalized_alias"), ("topic", 11, "asset_topic")}


def test_term_walk_agrees_with_brute_force(spark):
    random.seed(1)
    words = ["ab", "abc", "b", "贵州茅台", "茅台", "cab", "zz", "aab", "a" * 90]
    texts = [(i, "norm", "".join(random.choice("abc贵州茅台z ") for _ in range(random.randrange(0, 200))) + "a" * random.choice([0, 95]), random.randrange(0, 9)) for i in range(150)]
    hits = en.term_hits(spark.createDataFrame(texts, "content_id long, field string, text string, border int"), spark.createDataFrame([("norm", w) for w in words] + [("low", "zzz")], "field string, term string"))
    want = {}
    for i, _, t, border in texts:
        for w in words:
            at = [k for k in range(len(t)) if t.startswith(w, k)]
            body = [k for k in at if k >= border]
            if at:
                alone = any(not re.match("[A-Za-z0-9]", t[k - 1 : k] or " ") and not re.match("[A-Za-z0-9]", t[k + len(w) :] or " ") for k in at)
                want[i, w] = (any(k + len(w) <= border for k in at), bool(body), bool(body) and body[-1] - body[0] >= len(w), alone)
    got = hits.collect()
    assert {(r.content_id, r.term): (r.in_title, r.body_hit, r.body_twice, r.clean) for r in got} == want and len(got) == len(want)


def test_term_walk_sends_hits_only(spark):
    """No row for a character, whatever the text; equal keys, null borders and terms over the head length are kept apart."""
    texts = [(1, "norm", "x" * 5000 + "abcdefghij", 0), (1, "norm", "abcdefghijabcdefghij", 10), (2, "norm", "abcdefghix", None), (None, "norm", "zabcdefghij", None), (3, None, "abcdefghij", 0)]
    df = spark.createDataFrame(texts, "content_id long, field string, text string, border int")
    terms = spark.createDataFrame([("norm", "abcdefghij"), ("norm", "abcdefghi"), ("norm", None), (None, "abcdefghij")], "field string, term string")
    hits = en.term_hits(df, terms)
    assert "Generate" not in hits._jdf.queryExecution().executedPlan().toString()
    got = {(r.content_id, r.term): (r.in_title, r.body_hit, r.body_twice, r.clean) for r in hits.collect()}
    assert got == {
        (1, "abcdefghij"): (True, True, True, False), (1, "abcdefghi"): (True, True, True, False),
        (2, "abcdefghi"): (None, False, False, False), (None, "abcdefghij"): (None, False, False, False), (None, "abcdefghi"): (None, False, False, False),
    }


def test_wide_text_is_found(spark):
    assets, aliases, links, terms = _registry(spark)
    posts = spark.createDataFrame([(1, "x", None, "看好黄金ＥＴＦ和ＧＯＬＤ－ＥＴＦ"), (2, "x", "①ﬁ", "ａｐｐｌｅ　ｉｎｃ")], "content_id long, source string, title string, body string")
    got = {(r.content_id, r.entity_type, r.entity_id) for r in en.resolve_entities(posts, assets, aliases, links, terms, spark.createDataFrame([], "content_id long, topic_id long")).collect()}
    assert got == {(1, "topic", 12), (2, "asset", 2)}
    values = ["①ﬁ Straße", "Ａ－ｂ", "é́", "a\u00a0b", "İ", "ſ", None, ""]
    folded = spark.createDataFrame([(v,) for v in values], "v string").select(tx.normalize_text(F.col("v")).alias("n")).collect()
    assert [r.n for r in folded] == [re.sub(r"[\s\-_/]+", "", unicodedata.normalize("NFKC", v or "").strip().casefold()) for v in values]


def test_short_text_topic(spark):
    topics = spark.createDataFrame([(1, "gold", "黄金"), (2, "oil", "原油")], "topic_id long, slug string, name string")
    aliases = spark.createDataFrame([(1, "metal"), (2, "metal"), (2, "crude oil")], "topic_id long, alias string")
    rows = spark.createDataFrame([("GOLD",), ("metal",), ("Crude-Oil",)], "text string")
    assert {r.text: r.topic_id for r in en.resolve_topic_text(rows, topics, aliases).collect()} == {"GOLD": 1, "metal": None, "Crude-Oil": 2}


def _simhash(text):
    low = text.casefold()
    words = re.findall(r"[a-z0-9_]+|[一-鿿]", low) or [low]
    score = [0] * 64
    for w in words:
        value = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        for b in range(64):
            score[b] += 1 if value >> b & 1 else -1
    return sum(1 << b for b in range(64) if score[b] >= 0)


def test_simhash_matches_the_definition(spark):
    texts = ["Hello world hello", "茅台 is up 3_x", "", "!!!", "a b c d e f g", "É only"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(nd.simhash(F.col("t")).alias("f")).collect()
    assert [r.f % (1 << 64) for r in got] == [_simhash(t) for t in texts]


def _greedy(rows, reach=3):
    leaders, out = [], {}
    for i, fp in sorted(rows):
        hit = next(((j, g) for j, g in leaders if bin((fp ^ g) & (2**64 - 1)).count("1") <= reach), None)
        if hit is None:
            leaders.append((i, fp))
            hit = (i, fp)
        out[i] = hit[0]
    return out


def test_clusters_equal_the_sequential_rule(spark):
    random.seed(7)
    rows = []
    for i in range(300):
        if rows and random.random() < 0.7:
            fp = random.choice(rows)[1]
            for _ in range(random.randrange(0, 4)):
                fp ^= 1 << random.randrange(64)
        else:
            fp = random.getrandbits(64)
        rows.append((i, fp))
    signed = [(i, fp - (1 << 64) if fp >= 1 << 63 else fp) for i, fp in rows]
    got = nd.cluster_contents(spark.createDataFrame(signed, "content_id long, fingerprint long"))
    found = got.collect()
    assert {r.content_id: r.leader_id for r in found} == _greedy(rows)
    assert max(r.distance for r in found) <= 3


def test_topics_of_collection_queries(spark):
    posts = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "z")], "content_id long, source string, source_item_id string")
    raw = spark.createDataFrame([(10, "a", "x"), (11, "a", "x"), (12, "b", "x"), (13, "a", "y"), (14, "a", None)], "raw_id long, source string, source_item_id string")
    links = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 3), (13, 1), (14, 1), (12, None)], "raw_id long, topic_id long")
    topics = spark.createDataFrame([(1,), (2,)], "topic_id long")
    assert sorted(map(tuple, en.collection_topics(posts, raw, links, topics).collect())) == [(1, 1), (1, 2)]


def test_groups_are_decided_alike_in_a_task_and_in_rounds(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))) for c in centres for _ in range(40)}
    ids = draw.sample(range(10_000), len(prints))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, sorted(prints), strict=True)]
    nodes = spark.createDataFrame([*rows, (None, 5)], "node long, fp long")
    leaders, want = [], {}
    for i, p in sorted(rows):
        near = [j for j, q in leaders if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3]
        want[i] = near[0] if near else i
        leaders += [] if near else [(i, p)]
    for whole in (1000, 10):
        got = nd.greedy_leaders(nodes, whole=whole).collect()
        assert {r.node: r.leader for r in got} == {**want, None: None} and len(got) == len(rows) + 1


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def _chain(draw, length):
    """Fingerprints of which each is three bits from the next."""
    value, out = draw.getrandbits(64), []
    for _ in range(length):
        out.append(value)
        value ^= sum(1 << b for b in draw.sample(range(64), 3))
    return list(dict.fromkeys(out))


def test_estimated_sizes_do_not_grow_with_the_rounds(spark):
    # One group that needs several rounds, whether a task or rounds decide it.
    rows = [(i * 37 % 101, _signed(v)) for i, v in enumerate(_chain(random.Random(4), 100))]
    for whole in (1000, 10):
        found = nd.greedy_leaders(spark.createDataFrame(rows, "node long, fp long"), whole=whole)
        # Hundreds of bits before, more with every round, in the driver's heap.
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
        assert {r.node: r.leader for r in found.collect()} == _greedy(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(i, _signed(v)) for i, v in enumerate(_chain(random.Random(8), 300))]
    tables, whole = [], nd.written
    monkeypatch.setattr(nd, "written", lambda df: tables.append(df) or whole(df))
    assert {r.node: r.leader for r in nd.greedy_leaders(spark.createDataFrame(rows, "node long, fp long")).collect()} == _greedy(rows)
    assert len(tables) < 40


def test_a_key_of_many_rows_is_dealt_and_no_pair_comes_twice(spark):
    draw = random.Random(12)
    centre = draw.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in draw.sample(range(12), draw.randrange(5))) for _ in range(400)})
    # Equal nodes follow their fingerprints.
    rows = sorted((draw.randrange(150), _signed(p)) for p in prints)
    nodes = spark.createDataFrame(draw.sample(rows, len(rows)), "node long, fp long")
    wanted = sorted((n, p, q) for i, (n, p) in enumerate(rows) for _, q in rows[i + 1 :] if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3)
    for block in (2048, 16):
        assert sorted(map(tuple, nd._pairs(nodes, 3, block).collect())) == wanted
    place = [(i, p) for i, (_, p) in enumerate(rows)]
    led = _greedy(place)
    found = {r.fp: (r.leader, r.leader_fp) for r in nd.greedy_leaders(nodes, block=16).collect()}
    assert found == {p: rows[led[i]] for i, p in place}
