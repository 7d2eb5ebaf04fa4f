from __future__ import annotations

import time

from murmur.llm import urls


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for kind, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (kind, h + p)
    return host, path, best and best[1], best[0] if best else "allow"


def test_every_url_gets_its_longest_rule(spark):
    made = [
        None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net/q?x=/en/", "http://example.net/en/", "https://www.Example.NET/en/1#t",
        "http://example.net/en", "http://badexample.com/de/1", "http://x.example.com/de/", "ftp://example.com/de", "http://a.org/fr//x", "http://org?/fr/", "http://..net/", "x://y://z.net/",
        "http://a.b.c.d.net/" + "p/" * 300, "http://ü.net/ñ/", "http://a.net/\nx",
    ]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate([*made, *made])] + [(None, "http://net/", None, None)], "page_id long, url string, host string, rule string")
    found = urls.judged(pages, urls.rule_table(spark)).collect()
    assert len(found) == 2 * len(made) + 1
    both = [*made, *made]
    for r in found:
        url = both[r["page_id"]] if r["page_id"] is not None else "http://net/"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(url), url
    assert urls.judged(pages.limit(0), urls.rule_table(spark)).collect() == []


def test_rules_need_not_end_in_a_slash(spark):
    pages = spark.createDataFrame([(1, "http://a.b/abcdef"), (2, "http://a.b/abx/abd"), (3, "http://a.b/ab")], "page_id long, url string")
    rules = urls.rule_table(spark, [("block", "a.b", "/abc"), ("allow", "b", "/abx/a"), ("block", "b", "")])
    assert {r["page_id"]: r["rule"] for r in urls.judged(pages, rules).collect()} == {1: "a.b/abc", 2: "b/abx/a", 3: "b"}


def test_long_paths_and_hosts_take_linear_time(spark):
    made = ["http://x.net/en/" + "/" * 100_000 + "z", "http://" + "a." * 50_000 + "example.com/de/" + "p/" * 50_000, "http://" + "." * 100_000 + "/"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    start = time.monotonic()
    found = urls.judged(pages, urls.rule_table(spark)).collect()
    assert time.monotonic() - start < 20
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in found} == {(0, "net/", "block"), (1, "example.com/de/", "block"), (2, None, "allow")}


def test_drawn_urls_meet_drawn_rules(spark):
    import random

    draw = random.Random(7)
    host = lambda n: ".".join(draw.choice(("a", "b", "")) for _ in range(draw.randint(1, n)))
    path = lambda n: "".join(draw.choice(("/", "x", "/y", "//")) for _ in range(draw.randint(0, n)))
    rules = sorted({(draw.choice(("block", "allow")), h, path(5)) for _ in range(60) if (h := host(3))})
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    made = [(i, f"http://{host(5)}{'/' if i % 2 else ''}{path(7)}") for i in range(400)]
    found = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(made, "page_id long, url string"), urls.rule_table(spark, rules)).collect()}
    for i, _ in made:
        h, p = found[i]["host"], found[i]["path"]
        fits = [(len(rh + rp), len(rh), v == "block", rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and h and p.startswith(rp)]
        best = max(fits, default=None)
        assert (found[i]["rule"], found[i]["verdict"]) == ((best[3], best[4]) if best else (None, "allow"))


def test_no_rules_reject_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.judged(pages, urls.rule_table(spark).limit(0)).collect()] == [(None, "allow")]
