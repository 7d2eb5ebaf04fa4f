from __future__ import annotations

import random
import time

import pytest

from murmur.llm import extraction as ex
from murmur.llm.blocks import blocks


@pytest.fixture(scope="module")
def html(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(html):
    return ex.train(html[:100])


def test_blocks_of_broken_markup():
    text = lambda h: [b.text for b in blocks(h)]
    assert text(None) == [] and text("") == [] and text("<!-- open") == []
    assert text("<p>a<p>b &amp; c&nbsp;&copy</div><script>x<y</script>z") == ["a", "b & c ©", "z"]
    assert text("<article><p>Hi <i>there</i>\n you<br>x") == ["Hi there you x"]
    assert text("a < b and <p>c") == ["a < b and", "c"]
    assert text('<script>var t="</p>";</script><style>p{}</style><p title="a>b">x') == ["x"]
    assert [b.path for b in blocks("<ul><li>a<li>b</ul><p><b>c<div>d")] == [("ul", "li"), ("ul", "li"), ("p",), ("div",)]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


@pytest.mark.parametrize("page,count", [("<div>x" * 170_000, 170_000), ("<div>" * 100_000 + "</x>" * 100_000 + "y", 1), ("<b>" * 100_000 + "<div></div>" * 60_000 + "z", 1)])
def test_a_megabyte_of_open_elements_takes_linear_time(page, count):
    start = time.monotonic()
    assert len(blocks(page)) == count
    assert time.monotonic() - start < 20


#: Pages written by hand with the article that a reader sees in them.
WRITTEN = [
    (
        "<html><body><nav><a href='/'>Home</a><a href='/n'>News</a></nav><article><h1>Storm closes the pass</h1><p>Snow fell all night on the mountain road, and ploughs could not keep up.</p>"
        "<p>The road opens again on Friday, the council said &amp; drivers should wait.</p></article><footer>&copy; 2024 The Valley Post. All rights reserved.</footer></body></html>",
        "Storm closes the pass\nSnow fell all night on the mountain road, and ploughs could not keep up.\nThe road opens again on Friday, the council said & drivers should wait.",
    ),
    (
        "<body><div class='cookie-notice'><p>We use cookies on this site.</p></div><main><p>Bread needs four things: flour, water, salt and time.</p><aside class='sidebar'><h3>Related</h3><ul><li><a href='/x'>Rolls</a></li></ul></aside>"
        "<p>Leave the dough in a cool room until it has doubled.</p></main><section class='comments'><div class='comment'><p>Great recipe, thank you so much!</p></div></section></body>",
        "Bread needs four things: flour, water, salt and time.\nLeave the dough in a cool room until it has doubled.",
    ),
    (
        "<body><div id='top-menu'><ul><li><a href='/'>Index</a></li></ul></div><div class='post-content'><h2>Old harbour</h2><p>The cranes were built in 1911 and still stand.</p><div class='related'><p>More on ships</p></div>"
        "<p>Visitors climb them in summer.</p><blockquote>It is a long way up, one of them said.</blockquote></div><div class='copyright'><p>&copy; Harbour trust</p></div></body>",
        "Old harbour\nThe cranes were built in 1911 and still stand.\nVisitors climb them in summer.\nIt is a long way up, one of them said.",
    ),
    ("<body><header><div>Daily</div></header><nav><ul><li><a href='/'>Start</a></li></ul></nav><form><label>Search</label></form><footer>Imprint</footer></body>", ""),
]


@pytest.mark.parametrize("page,text", WRITTEN)
def test_written_pages_give_their_article(model, page, text):
    page = blocks(page)
    assert "\n".join(b.text for b, main in zip(page, ex.label([page], model, {}, {})[0], strict=True) if main) == text


def test_unseen_pages_are_labelled(html, model):
    wrong = total = 0
    for page, main in zip(map(blocks, html[100:]), ex.label([blocks(h) for h in html[100:]], model, {}, {}), strict=True):
        want = ex._plain_labels(page)
        wrong += sum(bool(a) != bool(b) for a, b in zip(main, want, strict=True))
        total += len(want)
    assert wrong <= 0.002 * total


def test_unseen_layouts_are_labelled(model):
    draw, wrong, total = random.Random(99), 0, 0
    for _ in range(150):
        page = blocks(ex._composed(["lorem", "ipsum", "dolor", "sit", "amet"], draw))
        want = [ex.MARK in b.text for b in page]
        for b in page:
            b.text = b.text.replace(ex.MARK, "").strip() or "-"
        main = ex.label([page], model, {}, {})[0]
        wrong += sum(bool(a) != b for a, b in zip(main, want, strict=True))
        total += len(want)
    assert wrong <= 0.02 * total


def test_gradients_are_right():
    import numpy as np

    draw, model = np.random.default_rng(1), ex.Labeller()
    model.w = {k: v.astype("f8") for k, v in model.w.items()}
    x, mask = draw.standard_normal((2, 4, ex.FEATURES)) * 0.1, np.array([[1, 1, 1, 1], [1, 1, 0, 0]], dtype="f8")
    y = draw.integers(0, 2, (2, 4)).astype("f8")
    _, grads = model.step(x, y, mask)
    for name in ("xf", "hb", "cf", "out"):
        at = tuple(int(draw.integers(0, n)) for n in model.w[name].shape)
        losses = []
        for shift in (1e-4, -2e-4):
            model.w[name][at] += shift
            losses.append(model.step(x, y, mask)[0])
        model.w[name][at] += 1e-4
        assert abs((losses[0] - losses[1]) / 2e-4 - grads[name][at]) < 1e-3


def test_odd_rows(spark, model):
    page = "<article><h1>T</h1><p>Some text of an article, long enough.</p></article>"
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", page, None), (4, "u", page, "t"), (4, "u", page, "t"), (5, "u", "<p>" * 2000 + "x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = ex.extracted(pages, model).collect()
    assert len(found) == 6 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [r["text"] for r in found if r["page_id"] in (1, 2)] == ["", ""]
    assert {r["text"] for r in found if r["page_id"] == 4} == {"T\nSome text of an article, long enough."}
    assert ex.extracted(pages.limit(0), ex.fit(pages.limit(0))).collect() == []
