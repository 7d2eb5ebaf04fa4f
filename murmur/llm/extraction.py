"""Operator 8, HTML extraction: a recurrent block labeller.

A page is a sequence of leaf blocks. Each block gives a vector of its hashed tag
path, its hashed words and a few measures; a bidirectional LSTM in numpy reads the
sequence both ways and labels every block, so a block is judged in the context of
the whole page.

The labeller is trained here, on a bounded sample of pages whose markup names the
article plainly (``article`` or ``main``) and on composed pages of many layouts,
which hold all kinds of boilerplate around and inside an article.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.blocks import Block, Place, blocks
from murmur.llm.common import query, table

#: Buckets of path tokens and of words, measures, hidden units of each direction.
PATHS, WORDS, MEASURES, HIDDEN = 256, 32, 8, 16
#: Pages of the sample, composed pages, rounds, pages of a training step, blocks read at once.
SAMPLE, COMPOSED, ROUNDS, STEP, READ = 150, 600, 12, 32, 20_000
#: Class words of boilerplate and of articles.
BOILERPLATE = (
    "nav", "menu", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "cookie", "consent",
    "notice", "alert", "popup", "comment", "comments", "reply", "discussion", "form", "login", "search", "subscribe", "newsletter", "related", "recommended", "share", "social",
    "breadcrumb", "breadcrumbs", "widget", "toolbar", "hidden", "copyright", "legal", "disclaimer", "pagination", "tags",
)
ARTICLE = ("article", "main", "content", "post", "entry", "story", "body", "text")
MARK = "⁠"
WORD = re.compile(r"\w+")
FEATURES = PATHS + WORDS + MEASURES


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


def _path_key(place: Place | None) -> tuple[int, str | None]:
    """(bits of the path's buckets, innermost tag); a place is read once however many blocks share it."""
    if place is None:
        return 0, None
    fresh = []
    for at in place.up():
        if at.hot is not None:
            break
        fresh.append(at)
    for at in reversed(fresh):
        at.hot = at.parent.hot if at.parent else 0
        for token in at.tokens:
            at.hot |= 1 << _bucket(token, PATHS)
    return place.hot, place.tokens[0]


def _path_vector(key: tuple[int, str | None]) -> np.ndarray:
    hot, tag = key
    out = np.array([hot >> k & 1 for k in range(PATHS)], dtype="f4")
    if tag is not None:
        out[_bucket("leaf " + tag, PATHS)] = 1
    return out


def _rest_vector(page: list[Block], i: int, hashes: dict[str, int]) -> np.ndarray:
    block = page[i]
    out = np.zeros(WORDS + MEASURES, dtype="f4")
    words = WORD.findall(block.text)
    for word in words:
        at = hashes.get(word)
        if at is None:
            at = _bucket(word.lower(), WORDS)
            if len(hashes) < 200_000:
                hashes[word] = at
        out[at] += 1
    out[:WORDS] /= max(len(words), 1)
    n = len(block.text)
    out[WORDS:] = (
        np.log1p(n) / 8, min(1.0, block.linked / max(block.size, 1)), i / max(len(page) - 1, 1), float(block.text[-1] in ".!?:;…"),
        sum(block.text.count(c) for c in ",.;") / max(len(words), 1), len(words) < 5, "©" in block.text, (block.place.length if block.place else 0) / 16,
    )
    return out


class Labeller:
    """Weights of the two directions and of the output; about 80 kilobytes."""

    def __init__(self, seed: int = 42):
        draw = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for d in ("f", "b"):
            self.w["x" + d] = (draw.standard_normal((FEATURES, 4 * h)) * 0.1).astype("f4")
            self.w["h" + d] = (draw.standard_normal((h, 4 * h)) * 0.2).astype("f4")
            self.w["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype("f4")
        self.w["out"] = (draw.standard_normal(2 * h) * 0.2).astype("f4")
        self.w["bias"] = np.zeros(1, dtype="f4")

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, inputs: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction over (pages, blocks); padding leaves the state as it is."""
        b, t, _ = inputs.shape
        h, c = np.zeros((b, HIDDEN), dtype="f4"), np.zeros((b, HIDDEN), dtype="f4")
        states, saved = np.zeros((b, t, HIDDEN), dtype="f4"), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inputs[:, k] + h @ self.w["h" + d]
            gates = self._sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[:, k, None]
            if keep:
                saved.append((k, i, f, o, g, c, tanh_c, h))
            h, c = np.where(m, o * tanh_c, h), np.where(m, new_c, c)
            states[:, k] = h
        return states, saved

    def logits(self, projected: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(projected[d], mask, d, False)[0] for d in ("f", "b")], axis=2)
        return states @ self.w["out"] + self.w["bias"][0]

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch by back-propagation through time."""
        runs = {d: self._run(x @ self.w["x" + d] + self.w["c" + d], mask, d, True) for d in ("f", "b")}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = self._sigmoid(states @ self.w["out"] + self.w["bias"][0])
        n = max(mask.sum(), 1)
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n
        error = ((p - y) * mask / n).astype("f4")
        grads = {"out": np.einsum("bt,bth->h", error, states), "bias": np.array([error.sum()], dtype="f4")}
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            to_state = error[:, :, None] * self.w["out"][part]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype="f4")
            grads["h" + d] = np.zeros_like(self.w["h" + d])
            dh, dc = np.zeros((len(x), HIDDEN), dtype="f4"), np.zeros((len(x), HIDDEN), dtype="f4")
            for k, i, f, o, g, c, tanh_c, h in reversed(runs[d][1]):
                m = mask[:, k, None]
                full = dh + to_state[:, k]
                new_c = dc + full * o * (1 - tanh_c**2)
                dz = np.concatenate([new_c * g * i * (1 - i), new_c * c * f * (1 - f), full * tanh_c * o * (1 - o), new_c * i * (1 - g**2)], axis=1) * m
                dz_all[:, k] = dz
                grads["h" + d] += h.T @ dz
                dh, dc = np.where(m, dz @ self.w["h" + d].T, full), np.where(m, new_c * f, dc)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads["x" + d] = x.reshape(-1, FEATURES).T @ flat
            grads["c" + d] = flat.sum(axis=0)
        return float(loss), grads


def _composed(words: list[str], draw: random.Random) -> str:
    """A page of a random layout; every article text carries ``MARK``."""
    def say(n: int) -> str:
        return " ".join(draw.choice(words) for _ in range(n))

    def sentence(low: int = 4, high: int = 60) -> str:
        return say(draw.randint(low, high)).capitalize() + draw.choice((".", ".", ".", "", "!", "?"))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{draw.choice(words)}">{say(draw.randint(1, 3))}</a></li>' for _ in range(n))

    def named(name: str) -> str:
        prefix = draw.choice(("", "", "", "site-", "page_", "c-", "left-"))
        return draw.choice((f'class="{prefix}{name}"', f'id="{name}"', f'class="box {name}"', f'class="{name}-{draw.choice(("wrap", "inner", "block", "list", "area"))}"'))

    def clutter() -> str:
        kind = draw.randrange(12)
        if kind == 0:
            return f'<nav {draw.choice(("", named("menu")))}><ul>{links(draw.randint(2, 8))}</ul></nav>'
        if kind == 1:
            return f'<div {named(draw.choice(("menu", "breadcrumb", "breadcrumbs", "tags", "pagination", "toolbar")))}><ul>{links(draw.randint(2, 6))}</ul></div>'
        if kind == 2:
            return f'<header {draw.choice(("", named("header")))}><div>{say(2)}</div><a href="/">{say(1)}</a></header>'
        if kind == 3:
            return f'<div {named(draw.choice(("header", "masthead", "banner")))}><h2>{say(3)}</h2><p>{sentence(3, 12)}</p></div>'
        if kind == 4:
            return f'<div {named(draw.choice(("ad", "ads", "advert", "advertisement", "sponsor", "promo")))}>{draw.choice(("", "<p>"))}{sentence(3, 40)}</div>'
        if kind == 5:
            return f'<div {named(draw.choice(("cookie", "consent", "notice", "alert", "popup", "disclaimer", "legal")))}><p>{sentence(5, 40)}</p><button>{say(1)}</button></div>'
        if kind == 6:
            return f'<aside {draw.choice(("", named("sidebar")))}><h3>{say(2)}</h3><ul>{links(3)}</ul><p>{sentence(5, 40)}</p></aside>'
        if kind == 7:
            return f'<div {named(draw.choice(("sidebar", "widget", "related", "recommended", "share", "social")))}><h3>{say(2)}</h3><p>{sentence(4, 40)}</p><ul>{links(draw.randint(0, 4))}</ul></div>'
        if kind == 8:
            return f'<form {draw.choice(("", named(draw.choice(("login", "search", "subscribe", "newsletter")))))}><label>{say(2)}</label><p>{sentence(3, 15)}</p><select><option>{say(1)}</option></select><button>{say(1)}</button></form>'
        if kind == 9:
            tag = draw.choice(("div", "li", "article", "blockquote"))
            entry = lambda: f'<{tag} class="comment"><b>{say(1)}</b><p>{sentence(5, 60)}</p></{tag}>'
            return f'<section {named(draw.choice(("comments", "comment", "discussion", "reply")))}><h3>{say(2)}</h3>{"".join(entry() for _ in range(draw.randint(1, 5)))}</section>'
        if kind == 10:
            return f'<footer {draw.choice(("", named("footer")))}>{draw.choice(("&copy; ", ""))}{sentence(3, 25)}{draw.choice(("", "<p>" + sentence(3, 20) + "</p>"))}</footer>'
        return f'<div {named(draw.choice(("footer", "copyright")))}><p>&copy; {sentence(3, 20)}</p><ul>{links(3)}</ul></div>'

    def paragraph() -> str:
        kind = draw.randrange(10)
        text = MARK + draw.choice((sentence(1, 8), sentence(8, 120), sentence(20, 120)))
        if kind < 5:
            return f"<p>{text}" + draw.choice(("</p>", "</p>", "", "<br>"))
        if kind == 5:
            return f'<p>{text} <a href="/{draw.choice(words)}">{say(2)}</a> {say(4)}</p>'
        if kind == 6:
            return f"<p><b>{text}</b><br>{say(5)}</p>"
        if kind == 7:
            tag = draw.choice(("h2", "h3", "blockquote", "pre"))
            return f"<{tag}>{text}</{tag}>"
        if kind == 8:
            return "<ul>" + "".join(f"<li>{MARK}{sentence(2, 20)}</li>" for _ in range(draw.randint(1, 4))) + "</ul>"
        return draw.choice((f"<table><tr><td>{text}</td><td>{MARK}{say(3)}</td></tr></table>", f"<div>{text}</div>", f"<figure><figcaption>{text}</figcaption></figure>"))

    inner = f"<h1>{MARK}{say(draw.randint(1, 9))}</h1>" if draw.random() < 0.8 else ""
    for _ in range(draw.randint(0, 9)):
        inner += paragraph()
        if draw.random() < 0.3:
            # Clutter may stand in the midst of an article, which goes on behind it.
            inner += draw.choice((clutter(), clutter(), f'<div {named(draw.choice(("ad", "advert", "promo", "share", "related", "newsletter")))}>{sentence(2, 25)}</div>', f"<aside>{sentence(3, 25)}</aside>"))
    box = draw.choice(("article", "article", "article", "main", "div", "div", "section"))
    name = named(draw.choice(ARTICLE)) if box in ("div", "section") or draw.random() < 0.3 else ""
    body = f"<{box} {name}>{inner}</{box}>"
    if draw.random() < 0.4:
        body = f'<{draw.choice(("main", "div"))} {draw.choice(("", named("content"), named("wrapper"), named("container")))}>{clutter() if draw.random() < 0.3 else ""}{body}{clutter() if draw.random() < 0.4 else ""}</div>'
    before, after = (("".join(clutter() for _ in range(draw.randint(0, 4)))) for _ in range(2))
    return f"<html><head><title>{say(4)}</title></head><body>{before}{body}{after}</body></html>"


def _plain_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page whose markup has an article; None if it has none."""
    in_article = [("article" in b.path or "main" in b.path) for b in page]
    if not any(in_article):
        return None
    clutter = {"nav", "aside", "footer", "form", "header", *("." + w for w in BOILERPLATE)}
    return [int(inside and not clutter.intersection(b.path)) for inside, b in zip(in_article, page, strict=True)]


def train(pages: list[str]) -> Labeller:
    """A labeller from sample pages and composed pages; the same for the same pages."""
    draw = random.Random(42)
    known = [blocks(h) for h in pages]
    words = sorted({w for page in known for b in page for w in WORD.findall(b.text)[:200]})[:5000] or ["one", "two", "three", "four", "five", "six", "seven"]
    examples = [(page, labels) for page in known if len(page) <= 80 and (labels := _plain_labels(page)) is not None]
    for _ in range(COMPOSED):
        page = blocks(_composed(words, draw))
        labels = [int(MARK in b.text) for b in page]
        for b in page:
            b.text = b.text.replace(MARK, "").strip() or "-"
        examples.append((page, labels))
    hashes: dict[str, int] = {}
    vectors = [np.stack([np.concatenate([_path_vector(_path_key(b.place)), _rest_vector(page, i, hashes)]) for i, b in enumerate(page)]) if page else None for page, _ in examples]
    data = [(v, np.array(labels, dtype="f4")) for v, (_, labels) in zip(vectors, examples, strict=True) if v is not None]
    model, moments, t = Labeller(), {}, 0
    for _ in range(ROUNDS):
        # Pages of like length share a step, so that little is padded.
        data.sort(key=lambda p: (len(p[1]), draw.random()))
        steps = [data[k : k + STEP] for k in range(0, len(data), STEP)]
        draw.shuffle(steps)
        for part in steps:
            longest = len(part[-1][1])
            x, y, mask = np.zeros((len(part), longest, FEATURES), dtype="f4"), np.zeros((len(part), longest), dtype="f4"), np.zeros((len(part), longest), dtype="f4")
            for j, (v, labels) in enumerate(part):
                x[j, : len(v)], y[j, : len(v)], mask[j, : len(v)] = v, labels, 1
            _, grads = model.step(x, y, mask)
            t += 1
            for name, grad in grads.items():
                m, s = moments.get(name, (0.0, 0.0))
                m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
                moments[name] = (m, s)
                model.w[name] = (model.w[name] - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-7)).astype("f4")
    return model


def label(pages: list[list[Block]], model: Labeller, paths: dict, hashes: dict[str, int]) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    w_path = np.concatenate([model.w["xf"][:PATHS], model.w["xb"][:PATHS]], axis=1)
    w_rest = np.concatenate([model.w["xf"][PATHS:], model.w["xb"][PATHS:]], axis=1)
    constant = np.concatenate([model.w["cf"], model.w["cb"]])

    def of_place(place: Place | None) -> np.ndarray:
        key = _path_key(place)
        found = paths.get(key)
        if found is None:
            found = _path_vector(key) @ w_path
            if len(paths) < 50_000:
                paths[key] = found
        return found

    k = 0
    while k < len(order):
        chosen = [order[k]]
        k += 1
        while k < len(order) and (len(chosen) + 1) * len(pages[order[k]]) <= READ:
            chosen.append(order[k])
            k += 1
        longest = len(pages[chosen[-1]])
        inputs, mask = np.zeros((len(chosen), longest, 8 * HIDDEN), dtype="f4"), np.zeros((len(chosen), longest), dtype="f4")
        for j, i in enumerate(chosen):
            page = pages[i]
            rest = np.stack([_rest_vector(page, b, hashes) for b in range(len(page))])
            inputs[j, : len(page)] = np.stack([of_place(b.place) for b in page]) + rest @ w_rest + constant
            mask[j, : len(page)] = 1
        z = model.logits({"f": inputs[:, :, : 4 * HIDDEN], "b": inputs[:, :, 4 * HIDDEN :]}, mask)
        for j, i in enumerate(chosen):
            out[i] = z[j, : len(pages[i])] > 0
    return out


def fit(pages: DataFrame) -> Labeller:
    """A labeller from at most ``SAMPLE`` pages (smallest id digests) of ordinary length, the same on every run."""
    short = pages.where((F.length("html") <= 20_000) & F.col("page_id").isNotNull())
    ids = short.select(F.col("page_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # At most SAMPLE ids go out and SAMPLE pages come back, whatever the number of tasks.
    chosen = short.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(ids), F.col("page_id") == F.col("_id"), "left_semi")
    return train([r["html"] for r in chosen.groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()])


def extracted(pages: DataFrame, model: Labeller) -> DataFrame:
    """Main text of every row from its whole html.

    Main blocks are joined in page order by a line break. A null or empty page,
    or one without main blocks, has an empty text. Broken markup is read as far as
    it goes. Repeated rows stay, ids and URLs may be null, an empty table gives no
    rows, extra columns are not read. Returns page_id, url, text, n_chars.
    """

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        paths, hashes = {}, {}
        for column in batches:
            found = []
            for k in range(0, len(column), 500):
                read = [blocks(h) for h in column.iloc[k : k + 500]]
                for page, main in zip(read, label(read, model, paths, hashes), strict=True):
                    found.append("\n".join(b.text for b, yes in zip(page, main, strict=True) if yes))
            yield pd.Series(found, dtype="object")

    rows = pages.select("page_id", "url", main_text(F.col("html").cast("string")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_extraction")
def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
