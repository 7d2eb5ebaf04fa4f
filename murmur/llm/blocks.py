"""Leaf blocks of an HTML page with the path of open elements; tolerant of broken markup."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

#: Elements that begin a block of text, that never close, and whose text is no page text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style title noscript template svg iframe object textarea".split())
#: Elements that an opening tag of the same group closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Place:
    """An open element behind the ones around it; blocks share places, so a deep page costs one place an element."""

    __slots__ = ("parent", "tokens", "length", "hot")

    def __init__(self, parent: Place | None, tokens: tuple[str, ...]):
        self.parent, self.tokens = parent, tokens
        self.length = len(tokens) + (parent.length if parent else 0)
        #: Kept by readers of the path: what they made of the tokens up to here.
        self.hot: int | None = None

    def up(self) -> Iterator[Place]:
        """This place and the ones around it, innermost first."""
        at: Place | None = self
        while at is not None:
            yield at
            at = at.parent


class Block:
    """Text of a block, the place of its elements, and how much of it is linked."""

    __slots__ = ("text", "place", "linked", "size")

    def __init__(self, text: str, place: Place | None, linked: int, size: int):
        self.text, self.place, self.linked, self.size = text, place, linked, size

    @property
    def path(self) -> tuple[str, ...]:
        """All path tokens, outermost first; made anew at each call."""
        return tuple(t for p in reversed(list(self.place.up() if self.place else ())) for t in p.tokens)


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for m in NAMES.finditer(attributes):
            out += ["." + part.lower() for part in PART.findall(m.group(1) or m.group(2) or m.group(3) or "")]
        if HIDDEN.search(attributes):
            out.append(".hidden")
    return tuple(out)


def blocks(html: str | None) -> list[Block]:
    """Blocks in page order; references decoded, white space folded, empty blocks left out.

    Each element is opened and closed once, so nested and unclosed elements cost no
    more than others.
    """
    if not html:
        return []
    #: Open elements: tag, place, and where the nearest block element among them stands (-1: none).
    stack: list[tuple[str, Place | None, int]] = []
    opened: Counter[str] = Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    at, where = 0, None

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, where, linked, sum(map(len, parts))))
        parts, linked = [], 0

    def leave(k: int) -> None:
        for tag, _, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    silent = ""
    while at < len(html):
        m = TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at and not silent:
            if not parts:
                where = stack[-1][1] if stack else None
            parts.append(html[at:end])
            linked += (end - at) if opened["a"] else 0
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        closing, tag = bool(m.group(1)), m.group(2).lower()
        if silent:
            silent = "" if closing and tag == silent else silent
            continue
        if tag in SILENT_TAGS:
            if not closing and not m.group(3).rstrip().endswith("/"):
                # Its text ends at its own closing tag only.
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            continue
        if tag == "br":
            parts.append(" ") if parts else None
            continue
        if tag in BLOCK_TAGS:
            close()
        if closing:
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in VOID_TAGS:
            continue
        near = stack[-1][2] if stack else -1
        if tag in BLOCK_TAGS and near >= 0 and (stack[near][0] == "p" or stack[near][0] in CLOSED_BY.get(tag, ())):
            # An open paragraph ends at the next block, with the inline elements in it.
            leave(near)
            near = stack[-1][2] if stack else -1
        tokens, around = _tokens(tag, m.group(3)), stack[-1][1] if stack else None
        place = Place(around, tokens) if tag in BLOCK_TAGS or len(tokens) > 1 else around
        stack.append((tag, place, len(stack) if tag in BLOCK_TAGS else near))
        opened[tag] += 1
    close()
    return out
