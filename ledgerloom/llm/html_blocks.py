"""Leaf blocks of a web page with their ancestors, from a tolerant reading of the tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_TOKEN = re.compile(r"[a-z]+")

# Tags of HTML by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea head".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr""".split()
)
CLOSED_BY_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                    "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select body article section div".split())


@dataclass
class Block:
    """Text between two block tags, and the elements open around it."""

    text: str
    leaf: str
    tags: frozenset[str]
    names: frozenset[str]
    hidden: bool
    linked: int  # characters inside links


class _Open:
    """The open elements, with counts of their tags and names, so that neither depends on the depth."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.stack: list[tuple[str, frozenset[str], bool]] = []
        self.tags: Counter = Counter()
        self.names: Counter = Counter()
        self.hidden = 0
        self._around: tuple | None = None

    def push(self, tag: str, attrs: str) -> None:
        names = names_of(attrs) if attrs else frozenset()
        if self.known is not None:
            names &= self.known
        hidden = bool(attrs) and bool(_HIDDEN.search(attrs))
        self.stack.append((tag, names, hidden))
        self.tags[tag] += 1
        self.names.update(names)
        self.hidden += hidden
        self._around = None

    def pop_to(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        """Close the innermost of ``tags`` and what is open inside it, unless one of ``stop`` is in between."""
        if not any(self.tags[t] for t in tags):
            return
        at = len(self.stack) - 1
        while self.stack[at][0] not in tags:
            if self.stack[at][0] in stop:
                return
            at -= 1
        for tag, names, hidden in self.stack[at:]:
            self.tags[tag] -= 1
            self.names.subtract(names)
            self.hidden -= hidden
        del self.stack[at:]
        self._around = None

    def around(self) -> tuple[str, frozenset[str], frozenset[str], bool]:
        if self._around is None:
            leaf = self.stack[-1][0] if self.stack else ""
            self.tags, self.names = +self.tags, +self.names
            self._around = (leaf, frozenset(self.tags), frozenset(self.names), self.hidden > 0)
        return self._around


def names_of(attrs: str) -> frozenset[str]:
    """Lowered letter runs of an element's class, id and role."""
    found = []
    for match in _NAMES.finditer(attrs):
        found += _TOKEN.findall((match[1] or match[2] or match[3] or "").lower())
    return frozenset(found)


def blocks_of(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order; blocks without text are left out.

    Character references are decoded, white space inside a block is one space.
    Scripts, styles, titles, text fields, comments and the head are left out; where one of
    them is never closed, only its tag is. All other elements are read; one that is never
    closed stays open to the end of what holds it. With ``known`` only those names are kept.
    """
    page = page or ""
    out: list[Block] = []
    around = _Open(known)
    parts: list[str] = []
    unclosed: set[str] = set()
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, *around.around(), linked))
            parts.clear()
        linked = 0

    while at < len(page):
        match = _PART.match(page, at)
        if match is None:  # cannot be read as a tag
            parts.append(page[at])
            at += 1
            continue
        at = match.end()
        if match["text"] is not None:
            parts.append(match["text"])
            if around.tags["a"]:
                linked += len(match["text"])
            continue
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["close"]:
            if tag not in INLINE:
                flush()
            around.pop_to({tag}, frozenset() if tag not in INLINE else SCOPES)
            continue
        if tag in RAW and not match["attrs"].endswith("/"):
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I).search(page, at)
            if end:
                at = end.start() if end[0].lower().startswith("<body") else end.end()
            else:
                unclosed.add(tag)  # nor is any later one
            continue
        if tag == "br":
            parts.append(" ")
        elif tag not in INLINE:
            flush()
            around.pop_to({"p"}, frozenset({"table", "article", "section", "div", "li", "blockquote", "body"}))
            if tag in CLOSED_BY_ITSELF:
                around.pop_to(CLOSED_BY_ITSELF[tag], SCOPES)
        if tag not in VOID and not match["attrs"].endswith("/"):
            around.push(tag, match["attrs"])
    flush()
    return out
