"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks. Each block has features of its ancestors
(tags, pairs of tags, words of their classes and ids) and of its text (length, share of
links, signs, place in the page). The field weighs features for the two labels, main
text and the rest, and the step from one label to the next; Viterbi finds the best
sequence of labels.

It is trained on labelled pages (``labelled_pages``): page layouts with articles,
menus, headers, footers, sidebars, notices, adverts, forms and comments, in many
arrangements and under many names, whose blocks are labelled as they are made. Their
number is fixed, the likelihood is maximised on the driver, and the weights go
to the tasks, which read pages in Arrow batches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks_of

LANDMARKS = ("article", "main", "section", "div", "header", "footer", "aside", "nav", "form", "table", "figure")


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block."""
    out = []
    for i, b in enumerate(blocks):
        tags = b.tags
        own = ["always", f"leaf:{b.leaf}"]
        own += [f"in:{t}" for t in sorted(tags)]
        own += [f"named:{n}" for n in sorted(b.names)]
        marks = [t for t in LANDMARKS if t in tags]
        own += [f"both:{a}+{c}" for k, a in enumerate(marks) for c in marks[k + 1 :]]
        words = b.text.count(" ") + 1
        own.append(f"words:{min(6, words.bit_length())}")
        share = b.linked / max(1, len(b.text))
        own.append("links:none" if share == 0 else "links:some" if share < 0.6 else "links:all")
        own.append(f"ends:{'stop' if b.text[-1] in '.!?…:;”\"' else 'none'}")
        if b.hidden:
            own.append("hidden")
        if "©" in b.text:
            own.append("copyright")
        own.append(f"place:{4 * i // len(blocks)}")
        out.append(own)
    return out


# --- labelled pages -----------------------------------------------------------

# Names that page templates give to the parts of a page.
NAMES = {
    "article": "article post entry story content article-body post-content entry-content body-text main-content text page-content".split(),
    "nav": "menu nav navbar navigation topnav main-menu breadcrumbs breadcrumb pagination pager tabs toc".split(),
    "header": "header site-header masthead top topbar logo branding page-header hero".split(),
    "footer": "footer site-footer bottom copyright page-footer legal colophon credits".split(),
    "aside": "sidebar aside widget related related-posts rail right-column popular recommended more-stories tags share social".split(),
    "notice": "notice cookie cookie-banner cookie-notice alert consent gdpr banner warning message info popup modal overlay disclaimer".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense ad-slot ad-container commercial".split(),
    "form": "form newsletter subscribe signup search search-form login contact-form poll".split(),
    "comments": "comments comment-list responses discussion replies reader-comments disqus feedback thread".split(),
    "comment": "comment reply response comment-body comment-text".split(),
}
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er in on ur".split()


class _Maker:
    """One page: parts of html, and the texts that are main text."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.main = rng, set()

    def pick(self, things):
        return things[int(self.rng.integers(len(things)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, stop: bool = True) -> str:
        n = int(self.rng.integers(low, high + 1))
        made = ["".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(2, 5)))) for _ in range(n)]
        return " ".join(made).capitalize() + ("." if stop and self.chance(0.85) else "")

    def attrs(self, part: str) -> str:
        key = self.pick(("class", "class", "id"))
        more = " " + self.pick(("wide", "left", "box", "js", "clear")) if key == "class" and self.chance(0.2) else ""
        return f' {key}="{self.pick(NAMES[part])}{more}"'

    def wrap(self, part: str, tags: tuple[str, ...], inner: str) -> str:
        tag = self.pick(tags)
        plain = tag == {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(part)
        return f"<{tag}{'' if plain and self.chance(0.6) else self.attrs(part)}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, False)}</a>' for i in range(int(self.rng.integers(low, high + 1)))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick((" ", " | ")).join(items)

    def paragraph(self, low: int = 1, high: int = 60) -> str:
        text = self.words(low, high)
        tag = self.pick(("p", "p", "p", "p", "div"))
        return f"<{tag}>{text}</{tag}>"

    def said(self, text: str) -> str:
        self.main.add(text)
        return text

    def nav(self) -> str:
        return self.wrap("nav", ("nav", "nav", "div", "ul"), self.links(3, 8))

    def header(self) -> str:
        inner = f"<{(h := self.pick(('h1', 'h2', 'div', 'p', 'span')))}>{self.words(1, 6, False)}</{h}>"
        inner += f"<p>{self.words(3, 12)}</p>" if self.chance(0.5) else ""
        return self.wrap("header", ("header", "header", "div"), inner + (self.nav() if self.chance(0.3) else ""))

    def footer(self) -> str:
        inner = self.pick(("&copy; ", "© ", "", "")) + self.words(2, 14)
        inner = f"<p>{inner}</p>" if self.chance(0.4) else inner
        return self.wrap("footer", ("footer", "footer", "div"), inner + (self.links(2, 5) if self.chance(0.4) else ""))

    def aside(self) -> str:
        inner = f"<h3>{self.words(1, 4, False)}</h3>" if self.chance(0.6) else ""
        inner += self.pick((lambda: self.links(2, 7), self.paragraph, lambda: self.words(2, 25), lambda: self.paragraph() + self.paragraph()))()
        return self.wrap("aside", ("aside", "aside", "div", "section"), inner)

    def notice(self) -> str:
        inner = self.pick((self.paragraph, lambda: self.words(3, 30), lambda: self.paragraph() + f"<button>{self.words(1, 2, False)}</button>"))()
        return self.wrap("notice", ("div", "div", "section", "p", "aside"), inner)

    def ad(self) -> str:
        inner = self.pick((self.paragraph, lambda: self.words(2, 25), lambda: f'<a href="/x">{self.words(2, 10)}</a>'))()
        return self.wrap("ad", ("div", "div", "aside", "section", "p", "ins"), inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4, False)}</label><input type='text'>"
        inner += f"<p>{self.words(2, 20)}</p>" if self.chance(0.5) else ""
        inner += f"<select><option>{self.words(1, 2, False)}</option><option>{self.words(1, 2, False)}</option></select>" if self.chance(0.3) else ""
        inner += f"<button>{self.words(1, 2, False)}</button>" if self.chance(0.7) else ""
        inner = f"<form action='/s'>{inner}</form>"
        return self.wrap("form", ("div",), inner) if self.chance(0.3) else inner

    def comments(self) -> str:
        inner = f"<h2>{self.words(1, 3, False)}</h2>" if self.chance(0.6) else ""
        for _ in range(int(self.rng.integers(1, 5))):
            body = f"<p>{self.words(2, 50)}</p>"
            body = (f"<b>{self.words(1, 2, False)}</b>" if self.chance(0.4) else "") + body
            inner += self.pick((f"<div{self.attrs('comment')}>{body}</div>", f"<li>{body}</li>", body, f"<article{self.attrs('comment')}>{body}</article>"))
        return self.wrap("comments", ("section", "div", "div", "ol", "aside"), inner)

    def story(self) -> str:
        def text(low: int, high: int) -> str:
            return self.said(self.words(low, high))

        out = []
        if self.chance(0.8):
            title = f"<h1>{self.said(self.words(1, 10, False))}</h1>"
            out.append(f"<header>{title}</header>" if self.chance(0.15) else title)
        for _ in range(int(self.rng.integers(2, 12))):
            kind = self.rng.random()
            if kind < 0.68:
                before = self.pick(("<p>", "<p>", "<p>", "<p><b>", "<div>"))
                out.append(before + text(1, 60) + self.pick(("</p>", "</p>", "</b></p>", "<br>")) if before != "<div>" else f"<div>{text(3, 60)}</div>")
            elif kind < 0.76:
                out.append(f"<h2>{self.said(self.words(1, 6, False))}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{text(1, 15)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{text(4, 30)}</blockquote>")
            elif kind < 0.88:
                out.append(f"<table><tr><td>{text(1, 5)}</td><td>{text(1, 5)}</td></tr></table>")
            elif kind < 0.90:
                out.append(f"<pre>{text(3, 15)}</pre>")
            elif kind < 0.92:
                out.append(f"<figure><img src='x'><figcaption>{text(3, 12)}</figcaption></figure>")
            else:
                out.append(self.pick((self.ad, self.notice, self.form, self.aside, self.nav))())
        if self.chance(0.12):
            out.append(self.comments())
        if self.chance(0.1):
            out.append(f"<footer>{self.words(2, 10)}</footer>")
        inner = "".join(out)
        shell = self.rng.random()
        if shell < 0.5:
            inner = f"<article{self.attrs('article') if self.chance(0.3) else ''}>{inner}</article>"
        elif shell < 0.65:
            inner = f"<main>{inner}</main>"
        elif shell < 0.9:
            inner = f"<div{self.attrs('article')}>{inner}</div>"
        else:
            inner = f"<section{self.attrs('article')}>{inner}</section>"
        return f"<main>{inner}</main>" if self.chance(0.2) and "<main>" not in inner else inner

    def page(self) -> tuple[str, set[str]]:
        before = [f() for f in (self.header, self.nav, self.notice, self.ad, self.form, self.aside) if self.chance(0.45)]
        after = [f() for f in (self.aside, self.comments, self.ad, self.form, self.notice, self.nav) if self.chance(0.35)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        body = "".join(before) + self.story() + "".join(after) + (self.footer() if self.chance(0.85) else "")
        if self.chance(0.3):
            body = f'<div class="{self.pick(("page", "wrapper", "container", "site"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>", self.main


def labelled_pages(pages: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of made pages and their labels, 1 for main text."""
    out = []
    for i in range(pages):
        page, main = _Maker(np.random.default_rng([seed, i])).page()
        blocks = blocks_of(page)
        out.append((blocks, np.array([b.text in main for b in blocks], dtype=np.int64)))
    return [x for x in out if len(x[0])]


# --- the field ----------------------------------------------------------------


def train(pages: int = 900, seed: int = 3, ridge: float = 0.05, steps: int = 150, rate: float = 0.1) -> tuple[dict[str, float], np.ndarray]:
    """(weight of each feature for label 1 against 0, 2 x 2 weights of the steps between labels)."""
    return _train(pages, seed, ridge, steps, rate)


@functools.lru_cache(maxsize=2)
def _train(pages: int, seed: int, ridge: float, steps: int, rate: float) -> tuple[dict[str, float], np.ndarray]:
    made = labelled_pages(pages, seed)
    rows = [features(b) for b, _ in made]
    place = {f: i for i, f in enumerate(sorted({f for page in rows for own in page for f in own}))}
    n, longest = len(made), max(len(b) for b, _ in made)
    at = np.array([place[f] for page in rows for own in page for f in own])
    row = np.array([p * longest + i for p, page in enumerate(rows) for i, own in enumerate(page) for _ in own])
    y = np.zeros((n, longest), dtype=np.int64)
    real = np.zeros((n, longest), dtype=bool)
    for p, (_, labels) in enumerate(made):
        y[p, : len(labels)], real[p, : len(labels)] = labels, True
    theta = np.zeros(len(place) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    both = real[:, 1:]
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for step in range(1, steps + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.bincount(row, weights=w[at], minlength=n * longest).reshape(n, longest)
        scores = np.stack([np.zeros_like(emit), emit], axis=2)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + move[0], ahead[:, t - 1, 1, None] + move[1]) + scores[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        back = np.zeros((n, longest, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            after = scores[:, t + 1] + back[:, t + 1]
            new = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
            ok = real[:, t + 1]
            back[:, t] = np.where(ok[:, None], new, 0.0)
            pair = ahead[:, t, :, None] + move[None] + after[:, None, :] - total[:, None, None]
            expected += np.exp(pair[ok]).sum(axis=0)
        p = np.where(real, np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None]), 0.0)
        off = ((p - y) * real).ravel()
        grad = np.append(np.bincount(at, weights=off[row], minlength=len(place)), (expected - seen).ravel()) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {f: float(theta[i]) for f, i in place.items()}, theta[-4:].reshape(2, 2)


def decode(blocks: list[Block], weights: dict[str, float], move: np.ndarray) -> list[int]:
    """The best labels of a page's blocks, by Viterbi; ties go to the rest."""
    if not blocks:
        return []
    (m00, m01), (m10, m11) = move.tolist()
    zero, one, steps = 0.0, 0.0, []
    for i, own in enumerate(features(blocks)):
        emit = sum(weights.get(f, 0.0) for f in own)
        if i == 0:
            zero, one = 0.0, emit
            continue
        from_one_0, from_one_1 = one + m10 > zero + m00, one + m11 > zero + m01
        steps.append((from_one_0, from_one_1))
        zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + emit
    label = int(one > zero)
    out = [label]
    for step in reversed(steps):
        label = int(step[label])
        out.append(label)
    return out[::-1]


_names: dict[int, tuple[dict, frozenset[str]]] = {}


def _known_names(weights: dict[str, float]) -> frozenset[str]:
    """Names that have a weight; the others change no label."""
    held = _names.get(id(weights))
    if held is None or held[0] is not weights:
        _names.clear()
        held = _names[id(weights)] = (weights, frozenset(f[6:] for f in weights if f.startswith("named:")))
    return held[1]


def main_text(page: str | None, weights: dict[str, float], move: np.ndarray) -> str:
    blocks = blocks_of(page, _known_names(weights))
    return "\n\n".join(b.text for b, label in zip(blocks, decode(blocks, weights, move), strict=True) if label)


def extract(
    pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text", **training
) -> DataFrame:
    """``keep`` columns of every row, ``text_col`` and ``n_chars``, its code points.

    A null or empty page, or one without main text, has an empty text. Pages of any
    length are read whole. Repeated rows are read alike. Other columns are left
    out. An empty table gives an empty result.
    """
    weights, move = train(**training)
    picked = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights, move) for h in batch.column(len(keep)).to_pylist()]
            arrays = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, text_col, "n_chars"])

    fields = "".join(f"`{c}` {picked.schema[c].dataType.simpleString()}, " for c in keep)
    return picked.mapInArrow(run, f"{fields}{text_col} string, n_chars long")
