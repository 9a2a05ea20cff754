"""HTML extraction: held-out layouts, Viterbi against brute force, odd pages."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest

from ledgerloom.llm import html_extract
from ledgerloom.llm.html_blocks import blocks_of


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_held_out_layouts(model):
    right = total = 0
    for blocks, labels in html_extract.labelled_pages(150, seed=1234):
        right += int((np.array(html_extract.decode(blocks, *model)) == labels).sum())
        total += len(labels)
    assert total > 3000 and right / total > 0.985


def test_viterbi_equals_brute_force(model):
    weights, move = model
    for blocks, _ in html_extract.labelled_pages(12, seed=77):
        blocks = blocks[:9]
        emit = [sum(weights.get(f, 0.0) for f in own) for own in html_extract.features(blocks)]

        def score(labels, emit=emit):
            return sum(e for e, y in zip(emit, labels, strict=True) if y) + sum(move[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert score(tuple(html_extract.decode(blocks, *model))) == pytest.approx(score(best))


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p><p>no script</p>";</script></head><body>
<header class="site-header"><h2>Site name</h2><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav></header>
<div class="cookie-notice"><p>We keep cookies here and there.</p></div><!-- <p>no remark</p> -->
<div class="ad">Buy this now, it is cheap and good.</div>
<article><h1>A  &amp;   B</h1><p>First <b>bold</b> and <a href="#">linked</a> words,<br>with a break &eacute;&#233;.<p>Second one; never closed
<form action="/s"><label>Mail</label><input><button>Send</button></form><p>Third.</p><ul><li>point one here</li><li>point two here</li></ul></article>
<aside><h3>Related</h3><p>Other stories of today.</p></aside>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all.</p></div></section>
<footer>&copy; somebody</footer></body></html>"""


def test_parts_of_a_page(model):
    got = html_extract.main_text(PAGE, *model)
    assert got == "A & B\n\nFirst bold and linked words, with a break éé.\n\nSecond one; never closed\n\nThird.\n\npoint one here\n\npoint two here"


def test_pages_of_the_table_give_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    weights, move = html_extract.train()
    for r in rows:
        inside = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert html_extract.main_text(r["html"], weights, move) == "\n\n".join(b.text for b in blocks_of(inside))


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    odd = [None, "", "   ", "plain words", "<p", "<", "a < b <3", "<script>never closed", "<!-- never closed", '<p class="x', "</p></div></x>", deep,
           "<p>" + "long words " * 200_000 + "</p>", "<<<p>>>", "<p a='\">x</p>"]
    frame = spark.createDataFrame([(i, f"u{i}", h, "clash", 1) for i, h in enumerate(odd)] + [(None, None, None, None, None), (3, "u3", "plain words", "clash", 1)],
                                  "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(odd) + 2 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] == "" for r in rows if r["page_id"] in (None, 0, 1, 2))
    assert html_extract.extract(frame.limit(0)).count() == 0
    assert [b.text for b in blocks_of("a < b <3")] == ["a < b <3"]


@pytest.mark.parametrize("tag", ["svg", "iframe", "math", "canvas", "audio", "video", "template", "object", "noscript"])
def test_text_of_other_elements_stays(model, tag):
    told = "Here the story goes on with some more words."
    for inner in (f"<{tag}><path>", f"<{tag}><path></path></{tag}>"):
        page = f"<body><article><p>{told}</p>{inner}<p>{told} Two.</p></article></body>"
        assert html_extract.main_text(page, *model) == f"{told}\n\n{told} Two."
    assert [b.text for b in blocks_of(f"<p>a</p><{tag}>b</{tag}><p>c</p>")] == ["a", "b", "c"]


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title", "head"])
def test_a_raw_element_that_is_never_closed_loses_its_tag_only(tag):
    assert [b.text for b in blocks_of(f"<p>a</p><{tag}><p>b</p>" + f"<{tag}>" * 20_000)] == ["a", "b"]
    assert [b.text for b in blocks_of(f"<p>a</p><{tag}>x</{tag}><p>b</p>")] == ["a", "b"]


@pytest.mark.parametrize("nest", ["<div class='a{i}'>{i}", "<b>{i}<div>", "<li>{i}</x>", "<p>{i}</p><section id=s{i}>"])
def test_depth_costs_no_more_than_length(nest, model):
    page = "".join(nest.format(i=i) for i in range(20_000))
    began = time.process_time()
    html_extract.main_text(page, *model)
    assert time.process_time() - began < 10
